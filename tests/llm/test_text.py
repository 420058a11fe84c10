"""Token counts, packing, mixing and residue detection."""

import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import markup, mixing, packing, residue, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
def test_token_counts_of_awkward_texts(spark):
    texts = ["", None, "a", " ", "<|endoftext|>", "é\u2028x\r\n", "word " * 50_000, "\U0001f600" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_tokens_", F.lit(1))
    got = dict(tokens.token_counts(df, ["doc_id"]).collect())
    enc = tokens.encoder(open(tokens.VOCABULARY, "rb").read())
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


# --- packing ---
def naive_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                break
        else:
            i = len(room)
            room.append(capacity)
        room[i] -= s
        out.append(i)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_tournament_tree_is_first_fit(xs):
    xs = sorted(xs, reverse=True)
    assert packing.first_fit_decreasing(np.array(xs, np.int64), 50).tolist() == naive_first_fit(xs, 50)


def test_packing_places_every_token_once(spark):
    rng = random.Random(1)
    sizes = [(i, rng.choice([1, 7, 100, 512, 513, 1500, 5000])) for i in range(600)] + [(1000, 0), (1001, None), (None, 5)]
    kinds = spark.createDataFrame([("short", 512), ("long", 2048), ("bad", 0), ("none", None)], "pack_name string, capacity_tokens int")
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens int").withColumn("piece", F.lit(1))
    placed = packing.pack(df, kinds, group_items=150).toPandas()
    want = {i: n for i, n in sizes if i is not None and n}
    for (_, cap), p in placed.groupby(["pack_name", "capacity_tokens"]):
        assert (p.groupby("bin_id")["n_tokens"].sum() <= cap).all()
        assert p.groupby("doc_id")["n_tokens"].sum().to_dict() == want
        for doc, q in p.groupby("doc_id"):
            q = q.sort_values("piece")
            assert (len(q) == 1) == (want[doc] <= cap) and q["start_token"].tolist() == np.append(0, q["n_tokens"].cumsum()[:-1]).tolist()
    assert set(placed["pack_name"]) == {"short", "long"}
    fill = packing.fill(packing.pack(df, kinds, group_items=150)).collect()
    assert all(r["fill"] > 0.9 and r["n_bins"] >= r["fewest_bins"] for r in fill)
    assert packing.pack(df.limit(0), kinds).count() == 0 and packing.pack(df, kinds.limit(0)).count() == 0


# --- mixing ---
def test_shortage_goes_to_siblings_before_ancestors():
    leaf = lambda n, w, c: mixing.Node(n, w, c)
    a, b, c = leaf("a", 0.25, 10), leaf("b", 0.25, 1000), leaf("c", 0.5, 1000)
    root = mixing.Node("all", children=[mixing.Node("x", children=[a, b]), mixing.Node("y", children=[c])]).settle()
    root.allocate(100)
    assert (a.budget, b.budget, c.budget) == (10, 40, 50)
    b.capacity = 20
    root.settle().allocate(100)
    assert (a.budget, b.budget, c.budget) == (10, 20, 70)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10), st.integers(0, 500)), min_size=1, max_size=6), st.integers(0, 1500))
def test_allocation_uses_all_that_fits(leaves, total):
    nodes = [mixing.Node(str(i), float(w), float(c)) for i, (w, c) in enumerate(leaves)]
    root = mixing.Node("all", children=[mixing.Node("x", children=nodes[:3]), mixing.Node("y", children=nodes[3:])] if nodes[3:] else nodes).settle()
    root.allocate(total)
    assert all(n.budget <= n.capacity + 1e-6 for n in nodes)
    assert sum(n.budget for n in nodes) == pytest.approx(min(total, sum(n.capacity for n in nodes)))


def test_packing_of_one_name_with_two_capacities(spark):
    kinds = spark.createDataFrame([("x", 1000), ("x", 400)], "pack_name string, capacity_tokens int")
    df = spark.createDataFrame([(i, 300) for i in range(20)], "doc_id bigint, n_tokens int")
    got = {r["capacity_tokens"]: r["n_bins"] for r in packing.fill(packing.pack(df, kinds)).collect()}
    assert got == {1000: 7, 400: 20}


TREE = {"big": "x", "small": "x", "absent": "x"}


def test_mix_reaches_shares_and_respects_repeats(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["big"] * 6 + ["small", "stray"]), rng.choice(["en", "ENG", "de", None]), rng.randint(5, 40)) for i in range(4000)]
    docs += [(9000, "big", "en", None), (None, "big", "en", 3), (9002, None, "en", 3)]
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.1, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, source string, lang string, n_tokens int").withColumn("tokens", F.lit("x")).withColumn("budget", F.lit(1))
    leaves = mixing.budgets(df, t, TREE)
    mix = mixing.select(df, leaves)
    got = {r["source"]: r for r in mixing.shares(mix, t.where("source is not null"), leaves).collect()}
    assert got["big"]["share"] == pytest.approx(5 / 9, abs=0.001) and got["small"]["share"] == pytest.approx(4 / 9, abs=0.001)
    assert got["small"]["budget_share"] == pytest.approx(4 / 9)
    assert got["absent"]["tokens"] == 0 and got["small"]["most_uses"] == 3 and got["big"]["most_uses"] == 1
    p = mix.toPandas()
    assert p["doc_id"].is_unique and set(p["source"]) == {"big", "small"}
    assert sorted(p["doc_id"]) == sorted(mixing.select(df, leaves).toPandas()["doc_id"])
    short = mixing.select(df, mixing.budgets(df, t, TREE, total_tokens=10**9)).toPandas()  # everything as often as it may be used
    assert (short[short["source"] == "big"]["n_uses"] == 1).all() and (short[short["source"] == "small"]["n_uses"] == 3).all()
    for none in (mixing.budgets(df.limit(0), t, TREE), mixing.budgets(df, t.limit(0), TREE)):
        assert mixing.select(df, none).count() == 0


def test_a_short_source_passes_its_rest_to_its_siblings(spark):
    docs = [(i, "small", "en", 10) for i in range(10)] + [(100 + i, "big", "en", 10) for i in range(1000)] + [(5000 + i, "far", "en", 10) for i in range(1000)]
    t = spark.createDataFrame([("big", 0.25, 1), ("small", 0.25, 2), ("far", 0.5, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, source string, lang string, n_tokens int")
    leaves = mixing.budgets(df, t, {"big": "x", "small": "x", "far": "y"}, 4000)
    got = {r["source"]: r["tokens"] for r in mixing.shares(mixing.select(df, leaves), t, leaves).collect()}
    assert got == {"small": 200, "big": 1800, "far": 2000}


DOMAIN = {"journal_dump": "p", "errata_feed": "p", "referee_reports": "p", "thesis_repo": "q"}


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from(["journal_dump", "errata_feed", "thesis_repo", "stray"]), st.sampled_from(["en", "de", "other"])), st.integers(1, 10_000), min_size=1), st.lists(st.integers(0, 3), min_size=5, max_size=5))
def test_default_total_is_the_largest_that_the_sources_allow(tokens, repeats):
    names = ["journal_dump", "errata_feed", "referee_reports", "thesis_repo", "stray"]  # the third is always empty
    targets = list(zip(names, [0.4, 0.1, 0.2, 0.2, 0.1], repeats, strict=True))

    def reached(total):
        root = mixing.build_tree(targets, tokens, DOMAIN)
        root.allocate(total)
        return {s: sum(leaf.budget for path, leaf in root.leaves() if path[-1] == s) for s in names}

    usable = {s for (s, _) in tokens if dict(zip(names, repeats, strict=True))[s]}
    best = mixing.feasible_total(targets, tokens, DOMAIN)
    if not usable:
        assert best == 0
        return
    share = reached(1.0)
    assert sum(share.values()) == pytest.approx(1)
    assert all(n == pytest.approx(share[s] * best) for s, n in reached(best).items())
    assert any(n < share[s] * best * 1.01 * (1 - 1e-6) for s, n in reached(best * 1.01).items())


def test_empty_source_next_to_a_tiny_language_leaf():
    targets = [("journal_dump", 0.6, 1), ("errata_feed", 0.3, 1), ("referee_reports", 0.1, 1)]
    tokens = {("journal_dump", "en"): 1000, ("journal_dump", "other"): 10, ("errata_feed", "en"): 504, ("errata_feed", "other"): 1}
    assert mixing.feasible_total(targets, tokens, DOMAIN) == pytest.approx(1515)
    root = mixing.build_tree(targets, tokens, DOMAIN)
    root.allocate(1515)
    assert {path[1:]: leaf.budget for path, leaf in root.leaves() if leaf.capacity} == pytest.approx({(lang, s): n for (s, lang), n in tokens.items()})


# --- residue ---
ARTICLE = r"""\documentclass{article}
\usepackage{lipsum}
\newcommand{\todo}[1]{\textcolor{red}{TBD: #1}}
\title{On the driven lattice}
\author{A.~Author}
\begin{document}
\begin{abstract}
We show that the field is bounded for $\|x\|_{2} < 0.5$ and ${\tau}_{{abc}}$.
\end{abstract}
\section{Method}
%s
\end{document}"""


@pytest.mark.parametrize(
    "body",
    [
        "% TODO: Your abstract goes here.\nThe rest is $x$.",
        "\\iffalse\nLorem ipsum dolor sit amet consectetur.\n\\fi\nThe rest is known.",
        "\\begin{verbatim}\n{{TITLE}} <author name>\n\\end{verbatim}",
        "Pages whose text was \\texttt{404 Not Found {x}} were labelled as failures.",
        "Readers saw 40 words of dummy Latin (``Lorem ipsum dolor sit amet.'') set in type.",
        "The companion page needs JavaScript.",
        "We call a record empty if it only says that scripts must be enabled; this removed 3\\% of the sample.",
        "\\input{missing/file}",
        "",
    ],
)
def test_what_is_quoted_commented_or_shown_is_no_residue(body):
    assert not any(map(residue.weak_label, markup.segments(ARTICLE % body)))


@pytest.mark.parametrize(
    "body",
    [
        "Your abstract goes here.", "\\lipsum[2-4]", "The fit took {{ n_samples }} runs.", "The fit took <n_samples> runs.", "Table~\\textless dataset\\textgreater shows it.", "Lorem ipsum dolor sit amet consectetur.", "asdf jkl; qwer asdf sdfg asdf jkl; qwer zxcv asdf",
        "Please enable scripts in your browser to read the full text.", "HTTP Status 503.", "! LaTeX Error: File `x.sty' not found.\nFatal error occurred, no output PDF file produced!", "Insérer le résumé ici.", "Diesen Absatz bitte ersetzen.", "Escriba aquí el texto.",
        "foo bar foo bar foo bar foo bar foo bar",
    ],
)
def test_what_is_set_in_place_of_content_is_residue(body):
    assert any(map(residue.weak_label, markup.segments(ARTICLE % body)))


@pytest.mark.parametrize("body", ["Log in to read the full text.", "Sign in to continue.", "N/A", "UnicodeTranslateError: 3"])
def test_phrases_behind_the_trigger_words_are_residue(body):
    assert any(map(residue.weak_label, markup.segments(ARTICLE % body)))


def test_words_of_other_scripts_are_words():
    assert residue.words_of("Поле ограничено, πεδίο žluťoučký 12") == ["поле", "ограничено", "πεδίο", "žluťoučký", "0"]


def sampled(tree, rng):
    """A text of a parsed pattern: of each branch one, of each repetition the least or one more."""
    out = ""
    for op, a in tree:
        match str(op):
            case "LITERAL":
                out += chr(a)
            case "IN":
                kind, c = rng.choice(a)
                plain = {"LITERAL": lambda c: chr(c), "RANGE": lambda c: chr(c[0])}.get(str(kind))
                out += plain(c) if plain else {"CATEGORY_SPACE": " ", "CATEGORY_NOT_WORD": " ", "CATEGORY_NOT_DIGIT": " ", "CATEGORY_DIGIT": "4"}.get(str(c), "q")
            case "BRANCH":
                out += sampled(rng.choice(a[1]), rng)
            case "SUBPATTERN":
                out += sampled(a[3], rng)
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += "".join(sampled(a[2], rng) for _ in range(rng.choice([a[0], min(a[1], a[0] + 1)])))
            case "ANY" | "NOT_LITERAL":
                out += "q"
    return out


def test_each_alternative_of_the_phrases_has_a_trigger():
    rng, tree = random.Random(1), re._parser.parse(residue.PHRASES.pattern, residue.PHRASES.flags)
    texts = [x for x in (sampled(tree, rng) for _ in range(30_000)) if residue.PHRASES.search(x)]
    assert len(texts) > 20_000 and [x for x in texts if not residue.triggered(x, residue.words_of(x))] == []


def test_macros_that_set_filler_count_when_used():
    body = "\\newcommand{\\body}{\\lipsum[1]}\nText."
    assert not any(map(residue.weak_label, markup.segments(ARTICLE % body)))
    assert any(map(residue.weak_label, markup.segments(ARTICLE % (body + " \\body"))))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=r"\{}%$`'\"<>abé .\n", max_size=80))
def test_any_markup_is_read_without_error(s):
    markup.segments(s)
    markup.segments("\\begin{document}" + s)


def corpus():
    rng = random.Random(3)
    words = "field lattice bound kernel shows the of for sample fit mean".split()
    bad = ["Your abstract goes here.", "Please enable JavaScript to read the full text.", "HTTP Status 404.", "Lorem ipsum dolor sit amet consectetur adipiscing."]
    out = []
    for i in range(400):
        body = " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(8))
        out.append((i, ARTICLE % (rng.choice(bad) if i % 10 == 0 else body), f"J{i % 23}", "s"))
    return [*out, (1000, None, None, None), (1001, "", "J", "s"), (1002, " ".join(f"The field {i} is bounded by the lattice." for i in range(5000)), "J", "s")]


def test_residue_is_found_and_validated_on_unseen_hosts(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, journal string, source string").withColumn("score", F.lit(1))
    got = {r["doc_id"] for r in residue.scored(df).where("residue").collect()}
    assert got == set(range(0, 400, 10))
    left = residue.without_residue(df)
    assert left.count() == 403 - 40 and "score" in left.columns
    v = {(r["labelled"], r["predicted"]): r["n_docs"] for r in residue.validation(df).collect()}
    assert v[True, True] >= 0.9 * sum(n for (a, _), n in v.items() if a) and v.get((False, True), 0) <= 2
    assert residue.scored(df.limit(0)).count() == 0


def test_a_quotation_ends_with_its_paragraph():
    cut = markup.segments(ARTICLE % "An open ``quote is never closed.\n\nLorem ipsum dolor sit amet consectetur adipiscing.\n\nMore text''.")
    assert any(map(residue.weak_label, cut))
    kept = markup.segments(ARTICLE % "They write ``Lorem ipsum dolor\nsit amet consectetur adipiscing.'' and it's so.")
    assert not any(map(residue.weak_label, kept))


def test_a_lone_tag_in_an_article_is_text_and_markup_is_not():
    assert any("<title>" in x for x in markup.segments(ARTICLE % "The value of <title> exceeded it."))
    assert markup.segments("<html><body><pre>Some text.</pre><hr></body></html>") == ["Some text."]


@pytest.mark.parametrize("mark", ["{{ %s }}", "[[%s]]", "<<%s>>", "<%s>", "‹%s›", "${%s}", "@@%s@@", "\\textless{}%s\\textgreater{}", "%%%%%s%%%%"])
def test_ways_of_marking_have_features_of_their_own(mark):
    box = lambda s: {x for x in residue._shapes(s) if x.startswith("#box")}
    assert box("The run took " + mark % "n_samples" + " steps.") and box(mark % "paper title")
    assert not box(r"We use $x_{i} < y$ in \emph{this} \cite{a}.")


def test_judging_looks_for_no_phrase(monkeypatch):
    for name in ("weak_label", "PHRASES", "PLACEHOLDER", "FILLER_COMMAND", "DISCUSSED", "LATIN", "TRIGGERS"):
        monkeypatch.setattr(residue, name, None)
    assert residue.best_score(ARTICLE % "Your abstract goes here. {{x_y}}", np.zeros(1 << residue.BITS, np.float32), 1.0)[0] == 1.0


def test_threshold_lies_between_the_kinds():
    s, y = np.array([-3.0, -1.0, 2.0, 5.0]), np.array([False, False, True, True])
    assert residue.threshold(s, y) == 0.5
    assert residue.threshold(s, np.array([False, True, False, True])) == -2.0
    assert residue.threshold(s, np.zeros(4, bool)) == 0.0


# labelled by hand; sentences of no corpus, and none of the phrases of the weak labels is copied
RESIDUE = [
    "Please insert your conclusions here.", "The acknowledgements text goes here.", "Sample size was {{sample_size}} patients.", "We thank <<funding agency>> for support.", "Contact: [[email address]].",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "\\lipsum[1-3]", "\\blindtext", "404 Not Found. The page could not be found on this server.", "503 Service Unavailable",
    "You do not have permission to access this article.", "Please enable JavaScript in your browser to view this article.", "This site requires cookies and JavaScript.", "Your session has expired. Please log in again.", "Conversion to HTML failed: undefined control sequence.",
    "asdf asdf jkl jkl asdf qwer asdf jkl qwer asdf", "Checking your browser before you continue.", "Replace this paragraph with your own text.", "TODO", "${project_name} is described in Section 2.",
]
CONTENT = [
    "The server returned an error in 4\\% of the requests, which we repeated.", "We compare scripts of two writers.", "The browser's cache has no effect on the timing.", "Each section of the rod was heated separately.", "Authors of both papers agree on this bound.",
    "The template matching step finds $x < y$ and $y > z$.", "Errors of this size are not found in the other sample.", "The service time is exponential, and the queue is stable.", "Let $f_{{ab}}$ be the field of the second kind.", "The access path to the cave is closed in winter.",
    "Sentences were written by the subjects and read aloud.", "Latin names are set in italics.", "The title of the manuscript is lost.", "Cookies were baked at 180 degrees for the tasting panel.", "Here the sum goes over all sites.",
    "The text of the treaty is missing two lines.", "A page of the codex was damaged by water.", "We enable the second channel after ten pulses.", "Requests arrive as a Poisson process with rate $\\lambda$.", "The author thanks the institution for its hospitality.",
]


BODY = ARTICLE.replace("A.~Author", "M.~Kelvar") % "The flow is bounded below 4\\,K. The second run of the pump gave the same slope.\n\n@\n\nWe repeat the fit for each crystal. All errors are statistical."


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/documents.parquet"), reason="no test data")
def test_hand_labelled_segments(spark):
    m = residue.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    w = np.frombuffer(m.w, np.float32)
    rest = set(markup.segments(BODY.replace("@", "")))

    def said(x):  # the sentence, among those of an article
        t = BODY.replace("@", x)
        return any(score >= m.least for s, score in zip(markup.segments(t), residue.best_score(t, w, m.bias)[1], strict=True) if s not in rest)

    found, wrong = [x for x in RESIDUE if said(x)], [x for x in CONTENT if said(x)]
    print(f"recall {len(found) / len(RESIDUE)}, precision {len(found) / (len(found) + len(wrong))}; missed {set(RESIDUE) - set(found)}; wrong {wrong}")
    assert len(found) >= 0.8 * len(RESIDUE) and len(wrong) <= 0.3 * len(CONTENT)  # content chosen for words that residue has
