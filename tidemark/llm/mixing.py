"""Mixing sources to target shares by hierarchical budgets.

Shares of sources become weights of the leaves of a tree domain - language - source. Budgets go down the tree by weight;
what a leaf cannot use goes to its siblings, and only what a whole subtree cannot use goes to its ancestors' other
children. A leaf's budget is taken in whole epochs over its documents and a token prefix of one more, in an order drawn
anew for each epoch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settled

# fixed values: spellings of languages
LANGUAGES = {"en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german"), "fr": ("fr", "fra", "fre", "french"), "es": ("es", "spa", "spanish")}
ORDER_BUCKETS = 4096


def language(c: Column) -> Column:
    """Language of a spelling; null and unknown ones are ``other``, so that a tree has few leaves."""
    low, out = F.lower(F.trim(c)), F.lit("other")
    for name, spellings in LANGUAGES.items():
        out = F.when(low.isin(*spellings), name).otherwise(out)
    return out


@dataclass
class Node:
    """A node of the budget tree; leaves have a weight and a capacity in tokens."""

    name: str
    weight: float = 0.0
    capacity: float = 0.0
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0

    def settle(self) -> Node:
        for c in self.children:
            c.settle()
        if self.children:
            self.weight, self.capacity = sum(c.weight for c in self.children), sum(c.capacity for c in self.children)
        return self

    def allocate(self, budget: float) -> None:
        """Shares ``budget`` (at most the capacity is used) among the children by weight; full children leave theirs to the others."""
        self.budget = min(budget, self.capacity)
        open_, left = [c for c in self.children if c.capacity > 0], self.budget
        given = dict.fromkeys(map(id, self.children), 0.0)
        while open_ and left > 1e-9:
            total = sum(c.weight for c in open_)
            part = {id(c): left * (c.weight / total if total else 1 / len(open_)) for c in open_}
            full = [c for c in open_ if given[id(c)] + part[id(c)] >= c.capacity]
            if not full:
                for c in open_:
                    given[id(c)] += part[id(c)]
                break
            for c in full:
                left -= c.capacity - given[id(c)]
                given[id(c)] = c.capacity
            open_ = [c for c in open_ if c not in full]
        for c in self.children:
            c.allocate(given[id(c)])

    def leaves(self, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Node]]:
        if not self.children:
            return [(path, self)] if path else []
        return [x for c in self.children for x in c.leaves((*path, c.name))]


Targets = list[tuple[str, float, int]]
Tree = dict[str, str]


def build_tree(targets: Targets, tokens: dict[tuple[str, str], int], tree: Tree) -> Node:
    """Tree of the target sources, their weights and capacities.

    ``tokens``: tokens by (source, language); ``tree``: domain of each source, ``other`` where it has none. A source's weight
    is spread over its languages as its tokens are; that of a source without usable documents, with no capacity, over the
    languages of its domain as their weights are, so that it leaves its share to its siblings evenly.
    """
    root = Node("all")
    nodes: dict[tuple[str, ...], Node] = {(): root}

    def at(path: tuple[str, ...]) -> Node:
        if path not in nodes:
            nodes[path] = Node(path[-1])
            at(path[:-1]).children.append(nodes[path])
        return nodes[path]

    spread: dict[str, dict[str, float]] = {}
    own: dict[str, dict[str, int]] = {}
    for source, share, repeats in sorted(targets):
        own[source] = {lang: n for (s, lang), n in sorted(tokens.items()) if s == source and n > 0 and repeats > 0}
        total = sum(own[source].values())
        for lang, n in own[source].items():
            here = spread.setdefault(tree.get(source, "other"), {})
            here[lang] = here.get(lang, 0.0) + share * n / total
    for source, share, repeats in sorted(targets):
        domain = tree.get(source, "other")
        parts = own[source] or spread.get(domain) or {"other": 1.0}
        total = sum(parts.values())
        for lang, n in parts.items():
            leaf = at((domain, lang, source))
            leaf.weight, leaf.capacity = share * (n / total), float(n * repeats) if own[source] else 0.0
    return root.settle()


def feasible_total(targets: Targets, tokens: dict[tuple[str, str], int], tree: Tree) -> float:
    """The largest total at which no source that has documents is short.

    Shares of sources without documents are redistributed by the tree first. They scale a domain evenly, so the leaves of
    a source are full at the same total, and its capacity over all languages decides.
    """
    root = build_tree(targets, tokens, tree)
    real: dict[str, float] = {}
    for path, leaf in root.leaves():
        real[path[-1]] = real.get(path[-1], 0.0) + leaf.capacity
        leaf.capacity = float("1e30") if leaf.capacity > 0 else 0.0
    root.settle().allocate(1.0)
    share = dict.fromkeys(real, 0.0)
    for path, leaf in root.leaves():
        share[path[-1]] += leaf.budget
    return min((real[s] / b for s, b in share.items() if b > 0), default=0.0)


BUDGETS = "source string, language string, weight double, tokens bigint, max_repeats int, budget double"


def _usable(sized: DataFrame) -> DataFrame:
    """Documents with an id and tokens, with their language."""
    some = sized.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull() & F.col("source").isNotNull())
    return some.select("doc_id", "source", language(F.col("lang")).alias("language"), "n_tokens")


def budgets(sized: DataFrame, targets: DataFrame, tree: Tree, total_tokens: float | None = None) -> DataFrame:
    """The leaves of the tree with their weights and budgets: source, language, weight, tokens, max_repeats, budget.

    ``targets``: source, target_share, max_repeats (null: once), a short table that is read to the driver with the leaves'
    totals (its sources times the few languages); shares need not sum to 1. ``tree``: the domain of each source.
    ``total_tokens``: the size aimed at, else the largest at which every source that has documents reaches its share. At a
    larger one short leaves pass their rest to their siblings, and full subtrees to those of their ancestors.
    """
    named = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0))
    each = named.groupBy("source").agg(F.max("target_share"), F.max(F.coalesce("max_repeats", F.lit(1)))).collect()
    share = sum(r[1] for r in each)
    wanted = [(r[0], float(r[1] / share), int(r[2])) for r in each]
    have = _usable(sized).join(named.select("source").distinct(), "source", "left_semi").groupBy("source", "language").agg(F.sum("n_tokens"))
    tokens = {(r[0], r[1]): int(r[2]) for r in have.collect()}
    root = build_tree(wanted, tokens, tree)
    root.allocate(feasible_total(wanted, tokens, tree) if total_tokens is None else total_tokens)
    repeats = {s: r for s, _, r in wanted}
    rows = [(p[-1], p[1], n.weight, tokens.get((p[-1], p[1]), 0), repeats[p[-1]], n.budget) for p, n in root.leaves()]
    return sized.sparkSession.createDataFrame(rows, BUDGETS)


def select(sized: DataFrame, leaves: DataFrame, seed: int = 11) -> DataFrame:
    """Documents of the mix and how often each is used: doc_id, source, language, n_tokens, n_uses.

    ``sized``: doc_id (unique), source, lang, n_tokens; it is read several times and should be settled. ``leaves``: of
    ``budgets``. A leaf's budget is taken in whole epochs over its documents and, of one more epoch in an order drawn anew,
    the longest prefix that fits; what the leaves of a source have left together goes to the document of one of them whose
    size is nearest to it. Documents of other sources, and those without tokens or id, are not used. Running
    totals are formed in buckets of the drawn order, so a source that holds a large part of all rows is spread over many
    tasks.
    """
    whole = F.least(F.floor(F.col("budget") / F.col("tokens")), F.col("max_repeats").cast("bigint")).cast("int")
    open_ = leaves.where(F.col("tokens") > 0).select("source", "language", "budget", "tokens", "max_repeats", whole.alias("_whole"))
    rest = F.when(F.col("_whole") < F.col("max_repeats"), F.col("budget") - F.col("_whole") * F.col("tokens")).otherwise(F.lit(0.0))
    drawn = _usable(sized).join(open_.select("source", "language", "_whole", "max_repeats", rest.alias("_rest")), ["source", "language"])
    drawn = drawn.withColumn("_h", F.xxhash64("doc_id", F.lit(seed), "_whole"))
    drawn = drawn.withColumn("_b", F.shiftrightunsigned("_h", 64 - ORDER_BUCKETS.bit_length() + 1).cast("int"))
    wb = Window.partitionBy("source", "language").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = drawn.groupBy("source", "language", "_b").agg(F.sum("n_tokens").alias("_n"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_n").over(wb), F.lit(0))).drop("_n")
    w = Window.partitionBy("source", "language", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = drawn.join(offsets, ["source", "language", "_b"]).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(w))
    again = F.col("_whole") < F.col("max_repeats")
    placed = settled(placed.select("doc_id", "source", "language", "n_tokens", "_whole", "_rest", "_upto", again.alias("_again")))
    fits = F.col("_again") & (F.col("_upto") <= F.col("_rest"))
    ends = placed.groupBy("source", "language").agg((F.max("_rest") - F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.lit(0))).alias("left"))
    left = ends.groupBy("source").agg(F.sum("left").alias("_left")).where(F.col("_left") > 0)
    free = placed.where(F.col("_again") & ~fits).join(left, "source")
    nearest = free.groupBy("source").agg(F.min(F.struct(F.abs(F.col("n_tokens") - F.col("_left")).alias("off"), "doc_id", "n_tokens", "_left")).alias("x"))
    extra = nearest.where(F.col("x.n_tokens") < 2 * F.col("x._left")).select(F.col("x.doc_id").alias("doc_id"), F.lit(True).alias("_more"))
    uses = F.col("_whole") + F.when(fits | F.coalesce("_more", F.lit(False)), 1).otherwise(0)
    used = placed.join(extra, "doc_id", "left").withColumn("n_uses", uses).where(F.col("n_uses") > 0)
    return used.select("doc_id", "source", "language", "n_tokens", "n_uses")


def shares(mix: DataFrame, targets: DataFrame, leaves: DataFrame) -> DataFrame:
    """Per source what was aimed at and what was reached.

    Columns: source, target_share, max_repeats, budget_share (the target after redistribution), share (reached), tokens,
    n_docs, most_uses.
    """
    size = F.col("n_tokens").cast("bigint") * F.col("n_uses")
    per = mix.groupBy("source").agg(F.sum(size).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("n_uses").alias("most_uses"))
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    b = leaves.groupBy("source").agg(F.sum("budget").alias("budget"))
    whole = Window.partitionBy(F.lit(0))  # a row per source
    part = lambda c: F.when(F.sum(c).over(whole) > 0, F.col(c) / F.sum(c).over(whole)).otherwise(F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = t.join(per, "source", "full").join(b, "source", "left").select("source", "target_share", "max_repeats", zero("tokens"), zero("n_docs"), zero("most_uses"), zero("budget"))
    return out.withColumns({"budget_share": part("budget"), "share": part("tokens")}).drop("budget")
