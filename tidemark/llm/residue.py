"""Template residue, filler, error pages and script notices in place of content.

A regularised linear classifier over hashed word n-grams, length and title features, and the ways in which names stand
between punctuation, scores every segment that is set. It is trained on weak labels: phrases, marks and response statuses
say what a segment of the sample is. The score alone decides, from a threshold on that is chosen on hosts which training
has not seen; no phrase is looked for when records are judged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.markup import segments
from tidemark.llm.tokens import spread, text_batches
from tidemark.session import settled

BITS = 18
#: Expected number of documents of the sample; bounds the one task that trains.
SAMPLE_DOCS = 8000
EPOCHS, RATE, DECAY = 25, 0.5, 1e-6
#: Differences of F1 that do not decide between thresholds.
NEARLY = 0.01
#: Hosts (journals, else sources) of this share are kept from training: the threshold is chosen on those in the sample.
UNSEEN = 0.2

_NAME = r"[A-Za-z][A-Za-z0-9_. -]{1,30}"
# fixed values: ways in which templates mark what is to be filled in
PLACEHOLDER = re.compile(
    rf"""\[\[\s*{_NAME}\s*\]\] | \[\s*(?:insert|your|enter|add|put|type)\s+{_NAME}\] | (?<![_^}}A-Za-z])\{{\{{\s*[A-Za-z][A-Za-z0-9_. -]{{2,30}}\s*\}}\}} | (?<!\$)\$\{{\s*[A-Za-z][A-Za-z0-9_. -]{{2,30}}\}}
    | <<\s*{_NAME}\s*>> | ‹\s*{_NAME}\s*› | <(?!/)[A-Za-z][A-Za-z0-9_. -]{{2,30}}> | \\textless\s*\{{?\}}?\s*{_NAME}\s*\\textgreater | \\(?:langle|textlangle)\s*\\mathit\{{{_NAME}\}}\\rangle(?=\s*\$?\s*$)
    | @@\s*{_NAME}\s*@@ | (?<![A-Za-z0-9])__{_NAME}__(?![A-Za-z0-9]) | ::\s*{_NAME}\s*:: | \#\{{\s*{_NAME}\}} | \?[A-Za-z][A-Za-z0-9_. -]{{2,30}}\?(?![A-Za-z])
    | \\?\$[A-Z][A-Z0-9_]{{2,30}}_HERE\\?\$ | \\?%\\?%\s*{_NAME}\s*\\?%\\?% | (?<![A-Za-z\\])[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)*_HERE\b""",
    re.X | re.I,
)
# fixed values: commands that typeset filler
FILLER_COMMAND = re.compile(r"\\(?:lipsum|kant|blindtext|Blindtext|blinddocument|Blinddocument|blindmathpaper|blinditemize|blindlist|blindenumerate|blinddescription|Blindlist|textblind|filltext)(?![A-Za-z])")
# fixed values: phrases of the weak labels, in several languages
PHRASES = re.compile(
    r"""\b(?:your|the|a|an)?\s*[\w-]+(?:\s[\w-]+)?\s(?:goes|comes|go|come)\s(?:here|in\sthis\splace)\b
    | \b(?:insert|add|enter|put|type|write|place|paste|provide)\s(?:your|the|any|some|an?)\s[\w\s-]{2,40}\shere\b
    | \b(?:section|paragraph|chapter|abstract)\stext\s(?:is\s)?(?:pending|missing|needed|required|to\sfollow)\b | ^\W*(?:TBD|TBA|TODO|FIXME|XXX|N/A|tbc)\b(?:\W*$|\s(?:by|later|soon|before|until|when|:))
    | \bto\sbe\s(?:supplied|written|filled\sin|completed|added|announced|determined|provided|inserted)\b(?:\sby\s\w+\s\w+|\slater)?\.?$
    | \b(?:overwrite|replace|delete|fill\sin)\sthis\s(?:paragraph|text|section|sentence|abstract|note|line)\b
    | \b(?:please|authors\s(?:should|must|may))\s(?:\w+\s)?(?:state|describe|summari[sz]e|explain|list|give|provide|outline|report|insert|add|write|mention|discuss)\b[^.]*\b(?:here|in\sthis\ssection|in\sthis\splace|before\ssubmission|delete\sthis\snote)\b
    | ^\W*(?:\\author|\\centerline)?\W*(?:first|second|third)\sauthor\b | \bauthor\sname\b | \btitle\sof\s(?:the|your)\s(?:paper|article)\s*\}?$
    | \b(?:dummy|filler|placeholder|blind)\s(?:text|copy|words?|sentence|paragraph)\b
    | \b(?:paragraph|sentence|text|line|passage)\s(?:only|merely|just|simply)\s(?:shows|demonstrates|illustrates|serves)\b
    | \b(?:nothing|no\sword)\shere\s(?:is\smeant|has\sa\smeaning|means)
    | \b(?:lorem\s+ipsum|dolor\s+sit\s+amet|consectetu?e?r\s+adipisc)
    | \b(?:ins[ée]rer|ajouter|saisir|écrire|mettre|placer|[ée]crivez|ins[ée]rez|ajoutez|saisissez)\b[^.]{2,60}\bici\b | \b(?:paragraphe|texte|section|résumé)\sà\s(?:remplacer|compl[ée]ter|écrire|rédiger|venir|fournir)\b | \b(?:texte\sde\sremplissage|faux\stexte|texte\sfactice)\b | \bremplac(?:er|ez)\sce\s(?:paragraphe|texte)
    | \b(?:ponga|escriba|inserte|añada|agregue|introduzca|incluya|coloque)\saqu[íi]\b | \baqu[íi]\sva\s | \b(?:párrafo|texto|sección|resumen)\spor\s(?:escribir|completar|redactar|rellenar)\b | \btexto\s(?:de\srelleno|simulado|ficticio|de\sprueba)\b | \b(?:sustituya|reemplace|sobrescriba)\seste\s
    | \b(?:hier|an\sdieser\sstelle)\b[^.]{2,60}\b(?:einfügen|eintragen|eingeben|ergänzen|einsetzen|schreiben|angeben)\b | \bdiesen\s(?:absatz|text|abschnitt)\b[^.]{0,20}\b(?:überschreiben|ersetzen|löschen|ergänzen|ausfüllen)\b | \b(?:blindtext|platzhaltertext|fülltext|platzhalter)\b | \b(?:text|abschnitt|absatz|titel)\s(?:folgt|fehlt\snoch|noch\szu\sschreiben)\b

    | \bHTTP\s(?:status|error)\b\D{0,5}\d{3} | \b[45]\d\d\s(?:bad\srequest|unauthorized|payment\srequired|forbidden|not\sfound|method\snot\sallowed|request\stimeout|gone|too\smany\srequests|internal\sserver\serror|bad\sgateway|service\s(?:temporarily\s)?unavailable|gateway\stime-?out) | \berror\s(?:code\s)?[45]\d\d\b | ^\W*(?:error|fehler|erreur)\W*[45]\d\d
    | "?(?:error|fault|status)"?\s*:\s*\{ | \{\s*"?code"?\s*: | \bquota\sexceeded\b | \bbackend\stimeout\b
    | \b(?:was|were|is|be)\snot\sfound\son\sthis\sserver\b | \bcould\snot\sfind\sth(?:at|is)\s(?:paper|page|article|item|document)\b | \bupstream\sserver\b | \bdid\snot\sanswer\sin\stime\b
    | \b(?:page|item|article|resource|document|content|record)\s(?:is\s(?:not|currently\snot|no\slonger)\savailable|has\sbeen\sremoved|does\snot\sexist|no\slonger\sexists|cannot\sbe\s(?:displayed|shown|found)) | \btemporarily\sunavailable\b | ^\W*(?:bad\sgateway|not\savailable|page\snot\sfound|problem\sloading\spage|not\sfound|forbidden|service\sunavailable|access\sdenied|internal\sserver\serror|gateway\stime-?out)\b
    | \byou\sdo\snot\shave\s(?:permission|access)\b | \baccess\s(?:to\sth\w+\s\w+\s)?(?:is|was)?\s?denied\b\W*(?:$|-) | \b(?:login|subscription|sign-?in|registration|authentication)\s(?:is\s)?(?:required|needed)\b | \b(?:sign|log)\sin\sto\s(?:download|read|view|access|continue)\b | \binstitution\sdoes\snot\ssubscribe\b | \btoo\smany\s(?:downloads|requests)\b | ^\W*your\ssession\shas\s(?:expired|timed) | \bsession\shas\sexpired\b\W*$ | \bsomething\swent\swrong\b | \bwe\sare\ssorry,\sbut\b | \bcontact\sthe\shelp\s?desk\b | \breturn\sto\sthe\ssearch\spage\b
    | \bconversion\s(?:to\s\w+\s)?(?:failed|stopped|aborted|error)\b | \bfull\stext\scould\snot\sbe\s | \b(?:document|file|request)\sprocessing\s(?:error|failed)\b | \bno\ssource\sfiles\sin\sthe\spackage\b | \barchive\sis\sdamaged\b | \bunhandled\sexception\b | \btraceback\s(?:in|while|\(most)\b | \b(?:key|timeout|value|type|runtime|memory|unicode\w+)error\b | \blatex\serror\b | \bundefined\scontrol\ssequence\b | \bfatal\serror\soccurred\b | \bemergency\sstop\b | \brunaway\sargument\b | \bno\s(?:pages\sof\soutput|output\spdf)\b | \bmissing\s\\?\$\sinserted\b
    | \b(?:document|article|page|texte)\s(?:est\sintrouvable|n.existe\splus|n.est\s(?:pas|plus)\sdisponible) | \bréessayez\splus\stard\b | \baccès\s(?:refusé|interdit) | \berreur\s(?:interne|du\sserveur)\b | \bsession\sa\sexpiré\b | \b(?:documento|artículo|página)\s(?:no\s(?:existe|está\sdisponible|se\sencuentra)|ya\sno\sexiste)\b | \bno\sse\s(?:encontró|ha\sencontrado|pudo)\s\w+ | \bvuelva\sa\sintentarlo\b | \bacceso\sdenegado\b | \b(?:seite|dokument|artikel)\s(?:wurde\snicht\sgefunden|ist\snicht\s(?:mehr\s)?(?:verfügbar|vorhanden)|existiert\snicht) | \bversuchen\ssie\ses\sspäter\b | \bzugriff\sverweigert\b

    | \b(?:enable|allow|turn\son|activate|switch\s(?:\w+\s)?on|permit)\b[^.]{0,30}\b(?:javascript|scripts?|scripting|js|cookies)\b | \b(?:javascript|scripts?|scripting|js|cookies)\s(?:and\s\w+\s)?(?:is|are|must\sbe|has\sto\sbe|to\sbe)\s(?:currently\s)?(?:disabled|blocked|turned\soff|required|needed|enabled|off|permitted|not\s\w+)\b | \bswitch\sscripts\son\b
    | \b(?:(?:this|our)\s(?:\w+\s){0,3}|the\s(?:online\s|full[\s-]text\s|web\s)?)(?:page|site|viewer|reader|display|app|article|service|platform|portal)\s(?:requires?|needs?|uses|does\snot\swork\swithout|only\sworks\swith)\s(?:\w+\s(?:and|or)\s)?(?:javascript|scripts?|scripting|js|cookies)\b
    | \byour\sbrowser\s(?:may\sbe\sblocking|does\snot\ssupport|has\sdisabled|blocks|is\snot\ssupported|has\s\w+\sdisabled) | \bchecking\s(?:if\s)?(?:your|the)\sbrowser\b | \bverifying\s(?:that\s)?you\sare\s(?:a\s)?human\b | \breload\safter\schanging\syour\ssettings\b | \bif\snothing\shappens,\scheck\b | \b(?:loading|rendering)\s(?:\w+\s?)?(?:\\l?dots|\.\.\.|…) | \bdo\snot\sclose\sthis\swindow\b
    | \b(?:activer|activez|autoriser|autorisez)\b[^.]{0,30}\b(?:javascript|scripts|cookies)\b | \bnécessite\s(?:javascript|les\sscripts|les\scookies)\b | \b(?:active|habilite|permita|active\w*)\s(?:javascript|los\sscripts|las\scookies)\b | \bnecesita\s(?:javascript|los\sscripts|las\scookies)\b | \b(?:javascript|skripte|cookies)\b[^.]{0,40}\b(?:aktivieren|einschalten|erlauben|zulassen|benötigt|erforderlich)\b | \b(?:aktivieren|erlauben)\ssie\b[^.]{0,30}\b(?:javascript|skripte|cookies)\b | \b(?:benötigt|braucht|erfordert)\s(?:javascript|skripte|cookies)\b""",
    re.X | re.I,
)
# fixed values: how a text speaks about such records; only for the labels
DISCUSSED = re.compile(
    r"""\b(?:labelled|labeled|classified|counted|discarded|marked|annotated|flagged|skipped|removed|excluded)\s(?:as|pages|records|by|when|if|because)\b
    | \bannotators\b | \bcrawl(?:ed)?\b | \bwe\s(?:call|exclude|define|removed?|skip)\b | \bsuch\s(?:records|pages|texts)\b | \bof\sthe\ssample\b | \bpattern\ssuch\sas\b""",
    re.X | re.I,
)
LATIN = frozenset(
    # fixed values: words of the customary filler
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua
    enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse
    cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit laborum vestibulum curabitur pellentesque
    mauris fringilla integer vitae turpis eget porta egestas nibh felis arcu cras semper justo lectus blandit ornare sodales rutrum litora torquent
    congue ultrices urna sapien auctor tempus placerat quisque venenatis aliquam nullam phasellus""".split()
)
TRIGGERS = frozenset(
    # fixed values: words of which each phrase holds one
    """
    acceso access accès added allowed angeben announced answer aqui aquí authentication author authors available backend blind blindtext browser cannot code come comes
    completar completed completer compléter consecteter consectetr consectetuer consectetur conversion cookies could damaged delete denied determined diesen disponible dolor
    downloads dummy einfügen eingeben einsetzen eintragen emergency encontrado encontró encuentra ergänzen erreur error escribir exist existe existiert exists fatal fault
    fehler fehlt fill filled filler find fixme folgt forbidden found fournir fülltext gateway gefunden go goes gone happens help helpdesk here http human ici inserted
    institution introuvable javascript js keyerror latex line loading log login lorem many memoryerror noch nothing output overwrite package pages paragraph passage payment
    permission placeholder platzhalter platzhaltertext please problem processing provided pudo quota redactar reemplace registration rellenar reload removed remplacer
    remplacez rendering replace request requests return runaway runtimeerror rédiger réessayez schreiben script scripting scripts sentence server service session sign signin
    skripte sobrescriba sorry status subscription supplied sustituya tba tbc tbd text texte texto timeout timeouterror title todo traceback typeerror unauthorized
    unavailable undefined unhandled unicodedecodeerror unicodeencodeerror upstream valueerror venir verfügbar versuchen vorhanden vuelva window word written wrong xxx
    zugriff écrire
    """.split()
)
#: Phrases that no single word gives away.
_ODD = re.compile(r"n/a\b|unicode\w+error|n.existe\splus", re.I)
_WORD = re.compile(r"\\[A-Za-z]+|[^\W\d_]{2,}|\d+|\.\.\.")
_FIELD = re.compile(r"\\(title|author|affiliation|section|subsection|centerline|beginsection)\b|\\bf\b")
# a name between two runs of punctuation, however a template may mark it; brackets written as commands are read as such
_AS_BRACKET = {
    r"\textless": "<", r"\textgreater": ">", r"\textlangle": "<", r"\textrangle": ">", r"\langle": "<", r"\rangle": ">", r"\mathit": "", r"\%": "%",
    r"\$": "$", r"\_": "_", r"\#": "#",
}
_COMMAND = re.compile(r"\\(?:text|)(?:less|greater|[lr]angle)(?:\{\}| )?|\\mathit|\\[%$_#]")
_BOX = re.compile(r"(?:^|([^<>{}\[\]@_:%?#$‹›|~\s])|\s)([<>{}\[\]@_:%?#$‹›|~]{1,3})\s?([A-Za-z][A-Za-z0-9_. -]{1,31}?)\s?([<>{}\[\]@_:%?#$‹›|~]{1,3})")
_CAPITALS = re.compile(r"(?<![A-Za-z\\])[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+(?![A-Za-z])")
_VOWELS = frozenset("aeiouyäöüáéíóúàèêâ")


def _plain(words: list[str]) -> list[str]:
    return [w for w in words if w[0].isalpha()]


def repeated(words: list[str]) -> bool:
    """Words over and over, or keys struck at random: many words, few different ones, hardly any vowels."""
    plain = _plain(words)
    if len(plain) < 8:
        return False
    kinds = len(set(plain))
    return kinds <= 2 or (kinds / len(plain) < 0.75 and kinds <= 14 and sum(_struck(w) for w in plain) / len(plain) > 0.5)


def _struck(w: str) -> bool:
    """Not a word that can be spoken: no vowel, or neighbours of one row of the keyboard."""
    return _VOWELS.isdisjoint(w) or any(w[:4] in row for row in ("qwertyuiop", "asdfghjkl", "zxcvbnm"))


def latin(words: list[str]) -> bool:
    """Mostly words of the customary filler."""
    plain = _plain(words)
    return len(plain) >= 4 and sum(w in LATIN for w in plain) >= max(3, 0.4 * len(plain))


def words_of(segment: str) -> list[str]:
    """Commands, words of two letters or more, numbers as ``0``; all in lower case."""
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(segment.lower())]


def triggered(segment: str, words: list[str]) -> bool:
    """Whether a segment can hold a phrase at all."""
    return not TRIGGERS.isdisjoint(words) or _ODD.search(segment) is not None


def weak_label(segment: str) -> bool:
    """What phrases, marks and response statuses say about a segment: the label it is trained with, never the decision."""
    if PLACEHOLDER.search(segment) or FILLER_COMMAND.search(segment):
        return True
    w = words_of(segment)
    said = triggered(segment, w) and PHRASES.search(segment) is not None
    return (said or repeated(w) or latin(w)) and not DISCUSSED.search(segment)


_BASE = 1 << BITS
_EDGE = zlib.crc32(b"^")
_index: dict[str, tuple[int, bool]] = {}


def _word(w: str) -> tuple[int, bool]:
    """A word's hash, and whether it was struck at random; remembered."""
    h = _index.get(w)
    if h is None:
        if len(_index) > 500_000:
            _index.clear()
        h = _index[w] = (zlib.crc32(w.encode()), _struck(w))
    return h


def _shapes(segment: str) -> list[str]:
    """How names stand between punctuation: the two runs, what stands before, and the letters' case."""
    if "\\" in segment:
        segment = _COMMAND.sub(lambda m: _AS_BRACKET.get(m.group().rstrip("{} "), ""), segment)
    out = []
    for before, left, name, right in _BOX.findall(segment):
        if len(left) + len(right) < 3 and left + right not in ("<>", "‹›", "??", "[]"):
            continue  # groups and formulas of every text
        case = "A" if name.isupper() else "a" if name.islower() else "Aa"
        form = f"{left}|{right}"
        out += [f"#box{form}", f"#box{form}{'.' if before else ' '}{case}", f"#box {case}{' ' in name}{'_' in name}", f"#in{form}{name.split()[0].lower()}"]
    if "_" in segment:
        out += [f"#caps{x.rsplit('_', 1)[1]}" for x in _CAPITALS.findall(segment)]
    return out


def features(segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all segments of a document, and the number of the segment that each belongs to.

    Words and pairs of neighbours, length, variety and vowels of the words, the heading that the segment is, the length of
    the document, and how names stand between punctuation.
    """
    uni: list[int] = []
    sizes: list[int] = []
    extra: list[int] = []
    more: list[int] = []
    length = f"#doc{min(len(segs), 24) // 3}"
    for s in segs:
        w = words_of(s)
        n, kinds = len(w), len(set(w))
        m = _FIELD.search(s)
        hashed = [_word(x) for x in w]
        struck = sum(x[1] for x in hashed)
        marks = [f"#len{min(n, 60) // 4}", f"#kinds{min(n, 8) // 4}{8 * kinds // max(n, 1)}", f"#head{m.group() if m else ''}"]
        marks += [f"#struck{4 * struck // max(n, 1)}", length, *_shapes(s)]
        extra += [_word(x)[0] for x in marks]
        more.append(len(marks))
        uni.append(_EDGE)
        uni += [x[0] for x in hashed]
        sizes.append(n + 1)
    a = np.array(uni, np.int64)
    bi = a * 1_000_003 + np.append(a[1:], _EDGE) ^ 0x5BD1E995
    number = np.arange(len(segs))
    seg = np.repeat(number, sizes)
    return np.concatenate([a, bi, np.array(extra, np.int64)]) % _BASE, np.concatenate([seg, seg, np.repeat(number, more)])


def train(f: np.ndarray, rows: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression; ``f`` are features of the segments ``rows``."""
    w, bias = np.zeros(_BASE), -4.0
    if not label.any() or label.all():
        return w.astype(np.float32), bias
    label = label.astype(np.float64)
    weight = np.where(label > 0, min(20.0, (len(label) - label.sum()) / label.sum()), 1.0) / len(label)
    g2, gb2 = np.full(_BASE, 1e-12), 1e-12
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[f], len(label)) + bias, -30, 30)))
        r = (p - label) * weight
        g = np.bincount(f, r[rows], _BASE) + DECAY * w
        g2 += g * g
        w -= RATE * g / np.sqrt(g2)
        gb2 += r.sum() ** 2
        bias -= RATE * r.sum() / np.sqrt(gb2)
    return w.astype(np.float32), float(bias)


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score from which on records are excluded, by held-out records: the middle of the cuts of nearly the greatest F1."""
    if not labels.any() or labels.all():
        return 0.0
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order].astype(np.float64)
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # equal scores are cut together
    good = np.flatnonzero(f1 >= f1.max() - NEARLY)
    last = good[-1]
    return float((s[good[0]] + s[min(last + 1, len(s) - 1)]) / 2)


def best_score(text: str | None, w: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """Greatest log odds of a segment, and those of all segments; a text without segments has -30."""
    segs = segments(text) if text else []
    if not segs:
        return -30.0, np.empty(0)
    f, seg = features(segs)
    score = np.bincount(seg, w[f], len(segs)) + bias
    return float(score.max()), score


def host(docs: DataFrame) -> Column:
    """Host of a record: its journal, else its source."""
    return F.coalesce("journal", "source", F.lit(""))


def unseen(docs: DataFrame) -> Column:
    """Hosts that training does not see."""
    return F.pmod(F.xxhash64(host(docs), F.lit("host")), F.lit(1000)) < int(1000 * UNSEEN)


class Model(NamedTuple):
    """Weights (float32), bias, and the score from which on a record is excluded."""

    w: bytes
    bias: float
    least: float


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features and weak labels of sampled records, a row each."""
    for pdf in batches:
        out = []
        for doc, text, held in zip(pdf["doc_id"], pdf["text"], pdf["_held"], strict=True):
            segs = segments(text) if text else []
            if segs:
                f, seg = features(segs)
                out.append((doc, held, f.astype(np.int32).tobytes(), seg.astype(np.int32).tobytes(), bytes(map(weak_label, segs))))
        yield pd.DataFrame(out, columns=["doc_id", "held", "f", "seg", "label"])


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([pd.DataFrame({"doc_id": [], "held": [], "f": [], "seg": [], "label": []}), *batches]).sort_values("doc_id")
    got: dict[bool, list] = {False: [], True: []}
    for r in rows.itertuples():
        got[bool(r.held)].append((np.frombuffer(r.f, np.int32), np.frombuffer(r.seg, np.int32), np.frombuffer(r.label, np.bool_)))
    del rows
    f, at, y, n = [], [], [], 0
    for x, seg, label in got.pop(False):
        f.append(x)
        at.append(seg + n)
        y.append(label)
        n += len(label)
    w, bias = train(*map(np.concatenate, (f, at, y))) if n else (np.zeros(_BASE, np.float32), -4.0)
    worst = [(np.bincount(seg, w[x], len(label)).max() + bias, label.any()) for x, seg, label in got[True]]
    least = threshold(np.array([s for s, _ in worst]), np.array([a for _, a in worst], bool)) if worst else 0.0
    yield pd.DataFrame({"w": [w.tobytes()], "bias": [bias], "least": [least]})


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Trains on a sample of about ``sample_docs`` records, drawn by hash of the id.

    The sample's features and labels are found in parallel; one task, bounded by the sample, trains on the seen hosts and
    chooses the threshold on the others.
    """
    n = max(1, docs.count())
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_docs / n))
    sample = docs.where(F.col("doc_id").isNotNull() & drawn).select("doc_id", "text", unseen(docs).alias("_held"))
    with text_batches(docs.sparkSession):
        rows = spread(sample).mapInPandas(_featured, "doc_id bigint, held boolean, f binary, seg binary, label binary")
        got = rows.repartition(1).mapInPandas(_fitted, "w binary, bias double, least double").first()
    return Model(bytes(got["w"]), float(got["bias"]), float(got["least"])) if got else Model(np.zeros(_BASE, np.float32).tobytes(), -4.0, 0.0)


def scored(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Every record with ``score`` (log odds of its worst segment), ``n_hits`` (segments of residue) and ``residue``.

    The score alone decides. Columns of ``docs`` other than doc_id, text, journal and source are not read. Null and empty
    texts have no residue. Whole texts are read; no record is left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        w = np.frombuffer(m.w, np.float32)
        for pdf in batches:
            got = [best_score(t, w, m.bias) for t in pdf["text"]]
            hits = [int((s >= m.least).sum()) for _, s in got]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": [g[0] for g in got], "n_hits": hits, "residue": [n > 0 for n in hits]})

    with text_batches(docs.sparkSession):
        return settled(spread(docs.select("doc_id", "text")).mapInPandas(run, "doc_id bigint, score double, n_hits int, residue boolean"))


def without_residue(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The records without residue; ``doc_id`` must be unique."""
    bad = scored(docs, sample_docs).where("residue").select(F.col("doc_id").alias("_bad"))
    return docs.join(bad, F.col("doc_id") == F.col("_bad"), "left_anti")


def validation(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """On all records of hosts that training has not seen: how the decisions agree with the weak labels.

    Columns: labelled, predicted, n_docs. Weak labels are not the truth; see the hand-labelled set of the tests.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        w = np.frombuffer(m.w, np.float32)
        for pdf in batches:
            yield pd.DataFrame([(any(map(weak_label, segments(t) if t else [])), best_score(t, w, m.bias)[0] >= m.least) for t in pdf["text"]], columns=["labelled", "predicted"])

    with text_batches(docs.sparkSession):
        out = settled(spread(docs.where(unseen(docs)).select("doc_id", "text")).mapInPandas(run, "labelled boolean, predicted boolean"))
    return out.groupBy("labelled", "predicted").agg(F.count(F.lit(1)).alias("n_docs"))
