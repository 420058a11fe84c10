"""What a reader of a typeset article sees: text in segments, without code, comments, definitions and quotations."""

from __future__ import annotations

import re

_CODE = re.compile(
    r"""\\begin\{(verbatim\*?|lstlisting|comment|minted|alltt)\}.*?(?:\\end\{\1\}|\Z)
    | \\verb\*?(?P<bar>[^\sA-Za-z*]).*?(?P=bar)
    | \\iffalse\b.*?(?:\\fi\b|\Z)
    | \\%
    | %[^\n]*
    | <!--.*?-->""",
    re.S | re.X,
)
# quotations by their opening mark, closed in the same paragraph; a text without the mark is not searched
_QUOTED = {
    "``": re.compile(r"``[^'\n]*(?:(?:'(?!')|\n(?![ \t]*\n))[^'\n]*)*''"),
    "“": re.compile(r"“[^”\n]*(?:\n(?![ \t]*\n)[^”\n]*)*”"),
    "„": re.compile(r"„[^“”\n]*(?:\n(?![ \t]*\n)[^“”\n]*)*[“”]"),
    "«": re.compile(r"«[^»\n]*(?:\n(?![ \t]*\n)[^»\n]*)*»"),
    '"': re.compile(r'(?<![{:,\[\w])(?<![{:,\[]\s)"[^"\n]{0,400}"(?!\s*:)'),
}
_SHOWN = re.compile(r"\\(?:texttt|lstinline|mintinline|path|url|footnote|detokenize)\s*\{")
_DEFINITION = re.compile(r"\\(?:re)?newcommand\*?|\\providecommand\*?|\\DeclareMathOperator\*?|\\DeclareRobustCommand\*?|\\[gex]?def(?![A-Za-z])|\\let(?![A-Za-z])|\\(?:re)?newenvironment\*?")
_PREAMBLE = re.compile(r"\\(?:documentclass|usepackage|RequirePackage|bibliographystyle|bibliography|input|include|subfile|includegraphics|label|magnification)(?:\s*\[[^\]]*\])?(?:\s*\{[^}]*\})?(?:=\d+)?")
_TAG = re.compile(
    r"</[a-z]\w*\s*>|<(html|head|title|body|h[1-6]|p|div|span|pre|center|hr|br|noscript|script|style|a|meta|link|table|tr|td|ul|li|b|i|em|strong"
    r"|img|form|input|button|iframe|nav|footer|header|section|article|main)\b([^<>]*)>|<!DOCTYPE[^<>]*>",
    re.I,
)
# fixed values: tags whose names may as well be those of a mark
_NAMES = frozenset("head title section header footer article main nav table form input button link style script meta".split())
_CLOSING = re.compile(r"</([a-z]\w*)\s*>", re.I)
_HEAD = re.compile(r"\\(?:title|author|affiliation|address|email|institute|thanks|date)\s*\{")
_BIBLIOGRAPHY = re.compile(r"\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)", re.S)


def group_end(s: str, i: int) -> int:
    """Position after the group that opens at ``s[i] == '{'``; the end of the text when it is not closed."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(s, i):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth:
            return m.end()
    return len(s)


def _without_groups(s: str, head: re.Pattern, put: str) -> str:
    """Takes out commands with their group."""
    out, at = [], 0
    for m in head.finditer(s):
        if m.start() < at:
            continue
        out += [s[at : m.start()], put]
        at = group_end(s, m.end() - 1)
    return "".join([*out, s[at:]])


def _definitions(s: str) -> tuple[str, dict[str, str]]:
    """The text without macro definitions, and the bodies by name."""
    out, at, bodies = [], 0, {}
    for m in _DEFINITION.finditer(s):
        if m.start() < at:
            continue
        kind, i = m.group(), m.end()
        name = re.compile(r"\s*\{?\s*(\\[A-Za-z@]+|\w+)\s*\}?").match(s, i)
        if not name:
            continue
        i = name.end()
        if kind.startswith("\\let"):
            end = re.compile(r"\s*=?\s*(?:\\[A-Za-z@]+|.)?").match(s, i).end()
        else:
            args = re.compile(r"(?:\s*\[[^\]\n]*\]|#\d|\s)*").match(s, i)
            i = args.end()
            if i >= len(s) or s[i] != "{":
                continue
            end = group_end(s, i)
            bodies[name.group(1)] = s[i + 1 : end - 1]
            if "environment" in kind and end < len(s) and s[end] == "{":
                end = group_end(s, end)
        out.append(s[at : m.start()])
        at = end
    return "".join([*out, s[at:]]), bodies


def _without_tags(s: str) -> str:
    """Takes out tags that are markup: with a partner, attributes, or a name that no mark has. A lone ``<title>`` is text."""
    paired = {x.lower() for x in _CLOSING.findall(s)}

    def put(m: re.Match) -> str:
        name = (m.group(1) or "").lower()
        return m.group() if name in _NAMES and name not in paired and not m.group(2).strip() else "\n"

    return _TAG.sub(put, s)


def visible(text: str) -> tuple[str, dict[str, str]]:
    """The text that is set, markup of its layout still in it, and the bodies of macros that the text uses."""
    s = text.replace("\r\n", "\n").replace("\r", "\n")
    s = _CODE.sub(lambda m: m.group() if m.group() == "\\%" else " ", s)
    s, bodies = _definitions(s)
    i = s.find("\\begin{document}")
    if i >= 0:
        lead, heads = s[:i], []
        j = lead.find("\\documentclass")
        before = lead[:j] if j > 0 else ""
        for m in _HEAD.finditer(lead):
            heads.append(lead[m.start() : group_end(lead, m.end() - 1)])
        s = "\n".join([before, *heads, s[i + 16 :]])
    s = _BIBLIOGRAPHY.sub("\n", s)
    s = _PREAMBLE.sub(" ", s)
    s = _without_groups(s, _SHOWN, " Q ")
    for mark, quoted in _QUOTED.items():
        if mark in s:
            s = quoted.sub(" Q ", s)
    if "<" in s:
        s = _without_tags(s)
    used = {n: b for n, b in bodies.items() if n.startswith("\\") and re.search(re.escape(n) + r"(?![A-Za-z])", s)}
    return s, used


_BREAK = re.compile(r"\\(?:section|subsection|paragraph|chapter|beginsection|medskip|noindent|item|begin\{[a-z*]+\}|end\{[a-z*]+\}|\\)\*?")


def segments(text: str) -> list[str]:
    """Sentences, headings and lines of what is set, and the bodies of macros that are used."""
    s, used = visible(text)
    s = _BREAK.sub("\n", "\n".join([s, *used.values()])).replace("\t", " ")
    for end in ".!?":
        s = s.replace(f"{end} ", f"{end}\n")
    return [x for x in map(str.strip, s.split("\n")) if x]
