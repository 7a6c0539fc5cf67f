"""Problem 2: markup residue of any kind in texts of any format.

A text is read in two passes.  The first goes over its lines, finds code blocks of every kind and takes their content
out (their delimiters count as markup, their content does not).  The second takes out code spans and then looks for the
marks of each kind.  The same marks, replaced instead of found, give the clean text.

The method named for this problem deduces a page template from tokens with equal occurrence vectors over the pages of
one host.  Texts of one project share no template here and the kind of a mark does not follow from how often it
occurs, so the kinds come from the marks themselves (see README); :mod:`lectern.llm.templates` has the named method.

Clean text keeps headings as ``#`` lines, list items as ``-`` lines, code in fences and formulas between ``$`` signs.

Defined results: null, empty and blank texts have no kinds; the clean text of null is null; repeated rows of one call
count once in :func:`residue`.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import format_key, map_rows
from lectern.runtime import spread

KINDS = ("html", "markdown", "wiki", "latex", "org", "rst")

#: Elements of HTML that count as such; fixed values.
ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col dd del details dfn div dl dt em"
    " embed figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main"
    " mark meta nav noscript ol option p param pre q s samp script section select small span strike strong style sub summary sup"
    " svg table tbody td textarea tfoot th thead title tr tt u ul var video"
).split()
TAG = rf"</?(?:{'|'.join(ELEMENTS)})(?:\s[^<>]*)?/?>"
ENTITY = r"&(?:[a-zA-Z][a-zA-Z0-9]{1,9}|#\d{1,6}|#x[0-9a-fA-F]{1,5});"
NAME = r"[A-Za-z][\w.+-]*"

#: What gives a kind away outside code, by kind.
MARKS = {
    "html": re.compile(rf"{TAG}|<!--(?:(?!<!--).)*?-->|<!DOCTYPE|{ENTITY}", re.I | re.S),
    "markdown": re.compile(
        r"^ {0,3}#{1,6}[ \t]+\S"  # heading
        r"|!?\[[^\[\]]+\]\((?:[^()\s]|\([^()\s]*\))+\)"  # link, image
        r"|(?<!\[)\[[^\[\]]+\]\[[^\[\]]*\]|^ {0,3}\[[^\[\]]+\]:[ \t]+\S+"  # reference link and its target
        r"|(?<![\w*])\*\*(?=[^\s*])[^*]+?(?<=[^\s*])\*\*(?![\w*])|(?<=[^\s\x00-\x7f])\*\*(?=[^\s*])[^*\n]+\*\*|\*\*(?=[^\s*])[^*\n]+\*\*(?=[^\s\x00-\x7f])"
        r"|(?<!\w)__(?=[^\s_])[^_\n]*[^\s_A-Z][^_\n]*__(?!\w)"
        r"|~~(?=[^\s~])[^~\n]+?~~"
        r"|^ {0,3}>[ \t]?\S"  # quotation
        r"|^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]"  # task
        r"|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t\r]*$"  # table rule
        r"|^[ \t]*(?:\d+\.|[-*+])[ \t]+!?\[[^\[\]]+\]\(",
        re.M,
    ),
    "wiki": re.compile(
        r"\{\{[^{}]+\}\}|^={2,6}[ \t]*[^=\s][^\n]*?[ \t]*={2,6}[ \t\r]*$"
        r"|'''(?=[^\s'])[^'\n]*(?:\n[^'\n]+)?'''|(?<!['\w`])''(?=[^\s'])[^'\n`]+(?:\n[^'\n`]+)?''(?!['\w])"
        r"|(?<!\[)\[\[(?!file:|https?:|id:|[#*])[^\[\]]+\]\](?!\()|(?<!\[)\[https?://[^\s\[\]]+[ \t\n][^\[\]]+\](?![\](])"
        r"|^\{\|.*|^\|\}[ \t\r]*$|^\|-[ \t\r]*$|__(?:NO)?TOC__|__[A-Z]{4,}__|</?(?:ref|nowiki|gallery|references|math)\b[^<>]*>|^#REDIRECT\b",
        re.M,
    ),
    "latex": re.compile(
        r"\\(?:begin|end)\{[A-Za-z]+\*?\}|\\[A-Za-z]+\*?(?:\[[^\[\]\n]*\])?\{|\\(?:item|maketitle|tableofcontents|centering|newpage|par|noindent|alpha|beta|leq|geq|ldots|cdot|LaTeX|TeX)\b"
        r"|\\\[[^\n]+|\\\][ \t\r]*$|\\\((?:(?!\\\().)+?\\\)|(?<![\w$])\$(?=[^\s$])[^$\n]*(?:\n[^$\n]+)?[\\^_=][^$\n]*\$(?!\d)|\$\$(?:(?!\$\$).)+\$\$",
        re.M | re.S,
    ),
    "org": re.compile(
        r"^[ \t]*#\+[A-Za-z_]+(?:\[[^\]]*\])?:?(?:[ \t]|\r?$)|^\*{1,8}[ \t]+(?:TODO|DONE|NEXT|WAIT|WAITING|CANCELLED)[ \t]+\S|^\*{2,8}[ \t]+\S(?![^\n]*\*\*)"
        r"|^[ \t]*:(?:PROPERTIES|END|LOGBOOK|CUSTOM_ID|ID):|^\*[ \t]+[^\n]*[ \t]:[\w@:]+:[ \t\r]*$"
        r"|\[\[[^\[\]]+\]\[[^\[\]]+\]\]|\[\[(?:file:|https?:|id:|[#*])[^\[\]]+\]\]|@@[a-z]+:.*?@@"
        r"|^[ \t]*(?:SCHEDULED|DEADLINE|CLOSED):[ \t]*[<\[]",
        re.M,
    ),
    "rst": re.compile(
        r"^[ \t]*\.\.[ \t]+(?:\|[^|\n]+\|[ \t]+)?[A-Za-z][\w.+-]*::|^[ \t]*\.\.[ \t]+_[^:\n]+:|^[ \t]*\.\.[ \t]+\[[^\]\n]+\][ \t]"
        r"|(?<![\w:]):[a-z][a-z:+-]*:`[^`]+`|`[^`<>]+<[^<>`]+>`__?|(?<![`\w])`[^`\n]+`__?(?!\w)|(?<!`)``(?=[^`\s])[^`]+``(?!`)|\[(?:\d+|#\w*)\]_(?!\w)"
        r"|^(?![ \t]*[-*+|>#])[^\n]*[^\s\n][ \t]*\r?\n([~^\"+#*`])\1{2,}[ \t]*\r?$",
        re.M,
    ),
}

#: Each mark of a kind holds one of these; looking for them is far cheaper than the patterns.
PARTS = {
    "html": ("<", "&"),
    "markdown": ("# ", "#\t", "](", "][", "]:", "**", "__", "~~", "\n>", "\n >", "\n  >", "\n   >", "[ ]", "[x]", "[X]", "--"),
    "wiki": ("{{", "==", "''", "[[", "[http", "\n{|", "|}", "|-", "__", "<", "#REDIRECT"),
    "latex": ("\\", "$"),
    "org": ("#+", "\n*", ":PROPERTIES:", ":END:", ":LOGBOOK:", ":CUSTOM_ID:", ":ID:", "[[", "@@", "SCHEDULED:", "DEADLINE:", "CLOSED:"),
    "rst": (".. ", "..\t", ":`", "`_", "``", "]_", "~~~", "^^^", '"""', "+++", "###", "***", "```"),
}
#: Nested items below an item that is a wiki link: no headlines, though they look alike.
WIKI_LIST = re.compile(r"^(\*[ \t]+(?:\[\[[^\[\]\n]+\]\](?!\[)|'')[^\n]*\n)(?:\*{1,8}[ \t][^\n]*(?:\n|\Z))+", re.M)
#: Without any of these there is no mark of any kind.
ANY_MARK = re.compile(r"[<>&{}\[\]\\$#*=~`|@^\"+]|''|__|::|^[ \t]*:[A-Z]|^[ \t]*\.\. |^[ \t]*(?:SCHEDULED|DEADLINE|CLOSED):", re.M)

FENCE = re.compile(r"^([ \t]*)(`{3,}|~{3,})[ \t]*([\w+.#-]*)[^`]*$")
ORG_BLOCK = re.compile(r"^[ \t]*#\+begin_(src|example|export|verbatim|comment)\b", re.I)
ORG_BLOCK_END = re.compile(r"^[ \t]*#\+end_(src|example|export|verbatim|comment)\b", re.I)
RST_CODE = re.compile(r"^([ \t]*)\.\.[ \t]+(?:code-block|code|sourcecode|literalinclude|parsed-literal|math|highlight|raw)::")
RST_LITERAL = re.compile(r"^([ \t]*)(?!\.\.[ \t])\S.*[^:\s]?::[ \t]*$")
TEX_CODE = re.compile(r"^\s*\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}")
TAG_CODE = re.compile(r"<(pre|code|script|style|source|syntaxhighlight|nowiki|tt|samp|kbd)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
SPAN = re.compile(r"(?<![`\w:\\])(`)(?=[^`])([^`\n]+(?:\n[^`\n]+)?)`(?![`_\w])|(?<!`)(``)(?=[^`])([^`\n]*(?:`[^`\n]+)*)``(?!`)|(\\verb\*?([|!+#]))[^\n]*?\6")
ROLE = re.compile(r"(?<![\w:])(:[a-z][a-z:+-]*:)`([^`]+)`")
INDENT = re.compile(r"[ \t]*")


def _indent(line: str) -> int:
    return INDENT.match(line).end()


def blocks(text: str, own: str = "plaintext") -> tuple[list[str], list[tuple[int, int]], set[str]]:
    """The lines with the content of code blocks, the line ranges of that content, and the kinds of the delimiters."""
    lines = text.split("\n")
    inside: list[tuple[int, int]] = []
    kinds: set[str] = set()
    if not any(x in text for x in ("```", "~~~", "#+", "\\begin", ".. ", "::")):
        return lines, inside, kinds
    i, n = 0, len(lines)
    fences = {c: [k for k, x in enumerate(lines) if c * 3 in x] for c in "`~"}
    while i < n:
        line = lines[i].rstrip("\r")
        start = i + 1
        if m := FENCE.match(line):
            mark = m[2]
            before = lines[i - 1].strip() if i else ""
            closing = re.compile(rf"[ \t]*{re.escape(mark[0])}{{{len(mark)},}}[ \t\r]*$")
            if mark[0] == "~" and not m[3] and before and set(before) != {"~"} and (len(mark) > 3 or len(before) <= 3 and own != "markdown"):
                i += 1  # the underline of a title
                continue
            later = fences[mark[0]]
            j = next((k for k in islice(later, bisect_left(later, start), None) if closing.match(lines[k])), n)
            if mark[0] == "~" and j == n:
                i += 1
                continue
            kinds.add("markdown")
            inside.append((start, j))
            i = j + 1
        elif ORG_BLOCK.match(line):
            j = start
            while j < n and not ORG_BLOCK_END.match(lines[j]):
                j += 1
            kinds.add("org")
            inside.append((start, j))
            i = j + 1
        elif m := TEX_CODE.match(line):
            j = start
            while j < n and f"\\end{{{m[1]}}}" not in lines[j]:
                j += 1
            kinds.add("latex")
            inside.append((start, j))
            i = j + 1
        elif (m := RST_CODE.match(line)) or own in ("rst", "plaintext") and (m := RST_LITERAL.match(line)) and not line.lstrip().startswith(":"):
            j = start
            while j < n and (not lines[j].strip() or _indent(lines[j]) > len(m[1])):
                j += 1
            while j > start and not lines[j - 1].strip():
                j -= 1
            if j > start:
                kinds.add("rst")
                while start < j and re.match(r"^[ \t]+:[\w-]+:", lines[start]):
                    start += 1
                inside.append((start, j))
            i = max(j, i + 1)
        else:
            i += 1
    return lines, inside, kinds


def masked(text: str, own: str = "plaintext") -> tuple[str, set[str]]:
    """The text without what stands in code of any kind, and the kinds of the delimiters of that code."""
    lines, inside, kinds = blocks(text, own)
    for a, b in inside:
        lines[a:b] = [""] * (b - a)
        if a and FENCE.match(lines[a - 1].rstrip("\r")):
            lines[a - 1] = ""
            if b < len(lines):
                lines[b] = ""
    rest = "\n".join(lines)

    def tag(m: re.Match) -> str:
        kinds.add("wiki" if m[1].lower() in ("source", "syntaxhighlight", "nowiki") else "html")
        return " " + "\n" * m[0].count("\n")

    if "</" in rest:
        rest = TAG_CODE.sub(tag, rest)
    if "`" in rest or "\\verb" in rest:

        def role(m: re.Match) -> str:
            kinds.add("rst")
            return m[1] + "``"

        def span(m: re.Match) -> str:
            kinds.add("latex" if m[5] else "rst" if m[3] else own if own in ("markdown", "rst") else "markdown")
            return " " + "\n" * m[0].count("\n")

        rest = SPAN.sub(span, ROLE.sub(role, rest))
    return rest, kinds


def kinds_of(text: str, own: str = "plaintext") -> set[str]:
    """All kinds of markup in the text; of its own kind only what delimits code."""
    if not ANY_MARK.search(text):
        return set()
    rest, kinds = masked(text, own)
    rest = "\n" + rest
    for kind, marks in MARKS.items():
        if kind == own or kind in kinds or not any(x in rest for x in PARTS[kind]):
            continue
        if marks.search(WIKI_LIST.sub(r"\1", rest) if kind == "org" and "\n**" in rest else rest):
            kinds.add(kind)
    return kinds


_HEADING = re.compile(r"^(?: {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*|(\*{1,6})[ \t]+(?:(?:TODO|DONE|NEXT|WAIT|WAITING)[ \t]+)?(.*?)(?:[ \t]+:[\w@:]+:)?|(={2,6})[ \t]*([^=].*?)[ \t]*={2,6})[ \t\r]*$")
_SECTION = re.compile(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}")
_LEVEL = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_DROP_LINE = re.compile(
    r"^[ \t]*(?:#\+[A-Za-z_]+.*|:[A-Za-z_]+:.*|\.\.[ \t].*|\\(?:documentclass|usepackage|label|begin|end|centering|maketitle)\b.*|__[A-Z]+__|\{\|.*|\|\}|\|-"
    r"|\|?[ \t]*:?-{2,}:?[ \t]*(?:[|+][ \t]*:?-+:?[ \t]*)+\|?|\[\[Category:[^\]]*\]\]|\[[^\[\]]+\]:[ \t]+\S+|([~^\"=-])\1{2,})[ \t\r]*$"
)
_ITEM = re.compile(r"^[ \t]*(?:[-+]|\*(?=[ \t]+\S)|\\item)[ \t]+(?:\[[ xX]\][ \t]+)?(.*)$")
_INLINE = (
    (re.compile(r"<!--.*?-->", re.S), ""),
    (re.compile(r"<(script|style)\b.*?</\1\s*>", re.I | re.S), ""),
    (re.compile(r"<h([1-6])\b[^<>]*>(.*?)</h\1>", re.I | re.S), lambda m: "\n" + "#" * int(m[1]) + " " + m[2] + "\n"),
    (re.compile(r"<li\b[^<>]*>", re.I), "\n- "),
    (re.compile(r"<(?:br|p|div|tr|/p|/div|/ul|/ol|/table)\b[^<>]*>", re.I), "\n"),
    (re.compile(TAG, re.I), ""),
    (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"!?\[([^\[\]]+)\]\((?:[^()\s]|\([^()\s]*\))+\)"), r"\1"),
    (re.compile(r"\[\[(?:File|Image):[^\[\]|]*(?:\|[^\[\]|]*)*\|([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\[\[[^\[\]]+\]\[([^\[\]]+)\]\]"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]"), r"\1"),
    (re.compile(r"\[https?://\S+[ \n]([^\[\]]+)\]"), r"\1"),
    (re.compile(r"(?<!\[)\[([^\[\]]+)\]\[[^\[\]]*\]"), r"\1"),
    (re.compile(r"'''?([^'\n]+)'''?"), r"\1"),
    (re.compile(r"\*\*([^*\n]+)\*\*"), r"\1"),
    (re.compile(r"`([^`<>]+?)[ \n]*<[^<>`]+>`__?"), r"\1"),
    (re.compile(r":[a-z][a-z:+-]*:`([^`]+)`"), lambda m: f"${m[1]}$" if m[0].startswith(":math:") else m[1]),
    (re.compile(r"@@[a-z]+:.*?@@"), ""),
    (re.compile(r"~?\\(?:cite|label|ref|index)[a-z]*\*?(?:\[[^\]]*\])?\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:emph|text[a-z]{2}|footnote|underline|href\{[^{}]*\})\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\\[(.*?)\\\]|\\\((.*?)\\\)", re.S), lambda m: f"${(m[1] or m[2]).strip()}$"),
)


def clean(text: str, own: str = "plaintext") -> str:
    """The text without markup, with its structure in one plain notation."""
    lines, inside, _ = blocks(text.replace("\r\n", "\n"), own)
    kept: list[str] = []
    out: list[str] = []
    starts = {a: b for a, b in inside}
    i = 0
    opener = closer = -1
    while i < len(lines):
        if i in starts:
            b = starts[i]
            kept.append("```\n" + "\n".join(lines[i:b]) + "\n```")
            out.append(f"\x00{len(kept) - 1}\x00")
            i = closer = b
            continue
        line = lines[i]
        opener = i + 1 in starts
        if (opener or closer == i and i < len(lines)) and (FENCE.match(line) or ORG_BLOCK.match(line) or ORG_BLOCK_END.match(line) or "\\begin{" in line or "\\end{" in line or RST_CODE.match(line)):
            pass
        elif _DROP_LINE.match(line):
            pass
        elif (m := _HEADING.match(line)) and (m[3] != "*" or own == "org"):
            mark = m[1] or m[3] or m[5]
            out.append("#" * len(mark) + " " + (m[2] or m[4] or m[6] or ""))
        elif m := _ITEM.match(line):
            out.append("- " + m[1])
        else:
            out.append(line)
        i += 1
    rest = "\n".join(out)

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    rest = re.sub(r"<pre\b[^<>]*>(?:<code>)?(.*?)(?:</code>)?</pre>", lambda m: keep(re.match(r"(?s).*", "```\n" + html.unescape(m[1]) + "\n```")), rest, flags=re.I | re.S)
    rest = _SECTION.sub(lambda m: "#" * _LEVEL[m[1]] + " " + m[2], rest)
    rest = re.sub(r"(?<![`\w:])`[^`\n]+`(?![`_\w])|``[^`\n]+``|\$[^$\n]+\$", keep, rest)
    for pattern, to in _INLINE:
        rest = pattern.sub(to, rest)
    rest = html.unescape(rest)
    rest = re.sub(r"\n[ \t]*(?:\n[ \t]*)+", "\n\n", rest).strip("\n")
    while "\x00" in rest:
        rest = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], rest)
    return rest


def _batch(batch: pa.RecordBatch) -> dict:
    texts, own = batch.column("text").to_pylist(), batch.column("own").to_pylist()
    kinds = [sorted(kinds_of(t, f) - {f}) if t else [] for t, f in zip(texts, own)]
    return {"call_id": batch.column("call_id"), "own": own, "foreign": kinds}


def _clean_batch(batch: pa.RecordBatch) -> dict:
    texts, own = batch.column("text").to_pylist(), batch.column("own").to_pylist()
    return {"call_id": batch.column("call_id"), "clean": [None if t is None else clean(t.replace("\x00", ""), f) for t, f in zip(texts, own)]}


def foreign_kinds(calls: DataFrame) -> DataFrame:
    """``(call_id, own, foreign)``: the kinds of markup in each text other than that of its format."""
    return map_rows(spread(calls.select("call_id", "text", format_key(F.col("format")).alias("own"))), _batch, "call_id bigint, own string, foreign array<string>")


def residue(calls: DataFrame) -> DataFrame:
    """``(call_id, markup)``, one row for each foreign kind of a call."""
    return foreign_kinds(calls).select("call_id", F.explode("foreign").alias("markup")).distinct()


def clean_texts(calls: DataFrame) -> DataFrame:
    """``(call_id, clean)`` for each row."""
    return map_rows(spread(calls.select("call_id", "text", format_key(F.col("format")).alias("own"))), _clean_batch, "call_id bigint, clean string")
