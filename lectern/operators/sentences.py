"""Sentences of a prose text, as a chain of built-in expressions (and the same in Python, for registered functions).

Unicode's sentence boundary rules are one regular expression, written for both engines.  Every later step asks only
what stands next to a boundary, so boundaries are marked in place and marks are taken away again: after segments that
end in an abbreviation, and after closing quotation marks before a small letter.

Defined results: null gives null, a blank text no sentences; segments without a letter or digit are dropped unless
nothing else is there, when the whole text is one sentence.  U+0000 and U+0001 are removed from texts.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.abbreviations import LANGS, language, tail_pattern
from lectern.functions.text import WHITE, let, unicode_trim

#: What is never split inside, in this order; fixed values.
TOKENS = (
    r"\[\[[^\]]*\]\]",
    r"\[\[[^\]]*\]\[[^\]]*\]\]",
    r"\[[^\]]+\]\([^)]+\)",
    r"!\[[^\]]*\]\([^)]+\)",
    r"\$[^$]+\$",
    r"\\[a-zA-Z]+\{[^}]*\}",
    r"~[^~]+~",
    r"=[^=]+=",
    r"`[^`]+`",
    r"""https?://\S+[^.\s!?,;:)\]'"]""",
    r"file:\S+",
    r"@@[a-zA-Z]+:[^@]*@@",
)
TOKEN = "(?U)" + "|".join(TOKENS)
#: A text without any of these has no token.
TOKEN_SIGN = r"[\[$\\~=`@]|://|file:"
PLACE = "\x00PH\x00"
MARK = "\x01"

_X = r"[\p{Mn}\p{Mc}\p{Me}\p{Cf}]*+"
_A = r".\u2024\uFE52\uFF0E"
_S = r"!?\u203C\u203D\u2047-\u2049\u3002\uFF01\uFF1F\uFF61\u0589\u061D-\u061F\u06D4\u0700-\u0702\u0964\u0965\u104A\u104B\u1362\u1367\u1368"
_CLOSE = r"""[\p{Ps}\p{Pe}\p{Pi}\p{Pf}"']"""
_SPACE = r"[\p{Zs}\t\x0B\x0C]"
_GOES_ON = r",\-:\u055D\u060C\u060D\u07F8\u1802\u1808\u2013\u2014\u3001\uFE10\uFE11\uFE13\uFE31\uFE32\uFE50\uFE51\uFE55\uFE58\uFE63\uFF0C\uFF0D\uFF1A\uFF64"
_PARAGRAPH = r"(?:\r\n|[\n\r\x85\u2028\u2029])"
_TAIL = rf"(?:{_CLOSE}{_X})*+(?:{_SPACE}{_X})*+(?![{_GOES_ON}{_A}{_S}])"
#: Few ranges that hold all marks: a cheap test that most characters fail.
_MAYBE = r"(?=[\n\r!.?\x85\u0589-\u1368\u2024-\u3002\uFE52-\uFF61])"
BOUNDARY = (
    rf"{_MAYBE}(?:(?:[{_S}]{_X}{_TAIL}"
    rf"|[{_A}]{_X}(?!\p{{Nd}})(?!(?<=[\p{{Lu}}\p{{Lt}}\p{{Ll}}][{_A}])\p{{Lu}}){_TAIL}(?![^\p{{L}}\p{{Nl}}\r\n\x85\u2028\u2029{_A}{_S}]*+\p{{Ll}}))"
    rf"{_PARAGRAPH}?|{_PARAGRAPH})(?!\z)"
)
SUBSTANCE = r"[\p{L}\p{Nl}\p{N}]"
QUOTED_END = r"""(?U)[.!?]["')\]]+\s*\z"""
CLOSED_END = r"""["')\]]\z"""
SMALL_START = r"(?U)\A\s*\p{Ll}"


def _joined(segments: Column, goes_on) -> Column:
    """Segments, each put together with the next where ``goes_on(segment, next)``."""
    last = F.size(segments) - 1
    marked = F.transform(segments, lambda s, i: F.when((i < last) & goes_on(s, F.get(segments, i + 1)), s).otherwise(F.concat(s, F.lit(MARK))))
    return F.filter(F.split(F.array_join(marked, ""), MARK), lambda s: s != "")


#: No abbreviation of a list is nearly so long.
_TAIL_LENGTH = 32


def _is_abbreviated(segment: Column, lang: Column | str | None, extras: Column | None) -> Column:
    return let(F.rtrim(segment, F.lit(WHITE)), lambda end: _ends_abbreviated(end, lang, extras))


def _ends_abbreviated(end: Column, lang: Column | str | None, extras: Column | None) -> Column:
    tail = F.right(end, F.lit(_TAIL_LENGTH))
    if isinstance(lang, Column):
        found = F
        for known in LANGS[1:]:  # literal patterns, so that each is compiled once
            found = found.when(lang == known, tail.rlike(tail_pattern(known)))
        found = found.otherwise(tail.rlike(tail_pattern("en")))
    else:
        found = tail.rlike(tail_pattern(lang))
    found = end.endswith(".") & found
    if extras is None:
        return found

    def ends_in(word: Column) -> Column:
        before = F.substr(end, F.length(end) - F.length(word) - 1, F.lit(1))
        free = (F.length(end) == F.length(word) + 1) | before.rlike(r"(?U)\A\s\z")
        return F.coalesce(end.endswith(F.concat(word, F.lit("."))) & free, F.lit(False))

    return found | F.coalesce(F.exists(extras, ends_in), F.lit(False))


def sentences(text: Column, lang: Column | str | None = None, extras: Column | None = None) -> Column:
    """``array<string>`` of the sentences of ``text``."""
    none = F.array().cast("array<string>")

    def restored(segments: Column, whole: Column) -> Column:
        return let(F.array_join(F.transform(segments, unicode_trim), MARK), lambda trimmed: put_back_into(trimmed, whole))

    def put_back_into(trimmed: Column, whole: Column) -> Column:
        parts = F.split(trimmed, r"\x00PH\x00")
        put_back = F.zip_with(parts, F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        whole_again = F.when(F.contains(trimmed, F.lit(PLACE)), F.array_join(put_back, "")).otherwise(trimmed)
        return F.filter(F.split(whole_again, MARK), lambda s: s != "")

    def of(t: Column) -> Column:
        tokens_out = F.when(t.rlike(TOKEN_SIGN), F.regexp_replace(t, TOKEN, PLACE)).otherwise(t)
        marked = F.regexp_replace(tokens_out, BOUNDARY, "$0" + MARK)
        raw = F.filter(F.split(marked, MARK), lambda s: s.rlike(SUBSTANCE))
        whole = lambda segments: let(
            _joined(segments, lambda s, _: _is_abbreviated(s, lang, extras)),
            lambda merged: restored(_joined(merged, lambda s, n: F.rtrim(s, F.lit(WHITE)).rlike(CLOSED_END) & s.rlike(QUOTED_END) & F.coalesce(n.rlike(SMALL_START), F.lit(False))), t),
        )
        return F.when(t == "", none).otherwise(let(raw, lambda segments: F.when(F.size(segments) == 0, F.array(t)).otherwise(whole(segments))))

    return let(unicode_trim(F.translate(text, "\x00\x01", "")), of)


@lru_cache(maxsize=32)
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern.removeprefix("(?U)").replace(r"\z", r"\Z"))


def split_text(text: str | None, lang: str | None = None, extras: tuple[str, ...] = ()) -> list[str]:
    """The same for one text in Python."""
    text = _compiled(r"(?U)\A\s+|\s+\z").sub("", (text or "").replace("\x00", "").replace("\x01", ""))
    if not text:
        return []
    tokens = [m[0] for m in _compiled(TOKEN).finditer(text)]
    marked = _compiled(BOUNDARY).sub(lambda m: m[0] + MARK, _compiled(TOKEN).sub(PLACE, text))
    segments = [s for s in marked.split(MARK) if _compiled(SUBSTANCE).search(s)]
    if not segments:
        return [text]
    tail = _compiled(tail_pattern(language(lang)))

    def abbreviated(s: str) -> bool:
        end = s.rstrip(WHITE)
        return bool(tail.search(end)) or any(e and end.endswith(e + ".") and (len(end) == len(e) + 1 or end[-len(e) - 2].isspace()) for e in extras)

    for goes_on in (lambda a, _: abbreviated(a), lambda a, b: bool(_compiled(QUOTED_END).search(a) and _compiled(SMALL_START).search(b))):
        out = [segments[0]]
        for before, s in zip(segments, segments[1:]):
            if goes_on(before, s):
                out[-1] += s
            else:
                out.append(s)
        segments = out
    rest = iter(tokens)
    whole = MARK.join(s.strip(WHITE) for s in segments)
    parts = whole.split(PLACE)
    return [s for s in "".join(a + next(rest, "") for a in parts).split(MARK) if s]
