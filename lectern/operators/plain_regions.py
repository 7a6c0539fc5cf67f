"""Regions of plain text as built-in expressions: one regular expression parts a text, nothing is shuffled.

A part is a marker that switches formatting off with all lines up to the one that switches it on, any other marker, a
blank line, or the lines of a paragraph.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx

_WHITE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in tx.WHITE if c != "\n") + "]"


def _marker(name: str, state: str) -> str:
    switch = f"{re.escape(name)}:{state}"
    return rf"(?:{_WHITE}*+(?:(?:[#%]\x20{_WHITE}*+)?{switch}|<!--\x20{_WHITE}*+{switch}{_WHITE}*+\x20?-->){_WHITE}*+\n)"


def regions_of_plain(text: Column, name: str = tx.MARKER) -> Column:
    """``array<struct<kind, text>>`` of a plain text whose lines end in LF; null for null."""
    off, any_marker = _marker(name, "off"), _marker(name, "(?:on|off)")
    blank = rf"(?:{_WHITE}*+\n)"
    line = r"(?:[^\n]*+\n)"
    # Groups repeat possessively, as anything else would recurse once a line.
    part = rf"{off}(?:(?!{_marker(name, 'on')}){line})*+|{any_marker}|{blank}|(?:(?!{blank}|{any_marker}){line})++"
    # A text's last line has its end put back, an empty text has no lines.
    ended = F.when(text == "", "").when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    region = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("text"))
    by_line = lambda c: F.transform(F.regexp_extract_all(c, F.lit(line), F.lit(0)), lambda x: region("structure", x))
    joined = lambda c: F.array_join(F.transform(F.split(c, "\n"), tx.unicode_trim), " ")

    def one(c: Column) -> Column:
        prose = F.array(region("prose", joined(F.regexp_replace(c, r"\n\z", ""))))
        if_marked = F.when(c.rlike(rf"\A{any_marker}"), by_line(c)).otherwise(prose)
        return F.when(c.rlike(rf"\A{blank}\z"), F.array(region("blank", c))).otherwise(if_marked)

    return F.flatten(F.transform(F.regexp_extract_all(ended, F.lit(part), F.lit(0)), one))


def plain_regions(df: DataFrame, key: str, text: str = "text", name: str = tx.MARKER) -> DataFrame:
    """``(key, region_no, kind, text)`` of each row. Null texts have no regions."""
    found = regions_of_plain(tx.unified_newlines(F.col(text)), name)
    rows = df.select(key, F.posexplode(found).alias("region_no", "r"))
    return rows.select(key, "region_no", "r.kind", "r.text")
