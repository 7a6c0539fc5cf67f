"""Problem 5: one consistent form for texts that look the same.

Each Arrow batch is normalised by SQL in an embedded DuckDB: invisible characters go, width and other compatibility
forms, sorts of space and hyphen and look-alike letters are mapped by ``translate``, ligatures and other forms of
several letters by ``replace``, and ``nfc_normalize`` composes what is left.  Case, accents, digits, words and line
breaks stay, so texts that differ in those stay different.

Defined results: a null text has a null form; an empty or blank text has an empty or blank form and is in no pair;
repeated rows of one call count once; any number of calls with equal texts give no pair among themselves.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_rows
from lectern.runtime import checkpointed, spread, worker_cache

#: Letters of other scripts and the Latin letters of the same shape; fixed values.
CYRILLIC = "аВсԁеһНіјКӏМорԛЅѕТхХуУѵԝАЕОРСІЈԌ", "aBcdehHijKlMopqSsTxXyYvwAEOPCIJG"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναϲϹϳͿ", "ABEZHIKMNOPTYXovacCjJ"
ARMENIAN = "օՕսՍհո", "oOuUhn"
#: Sorts of hyphen that look like the hyphen-minus; fixed values.
HYPHENS = "‐‑⁃−﹣－"
#: Characters without shape that no general category gives away; fixed values.
FILLERS = "͏ᅟᅠ឴឵ㅤﾠ"
#: Ranges of the other default-ignorable code points: Mongolian selectors, unassigned ones, tags and variation selectors.
IGNORABLE = "\u180b-\u180d\u180f\u2065\ufff0-\ufff8\U000e0000-\U000e0fff"
COMPAT_KINDS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>")


def tables() -> tuple[str, str, list[tuple[str, str]], str]:
    """From, to (single characters), replacements of several characters, and a class of what to delete: all by rule."""
    single: dict[str, str] = dict(zip(CYRILLIC[0] + GREEK[0] + ARMENIAN[0], CYRILLIC[1] + GREEK[1] + ARMENIAN[1]))
    many: list[tuple[str, str]] = []
    drop = []
    for code in range(0x80, 0x20000):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cs", "Co", "Cn", "Cc"):
            continue
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or ch in FILLERS:
            drop.append(ch)
        elif kind == "Zs":
            single[ch] = " "
        elif ch in HYPHENS:
            single[ch] = "-"
        elif ch not in single and (how := unicodedata.decomposition(ch)):
            if how.startswith(COMPAT_KINDS):
                form = unicodedata.normalize("NFKC", ch)
                form = "".join(single.get(x, x) for x in form)
                if len(form) == 1:
                    single[ch] = form
                elif form.strip() == form and kind not in ("Mn", "Lm", "Sk"):
                    many.append((ch, form))
            elif not how.startswith("<"):
                base, marks = unicodedata.normalize("NFD", ch)[0], unicodedata.normalize("NFD", ch)[1:]
                if base in single and len(form := unicodedata.normalize("NFC", single[base] + marks)) == 1:
                    single[ch] = form
    single["\uff9e"], single["\uff9f"] = "\u3099", "\u309a"
    for a, b in list(single.items()):
        single[a] = single.get(b, b)
    return "".join(single), "".join(single.values()), many, "".join(drop) + IGNORABLE


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def skeleton_sql(column: str) -> str:
    """The SQL expression of the consistent form of ``column``."""
    source, target, many, drop = tables()
    rest = f"regexp_replace({column}, '[{drop}]', '', 'g')"
    if many:
        shapes = "".join(a for a, _ in many)
        chain = "x"
        for a, b in many:
            chain = f"replace({chain}, {_quoted(a)}, {_quoted(b)})"
        rest = f"list_transform([{rest}], lambda x: CASE WHEN regexp_matches(x, '[{shapes}]') THEN {chain} ELSE x END)[1]"
    return f"nfc_normalize(translate({rest}, {_quoted(source)}, {_quoted(target)}))"


def _connection():
    cache = worker_cache()
    if "lookalike" not in cache:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "400MB"})
        cache["lookalike"] = con, skeleton_sql("text")
    return cache["lookalike"]


def _forms(batch: pa.RecordBatch) -> dict:
    con, sql = _connection()
    con.register("seen", pa.Table.from_batches([batch]))
    # Plain ASCII has nothing to map: it is its own form.
    out = con.sql(
        f"SELECT call_id, CASE WHEN regexp_full_match(text, '[[:ascii:]]*') THEN text ELSE {sql} END AS form FROM seen"
    ).to_arrow_table()
    return {"call_id": out.column("call_id").combine_chunks(), "form": out.column("form").combine_chunks()}


def _hashes(batch: pa.RecordBatch) -> dict:
    con, sql = _connection()
    con.register("seen", pa.Table.from_batches([batch]))
    out = con.sql(
        f"""SELECT call_id, unhex(md5(text)) AS raw, unhex(md5(CASE WHEN regexp_full_match(text, '[[:ascii:]]*') THEN text
        ELSE {sql} END)) AS form FROM seen WHERE text IS NOT NULL AND call_id IS NOT NULL"""
    ).to_arrow_table()
    return {k: out.column(k).combine_chunks() for k in ("call_id", "raw", "form")}


def consistent_form(texts: DataFrame) -> DataFrame:
    """``(call_id, form)`` of ``(call_id, text)``, a row for each row."""
    return map_rows(spread(texts.select("call_id", "text")), _forms, "call_id bigint, form string", rows=2048)


def _members(texts: DataFrame) -> DataFrame:
    """``(call_id, raw, form)``: hashes of each text and of its form, blank texts left out."""
    blank = F.length(F.regexp_replace("text", r"(?U)\s+", "")) == 0
    return map_rows(spread(texts.select("call_id", "text").where(~blank)), _hashes, "call_id bigint, raw binary, form binary", rows=2048).distinct()


def _ambiguous(members: DataFrame) -> DataFrame:
    """``(form, raw)``: classes of equal texts whose form other texts have, too."""
    forms = members.groupBy("form", "raw").agg(F.lit(1).alias("one"))
    several = forms.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("form")
    return forms.join(several, "form").select("form", "raw")


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """``(call_id, representative, texts, calls)`` of each call whose text looks like a different one.

    The representative is the smallest call of those that look the same, ``texts`` and ``calls`` are how many different
    texts and how many calls these are.  One row a call, whatever the size of a class.
    """
    members = checkpointed(_members(texts))
    alike = _ambiguous(members).groupBy("form").agg(F.count(F.lit(1)).alias("texts"))
    sizes = members.join(alike, "form").groupBy("form", "texts").agg(F.min("call_id").alias("representative"), F.countDistinct("call_id").alias("calls"))
    return members.join(sizes, "form").select("call_id", "representative", "texts", "calls").distinct()


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """``(call_id_a, call_id_b)`` of calls whose texts are different but have one form.

    Only 128-bit hashes are shuffled, never texts.  Calls with equal texts are one class; classes are paired within a
    form, and only classes that have a partner are expanded to calls, so a hot class costs no more than its result.
    """
    members = checkpointed(_members(texts))  # 40 bytes a call; read several times below
    classes = _ambiguous(members)
    a, b = classes.select("form", F.col("raw").alias("raw_a")), classes.select("form", F.col("raw").alias("raw_b"))
    pairs = a.join(b, "form").where("raw_a < raw_b").select("raw_a", "raw_b")
    calls = members.select("call_id", "raw")
    x = pairs.join(calls.select(F.col("call_id").alias("x"), F.col("raw").alias("raw_a")), "raw_a")
    xy = x.join(calls.select(F.col("call_id").alias("y"), F.col("raw").alias("raw_b")), "raw_b")
    return xy.where("x <> y").select(F.least("x", "y").alias("call_id_a"), F.greatest("x", "y").alias("call_id_b")).distinct()
