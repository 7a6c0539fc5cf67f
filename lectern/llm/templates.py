"""Template deduction by equivalence classes, for the pages of one host (here: the texts of one project).

Tokens that occur equally often on the same pages have equal occurrence vectors and form a class.  A
class is valid if its tokens have one order on all its pages, and if it crosses no other class there, so that classes
nest.  A host's template is its valid classes in the order of their first tokens; what stands between template tokens
of a page are its slots.  Tokens are the marks and the words of a page; a word that occurs on few pages of its host is in
no class of size, so it ends up in a slot.

Vectors are never gathered: the pages of a token are folded into two 64-bit hashes and two counts, so one aggregate
with partial sums gives the classes whatever the size of a host.

Defined results: null hosts are one host of their own (-1); null texts have no tokens; repeated rows of a page count
once; hosts without a class that holds on ``PAGES`` pages have no template.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from lectern.llm.common import map_rows
from lectern.runtime import checkpointed, small_side

#: A class holds on at least so many pages, and has at least so many tokens.
PAGES, TOKENS = 3, 2
MARK = re.compile(
    r"</?[A-Za-z][A-Za-z0-9]*|<!--|-->|&\w+;|\\[A-Za-z]+|#\+\w+|^[ \t]*:[A-Z_]+:|\.\.[ \t]+[\w-]+::|:[a-z]+:`|^#{1,6}(?=[ \t])|^\*+(?=[ \t])|`{3,}|~{3,}|\{\||\|\}|^\|-|\{\{|\}\}"
    r"|\[\[|\]\]|'''?|={2,6}|\$\$?|@@|\*\*|\]\(|^>|^[ \t]*[-+](?=[ \t])",
    re.M,
)
WORD = re.compile(r"\w+")


def marks(text: str) -> list[tuple[str, int, int]]:
    """The tokens of a page: its marks, and the words between them."""
    out: list[tuple[str, int, int]] = []
    at = 0
    for m in MARK.finditer(text):
        out += [(w[0], w.start(), w.end()) for w in WORD.finditer(text, at, m.start())]
        out.append((m[0].strip(), m.start(), m.end()))
        at = m.end()
    out += [(w[0], w.start(), w.end()) for w in WORD.finditer(text, at)]
    return out


def _page_tokens(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("token", "n", "first", "last")}
    for text in batch.column("text").to_pylist():
        found = marks(text)
        counts = Counter(t for t, _, _ in found)
        last = {token: at for token, at, _ in found}
        first = {token: at for token, at, _ in reversed(found)}
        for name, of_page in zip(out, (list(counts), list(counts.values()), [first[t] for t in counts], [last[t] for t in counts])):
            out[name].append(of_page)
    return {"host": batch.column("host"), "page": batch.column("page"), **out}


def pages_of(pages: DataFrame, host: str, page: str, text: str) -> DataFrame:
    """``(host, page, text)``, each page once."""
    rows = pages.where(F.col(text).isNotNull() & F.col(page).isNotNull())
    return rows.select(F.coalesce(F.col(host).cast("bigint"), F.lit(-1)).alias("host"), F.col(page).cast("bigint").alias("page"), F.col(text).alias("text")).distinct()


def packed_tokens(pages: DataFrame, host: str = "project_id", page: str = "call_id", text: str = "text") -> DataFrame:
    """A row for each page, with the tokens of it in arrays, which is a third of the size of rows."""
    schema = "host bigint, page bigint, token array<string>, n array<int>, first array<int>, last array<int>"
    return map_rows(pages_of(pages, host, page, text), _page_tokens, schema)


def page_tokens(packed: DataFrame) -> DataFrame:
    """``(host, page, token, n, first, last)``: how often and where each token occurs on each page."""
    return packed.select("host", "page", F.inline(F.arrays_zip("token", "n", "first", "last")))


def classes(tokens: DataFrame, pages: int = PAGES) -> DataFrame:
    """``(host, class, support, token)``: tokens of equal occurrence vectors, of classes that are large enough."""
    seen = F.struct("page", "n")
    vectors = tokens.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64(seen)).alias("v"), F.bit_xor(F.xxhash64(F.lit(7), seen)).alias("w"), F.count(F.lit(1)).alias("support"), F.sum("n").alias("total")
    )
    often = vectors.where(F.col("support") >= pages).withColumn("class", F.xxhash64("v", "w", "support", "total"))
    large = often.groupBy("host", "class").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= TOKENS)
    return often.join(small_side(large.select("host", "class")), ["host", "class"]).select("host", "class", "support", "token")


def crossing(spans: list[tuple[int, int, int]]) -> set[int]:
    """Of ``(first, last, class)`` on one page: the classes that begin inside an earlier one and end behind it."""
    found, ends, due = set(), [], []
    at = None
    for first, last, name in sorted(spans):
        if first != at:
            for x in due:
                insort(ends, x)
            at, due = first, []
        k = bisect_right(ends, first)
        if k < len(ends) and ends[k] < last:
            found.add(name)
        due.append(last)
    return found


@arrow_udf(ArrayType(LongType()))
def _crossing(pages: pa.Array) -> pa.Array:
    return pa.array([list(crossing([(x["first"], x["last"], x["class"]) for x in page or ()])) for page in pages.to_pylist()], pa.list_(pa.int64()))


def templates(pages: DataFrame, host: str = "project_id", page: str = "call_id", text: str = "text", least: int = PAGES) -> DataFrame:
    """``(host, class_no, tokens, support)``: the valid, nested classes of each host in order."""
    tokens = page_tokens(checkpointed(packed_tokens(pages, host, page, text)))  # read for vectors, orders and spans
    members = tokens.join(small_side(checkpointed(classes(tokens, least))), ["host", "token"])
    on_page = members.groupBy("host", "class", "support", "page").agg(
        F.array_sort(F.collect_list(F.struct("first", "token"))).alias("order"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    on_page = on_page.withColumn("tokens", F.col("order.token"))
    ordered = on_page.groupBy("host", "class", "support").agg(F.min("tokens").alias("tokens"), F.max("tokens").alias("other"), F.avg("first").alias("at")).where("tokens = other")
    ordered = checkpointed(ordered)  # a row a class
    spans = on_page.join(small_side(ordered.select("host", "class")), ["host", "class"]).groupBy("host", "page").agg(F.collect_list(F.struct("first", "last", "class")).alias("all"))
    crossing = spans.select("host", F.explode(_crossing("all")).alias("class")).distinct()
    valid = ordered.join(crossing, ["host", "class"], "left_anti")
    numbered = valid.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "class", "tokens", "support"))).alias("all"))
    return numbered.select("host", F.posexplode("all").alias("class_no", "c")).select("host", "class_no", "c.tokens", "c.support")


def slots_of(text: str, template: set[str]) -> list[str]:
    """What stands between the template's tokens on a page."""
    out, at = [], 0
    for token, start, end in marks(text):
        if token in template:
            if piece := text[at:start].strip():
                out.append(piece)
            at = end
    if piece := text[at:].strip():
        out.append(piece)
    return out


def slots(pages: DataFrame, host: str = "project_id", page: str = "call_id", text: str = "text", least: int = PAGES) -> DataFrame:
    """``(host, page, slot_no, slot)``: what of each page is left between the tokens of its host's template.

    Pages of hosts without a template are one slot.  A template is one row a host, joined by it: broadcast while small.
    """

    def of_batch(batch: pa.RecordBatch) -> dict:
        rows = []
        for h, p, body, template in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "text", "template"))):
            rows += [(h, p, k, slot) for k, slot in enumerate(slots_of(body, set(template or ())))]
        names = ("host", "page", "slot_no", "slot")
        return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    held = templates(pages, host, page, text, least).groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("template"))
    rows = pages_of(pages, host, page, text).join(small_side(checkpointed(held)), "host", "left")
    return map_rows(rows, of_batch, "host bigint, page bigint, slot_no int, slot string")
