"""Problem 4: cutting oversized lines into overlapping pieces at natural boundaries.

Greedy cutting is a walk: from boundary ``b`` a piece may run to the farthest boundary within the width, the next
piece starts there less the overlap.  Instead of walking, every boundary is joined to its farthest legal successor in
one pass, and the table of successors is squared again and again (pointer doubling): after k rounds all boundaries
within 2**k steps of a line's start are marked, for all lines of a batch at once.

Defined results: a null text or line gives no rows; a width that is null or below 1 means no limit; the overlap is
clipped to 0 .. width - 1; an empty line is one empty piece only if ``keep_whole`` asks for lines within the width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import FORMATS, format_key, map_rows, with_config

PIECES = "call_id bigint, line_no bigint, piece_no int, start_pos int, end_pos int, piece string"


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the offset of each text (one more than texts)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _table(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode("utf-32-le"), np.uint32)


#: Lines are cut in blocks of so many characters.
BLOCK = 1 << 18

#: A cut is natural after one of these; after closing marks of sentences and clauses, spaces and hyphens.
SPACES = " \t               　"
MARKS = "-‐–—/,;:.!?…。、，！？；：।॥"


def boundaries(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the joined text: whether a cut there is natural, and whether it splits no character cluster.

    A space belongs to the piece before it.  Between two ideographs or kana a cut is natural, too.
    """
    n = len(cp)
    natural, whole = np.zeros(n + 1, bool), np.ones(n + 1, bool)
    if n:
        space = np.isin(cp, _table(SPACES))
        cjk = ((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0x3400) & (cp <= 0x9FFF)) | ((cp >= 0xF900) & (cp <= 0xFAFF))
        mark = np.isin(cp, _table(MARKS))
        after_ok = np.append(space[1:] | cjk[1:], True)
        ascii_mark = mark & (cp < 0x80)
        natural[1:] = space | (mark & (~ascii_mark | (cp == 0x2D) | (cp == 0x2F) | after_ok)) | (cjk & np.append(cjk[1:], False))
        natural[1:-1] &= ~space[1:]  # not before a space: it stays with the piece before it
        joined = (
            ((cp >= 0x300) & (cp <= 0x36F)) | ((cp >= 0x1AB0) & (cp <= 0x1AFF)) | ((cp >= 0x1DC0) & (cp <= 0x1DFF))
            | ((cp >= 0x20D0) & (cp <= 0x20FF)) | ((cp >= 0xFE00) & (cp <= 0xFE0F)) | (cp == 0x200D)
            | ((cp >= 0x1F3FB) & (cp <= 0x1F3FF)) | ((cp >= 0x93A) & (cp <= 0x94F) & (cp != 0x93D))
            | ((cp >= 0x900) & (cp <= 0x903)) | (cp == 0xE31) | ((cp >= 0xE34) & (cp <= 0xE3A)) | ((cp >= 0xE47) & (cp <= 0xE4E))
            | ((cp >= 0x3099) & (cp <= 0x309A))
        )
        whole[:-1] &= ~joined
        whole[1:-1] &= cp[:-1] != 0x200D
        natural &= whole
    whole[offsets] = natural[offsets] = True
    return natural, whole


def _doubled(texts: list[str], widths: np.ndarray, overlaps: np.ndarray, leads: np.ndarray) -> list[np.ndarray]:
    """The cuts of each text by pointer doubling, its start and end included.

    The first piece of a text begins at 0; if ``leads`` is above 0, that many characters repeat what was cut before, and
    the first cut of the text is behind them.
    """
    cp, off = code_points(texts)
    n = len(cp)
    natural, whole = boundaries(cp, off)
    lengths = np.diff(off)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    at = np.arange(n, dtype=np.int32)
    begin, end = off[:-1].astype(np.int32)[owner], off[1:].astype(np.int32)[owner]
    ov, lead = overlaps.astype(np.int32)[owner], leads.astype(np.int32)[owner]
    first = (at == begin) & (lead == 0)
    # In 64 bits, as a width may be larger than what 32 hold; then back, as no position is.
    limit = np.minimum(np.where(first, at, at - ov) + widths.astype(np.int64)[owner], end).astype(np.int32)
    least = np.where(first, np.maximum(begin + ov, begin + 1), at + 1)  # a first piece must hold the overlap
    index = np.arange(n + 1, dtype=np.int32)
    last_natural = np.maximum.accumulate(np.where(natural, index, -1))[limit]
    last_whole = np.maximum.accumulate(np.where(whole, index, -1))[limit]
    step = np.where(limit == end, end, np.where(last_natural >= least, last_natural, np.where(last_whole >= least, last_whole, limit)))
    # A text's end is the next one's start in the joined array, so ends must not be walked on from: cuts are marked per
    # text with positions shifted by the text's number.
    table = np.arange(n + len(texts), dtype=np.int32)  # ends point to themselves
    table[at + owner] = step + owner
    starts = off[:-1] + np.arange(len(texts))
    marked = np.zeros(n + len(texts), bool)
    marked[starts] = True
    reached = starts + leads
    marked[reached] = True
    for _ in range(int(lengths.max()).bit_length() + 1):
        more = table[reached]
        more = more[~marked[more]]
        if not len(more):
            break
        marked[more] = True
        reached = np.flatnonzero(marked)
        reached = reached[~np.isin(reached, starts[leads > 0])]
        table = table[table]
    found = np.flatnonzero(marked)
    bounds = np.searchsorted(found, np.append(starts, n + len(texts)))
    return [found[a:b] - s for a, b, s in zip(bounds[:-1], bounds[1:], starts)]


def cut(texts: list[str], widths: np.ndarray, overlaps: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """The cuts of each text: its start, where pieces end, its end.  ``widths`` are above 0.

    A text longer than ``block`` is taken a block at a time, each beginning where the one before was cut last, so that
    memory does not grow with the longest line.
    """
    widths = np.maximum(np.asarray(widths, np.int64), 1)
    overlaps = np.clip(np.asarray(overlaps, np.int64), 0, widths - 1)
    out: list[np.ndarray] = [np.zeros(1, np.int64) for _ in texts]
    short = [k for k, t in enumerate(texts) if 0 < len(t) <= max(block, 4 * widths[k])]
    if short:
        none = np.zeros(len(short), np.int64)
        for k, cuts in zip(short, _doubled([texts[k] for k in short], widths[short], overlaps[short], none)):
            out[k] = cuts
    for k, text in enumerate(texts):
        size = int(max(block, 4 * widths[k]))
        if len(text) <= size:
            continue
        w, ov = widths[k : k + 1], overlaps[k : k + 1]
        parts, at = [np.zeros(1, np.int64)], 0
        while at < len(text):
            lead = int(ov[0]) if at else 0
            a = at - lead
            cuts = _doubled([text[a : a + size]], w, ov, np.array([lead]))[0]
            cuts = cuts[cuts > lead] + a
            if a + size < len(text):  # cuts that the end of the block has a part in are not yet known
                cuts = cuts[cuts < a + size - int(w[0]) - 2] if len(cuts) > 1 else cuts
            parts.append(cuts)
            at = int(cuts[-1])
        out[k] = np.concatenate(parts)
    return out


def _cut_batch(batch: pa.RecordBatch) -> dict:
    texts = batch.column("line").to_pylist()
    widths, overlaps = batch.column("width").to_numpy(zero_copy_only=False), batch.column("overlap").to_numpy(zero_copy_only=False)
    calls, lines = batch.column("call_id").to_pylist(), batch.column("line_no").to_pylist()
    out: dict[str, list] = {k: [] for k in ("call_id", "line_no", "piece_no", "start", "end", "piece")}
    for text, cuts, w, ov, call, line in zip(texts, cut(texts, widths, overlaps), widths, overlaps, calls, lines):
        ov = min(max(int(ov), 0), int(w) - 1)
        pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist())) or [(0, 0)]
        for k, (a, b) in enumerate(pairs):
            s = a - ov if k else a
            for name, x in zip(out, (call, line, k, s, b, text[s:b])):
                out[name].append(x)
    return out


def effective_width() -> Column:
    """The width that holds for a call, from columns ``max_width``, ``of_format`` and ``of_project``."""
    return F.when(F.col("max_width") > 0, F.col("max_width")).otherwise(F.coalesce("of_format", "of_project", F.lit(0)))


def lines_of_calls(calls: DataFrame, configs: DataFrame) -> DataFrame:
    """A row for each line, with the width and overlap that hold for it."""
    per_format = [F.col(f"{f}.max_width").alias(f"w_{f}") for f in FORMATS]
    known = with_config(
        calls.where(F.col("text").isNotNull()).select("call_id", "project_id", "text", "format", "max_width", "piece_overlap"),
        configs, F.col("max_width").alias("of_project"), *per_format,
    )
    key = format_key(F.col("format"))
    of_format = F.coalesce(*[F.when(key == f, F.col(f"w_{f}")) for f in FORMATS])
    return (
        known.withColumn("of_format", of_format)
        .withColumn("width", effective_width())
        .withColumn("overlap", F.coalesce("piece_overlap", F.lit(0)))
        .select("call_id", "width", "overlap", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
        .select("call_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line", "width", "overlap")
    )


def pieces(calls: DataFrame, configs: DataFrame) -> DataFrame:
    """The pieces of each line that is longer than its width, in order: columns of ``PIECES``.

    Lines within their width never leave the JVM; they are their own single piece and give no rows.
    """
    lines = lines_of_calls(calls, configs).where((F.col("width") > 0) & (F.length("line") > F.col("width")))
    return map_rows(lines, _cut_batch, PIECES, step_bytes=2 << 20)


def oversized_lines(calls: DataFrame, configs: DataFrame) -> DataFrame:
    """``(call_id, line_no)`` of each line that was cut: those with a second piece; redelivered calls count once."""
    return pieces(calls, configs).where(F.col("piece_no") == 1).select("call_id", "line_no").distinct()
