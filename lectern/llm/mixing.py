"""Problem 7: mixing sources to target weights by a time-varying curriculum.

Each source's weight changes over the training time t in 0..1; its integral over the whole time is its target share.
Weights are linear: ``share * (1 + tilt * lean * (2t - 1))``, where a source leans towards the end the more it has to
be repeated (its need, centred on the share-weighted mean, so that all weights sum to 1 at every t).  The cumulative
demand of a source is the integral times the total size.  Its documents lie one after another on its own axis of
tokens, again and again as often as allowed; inverting the demand gives the time at which each is due, and the mixture
is range-sorted by that time.

Defined results: documents whose source is null or has no target are left out; a null or empty text has no tokens but
is placed like any other; sources without documents appear in the report with nothing; several target rows for one
source are added up, with the largest cap; null shares and caps count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import small_side

#: How strongly weights change over time, 0 (not at all) to 1.
TILT = 0.5
#: Documents of a source are laid out in blocks of about so many, so that a source of any size is spread over many tasks.
BLOCK_ROWS = 20_000


def targets_of(targets: DataFrame) -> DataFrame:
    return (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    )


def integral(t, share, lean, tilt: float):
    """The integral of a source's weight from 0 to ``t``: its share of all tokens up to then; at 1 the share itself."""
    return share * (t + F.lit(tilt) * lean * (t * t - t))


def schedule(sized: DataFrame, targets: DataFrame, tilt: float = TILT) -> DataFrame:
    """A row for each source with a target: what it has, its lean, and its demand over the whole time.

    ``sized`` has ``(source, tokens)`` per document.  Everything after the first aggregate has a row per source.
    """
    has = sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("of_source"), F.count(F.lit(1)).alias("documents"))
    wanted = targets_of(targets).join(has, "source", "left").fillna({"of_source": 0, "documents": 0})
    everything = Window.partitionBy(F.lit(1))  # one row per source
    need = F.when(F.col("of_source") > 0, F.least(F.lit(1.0), F.col("share") * F.col("total") / (F.col("of_source") * F.greatest("max_repeats", F.lit(1))))).otherwise(1.0)
    mean = F.sum(F.col("share") * F.col("need")).over(everything) / F.sum("share").over(everything)
    return (
        wanted.withColumn("total", F.sum("of_source").over(everything))
        .withColumn("need", need)
        .withColumn("lean", F.coalesce(F.col("need") - mean, F.lit(0.0)))
        .withColumn("demand", integral(F.lit(1.0), F.col("share"), F.col("lean"), tilt) * F.col("total"))
        .drop("need")
    )


def due(u, demand, lean, tilt: float):
    """The time at which the cumulative demand reaches ``u``: the root in 0..1 of a*t*t + (1 - a)*t = u / demand."""
    a, v = F.lit(tilt) * lean, F.least(u / demand, F.lit(1.0))
    b = F.lit(1.0) - a
    return F.when(F.abs(a) < 1e-9, v).otherwise(F.least(2.0 * v / (b + F.sqrt(F.greatest(b * b + 4.0 * a * v, F.lit(0.0)))), F.lit(1.0)))


def placed(sized: DataFrame, plan: DataFrame, tilt: float = TILT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id, source, tokens, repeat_no, start, position)`` of each copy that is taken.

    ``sized`` has ``(doc_id, source, tokens)``.  A document's place on its source's axis is a prefix sum in two levels:
    over blocks (by a hash of the id; as many as the source's documents need), then inside a block.  A copy is taken if
    it starts before the demand of the whole time is met; its position is when the demand reaches its middle.
    """
    plan = small_side(plan.select("source", "of_source", "documents", "max_repeats", "lean", "demand"))
    docs = sized.select("doc_id", "source", "tokens").join(plan, "source")
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("documents") / F.lit(block_rows))))
    per_block = docs.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    before = per_block.select(
        "source", "block",
        F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id"), "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    laid = docs.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, ["source", "block"])
    rounds = F.when(F.col("of_source") > 0, F.least(F.col("max_repeats").cast("bigint"), F.ceil(F.col("demand") / F.col("of_source")))).otherwise(F.least(F.col("max_repeats"), F.lit(1)))
    copies = laid.where(rounds > 0).withColumn("repeat_no", F.explode(F.sequence(F.lit(1), rounds.cast("int"))))
    at = copies.withColumn("start", F.col("before") + F.col("within") + (F.col("repeat_no") - 1) * F.col("of_source"))
    taken = at.where((F.col("start") < F.col("demand")) | (F.col("of_source") == 0))
    position = F.when(F.col("demand") > 0, due(F.col("start") + F.col("tokens") / 2.0, F.col("demand"), F.col("lean"), tilt)).otherwise(0.0)
    return taken.select("doc_id", "source", "tokens", "repeat_no", "start", position.alias("position"))


def mixture(sized: DataFrame, targets: DataFrame, tilt: float = TILT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(doc_id, source, tokens, repeat_no, position)`` in the order of training, without a sort in one task."""
    timed = placed(sized, schedule(sized, targets, tilt), tilt, block_rows).drop("start")
    return timed.repartitionByRange("position").sortWithinPartitions("position", "source", "doc_id", "repeat_no")


def report(sized: DataFrame, targets: DataFrame, tilt: float = TILT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each source with a target: what it has, should give, and really gives in the mixture.

    ``given`` and ``copies`` count the copies that were placed, ``actual_share`` is the share of them all, ``most_repeats``
    how often a document was taken at most, ``runs_out_at`` the time from which on the source has nothing left to give
    (null where it meets its demand).
    """
    plan = schedule(sized, targets, tilt)
    sums = placed(sized, plan, tilt, block_rows).groupBy("source").agg(
        F.sum("tokens").alias("given"), F.count(F.lit(1)).alias("copies"), F.max("repeat_no").alias("most_repeats"), F.max(F.col("start") + F.col("tokens")).alias("supply")
    )
    got = plan.join(sums, "source", "left").fillna({"given": 0, "copies": 0, "most_repeats": 0, "supply": 0})
    everything = Window.partitionBy(F.lit(1))  # one row per source
    # The axis of a source ends where its last copy ends: the demand that lies beyond is never met.
    out = F.when(F.col("supply") < F.col("demand"), due(F.col("supply"), F.col("demand"), F.col("lean"), tilt))
    return got.select(
        "source", "documents", F.col("of_source").alias("tokens"), "share", "max_repeats", "lean", "demand", "copies", "given", "most_repeats",
        F.coalesce(F.col("given") / F.nullif(F.sum("given").over(everything), F.lit(0)), F.lit(0.0)).alias("actual_share"), out.alias("runs_out_at"),
    )


def short_sources(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """The sources whose copies run out before their demand over the whole time is met."""
    return report(sized, targets).where(F.col("runs_out_at").isNotNull()).select("source")
