"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Weights given to the sources in code point order, null last, again and again.
WEIGHTS = (5, 2, 1)
#: Most epochs of a source.
MOST_EPOCHS = 3
#: A source's keys are histogrammed into so many bins before any of them is ordered.
BINS = 4096
#: The table of sources is broadcast only up to so many rows; beyond that it is joined as any other.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"
#: Signs whose share of a text lowers its quality weight.
NOISE = "!#$%&*|"


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """In (0, 1]: falls with the share of noise signs; 1 for empty and null texts."""
    clean = F.length(F.translate(text, NOISE, ""))
    share = (F.length(text) - clean).cast("double") / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(1.0 / (1.0 + 10.0 * share), F.lit(1.0))


def sampling_key(ident: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) drawn from the id and the seed, so that reruns agree."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(ident.cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the total is shared by weight, no target above
    ``most_epochs`` times its source's size, the excess going to the others by weight.

    Filling from the source whose cap comes first needs one ordered pass over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("double")).withColumn("cap", (most_epochs * F.col("source_size")).cast("double"))
    rows = rows.withColumn("at", F.col("cap") / F.col("w"))
    every = Window.partitionBy()
    ranked = Window.orderBy("at", F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(ranked))
    rows = rows.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("heavy", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / F.col("heavy"))
    # The first source whose cap is not below its share sets the level for itself and all after it.
    first = F.min(F.when(F.col("level") <= F.col("at"), F.struct("place", "level"))).over(every)
    rows = rows.withColumn("first", first)
    target = F.when(F.col("place") < F.col("first.place"), F.col("cap")).otherwise(F.col("first.level") * F.col("w"))
    return rows.select("source", "source_size", F.coalesce(target, F.col("cap")).alias("target"))


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with mix_size, mix_key and mix_bin."""
    out = docs.withColumn("mix_size", size_of(F.col("text")))
    out = out.withColumn("mix_key", sampling_key(F.col("doc_id"), quality_weight(F.col("text")), seed))
    return out.withColumn("mix_bin", F.floor((1.0 - F.exp(-F.col("mix_key"))) * BINS).cast("int"))


def cutoffs(slim: DataFrame, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS, whole: bool = False) -> DataFrame:
    """One row per source: its size, target, whole epochs and the key at which the fractional epoch ends.

    Sizes are summed per (source, bin) before the shuffle, prefix sums run over at most BINS rows a
    source, and only the documents of the one bin that the budget falls into are put in order.
    """
    bins = slim.groupBy("source", "mix_bin").agg(F.sum("mix_size").alias("bin_size"))
    bins = cut(bins, "bins")
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs)
    targets = targets.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    targets = cut(targets, "targets")
    below = Window.partitionBy("source").orderBy("mix_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(below), F.lit(0)))
    t = targets.select(F.col("source").alias("s"), "rest")
    edge = bins.join(t, F.col("source").eqNullSafe(F.col("s")))
    edge = edge.where("before < rest AND rest <= before + bin_size").select("s", F.col("mix_bin").alias("b"), "before", "rest")
    near = slim.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("mix_bin") == F.col("b")))
    # Rows that repeat an id and a key are one step, whose words are shared evenly.
    steps = near.groupBy("s", "before", "rest", "mix_key", "doc_id").agg(F.sum("mix_size").alias("step"), F.count("*").alias("n"))
    order = Window.partitionBy("s").orderBy("mix_key", F.col("doc_id").asc_nulls_last())
    steps = steps.withColumn("sum", F.col("before") + F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hit = steps.where("sum - step < rest AND rest <= sum")
    part = F.floor((F.col("rest") - F.col("sum") + F.col("step")) / F.col("n")).cast("long")
    if whole:
        part = F.when(2 * (F.col("rest") - F.col("sum") + F.col("step")) >= F.col("step"), F.floor(F.col("step") / F.col("n")).cast("long")).otherwise(0)
    hit = hit.select("s", F.col("mix_key").alias("cut_key"), F.col("doc_id").alias("cut_id"), part.alias("cut_part"))
    ends = targets.join(hit, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")
    return cut(ends.withColumnRenamed("source", "cut_source"), "ends")


def taken(measured_docs: DataFrame, ends: DataFrame) -> DataFrame:
    """``measured_docs`` with source_size, target, epochs, mix_part (words of the fractional epoch) and taken."""
    if ends.count() <= BROADCAST_SOURCES:
        ends = F.broadcast(ends)
    rows = measured_docs.join(ends, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    low = (F.col("mix_key") < F.col("cut_key")) | (
        (F.col("mix_key") == F.col("cut_key")) & (F.coalesce(F.col("doc_id") < F.col("cut_id"), F.col("doc_id").isNotNull() & F.col("cut_id").isNull()))
    )
    part = F.when(F.col("cut_key").isNull(), 0).when(low, F.col("mix_size"))
    part = part.when((F.col("mix_key") == F.col("cut_key")) & F.col("doc_id").eqNullSafe(F.col("cut_id")), F.least("cut_part", "mix_size")).otherwise(0)
    rows = rows.withColumn("mix_part", part.cast("long"))
    return rows.withColumn("taken", F.col("epochs") * F.col("mix_size") + F.col("mix_part"))


def plan_mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    A null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; rows that
    repeat an id share what one of them would get at the cut; an empty table gives no rows. Other
    columns are not read.
    """
    slim = cut(measured(docs.select("doc_id", "text", "source"), seed).drop("text"), "sizes")
    rows = taken(slim, cutoffs(slim, weights, most_epochs))
    return rows.select("doc_id", "source", F.col("mix_size").alias("size"), "source_size", "target", "taken")


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The mixed corpus itself: each document as often as whole epochs and the fractional one take it.

    The document at the cut is taken whole if more than half of it fits, so texts stay whole.
    Documents without words are kept once per whole epoch, at least once. Columns are those of ``docs``.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    own = docs.select("doc_id", "text", "source", *([F.struct(*others).alias("mix_others")] if others else []))
    slim = cut(measured(own.select("doc_id", "text", "source"), seed).drop("text"), "sizes")
    rows = taken(measured(own, seed), cutoffs(slim, weights, most_epochs, whole=True))
    times = (F.col("epochs") + (F.col("mix_part") > 0).cast("long")).cast("int")
    times = F.when(F.col("mix_size") == 0, F.greatest(times, F.lit(1))).otherwise(times)
    rows = rows.select("doc_id", "text", "source", *(["mix_others"] if others else []), F.explode(F.array_repeat(F.lit(True), times)).alias("mix_copy"))
    return rows.select(*[F.col("mix_others")[c].alias(c) if c in others else F.col(c) for c in docs.columns])
