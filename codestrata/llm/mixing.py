"""Mixing sources to target weights, by hash thresholds and without sorting.

Every record has a fixed place in [0, 2**36) by the hash of its key. Tokens are summed by source and hash
bucket; the bucket in which a source's budget runs out is found by a running sum over its buckets, and only
that bucket is divided again. Records below the threshold are drawn. Since the places don't depend on the
mix, a larger budget draws a superset of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .tokenizing import token_counts

LEVELS, LEVEL_BITS = 3, 12
#: Rows of targets that are sent to every worker; a matter of speed only.
MOST_SENT = 100_000


def targets_of(targets: DataFrame) -> DataFrame:
    """One row per mix and source: weights of repeated rows are added, the least ``max_repeats`` holds. A null
    ``max_repeats`` means that records are used once; rows without a positive weight or with a null mix or
    source ask for nothing."""
    return (
        targets.filter("mix_name IS NOT NULL AND source IS NOT NULL AND weight > 0 AND NOT isnan(weight) AND weight < double('inf')")
        .groupBy("mix_name", "source")
        .agg(F.sum("weight").alias("weight"), F.greatest(F.min(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"))
    )


def budgets(targets: DataFrame, sizes: DataFrame, total: float | None = None) -> DataFrame:
    """Per mix and source its share and budget of tokens. The total is the largest at which every source that
    has records reaches its share within its repeats; with ``total`` given, a source gets its share of it as
    far as its repeats go. Sources without tokens, or that may not be used, get nothing; the others' weights
    count as a whole."""
    t = targets_of(targets).join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0)
    mix = W.partitionBy("mix_name")
    share = F.when(usable, F.col("weight") / F.sum(F.when(usable, F.col("weight"))).over(mix)).otherwise(0.0)
    t = t.withColumn("share", share).withColumn("asked", F.col("weight") / F.sum("weight").over(mix))
    reach = F.min(F.when(usable, F.col("available") * F.col("max_repeats") / F.col("share"))).over(mix)
    size = reach if total is None else F.lit(float(total))
    most = (F.col("available") * F.col("max_repeats")).cast("double")
    t = t.withColumn("budget", F.when(usable, F.least(F.col("share") * size, most)).otherwise(0.0))
    # whole copies of the source, and what is left for a part of it (a rounding error of the last bit is no copy)
    whole = F.least(F.floor(F.col("budget") / F.greatest(F.col("available"), F.lit(1)) + 1e-9), F.col("max_repeats"))
    return t.withColumn("copies", whole.cast("int")).withColumn("rest", F.when(whole >= F.col("max_repeats"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("budget") - whole * F.col("available"))))


def place(key: str, seed: int):
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 64 - LEVELS * LEVEL_BITS)


def mix(documents: DataFrame, targets: DataFrame, tokenizer_path: str, total: float | None = None, seed: int = 7, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(draws, shares).

    Draws: ``mix_name, doc_id, source, tokens, copies`` of the records with at least one copy. Shares:
    ``mix_name, source, target_share, available_tokens, drawn_tokens, share, max_copies`` of each target row.
    A draw never exceeds a source's budget and misses it by less than the records of the last boundary
    bucket (a 2**-36 of the source, mostly one record). Null, empty texts: no tokens; they are drawn with
    whole copies or by their place. Records with a null source, or one that no mix names, aren't drawn.
    Repeated rows are records of their own with the same place.

    Plan: texts are read once, for the token counts, which are written to the shared folder (a few bytes a
    record). Each level adds map-side sums by source and bucket; only sums are shuffled. Targets, budgets
    and thresholds have one row per mix and source, the user's list of targets; they are counted, and sent to all
    workers up to MOST_SENT rows. A longer list is joined by AQE's choice, which splits hot sources."""
    counted = cut(token_counts(documents, tokenizer_path, [key, "source"]).filter("source IS NOT NULL").withColumn("place", place(key, seed)))
    sizes = counted.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = cut(budgets(targets, sizes, total))
    few = plan.count() <= MOST_SENT
    sent = lambda rows: F.broadcast(rows) if few else rows
    # below: the first place that isn't drawn; left: budget that is left for the open bucket
    open_ = plan.select("mix_name", "source", F.lit(0).cast("long").alias("below"), F.col("rest").alias("left"))
    for level in range(1, LEVELS + 1):
        width = 1 << (LEVELS - level) * LEVEL_BITS
        above = width << LEVEL_BITS
        inside = counted.join(sent(open_.filter("left > 0")), "source").filter((F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + above))
        sums = inside.groupBy("mix_name", "source", "below", "left", F.floor((F.col("place") - F.col("below")) / width).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        running = F.sum("tokens").over(W.partitionBy("mix_name", "source").orderBy("bucket"))
        at = sums.withColumn("upto", running).filter(F.col("upto") > F.col("left"))
        first = at.groupBy("mix_name", "source").agg(F.min(F.struct("bucket", "upto", "tokens", "below", "left")).alias("f"))
        open_ = cut(
            first.select("mix_name", "source", (F.col("f.below") + F.col("f.bucket") * width).cast("long").alias("below"), (F.col("f.left") - (F.col("f.upto") - F.col("f.tokens"))).alias("left"), F.lit(True).alias("bounded")).drop("bounded")
            .unionByName(open_.filter("left <= 0"))
        )
    cuts = plan.join(open_.select("mix_name", "source", "below"), ["mix_name", "source"], "left").select("mix_name", "source", "copies", F.coalesce("below", F.lit(0)).alias("below"))
    copies = F.col("copies") + (F.col("place") < F.col("below")).cast("int")
    draws = counted.join(sent(cuts), "source").withColumn("copies", copies).filter("copies > 0").select("mix_name", key, "source", "tokens", "copies")
    drawn = draws.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("max_copies"))
    done = F.coalesce("drawn_tokens", F.lit(0))
    shares = plan.join(drawn, ["mix_name", "source"], "left").select(
        "mix_name", "source", F.round("asked", 6).alias("target_share"), F.col("available").alias("available_tokens"), done.alias("drawn_tokens"),
        F.round(F.coalesce(F.try_divide(done, F.sum(done).over(W.partitionBy("mix_name"))), F.lit(0.0)), 6).alias("share"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"))
    return draws, shares
