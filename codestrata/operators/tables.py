"""Small general operators: counts, first-wins unions, set differences, comparison of two sets of pairs, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts that a group is spread over before it is put together.
SPREAD = 64


def count_by(rows: DataFrame, key: str) -> DataFrame:
    """``key, count``, most frequent first, equal ones by key."""
    return rows.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key)


def first_wins(parts: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """All rows of all parts, of equal keys only the row of the first part (within it the least by ``order``)."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    n = F.row_number().over(W.partitionBy(*key).orderBy("_part", *order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_part", "_n")


def difference(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of the first that the second lacks."""
    return current.select(*key).distinct().join(previous.select(*key).distinct(), key, "left_anti")


def agreement(found: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """One row: true_positives, false_positives, false_negatives, precision, recall (null where undefined)."""
    j = found.select(*key).distinct().withColumn("f", F.lit(1)).join(truth.select(*key).distinct().withColumn("t", F.lit(1)), key, "full_outer")
    tp, fp, fn = (F.count_if(c) for c in (F.col("f").isNotNull() & F.col("t").isNotNull(), F.col("t").isNull(), F.col("f").isNull()))
    a = j.agg(tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"))
    return a.select("*", F.round(F.try_divide("true_positives", F.col("true_positives") + F.col("false_positives")), 4).alias("precision"), F.round(F.try_divide("true_positives", F.col("true_positives") + F.col("false_negatives")), 4).alias("recall"))


def evidence_coverage(judgements: DataFrame, evidence: str = "evidence") -> DataFrame:
    """One row: judgements, with_evidence, share (null when there are none)."""
    n, k = F.count("*"), F.count_if(F.size(evidence) > 0)
    return judgements.agg(n.alias("judgements"), k.alias("with_evidence"), F.round(F.try_divide(k, n), 4).alias("share"))


def dominant(rows: DataFrame, by: list[str], value: str, least: int, threshold: float) -> DataFrame:
    """``by, value, count, total``: the most frequent value of a group with enough samples and share."""
    c = rows.groupBy(*by, value).agg(F.count("*").alias("count"))
    top = c.groupBy(*by).agg(F.sum("count").alias("total"), F.min(F.struct((-F.col("count")).alias("n"), F.col(value).alias("v"))).alias("t"))
    top = top.select(*by, F.col("t.v").alias(value), (-F.col("t.n")).alias("count"), "total")
    return top.filter((F.col("total") >= least) & (F.col("count") >= threshold * F.col("total")))


def fold(rows: DataFrame, by: list[str], subject: str = "subject", most: int = 5) -> DataFrame:
    """``by, count, subject, samples``: distinct subjects counted, the least five as samples, the subject itself where
    there is only one. A hot group is spread by a hash of the subject: each part gives its number and its first five,
    so that a group takes part in the last step with a few rows a part. Null subjects are counted, not sampled."""
    s = rows.select(*by, subject).distinct().withColumn("_part", F.pmod(F.xxhash64(subject), F.lit(SPREAD)))
    rank = F.row_number().over(W.partitionBy(*by, "_part").orderBy(F.asc_nulls_last(subject)))
    parts = s.withColumn("_r", rank).groupBy(*by, "_part").agg(F.count("*").alias("_c"), F.collect_list(F.when(F.col("_r") <= most, F.col(subject))).alias("_s"))
    a = parts.groupBy(*by).agg(F.sum("_c").alias("count"), F.slice(F.array_sort(F.flatten(F.collect_list("_s"))), 1, most).alias("samples"))
    return a.select(*by, "count", F.when(F.col("count") == 1, F.get("samples", F.lit(0))).alias("subject"), "samples")
