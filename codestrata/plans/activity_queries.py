"""Activity, cycles and streaming-style queries on the order tables: an order is a commit, its customer the author, its
parts the files, their brand the module, their type the repository."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import activity, graph
from ..session import table

NOW = datetime(2001, 6, 1)


def _touches(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("module"), F.col("p_type").alias("repo"))
    line = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"))
    return line.join(p, "path").join(o, "sha")


def activity_by_file(spark, folder):
    return activity.activity(_touches(spark, folder), "path", F.lit(NOW).cast("timestamp_ntz"), 90)


def activity_by_module(spark, folder):
    return activity.activity(_touches(spark, folder), "module", F.lit(NOW).cast("timestamp_ntz"), 90)


def top_contributors(spark, folder):
    return activity.top_contributors(_touches(spark, folder), "module").select("repo", "module", F.col("rank").cast("long").alias("rank"), "author", "commits", "touches")


def nearest_rank_quantiles(spark, folder):
    c = _touches(spark, folder).groupBy("repo", "path").agg(F.count_distinct("sha").alias("n"))
    return activity.nearest_rank(c, ["repo"], "n", {"low": 0.33, "high": 0.66})


def event_cycles(spark, folder):
    """Which event types lead to each other, as strongly connected components over all users' consecutive events."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events").select(F.lit("all").alias("repo"), F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target"))
    return graph.cycles(e)


def supplier_reach(spark, folder):
    """Suppliers within two steps of each nation's least supplier, a step being a part that both supply, whoever they
    are: by way of the part, so that no pairs of suppliers are made."""
    to_part = table(spark, folder, "lineitem").filter("l_suppkey IS NOT NULL AND l_partkey IS NOT NULL").select(F.lit("all").alias("repo"), F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).distinct()
    e = to_part.unionByName(to_part.select("repo", F.col("target").alias("source"), F.col("source").alias("target")))
    starts = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s")).select(F.lit("all").alias("repo"), F.concat(F.lit("s"), "s").alias("node"))
    met = graph.reachable(e, starts, 4).filter("node LIKE 's%'")
    return met.groupBy(F.substr("start", F.lit(2)).alias("start"), (F.col("level") / 2).cast("long").alias("level")).agg(F.count("*").alias("reached"))


QUERIES = {f.__name__: f for f in (activity_by_file, activity_by_module, top_contributors, nearest_rank_quantiles, event_cycles, supplier_reach)}

_T = "t AS (SELECT l_orderkey AS sha, l_partkey AS path, p_brand AS module, p_type AS repo, o_custkey AS author, o_orderdate AS ts FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey)"


def _activity(key: str) -> str:
    return f"""WITH {_T}, a AS (SELECT repo, {key}, count(DISTINCT sha) AS changes, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2001-06-01' - INTERVAL 90 DAY THEN sha END) AS recent, strftime(max(ts), '%Y-%m-%d') AS last_changed, count(DISTINCT author) AS authors FROM t GROUP BY ALL),
q AS (SELECT repo, list_sort(list(changes)) AS l FROM a GROUP BY repo), h AS (SELECT repo, l[1 + floor(0.33::DOUBLE * (len(l) - 1) + 0.5)::INT] AS low, l[1 + floor(0.66::DOUBLE * (len(l) - 1) + 0.5)::INT] AS high FROM q)
SELECT a.*, CASE WHEN changes <= 0 THEN 'none' WHEN changes >= greatest(high, 2) THEN 'high' WHEN changes >= greatest(low, 1) THEN 'medium' ELSE 'low' END AS frequency FROM a JOIN h USING (repo)"""


SQL = {
    "activity_by_file": _activity("path"),
    "activity_by_module": _activity("module"),
    "top_contributors": f"WITH {_T} SELECT repo, module, row_number() OVER (PARTITION BY repo, module ORDER BY commits DESC, author) AS rank, author, commits, touches FROM (SELECT repo, module, author, count(DISTINCT sha) AS commits, count(*) AS touches FROM t GROUP BY ALL) QUALIFY rank <= 3",
    "nearest_rank_quantiles": f"WITH {_T}, c AS (SELECT repo, path, count(DISTINCT sha) AS n FROM t GROUP BY ALL), q AS (SELECT repo, list_sort(list(n)) AS l FROM c GROUP BY repo) SELECT repo, l[1 + floor(0.33::DOUBLE * (len(l) - 1) + 0.5)::INT] AS low, l[1 + floor(0.66::DOUBLE * (len(l) - 1) + 0.5)::INT] AS high FROM q",
    "event_cycles": """WITH RECURSIVE n AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), e AS (SELECT DISTINCT a, b FROM n WHERE b IS NOT NULL AND a <> b),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), m AS (SELECT x.a, x.b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b) SELECT 'all' AS repo, least(a, min(b)) AS component, a AS node FROM m GROUP BY a""",
    "supplier_reach": """WITH RECURSIVE l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_suppkey IS NOT NULL AND l_partkey IS NOT NULL), e AS (SELECT DISTINCT x.s AS a, y.s AS b FROM l x JOIN l y ON x.p = y.p WHERE x.s <> y.s),
f AS (SELECT DISTINCT min(s_suppkey) AS start FROM supplier GROUP BY s_nationkey), r AS (SELECT start, start AS node, 0 AS level FROM f UNION SELECT r.start, e.b, r.level + 1 FROM r JOIN e ON e.a = r.node WHERE r.level < 2)
SELECT CAST(start AS VARCHAR) AS start, level, count(*) AS reached FROM (SELECT start, node, min(level)::BIGINT AS level FROM r WHERE node <> start GROUP BY ALL) GROUP BY ALL""",
}
