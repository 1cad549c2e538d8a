"""Processing only new or changed records.

High-watermark on a monotonic commit sequence. A step fixes its upper limit when it starts and reads nothing newer, finds
the runs whose deliveries up to the limit aren't those that the last commit saw, handles these, and commits its output
together with the new watermark by creating one file that must not exist. A step that dies before leaves nothing that a
reader or a later step sees; the step after it starts from the old watermark.

The commit sequence of a delivery is the time at which it arrived (``updated_at`` of a run's row, ``arrived_at`` of a
file record). Such a clock has ties, and rows may become visible after the watermark has passed them or have no time at
all. So each commit also keeps, of each run, the number and the digest of the rows it saw: whatever makes them differ is
handled, and nothing else. A row belongs to the run that it names: the run, and the next succeeded run of its root (whose
base it is), are handled again, and the newer commit's rows replace the older commit's rows of those runs. The rows of
all commits together equal what one pass over everything up to the upper limit gives.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.spelling import plain_hash, plain_path

RUN_FIELDS = ("root_id", "run_no", "status", "config_hash", "tool_version")


def final_runs(runs: DataFrame) -> DataFrame:
    """One row per run: the one with the greatest ``updated_at`` (null is the least; equal ones by their fields)."""
    best = F.max(F.struct("updated_at", "status", "config_hash", "tool_version", "root_id", "run_no"))
    return runs.groupBy("run_id").agg(best.alias("b")).select("run_id", *(F.col(f"b.{c}").alias(c) for c in RUN_FIELDS))


def succeeded_in_order(runs: DataFrame) -> DataFrame:
    """The succeeded runs of each root, numbered from 1 by ``run_no``; ``same_setup`` tells whether the
    one before ran with the same configuration and tool version (two nulls are the same)."""
    w = W.partitionBy("root_id").orderBy("run_no", "run_id")
    ok = final_runs(runs).filter(F.col("status") == "succeeded")
    same = F.col("config_hash").eqNullSafe(F.lag("config_hash").over(w)) & F.col("tool_version").eqNullSafe(F.lag("tool_version").over(w))
    return ok.select("run_id", "root_id", F.row_number().over(w).alias("ordinal"), F.lag("run_id").over(w).alias("base_run"), same.alias("same_setup"))


def _until(rows: DataFrame, seq: str, high: datetime | None) -> DataFrame:
    """The rows up to the limit; a null sequence is before any limit."""
    return rows if high is None else rows.filter(F.col(seq).isNull() | (F.col(seq) <= F.lit(high)))


def upper_limit(runs: DataFrame, state: DataFrame) -> datetime | None:
    """The greatest commit sequence that is there now; None where both tables are empty or without any."""
    tops = [runs.agg(F.max("updated_at")).first()[0], state.agg(F.max("arrived_at")).first()[0]]
    return max((t for t in tops if t is not None), default=None)


def deliveries(runs: DataFrame, state: DataFrame, high: datetime | None) -> DataFrame:
    """``run_id, n, digest``: of each run the rows that were delivered up to the limit, summed before they are shuffled.
    Equal rows count each, so that the digest (a sum) doesn't lose them."""
    r = _until(runs, "updated_at", high).select("run_id", F.xxhash64(F.lit(1), "updated_at", *RUN_FIELDS).alias("h"))
    s = _until(state, "arrived_at", high).select("run_id", F.xxhash64(F.lit(2), "arrived_at", "path", "hash").alias("h"))
    h = F.col("h").cast("decimal(20,0)")
    return r.union(s).groupBy("run_id").agg(F.count("*").alias("n"), F.sum(h).alias("digest"))


def changed_records(runs: DataFrame, state: DataFrame, high: datetime | None = None, new: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(cases, touched runs) of the deliveries up to ``high``.

    Cases (``run_id, path, hash``): the files that a succeeded run lists with a hash, where the root has
    no earlier succeeded run, or the nearest one did not list the file, gave another, an empty or a null
    hash, or ran with another configuration or tool version. ``new``: the runs (``run_id``) with deliveries that weren't
    handled yet; None means all, and then the second result is None.

    Null hash or empty hash: never a case, and a base that gives none. Null path: a name like any other.
    Runs with a null root form one root of their own. A file listed more than once in a run: the greatest
    ``arrived_at`` holds, equal ones by the greatest hash. Empty tables give no rows. Further columns are
    ignored. Plan: file records are shuffled by run to join the run's place in its root (an inner join that
    AQE splits where one run is hot, and broadcasts the runs where a step touches few) and once by (root, path); both
    windows use that one exchange and sort.
    """
    runs = _until(runs.select("run_id", "updated_at", *RUN_FIELDS), "updated_at", high)
    state = _until(state.select("run_id", plain_path(F.col("path")).alias("path"), plain_hash(F.col("hash")).alias("hash"), "arrived_at"), "arrived_at", high)
    order = succeeded_in_order(runs)
    touched = None
    if new is not None:
        # a run that no longer counts changes the base of the next one as well: its whole root is put in order again
        roots = final_runs(runs).join(new, "run_id", "left_semi").select("root_id").distinct()
        near = order.join(roots, order.root_id.eqNullSafe(roots.root_id), "left_semi")
        mark = new.withColumn("new", F.lit(True))
        w = W.partitionBy("root_id").orderBy("run_no", "run_id")
        in_root = final_runs(runs).join(roots.withColumnRenamed("root_id", "r"), F.col("root_id").eqNullSafe(F.col("r")), "left_semi").join(mark, "run_id", "left")
        # touched: delivered anew, or no succeeded run lies between it and a touched run before it
        ok = F.col("status") == "succeeded"
        before = F.max(F.when(F.col("new"), F.struct("run_no", "run_id"))).over(w.rowsBetween(W.unboundedPreceding, -1))
        last_ok = F.max(F.when(ok, F.struct("run_no", "run_id"))).over(w.rowsBetween(W.unboundedPreceding, -1))
        touched = in_root.select("run_id", "status", "new", before.alias("b"), last_ok.alias("k")).filter(F.col("new") | (ok & F.col("b").isNotNull() & (F.col("k").isNull() | (F.col("b") >= F.col("k"))))).select("run_id")
        wanted = near.join(touched, "run_id", "left_semi")
        need = wanted.select("run_id").union(wanted.select(F.col("base_run").alias("run_id"))).filter("run_id IS NOT NULL").distinct()
        order = near.join(need, "run_id", "left_semi")
    listed = state.join(order, "run_id")
    key = W.partitionBy("root_id", "path")
    first = F.lag("ordinal").over(key.orderBy("ordinal", F.desc_nulls_last("arrived_at"), F.desc_nulls_last("hash")))
    one = listed.withColumn("_o", first).filter(F.col("_o").isNull() | (F.col("_o") != F.col("ordinal")))
    w = key.orderBy("ordinal")
    seen, old = F.lag("ordinal").over(w), F.lag("hash").over(w)
    same = F.col("same_setup") & (F.col("_seen") == F.col("ordinal") - 1) & (F.col("_old") == F.col("hash"))
    cases = one.withColumns({"_seen": seen, "_old": old}).filter((F.col("hash") != "") & ((F.col("ordinal") == 1) | ~F.coalesce(same, F.lit(False))))
    if touched is not None:
        cases = cases.join(touched, "run_id", "left_semi")
    return cases.select("run_id", "path", "hash"), touched


class ChangeLog:
    """The commits of the operator in a folder that all executors share.

    ``<folder>/commits/<n>.json`` names the outputs of commit n and its watermark; it is created only if it isn't there,
    in one go, or not at all. ``<folder>/output/<attempt>`` holds rows of attempts; those that no commit names are
    remains of failed steps and are never read. After COMPACT commits a step writes all cases anew, so that what a
    reader puts together doesn't grow with the number of steps."""

    COMPACT = 8

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("commits", "drafts"):
            self._fs.mkdirs(self._path(f"{self.folder}/{part}"))

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/commits"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _entry(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/commits/{n:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict | None:
        """The newest commit."""
        n = self._numbers()
        return self._entry(n[-1]) if n else None

    def commits(self) -> list[dict]:
        """All commits, oldest first."""
        return [self._entry(n) for n in self._numbers()]

    def step(self, runs: DataFrame, state: DataFrame, high: datetime | None = None) -> dict | None:
        """Handle what the last commit didn't see, up to the limit (what is there now, if none is given; never below
        the watermark). None where nothing differs."""
        done = self.last()
        high = upper_limit(runs, state) if high is None else high
        if done and done["watermark"] is not None:
            low = datetime.fromisoformat(done["watermark"])
            high = low if high is None else max(low, high)
        attempt = f"{self.folder}/output/{uuid.uuid4().hex}"
        deliveries(runs, state, high).write.parquet(f"{attempt}/seen")
        seen = self.spark.read.parquet(f"{attempt}/seen")
        new = None
        if done:
            old = self.spark.read.parquet(f"{done['outputs'][-1]['at']}/seen").withColumnsRenamed({"run_id": "r", "n": "m", "digest": "d"})
            same = F.col("n").eqNullSafe(F.col("m")) & F.col("digest").eqNullSafe(F.col("d"))
            changed = seen.join(old, F.col("run_id").eqNullSafe(F.col("r")), "full_outer").filter(~same).select(F.coalesce("run_id", "r").alias("run_id"))
            changed.write.parquet(f"{attempt}/new")
            new = self.spark.read.parquet(f"{attempt}/new")
        if (seen if new is None else new).isEmpty():
            self._fs.delete(self._path(attempt), True)
            return None
        cases, touched = changed_records(runs, state, high, new)
        whole = touched is None
        if touched is not None:
            touched.write.parquet(f"{attempt}/touched")
            if len(done["outputs"]) >= self.COMPACT:
                again = self.spark.read.parquet(f"{attempt}/touched")
                cases, whole = self.cases().join(again, "run_id", "left_anti").unionByName(cases), True
        cases.write.parquet(f"{attempt}/cases")
        outputs = [] if whole else done["outputs"]
        entry = {"n": done["n"] + 1 if done else 1, "watermark": high and high.isoformat(), "outputs": [*outputs, {"at": attempt, "all": whole}]}
        self._publish(entry)
        return entry

    def _publish(self, entry: dict) -> None:
        """Write a draft and give it the commit's name, which fails if another step has it."""
        jvm = self.spark._jvm
        name = f"{self.folder}/commits/{entry['n']:010d}.json"
        draft = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a link fails where the name is taken; a local rename would replace
                local = lambda p: jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(name), local(draft.toString()))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(draft, self._path(name), options)
        except Py4JJavaError as e:
            if self._fs.exists(self._path(name)):
                raise RuntimeError(f"commit {entry['n']} was made by another step; this step's output is not part of the log") from e
            raise
        finally:
            self._fs.delete(draft, False)

    def cases(self) -> DataFrame:
        """The cases of all commits: of each run, those of the newest commit that touched it. At most COMPACT + 1
        outputs are put together."""
        done = self.last()
        if done is None:
            return self.spark.createDataFrame([], "run_id bigint, path string, hash string")
        rows, hidden = None, None
        for output in reversed(done["outputs"]):
            part = self.spark.read.parquet(f"{output['at']}/cases")
            if hidden is not None:
                part = part.join(hidden, part.run_id.eqNullSafe(hidden.run_id), "left_anti")
            rows = part if rows is None else rows.unionByName(part)
            if not output["all"]:
                more = self.spark.read.parquet(f"{output['at']}/touched")
                hidden = more if hidden is None else hidden.union(more)
        return rows
