"""Problem 1: against a plain Python reading of the definition, and through steps that fail and repeat."""

import random
from datetime import datetime, timedelta

import pytest

from codestrata.operators.changed_records import ChangeLog, changed_records, upper_limit

RUNS = "run_id bigint, root_id bigint, run_no int, status string, config_hash string, tool_version string, updated_at timestamp_ntz, extra string"
STATE = "run_id bigint, path string, hash string, arrived_at timestamp_ntz, root_id bigint, ordinal string"
T0 = datetime(2024, 1, 1)


def brute(runs, state):
    final = {}
    for r in runs:
        k = (r[6] is not None, r[6] or T0, r[3] or "", r[4] or "", r[5] or "")
        if r[0] not in final or k >= final[r[0]][0]:
            final[r[0]] = (k, r)
    by_root = {}
    for _, r in final.values():
        if r[3] == "succeeded":
            by_root.setdefault(r[1], []).append(r)
    listed = {}
    for run, path, h, at, *_ in state:
        p = path.replace("\\", "/") if path is not None else None
        while p is not None and p.startswith("./"):
            p = p[2:].lstrip("/")
        h = h.lower().strip().removeprefix("sha256:") if h is not None else None
        k = (at is not None, at or T0, h is not None, h or "")
        cur = listed.setdefault(run, {})
        if p not in cur or k > cur[p][0]:
            cur[p] = (k, h)
    out = set()
    for rs in by_root.values():
        rs.sort(key=lambda r: r[2])
        for before, r in zip([None, *rs], rs):
            for p, (_, h) in listed.get(r[0], {}).items():
                if not h:
                    continue
                old = listed.get(before[0], {}).get(p, (None, None))[1] if before else None
                if before is None or old != h or before[4:6] != r[4:6]:
                    out.add((r[0], p))
    return out


def made(seed, roots=4, runs=6):
    rnd = random.Random(seed)
    rs, st, n = [], [], 0
    for root in range(roots):
        for no in range(1, runs + 1):
            n += 1
            at = T0 + timedelta(hours=n)
            rs.append((n, root if root else None, no, "running", None, "1", at, "x"))
            if rnd.random() < 0.9:
                rs.append((n, root if root else None, no, rnd.choice(["succeeded", "succeeded", "failed"]), rnd.choice(["a", "a", "a", None]), "1", at + timedelta(minutes=5), "x"))
            for f in range(6):
                if rnd.random() < 0.8:
                    for _ in range(rnd.choice([1, 1, 2])):
                        late = timedelta(hours=rnd.choice([0, 0, 0, 30]))
                        st.append((n, rnd.choice(["", "./"]) + rnd.choice([f"d/f{f}", f"d\\f{f}"]), rnd.choice([f"{f}aa", f"{f}AA", f"sha256:{f}aa", f"{f}bb", "", None]), at + late, root, "y"))
    return rs, st


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_is_the_definition(spark, rows, seed):
    r, s = made(seed)
    got, _ = changed_records(spark.createDataFrame(r + r[:5], RUNS), spark.createDataFrame(s + s[:9], STATE))
    assert set(rows(got, "run_id", "path")) == brute(r, s) and got.count() == len(brute(r, s))


def test_steps_together_are_one_pass(spark, rows, tmp_path):
    r, s = made(3)
    cut = [T0 + timedelta(hours=h) for h in (8, 9, 15, 200)]
    log = ChangeLog(spark, str(tmp_path / "log"))
    for c in cut:
        early = spark.createDataFrame([x for x in r if x[6] <= c], RUNS), spark.createDataFrame([x for x in s if x[3] <= c], STATE)
        log.step(*early)
        assert log.step(*early) is None  # nothing new, nothing repeated
        assert set(rows(log.cases(), "run_id", "path")) == brute([x for x in r if x[6] <= c], [x for x in s if x[3] <= c])
        assert log.cases().count() == len(set(rows(log.cases(), "run_id", "path")))


def test_a_step_that_dies_leaves_no_trace(spark, rows, tmp_path, monkeypatch):
    r, s = made(4)
    runs, state = spark.createDataFrame(r, RUNS), spark.createDataFrame(s, STATE)
    log = ChangeLog(spark, str(tmp_path / "log"))
    with monkeypatch.context() as m:
        m.setattr(ChangeLog, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.step(runs, state)
    assert log.cases().count() == 0 and log.commits() == []
    entry = log.step(runs, state)
    assert set(rows(log.cases(), "run_id", "path")) == brute(r, s)
    with pytest.raises(RuntimeError):
        log._publish({**entry, "n": 1})  # another step was first


def test_ties_late_rows_and_rows_without_a_time(spark, rows, tmp_path):
    """What becomes visible at or below the watermark is handled by the next step."""
    log = ChangeLog(spark, str(tmp_path / "log"))
    r = [(1, 1, 1, "succeeded", "c", "1", T0, "x"), (2, 1, 2, "succeeded", "c", "1", T0, "x")]
    s = [(1, "a", "aa", T0, 1, "y"), (2, "a", "aa", T0, 1, "y")]
    frame = lambda: (spark.createDataFrame(r, RUNS), spark.createDataFrame(s, STATE))
    log.step(*frame())
    for more in ((2, "b", "bb", T0, 1, "y"), (2, "c", "cc", None, 1, "y"), (1, "b", "bb", T0 - timedelta(days=9), 1, "y"), (2, "a", "ab", T0 + timedelta(days=1), 1, "y"), (1, "b", "bb", T0 - timedelta(days=9), 1, "y")):
        s.append(more)
        assert log.step(*frame()) is not None and log.step(*frame()) is None
        assert set(rows(log.cases(), "run_id", "path")) == brute(r, s) and log.cases().count() == len(brute(r, s))
    s.pop(0)  # a row that is taken back
    log.step(*frame())
    assert set(rows(log.cases(), "run_id", "path")) == brute(r, s)


def test_plans_are_bounded(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(ChangeLog, "COMPACT", 2)
    r, s = made(5, roots=2, runs=4)
    log = ChangeLog(spark, str(tmp_path / "log"))
    sizes = []
    for hours in (2, 4, 6, 7, 200):
        log.step(spark.createDataFrame(r, RUNS), spark.createDataFrame(s, STATE), T0 + timedelta(hours=hours))
        sizes.append(len(log.last()["outputs"]))
    assert max(sizes) == 2 and 1 in sizes[1:] and len(log.commits()) == 5
    assert set(rows(log.cases(), "run_id", "path")) == brute(r, s)


def test_empty_tables(spark):
    runs, state = spark.createDataFrame([], RUNS), spark.createDataFrame([], STATE)
    assert upper_limit(runs, state) is None
    assert changed_records(runs, state)[0].count() == 0


def test_empty_log(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "log"))
    assert log.step(spark.createDataFrame([], RUNS), spark.createDataFrame([], STATE)) is None and log.cases().count() == 0
