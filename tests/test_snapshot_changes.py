"""Problem 3: against a plain Python reading of the definition; values that are spelled otherwise are equal."""

import json
import random
from datetime import datetime, timedelta

import pytest

from codestrata.operators.snapshot_changes import canonical, snapshot_changes

RUNS = "run_id bigint, root_id bigint, run_no int, status string, config_hash string, tool_version string, updated_at timestamp_ntz"
RECORDS = "run_id bigint, section string, record_key string, payload string, delivered_at timestamp_ntz, root_id bigint, leaf string, n string"
T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ('{"a":1,"b":[1,2]}', ' { "b": [1.0, 2e0], "a": 10e-1 } ', True),
        ('{"a":"\\u00e9"}', '{"a":"é"}', True),
        ('{"a":1,"scannedAt":"x"}', '{"a":1}', True),
        ('{"a":[1,2]}', '{"a":[2,1]}', False),
        ('{"a":1}', '{"a":"1"}', False),
        ('{"a":true}', '{"a":1}', False),
        ("null", None, False),
        (None, None, True),
        ("not json", "not json", True),
        ("not json", "not  json", False),
        ('{"a":0}', '{"a":-0.0}', True),
        ('{"a":12345678901234567890}', '{"a":12345678901234567891}', False),
        ('{"a":1e400}', '{"a":10e399}', True),
    ],
)
def test_values(a, b, same):
    assert (canonical(a) == canonical(b)) is same


def test_against_definition(spark, rows):
    rnd = random.Random(5)
    runs, records, snaps = [], [], {}
    n = 0
    for root in (1, 2, None):
        state = {}
        for no in range(1, 7):
            n += 1
            ok = rnd.random() < 0.8
            runs.append((n, root, no, "succeeded" if ok else "failed", None, "1", T0 + timedelta(hours=n)))
            for k in range(60 if root == 1 else 5):
                if rnd.random() < 0.3:
                    state.pop(k, None)
                elif rnd.random() < 0.5 or k not in state:
                    state[k] = rnd.choice([None, {"v": rnd.randint(0, 3)}])
            if no == 3:
                continue  # a run that delivers none
            for k, v in state.items():
                text = None if v is None else rnd.choice([json.dumps(v), json.dumps(v, separators=(",", ":")), json.dumps({**v, "scannedAt": n})])
                for late in range(rnd.choice([1, 1, 2])):
                    records.append((n, None if k == 0 else "s", f"k{k}", text, T0 + timedelta(hours=n, minutes=late), root, "z", "z"))
            if ok and state:
                snaps.setdefault(root, []).append((n, dict(state)))
    want = set()
    for rs in snaps.values():
        for (_, old), (run, new) in zip(rs, rs[1:]):
            for k in {*old, *new}:
                kind = "added" if k not in old else "removed" if k not in new else "changed" if old[k] != new[k] else None
                if kind:
                    want.add((run, None if k == 0 else "s", f"k{k}", kind))
    for size, bits in ((16, 20), (1, 12), (1000, 20)):
        got = snapshot_changes(spark.createDataFrame(runs, RUNS), spark.createDataFrame(records, RECORDS), size, bits)
        assert set(rows(got)) == want and got.count() == len(want)


def test_latest_delivery_holds_and_empty(spark, rows):
    runs = spark.createDataFrame([(1, 1, 1, "succeeded", None, "1", T0), (2, 1, 2, "succeeded", None, "1", T0)], RUNS)
    records = [(1, "s", "k", '{"v":1}', T0, 1, "", ""), (2, "s", "k", '{"v":2}', T0, 1, "", ""), (2, "s", "k", '{"v":1}', T0 + timedelta(hours=1), 1, "", "")]
    assert snapshot_changes(runs, spark.createDataFrame(records, RECORDS)).count() == 0
    assert snapshot_changes(runs.limit(0), spark.createDataFrame([], RECORDS)).count() == 0
