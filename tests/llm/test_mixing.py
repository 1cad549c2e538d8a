"""Problem 7: caps and budgets against a plain computation, nesting, sources that are missing on either side."""

import pytest

pytest.importorskip("sentencepiece")
from codestrata.llm.mixing import mix  # noqa: E402
from codestrata.llm.tokenizing import tokenizer, vocabulary_path  # noqa: E402

DOCS = "doc_id bigint, source string, text string, tokens string, place string"
TARGETS = "mix_name string, source string, weight double, max_repeats int"


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return vocabulary_path()


def docs(n=400):
    size = lambda i: 1 + i % 17
    return [(i, "big" if i % 3 else "mid" if i % 2 else "small", "word " * size(i), "", "") for i in range(n)] + [(9001, None, "no source", "", ""), (9002, "big", None, "", ""), (9003, "big", "", "", ""), (9004, "lonely", "x " * 500, "", "")]


def test_shares_caps_and_budgets(spark, path):
    t = tokenizer(path)
    n = {}
    for i, s, x, *_ in docs():
        n[s] = n.get(s, 0) + len(t.encode(x))
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 3), ("m", "gone", 1.0, 4), ("z", "big", 1.0, None), ("z", "small", float("nan"), 1), ("z", "mid", 0.0, 1), (None, "big", 1.0, 1)]
    draws, shares = mix(spark.createDataFrame(docs(), DOCS), spark.createDataFrame(targets, TARGETS), path)
    caps = {"big": 1, "mid": 2, "small": 3}
    total = min(caps[s] * n[s] / w for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))
    got = {(r["mix_name"], r["source"]): r for r in shares.collect()}
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        r = got["m", s]
        assert r["drawn_tokens"] <= w * total + 1e-6 and r["drawn_tokens"] > w * total - 40 and r["max_copies"] <= caps[s]
        assert abs(r["share"] - w) < 0.03
    assert got["m", "gone"]["drawn_tokens"] == 0 and got["z", "big"]["drawn_tokens"] == n["big"] and ("z", "small") not in got
    rows = draws.collect()
    assert len({(r["mix_name"], r["doc_id"]) for r in rows}) == len(rows)
    assert not {r["source"] for r in rows} & {"lonely", None}
    for s in caps:
        assert sum(r["tokens"] * r["copies"] for r in rows if r["mix_name"] == "m" and r["source"] == s) == got["m", s]["drawn_tokens"]


def test_larger_budgets_draw_supersets(spark, path):
    d, t = spark.createDataFrame(docs(), DOCS), spark.createDataFrame([("m", "big", 1.0, 5)], TARGETS)
    small, large = ({r["doc_id"]: r["copies"] for r in mix(d, t, path, total=x)[0].collect()} for x in (300.0, 900.0))
    assert set(small) < set(large) and all(large[k] >= v for k, v in small.items())


def test_empty(spark, path):
    d, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    draws, shares = mix(d, t, path)
    assert draws.count() == 0 and [r["share"] for r in shares.collect()] == [0.0]
    draws, shares = mix(spark.createDataFrame(docs(9), DOCS), t.limit(0), path)
    assert draws.count() == 0 and shares.count() == 0
