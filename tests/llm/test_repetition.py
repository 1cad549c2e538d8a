"""Problem 8: against the definition read word by word; the field's labels; its training."""

import random

import numpy as np

from codestrata.llm import repetition as repetition_module
from codestrata.llm.repetition import KEEP, SHARE, STRETCH, _codes, exact_share, labelled, measure, repeated_words, repetition, sample, train, viterbi


def brute(text):
    import re

    w = re.findall(r"[^\W_]+", (text or "").lower())
    hit = [False] * len(w)
    for i in range(len(w) - STRETCH + 1):
        if any(w[j : j + STRETCH] == w[i : i + STRETCH] for j in range(i)):
            hit[i : i + STRETCH] = [True] * STRETCH
    return len(w), sum(hit)


def made(n=200):
    rnd, out = random.Random(2), [None, "", " \n", "é" * 5, "a " * 9, "a " * 10, "a " * 11, "Ab_c " * 30, "x\n" * 40]
    for _ in range(n):
        lines = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(0, 14))) for _ in range(rnd.randint(1, 8))]
        out.append("\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 20))))
    return out


def test_measures_are_the_definition():
    texts = made()
    words, repeated, _ = measure(texts)
    for t, w, r in zip(texts, words, repeated):
        assert (w, r) == brute(t) == exact_share(t)


def test_equal_hashes_of_other_words_do_not_count(monkeypatch):
    real = repetition_module._runs
    monkeypatch.setattr(repetition_module, "_runs", lambda codes, doc, n: (real(codes, doc, n)[0], real(codes, doc, n)[1] % np.uint64(7)))
    codes, doc, *_ = _codes(made(40))
    assert np.bincount(doc[repeated_words(codes, doc)], minlength=49).tolist() == [brute(t)[1] for t in made(40)]


def test_field_decides_and_misses_little():
    """Labels are not what is counted, they take documents away, and they hold nearly all cases."""
    rnd, vocabulary = random.Random(5), [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(1500):
        base, words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))], []
        while len(words) < rnd.randint(10, 200):
            words += base if rnd.random() < rnd.choice([0.3, 0.6, 0.9]) else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))]
        gaps = rnd.choice([[" "], [" ", " ", " ", "\n"], ["\n"], ["\n\n", " ", " "]])
        texts.append("".join(w + rnd.choice(gaps) for w in words))
    words, repeated, content = measure(texts)
    case, held = (words >= STRETCH) & (repeated >= SHARE * words), content <= KEEP * words
    assert case.sum() > 300 and (case & held).sum() >= 0.99 * case.sum() and (~held).sum() > 100
    assert (measure(texts, held_only=True)[1] == np.where(held, repeated, 0)).all()
    codes, doc, line, starts, _ = _codes(texts)
    labels, _ = labelled(codes, doc, line, starts)
    again = np.bincount(line[repeated_words(codes, doc)], minlength=len(labels)) > 0
    assert 0 < (labels.astype(bool) != again).mean() < 0.2
    other = {"emission": [-99.0, 0, 0, 0], "transition": 0.0}
    assert (measure(texts, weights=other)[2] == words).all()  # with other weights all is content, and nothing is held


def test_viterbi_is_the_best_labelling():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        sizes = rnd.integers(0, 7, 4)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        margin, t = rnd.normal(0, 2, starts[-1]), float(rnd.normal(0.5, 1))
        got = viterbi(margin, starts, t)
        for a, b in zip(starts, starts[1:]):
            def score(y):
                return sum(margin[a + i] * y[i] for i in range(b - a)) + t * sum(y[i] == y[i - 1] for i in range(1, b - a))
            best = max((score([n >> i & 1 for i in range(b - a)]) for n in range(1 << (b - a))), default=0)
            assert abs(score(got[a:b].tolist()) - best) < 1e-9


def test_training_finds_weights():
    rnd = random.Random(4)
    texts = ["\n".join(" ".join(f"{rnd.choice('abcdefgh')}{rnd.randint(0, 40)}" for _ in range(14)) for _ in range(8)) for _ in range(20)]
    texts = [t + "\n" + t if n % 2 else t for n, t in enumerate(texts)]
    sets = sample(texts)
    got = train(sets, rounds=150)
    labels = np.concatenate([viterbi(x @ np.array(got["emission"]), np.array([0, len(x)]), got["transition"]) for x, _ in sets])
    assert (labels == np.concatenate([y for _, y in sets])).mean() > 0.95


def test_operator(spark):
    texts = made(60)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, *texts[:5]])], "doc_id bigint, text string, words int")
    got = {r["doc_id"]: (r["words"], r["repeated"]) for r in repetition(df).collect()}
    assert all(got[i] == brute(t) for i, t in enumerate(texts))
    held = measure([*texts, *texts[:5]])[2]
    want = sorted(i for i, t in enumerate([*texts, *texts[:5]]) if (b := brute(t))[0] >= 10 and b[1] >= SHARE * b[0] and held[i] <= KEEP * b[0])
    assert sorted(r["doc_id"] for r in repetition(df, SHARE).collect()) == want
    assert repetition(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "w " * 300_000), (2, " ".join(map(str, range(200_000))))], "doc_id bigint, text string")
    assert [r["doc_id"] for r in repetition(long, SHARE).collect()] == [1]
