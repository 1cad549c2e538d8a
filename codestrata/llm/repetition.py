"""Repetition inside a single document.

Each line is described by cheap signs of what the document said before, a linear-chain conditional random field labels
lines as content or as repeated (Viterbi decoding), and the share of words in content lines decides which documents are
kept as content and which are held for the exact count.

The labels alone can't give the published measure, which counts words in stretches of ten and not lines: of the
documents that the field holds, the repeated words are counted exactly, and only they can be cases. What the field
alone finds is told in the read me.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import spread
from .tokenizing import chunks

STRETCH = 10
SHARE = 0.4
#: A document is kept as content if more than this share of its words stands in lines that the field calls content.
KEEP = 0.9
#: Words of the runs that count as a sign, and the share of repeated words of lines labelled so in training.
RUN, MARKED = 6, 0.1
_words_and_lines = re.compile(r"[^\W_]+|\n").findall
_words = re.compile(r"[^\W_]+").findall

# Trained by train(sample(..), rounds=400) on 250 documents, the bound of the sample.
# Emission (score of repeated less that of content): bias, share of words in runs of six that were there before (half
# of them or more count as all), whether the whole line was there before, place in the text.
# Transition: score of two neighbouring lines with the same label less that of different ones.
WEIGHTS = {"emission": (-2.9209, 4.6132, -0.0041, 0.2241), "transition": 1.4501}


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all words, their documents, their lines, first line of each text and the end, words of each
    text). Equal words have equal numbers and others don't; lines without words aren't counted."""
    found = [_words_and_lines(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    number = dict(zip(dict.fromkeys(chain(["\n"], chain.from_iterable(found))), count()))
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(found)), sizes)
    newline = codes == 0
    line = np.cumsum(newline) + doc
    word = ~newline
    codes, doc, line = codes[word], doc[word], line[word]
    new = np.concatenate([[True], line[1:] != line[:-1]])[: len(line)]
    starts = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(found)))])
    return codes, doc, np.cumsum(new) - 1, starts, np.bincount(doc, minlength=len(found))


def _runs(codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places at which a run of n words of one text begins, hashes of run and text)."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c, mix = codes.view(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    total = doc[:size].astype(np.uint64) * mix
    with np.errstate(over="ignore"):
        for k in range(n):
            total = (total + c[k : k + size]) * mix
            total ^= total >> np.uint64(29)
    at = np.flatnonzero(doc[:size] == doc[n - 1 :])
    return at, total[at]


def _again(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places whose key an earlier place has, the nearest such place)."""
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]]) + 1
    return at[order[same]], at[order[same - 1]]


def _covered(begins: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a run of n from one of the places."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, begins + n, -1)
    return np.cumsum(step[:-1]) > 0


def features(codes: np.ndarray, doc: np.ndarray, line: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row of signs per line, words of each line)."""
    lines = int(starts[-1])
    words = np.bincount(line, minlength=lines)
    share = lambda hit: np.bincount(line[hit], minlength=lines) / words
    run = _covered(_again(*_runs(codes, doc, RUN))[0], RUN, len(codes))
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    with np.errstate(over="ignore"):
        place = (np.arange(len(codes)) - first[line] + 1).astype(np.uint64)
        spelled = (codes.view(np.uint64) + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
        spelled ^= spelled >> np.uint64(31)
        total = np.zeros(lines, np.uint64)
        np.add.at(total, line, spelled)
        of = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(np.uint64)
        total = (total + of) * np.uint64(0xD1B54A32D192ED03)
    whole = np.zeros(lines, bool)
    whole[_again(np.arange(lines), total)[0]] = True
    length = np.diff(starts)
    nth = np.arange(lines) - np.repeat(starts[:-1], length)
    return np.column_stack([np.ones(lines), np.minimum(1, 2 * share(run)), whole, nth / np.repeat(length, length)]).astype(float), words


def viterbi(margin: np.ndarray, starts: np.ndarray, transition: float) -> np.ndarray:
    """The best labels (1: repeated) of sequences that lie one after another; ``starts`` has the first line of
    each and the end. ``margin``: emission score of label 1 less that of label 0. All sequences are decoded
    side by side, a step of the loop takes the n-th line of each."""
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    begin, size = starts[:-1][order], size[order]
    labels = np.zeros(len(margin), np.int8)
    if not len(size) or not size[0]:
        return labels
    back0, back1 = np.zeros(len(margin), bool), np.zeros(len(margin), bool)
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")  # sequences longer than n
    gap = margin[begin[: live[0]]].copy()  # best score ending in 1 less best ending in 0
    final = np.zeros(len(size))
    final[: live[0]] = gap
    for n in range(1, size[0]):
        k = live[n]
        at = begin[:k] + n
        gap = gap[:k]
        back1[at] = gap + transition >= 0  # ending in 1: came from 1
        back0[at] = gap - transition > 0  # ending in 0: came from 1
        # max(g + t, 0) - max(g, t), with the score of the zero label taken as origin
        gap = margin[at] + np.maximum(gap + transition, 0) - np.maximum(gap, transition)
        final[:k] = gap
    last = (final > 0).astype(np.int8)
    state = last
    for n in range(size[0] - 1, -1, -1):
        k = live[n]
        at = begin[:k] + n
        labels[at] = state[:k]
        if n:
            state[:k] = np.where(state[:k] == 1, back1[at], back0[at])
    return labels


def repeated_words(codes: np.ndarray, doc: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """Whether each word is repeated. ``codes``: numbers of words, ``doc``: their documents, in order. Stretches with
    equal hashes are compared word by word; where two differ, their document is counted by the words themselves."""
    later, earlier = _again(*_runs(codes, doc, stretch))
    odd = np.zeros(len(later), bool)
    for k in range(stretch if len(later) else 0):
        odd |= codes[later + k] != codes[earlier + k]
    out = _covered(later, stretch, len(codes))
    for d in np.unique(doc[later[odd]]):
        at = np.flatnonzero(doc == d)
        out[at] = _marks(codes[at].tolist(), stretch)
    return out


def _marks(words: list, stretch: int) -> np.ndarray:
    """Whether each word is repeated, by comparing the words themselves."""
    seen: dict[tuple, int] = {}
    reach, marks = 0, np.zeros(len(words), bool)
    for i in range(len(words) - stretch + 1):
        if seen.setdefault(tuple(words[i : i + stretch]), i) < i:
            marks[max(i, reach) : i + stretch] = True
            reach = i + stretch
    return marks


def exact_share(text: str | None, stretch: int = STRETCH) -> tuple[int, int]:
    """(words, repeated words) of one text."""
    words = _words((text or "").lower())
    return len(words), int(_marks(words, stretch).sum())


def labelled(codes: np.ndarray, doc: np.ndarray, line: np.ndarray, starts: np.ndarray, weights: dict = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """(label of each line, words in content lines of each text)."""
    signs, words = features(codes, doc, line, starts)
    labels = viterbi(signs @ np.asarray(weights["emission"]), starts, weights["transition"])
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return labels, np.bincount(of, np.where(labels == 0, words, 0), minlength=len(starts) - 1).astype(np.int64)


def measure(texts: list[str | None], held_only: bool = False, weights: dict = WEIGHTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, repeated words, words in lines labelled content) of each text; ``held_only``: repeated words only of
    the texts that the field holds, and 0 of the others."""
    codes, doc, line, starts, words = _codes(texts)
    _, content = labelled(codes, doc, line, starts, weights)
    if held_only:
        held = (words >= STRETCH) & (content <= KEEP * words)
        some = held[doc]
        codes, doc = codes[some], doc[some]
    return words, np.bincount(doc[repeated_words(codes, doc)], minlength=len(texts)), content


def sample(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the signs of its lines and their labels: at least a share MARKED of the words is repeated. Each text
    stands in the sample as it is, on one line, and as a few of its words said over and over, on one line and on short ones."""
    more = []
    for n, t in enumerate(texts):
        words = t.split()[: 1 + n % 14]
        often = 11 // max(1, len(words)) + 1 + n % 4
        said = words * often
        more += [" ".join(t.split()), " ".join(said), "\n".join(" ".join(said[i : i + 1 + n % 6]) for i in range(0, len(said), 1 + n % 6))]
    out = []
    for t in [*texts, *more]:
        codes, doc, line, starts, _ = _codes([t])
        x, words = features(codes, doc, line, starts)
        again = np.bincount(line[repeated_words(codes, doc)], minlength=len(words))
        out.append((x, (again >= MARKED * words).astype(float)))
    return out


def train(sets: list[tuple[np.ndarray, np.ndarray]], rounds: int = 300, rate: float = 0.5) -> dict:
    """Weights by gradient ascent on the likelihood of the labels (see ``sample``). The caller bounds the sample."""
    sets = [(x, y) for x, y in sets if len(x)]
    emission, transition = np.zeros(sets[0][0].shape[1]), 0.0
    for _ in range(rounds):
        grad, grad_t, n = np.zeros(len(emission)), 0.0, 0
        for x, y in sets:
            m = x @ emission
            e = np.stack([np.zeros_like(m), m])
            t = np.array([[transition, 0.0], [0.0, transition]])
            a = np.zeros_like(e)
            b = np.zeros_like(e)
            a[:, 0] = e[:, 0]
            for i in range(1, len(m)):
                a[:, i] = e[:, i] + np.logaddexp(a[0, i - 1] + t[0], a[1, i - 1] + t[1])
            for i in range(len(m) - 2, -1, -1):
                b[:, i] = np.logaddexp(t[:, 0] + e[0, i + 1] + b[0, i + 1], t[:, 1] + e[1, i + 1] + b[1, i + 1])
            z = np.logaddexp(a[0, -1], a[1, -1])
            p = np.exp(a[1] + b[1] - z)
            grad += x.T @ (y - p)
            if len(m) > 1:
                same = np.exp(a[0, :-1] + t[0, 0] + e[0, 1:] + b[0, 1:] - z) + np.exp(a[1, :-1] + t[1, 1] + e[1, 1:] + b[1, 1:] - z)
                grad_t += float((y[1:] == y[:-1]).sum() - same.sum())
            n += len(m)
        emission += rate * 20 * grad / n
        transition += rate * grad_t / n
    return {"emission": tuple(map(float, emission)), "transition": float(transition)}


def repetition(documents: DataFrame, share: float | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, words, repeated, repeated_share, content_share`` of each document; with ``share`` only those that the
    field doesn't keep as content, with at least STRETCH words of which at least that share is repeated.

    Null and empty texts, and texts without words, have shares of 0 (repeated) and 1 (content). Repeated rows
    are measured each; further columns are ignored. One narrow stage, whole texts, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                words, repeated, content = measure(texts, share is not None)
                of = np.maximum(words, 1)
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(words.astype(np.int64)), pa.array(repeated.astype(np.int64)), pa.array(repeated / of), pa.array(np.where(words > 0, content / of, 1.0))], names=[key, "words", "repeated", "repeated_share", "content_share"])
                yield out if share is None else out.filter(pa.array((words >= STRETCH) & (content <= KEEP * words) & (repeated >= share * words - 1e-9)))

    rows = spread(documents.select(key, text))
    out = T.StructType([rows.schema[key], T.StructField("words", T.LongType()), T.StructField("repeated", T.LongType()), T.StructField("repeated_share", T.DoubleType()), T.StructField("content_share", T.DoubleType())])
    return rows.mapInArrow(run, out)
