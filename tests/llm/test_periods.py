"""Periodic runs against every period tried at every place."""

import random

import numpy as np
import pytest

from tessitura.llm.periods import Wavelet, find_runs, periodic_runs
from tessitura.llm.queries import looped
from tests.llm.test_texts import docs


def every_run(w, min_words, min_repeats):
    found = {}
    for q in range(1, len(w) // min_repeats + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(min_words, min_repeats * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repeating(draw):
    letters, w = draw.choice([1, 2, 3, 30]), []
    for _ in range(draw.randrange(1, 14)):
        part = [draw.randrange(letters) for _ in range(draw.choice([1, 2, 3, 5, 8, 13, 16, 31]))]
        if draw.random() < 0.5:  # a period whose own part repeats
            part = part * draw.randrange(1, 8) + [draw.randrange(letters)]
        w += part * draw.randrange(1, 6)
        w += w[-draw.randrange(1, 40) :] * draw.choice([0, 1, 3])
    return w[:400]


@pytest.mark.parametrize("seed", range(60))
def test_runs_match_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(10):
        words, repeats = draw.choice([(24, 3), (24, 3), (1, 3), (10, 4)])
        w = repeating(draw)
        got = [tuple(r) for r in find_runs(np.array([*w, max(w) + 1]), words, repeats).tolist()]
        assert got == every_run(w, words, repeats)


def test_wavelet_successor():
    draw = random.Random(1)
    values = np.array(draw.sample(range(300), 200))
    wavelet = Wavelet(values)
    asked = [(lo, draw.randrange(lo, 201), draw.randrange(320)) for lo in (draw.randrange(200) for _ in range(500))]
    lo, hi, x = (np.array(c) for c in zip(*asked))
    assert wavelet.successor(lo, hi, x).tolist() == [min((v for v in values[a:b].tolist() if v >= c), default=-1) for a, b, c in asked]


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_documents(spark):
    draw = random.Random(9)
    texts = ["", None, " \t\n", "one", "É \x0bÉ\xa0 " * 30, "a b " * 12, "a b " * 11 + "a", " ".join(["x"] * 3000)]
    texts += [draw.choice([" ", "\n\n"]).join(f"w{k}" for k in repeating(draw)) for _ in range(60)]
    for rewrite in (None, looped):
        got = {r["doc_id"]: r for r in periodic_runs(docs(spark, texts), rewrite=rewrite).collect()}
        assert len(got) == len(texts)
        for k, text in enumerate(texts):
            w = [b.decode() for b in (looped if rewrite else lambda _, x: x)(k, (text or "").encode().split())]
            runs = every_run(w, 24, 3)
            assert [tuple(r) for r in got[k]["runs"]] == runs and got[k]["collapsed"] == collapsed(w, runs)


def test_odd_rows(spark):
    assert periodic_runs(docs(spark, [])).count() == 0
    rows = periodic_runs(docs(spark, [(None, "a " * 30), (7, "a " * 30), (7, "a " * 30), (None, None)]), rewrite=looped).collect()
    assert sorted((r["doc_id"] or 0, len(r["runs"]), r["collapsed"]) for r in rows) == [(0, 0, ""), (0, 1, "a"), (7, 1, "a"), (7, 1, "a")]
    with pytest.raises(ValueError):
        periodic_runs(docs(spark, []), min_repeats=2)


def test_long_documents_take_little(spark):
    """Nothing grows with the square of a document."""
    rows = find_runs(np.array([0] * 200_000 + [1]))
    assert rows.tolist() == [[0, 200_000, 1]]
