"""Packing: the plan against plain best-fit decreasing, ids against the tokenizers library, windows without gaps."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessitura.llm.packing import END_ID, Encoder, best_fit_decreasing, pack, plan, windows, word_level_path
from tests.llm.test_texts import docs


def plain_best_fit(counts, window):
    """One piece after the other into the tightest window that has room."""
    open_ = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [w for w in open_ if sum(w) + length <= window]
        if fits:
            max(fits, key=sum).append(length)
        else:
            open_.append([length])
    return Counter(map(sum, open_))  # windows of equal room are interchangeable


def drawn(seed, window):
    draw = random.Random(seed)
    lengths = draw.sample(range(1, window + 1), draw.randrange(1, 14))
    return {n: draw.choice([1, 2, 5, 40]) for n in lengths}


@pytest.mark.parametrize("seed", range(40))
def test_steps_are_best_fit_decreasing(seed):
    window = random.Random(seed).choice([8, 50, 64])
    counts = drawn(seed, window)
    steps, _, made = best_fit_decreasing(counts, window)
    filled, ranks = {}, {}
    for length, rank, count, first, offset in steps:
        ranks.setdefault(length, []).extend(range(rank, rank + count))
        for w in range(first, first + count):
            assert sum(filled.setdefault(w, [])) == offset
            filled[w].append(length)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert len(filled) == made and Counter(map(sum, filled.values())) == plain_best_fit(counts, window)


@pytest.mark.parametrize("seed", range(40))
def test_settled_windows_keep_every_token(seed):
    window = 64
    counts = drawn(seed, window)
    made = plan(counts, window, 8)
    assert int((made.gone[:, 1] * made.gone[:, 2]).sum()) == int((made.cells[:, 1] * made.cells[:, 2]).sum())


def check(rows, ids_of, window, slack):
    """Every id once, and sequences without gaps whose padding stays below `slack`."""
    pieces, sequences = {}, {}
    for r in rows:
        raw = np.array(ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(raw) and r["length"] > 0
        assert r["doc_tokens"] == len(ids_of[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, total in [(p, len(ids_of[d])) for d, p in pieces.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert total is None or at == total
        if total is None:
            assert at <= window and (window - at < slack or at & (at - 1) == 0)
    assert set(pieces) == set(ids_of)


def library(text):
    return Tokenizer.from_file(word_level_path()).encode(text or "", add_special_tokens=False).ids + [END_ID]


ODD = ["", None, " ", "It's THE end.", "x" * 3000, "naïve  café İstanbul ΣΑΣ", "a<|endoftext|>b", "<|ENDOFTEXT|> x", "1234 a1b2!?", " a\x1cb c\x85d"]


def test_encoder_gives_the_library_s_ids():
    tokenizer, encoder = Tokenizer.from_file(word_level_path()), Encoder(word_level_path(), END_ID, limit=5000)
    draw, letters = random.Random(3), list("abzAZ09'-,.<|>&#\n\t \x0b\x1f éÉßŒ́ſKﬁ漢🙂") + ["'s", "'LL", " the ", "<|endoftext|>", "tion"]
    texts = [t or "" for t in ODD] + ["".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(4000)]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids + [END_ID]
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == want, text
    assert encoder.used <= 5000 + 9000


@pytest.mark.parametrize(("window", "slack"), [(64, 8), (100, 100), (4096, 64)])
def test_documents_are_packed(spark, window, slack):
    draw = random.Random(window)
    words = "the of tion and ing pre sub lime stone water".split()
    texts = ODD + [" ".join(draw.choices(words, k=draw.choice([1, 3, 30, 38, 38, 38, 700]))) for _ in range(150)]
    packed = pack(docs(spark, texts), window=window, slack=slack, ids=True).cache()
    ids_of = {i: library(t) for i, t in enumerate(texts)}
    rows = packed.collect()
    check(rows, ids_of, window, slack)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
    assert sorted(map(key, rows)) == sorted(map(key, pack(docs(spark, texts), window=window, slack=slack).collect()))
    full = {r["sequence_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in windows(packed).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        want.setdefault(r["sequence_id"], []).extend(ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    assert full == want


def test_many_documents_of_one_awkward_length(spark):
    """Nothing is short enough to fill the rest of their windows: some are cut."""
    texts = ["tion " * 39] * 101
    rows = pack(docs(spark, texts), window=64, slack=8).collect()
    check(rows, dict.fromkeys(range(101), library(texts[0])), 64, 8)
    assert len({r["sequence_id"] for r in rows}) <= -(-101 * 40 // 64) + 6


def test_odd_tables(spark):
    assert pack(docs(spark, [])).count() == 0
    rows = pack(docs(spark, [(5, "a b"), (5, "a b"), (None, "a b"), (None, None)])).collect()
    assert Counter(r["start"] for r in rows if r["start"] == 0) == {0: 4}
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 6 and sum(r["length"] for r in rows if r["doc_id"] is None) == 4
    filled = Counter()
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert sorted(filled.values()) == [2, 8]  # ten ids in windows that need no padding
    with pytest.raises(ValueError):
        pack(docs(spark, []), slack=0)
