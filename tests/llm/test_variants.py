"""Spelling variants against plain edit comparison, and the bound on affected grams against every edit."""

import random
import re
import zlib
from collections import Counter

import pytest

from tessitura.llm.variants import Q_MAX, Q_MIN, count_words, decompose, near_words, spelling_variants
from tests.llm.test_texts import docs, folded


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) <= 1 and a != b and a[k + (len(a) == len(b)) :] == b[k + 1 :]


def drawn(draw, n):
    letters = draw.choice(["ab", "abcd", "abcdefghijé"])
    parts = ["".join(draw.choices(letters, k=draw.randrange(1, 4))) for _ in range(8)]
    words = {"".join(draw.choices(parts, k=draw.randrange(1, 5))) for _ in range(n)}
    for w in sorted(words)[: n // 2]:
        k = draw.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + draw.choice(letters) + w[k:], w[:k] + draw.choice(letters) + w[k + 1 :]}
    return sorted(words - {""})


def frequent_grams(words, frequent):
    n = Counter(w[p : p + q] for w in words for q in range(Q_MIN, Q_MAX) for p in range(len(w) - q + 1))
    often = {g for g, c in n.items() if c > frequent}
    return often, {g[1:] for g in often}


def parts(word, often, tails):
    found = {(p, q): word[p : p + q] in tails for q in range(Q_MIN, Q_MAX) for p in range(len(word) - q + 1) if word[p : p + q] in often}
    return decompose(word, found)


@pytest.mark.parametrize("frequent", [0, 1, 3, 10, 1000])
def test_no_edit_affects_more_grams(frequent):
    draw = random.Random(frequent)
    words = drawn(draw, 150)
    often, tails = frequent_grams(words, frequent)
    remaining = 0
    for w in words:
        grams, affected = parts(w, often, tails)
        near = {w[:i] + c + w[i + d :] for i in range(len(w) + 1) for d in (0, 1) for c in ["", *"abcdé"]} - {w, ""}
        for other in near:
            shift, theirs = len(other) - len(w), {(other[a:b], a) for a, b in parts(other, often, tails)[0]}
            kept = sum((w[a:b], a) in theirs or (w[a:b], a + shift) in theirs for a, b in grams)
            assert kept >= len(grams) - affected, (w, other)
        remaining += len(grams) > affected
    assert frequent < 1000 or remaining  # with short grams alone, most words keep some


@pytest.mark.parametrize(("frequent", "seed"), [(0, 1), (2, 2), (8, 3), (40, 4), (1000, 5)])
def test_pairs_match_plain_comparison(spark, frequent, seed):
    words = drawn(random.Random(seed), 250) + ["x" * 400, "x" * 401, "y", "yz", "z"]
    got = {tuple(sorted(r)) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string"), frequent).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def grouped(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-counts[x], x) for x in counts if one_edit(w, x))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[w] = (n, len(near), form, counts[form] if form else None)
    roots = {}
    for w in counts:
        end = w
        while out[end][2]:
            end = out[end][2]
        roots[w] = end
    return {w: (*row, roots[w]) for w, row in out.items()}


def test_forms_and_roots(spark):
    draw = random.Random(7)
    counts = {w: draw.choice([1, 2, 3, 4, 8, 16, 40, 90]) for w in drawn(draw, 150)}
    counts |= {"chain" + "x" * k: 2**k for k in range(20)}
    table = spark.createDataFrame([*counts.items(), (None, 3)], "word string, n int")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling_variants(table, 4).collect()}
    assert got == grouped(counts)
    assert spelling_variants(table.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling_variants(table, ratio=1)


def test_words_are_counted(spark):
    draw = random.Random(3)
    texts = ["", None, "1 2 - ", "ÀÉ×÷ÿ Straße STRASSE œuvre naïve漢naïve", "q" * 5000 + " " + "É" * 300, "q" * 5000]
    texts += [" ".join(draw.choice(["Hello", "hELLO", "wörld", "don't", "a", "abcdef1ghijkl", "ünder_score"]) for _ in range(draw.randrange(300))) for _ in range(40)]
    for typo in (None, 97, 3):
        want = Counter()
        for k, text in enumerate(texts):
            for run in re.findall("[A-Za-zÀ-ÿ]+", folded(text)):
                h = zlib.crc32(f"{k}:{run}".encode())
                if typo and h % typo == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 5:
                    want[run] += 1
        assert {r["word"]: r["n"] for r in count_words(docs(spark, texts), typo=typo).collect()} == want
    assert count_words(docs(spark, [])).count() == 0
    assert [tuple(r) for r in count_words(docs(spark, [(None, "words words")]), typo=10**9).collect()] == [("words", 2)]
