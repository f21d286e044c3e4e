import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessitura.functions import distance
from tessitura.functions import text as T
from tessitura.functions.distance import edit_distance
from tessitura.functions.words import ngrams, punct_labels, word_code_pair, words
from tessitura.operators.punct import feature_array, oracle_marks

t = F.col("t")


def test_normalise(values):
    pairs = {
        "  Ng’anga`s CAFÉ, 12% (ok)!\t—fin…  ": "ng'anga's café, ok ! fin",
        "": "",
        "a  b": "a b",
        "½ x²y": "x y",
        "ŊʼA b": "ŋ'a b",
        "e\u0301té \u1100\u1161": "été 가",
        "\u212b \u2019tis": "å 'tis",
    }
    assert values(T.normalise(t), list(pairs)) == list(pairs.values())


def test_normalise_is_idempotent(values):
    texts = ["Ab’ 1 – c", "x´y", "Ünï̈"]
    once = values(T.normalise(t), texts)
    assert values(T.normalise(t), once) == once


def test_cased_variant_keeps_case_and_apostrophes(values):
    assert values(T.normalise_cased(t, lowercase=False), ["It’s 5 O`clock"]) == ["It’s O clock"]


def test_fold_rare(values):
    allowed = "abcdefghijklmnopqrstuvwxyz é"
    assert values(T.fold_rare(t, allowed), ["é ĝo þa 한", "œuf"]) == ["é go a", "uf"]


def test_charset(values):
    allowed = F.lit(" abcdefgh")
    assert values(T.charset_ratio(t, allowed), ["abz", "", "ab a"]) == [1 / 3, 0.0, 0.0]
    assert values(T.acceptable(t, allowed), ["abc defg", "abcdefgh", "ab c", "abc defz"]) == [True, False, False, False]


def test_ids_and_marks(values):
    assert values(T.lang_from_id(t, ["lug", "lin"]), ["lug_961", " LIN_1", "ID_ABC", "sna_1"]) == ["lug", "lin", None, None]
    assert values(T.strip_punct(t), ["«A, b.» c-d"]) == ["A b cd"]
    assert values(T.strip_marks(t), ["g'a, b.c  d"]) == ["g'a bc d"]


def test_period_rules_differ_only_where_they_should(values):
    texts = ["ab", "ab.", "", "  "]
    assert values(T.append_period(t, "always"), texts) == ["ab.", "ab..", ".", "  ."]
    assert values(T.append_period(t, "nonblank"), texts) == ["ab.", "ab..", "", "  "]
    assert values(T.append_period(t, "guarded"), texts[:3]) == ["ab.", "ab.", ""]
    assert values(T.finish(t, F.lit("en"), ["en"]), ["Ab 1", "ab?", ""]) == ["ab.", "ab?", ""]


def test_capfirst(values):
    pairs = {" ab. cd? ef! éa .x": " Ab. Cd? Ef! éa .x", "a.b": "A.b", "1a. b": "1a. B", "": "", "x.\ny": "X.\nY"}
    assert values(T.capfirst(t), list(pairs)) == list(pairs.values())


def test_fill_blank(values):
    assert values(T.fill_blank(t), [None, "", "  ", "x"]) == ["a", "a", "a", "x"]


def test_labels_and_ngrams(values):
    got = values(punct_labels(t), ["a, b. -- c?. d"])[0]
    assert [(r["word"], r["label"]) for r in got] == [("a", 2), ("b", 1), ("c", 1), ("d", 0)]
    assert values(ngrams(words(t), 3), ["x y", ""]) == [["<s> x y", "x y </s>"], []]
    assert values(ngrams(words(t), 2, sentinels=False), ["x", "x y z"]) == [[], ["x y", "y z"]]


def test_context_features_use_sentinels_and_caps(values):
    got = values(feature_array(words(t), F.lit("en")), ["Aa bbbb c d e f g"])[0]
    assert got[0][:5] == ["lang=en", "w=aa", "prev=<s>", "next=bbbb", "next2=c"]
    assert got[0][7:] == ["suf3=aa", "nsuf3=bbb", "last=false", "from_end=5", "pos=0", "len=1"]
    assert got[6][3:7] == ["next=</s>", "next2=</s>", "w|next=g|</s>", "prev|w=f|g"]
    assert got[6][9:12] == ["last=true", "from_end=0", "pos=5"]


def test_oracle_marks_last_occurrence_wins(values):
    ref = F.lit("ab, c ab. d")
    assert values(oracle_marks(ref, t), ["ab x c d ab", ""]) == ["ab. x c d ab.", ""]


def test_oracle_marks_of_long_rows(values):
    rng = random.Random(2)
    ref = " ".join(f"w{rng.randrange(40)}" + rng.choice(["", "", ".", ",", "'s"]) for _ in range(400))
    hyp = " ".join(rng.choice(["w%d" % rng.randrange(60), "w1s", ",", "."]) for _ in range(400))
    full = {}
    for w in ref.split(" "):
        bare = "".join(c for c in w if c not in T.ALL_PUNCTUATION)
        if bare != w:
            full[bare] = w
    want = " ".join(full.get(w, w) for w in hyp.split(" "))
    got = values(oracle_marks(F.lit(ref), t), [hyp, "", None, "w1 " * 3 + "w2"])
    assert got == [want, "", None, " ".join(full.get(w, w) for w in "w1 w1 w1 w2".split())]


def test_distances(values, spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            nxt = [i]
            for j, y in enumerate(b, 1):
                nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
            row = nxt
        return row[-1]

    rng = random.Random(7)
    pairs = [("".join(rng.choice("abé ") for _ in range(rng.randrange(40))), "".join(rng.choice("abé ") for _ in range(rng.randrange(40)))) for _ in range(200)]
    long = [("ab" * 150, "ba" * 140), ("x" * 200, ""), ("x" * 1500, "y" * 1400), ("ab" * 300, "ab" * 200 + "c" * 190)]
    rows = spark.createDataFrame(pairs + long, "a string, b string")
    frame = rows.select("a", "b", edit_distance(F.col("a"), F.col("b")).alias("d"))
    assert all(r["d"] == plain(r["a"], r["b"]) for r in frame.collect())
    assert "Python" not in frame._jdf.queryExecution().toString()
    coded = rows.select(F.filter(F.split("a", " "), lambda w: w != "").alias("x"), F.filter(F.split("b", " "), lambda w: w != "").alias("y"))
    got = coded.select("x", "y", word_code_pair(F.col("x"), F.col("y")).alias("c")).select("x", "y", F.levenshtein("c.r", "c.h").alias("d")).collect()
    assert all(r["d"] == plain(r["x"], r["y"]) for r in got)


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def _alike(rng):
    size = rng.choice([2, 3, 20])
    a = [rng.randrange(size) for _ in range(rng.randrange(50))]
    b = [x for x in a if rng.random() > 0.2]
    for _ in range(rng.randrange(6)):
        b.insert(rng.randrange(len(b) + 1), rng.randrange(size))
    return a, b if rng.random() > 0.2 else [rng.randrange(size) for _ in range(rng.randrange(50))]


@pytest.mark.parametrize("block", [1, 3, 7, 64])
def test_bit_vectors_in_blocks_and_bands(monkeypatch, block):
    monkeypatch.setattr(distance, "BLOCK", block)
    monkeypatch.setattr(distance, "WIDE_BLOCK", block)
    rng = random.Random(block)
    for _ in range(250):
        a, b = _alike(rng)
        want = _plain(a, b)
        assert distance.distance(a, b) == want
        if len(a) >= len(b) > 0:
            band = len(a) - len(b) + 2
            found = distance._banded(np.array(a), np.array(b), band)
            assert found == want or found > want > band


def test_alike_sequences_share_their_beginnings():
    rng = random.Random(5)
    for _ in range(400):
        a, base = _alike(rng)
        others = [base]
        for _ in range(rng.randrange(6)):
            b = list(base)
            for _ in range(rng.randrange(4)):
                b.insert(rng.randrange(len(b) + 1), rng.randrange(3))
            others.append(b)
        others.append([])
        got = distance.distances(np.array(a, np.int64), [np.array(b, np.int64) for b in others])
        assert got == [_plain(a, b) for b in others]


@pytest.mark.parametrize(("together", "alone"), [(1, 0), (7, 0), (1024, 24)])
def test_many_pairs_at_once(monkeypatch, together, alone):
    monkeypatch.setattr(distance, "TOGETHER", together)
    monkeypatch.setattr(distance, "ALONE", alone)
    rng = random.Random(together)
    pairs = [_alike(rng) for _ in range(120)] + [([], []), ([1], []), ([], [1]), ([1], [1])]
    for n in (63, 64, 65, 127, 128, 129, 200):
        a = [rng.randrange(4) for _ in range(n)]
        pairs += [(a, a), (a, a[3:] + [9]), (a[::2], a), (a, [rng.randrange(4) for _ in range(n)])]
    sides = []
    for k in (0, 1):
        sizes = np.array([len(p[k]) for p in pairs])
        sides.append(distance.Sequences(np.array([x for p in pairs for x in p[k]], np.int32), np.cumsum(sizes) - sizes, sizes))
    assert distance.pair_distances(*sides).tolist() == [_plain(a, b) for a, b in pairs]


def test_long_distances_stay_affordable():
    rng = random.Random(1)
    a = [rng.randrange(40) for _ in range(33_000)]
    b = [x if rng.random() > 0.2 else rng.randrange(40) for x in a if rng.random() > 0.05]
    start = time.process_time()
    assert 0 < distance.distance(a, b) < 33_000
    words = list(range(100_000))  # every one another
    assert distance.distance(words, [w for w in words if w % 50]) == 2_000
    assert time.process_time() - start < 20


def test_long_pairs_of_text(spark):
    a = "ab é " * 300
    rows = spark.createDataFrame([(a, a.replace("é", "e")), (a, ""), ("x" * 600, "x" * 590), ("a b", "a c"), ("", "b"), ("", "")], "a string, b string")
    got = rows.select(distance.char_distance(F.col("a"), F.col("b")).alias("c"), distance.word_distance(F.col("a"), F.col("b")).alias("w")).collect()
    assert [r["c"] for r in got] == [300, 1500, 10, 1, 1, 0] and [r["w"] for r in got] == [300, 601, 1, 1, 1, 0]


def test_equal_ends_are_not_aligned(monkeypatch):
    seen = []
    columns = distance._columns
    monkeypatch.setattr(distance, "_columns", lambda longer, *rest: seen.append(longer.shape) or columns(longer, *rest))
    same = "the same words " * 15
    texts = [(f"{same}{'x' * (i % 7)} {same}", f"{same}y{i % 3} {same}") for i in range(200)] + [("", "ab"), ("ab", "ab"), ("aab", "ab")]
    got = distance._both(pa.array([a for a, _ in texts]), pa.array([b for _, b in texts]), distance._letters).to_pylist()
    assert seen and max(width for _, width in seen) == 64
    assert got == [distance._banded(*(np.array([ord(c) for c in t], np.int64) for t in pair), 1000) if all(pair) else 2 for pair in texts]
