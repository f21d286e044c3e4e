"""Top-k search, mixing and archives against plain Python on small tables, odd cases included."""

import base64
import hashlib
import math
import random


from tessitura.llm.mixing import emitted, mix
from tessitura.llm.topk import Blocks, top_k
from tessitura.llm.warc import find_captures, parsed, read_archives, record, url_key, write_archives

VECTORS = "vec_id long, embedding array<float>, rank int"


def best(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in {i for i, _ in ok if i % 100 == 0}:
        asked = min(v for i, v in ok if i == q)
        scores = sorted((-sum(a * b for a, b in zip(asked, v)), i) for i, v in ok if i != q)
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def searched(spark, rows, k, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    out = {}
    for r in top_k(df, df.where("vec_id % 100 = 0"), k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_top_k_with_ties_nulls_and_repeats(spark):
    draw = random.Random(5)
    rows = [(i, [round(draw.uniform(-1, 1), 1) for _ in range(4)]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [float("nan")] * 4), (1003, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    rows += [rows[7], rows[100], (100, [0.5, 0.5, 0.5, 0.5]), (2000, []), (2001, [1.0])]
    assert searched(spark, rows, 7, block_rows=16, query_rows=2, range_rows=64) == best(rows, 7)


def test_top_k_of_few_or_no_rows(spark):
    assert searched(spark, [], 3) == {}
    assert searched(spark, [(100, [1.0])], 3) == {}
    assert searched(spark, [(100, [1.0]), (1, [2.0])], 3) == {100: [(1, 1, 2048 * 1024)]}


def test_blocks_below_the_kth_bound_are_not_scored():
    import numpy as np

    near = np.array([[100, 0]] * 4 + [[1, 0]] * 40)
    blocks = Blocks(np.arange(44), near, 4)
    seen = []
    blocks.ids = type("Seen", (np.ndarray,), {"__getitem__": lambda self, k: (seen.append(k), np.ndarray.__getitem__(self, k))[1]})((44,), int, blocks.ids)
    ((_, ids, scores),) = blocks.best(np.array([99]), np.array([[1, 0]]), 3)
    assert ids.tolist() == [0, 1, 2] and scores.tolist() == [100] * 3 and len(seen) == 1


def mixed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, n int")
    return [(r["doc_id"], r["source"], *r["mix"]) for r in mix(df, **more).collect()]


def test_mix_meets_targets_and_reruns_agree(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice(["a", "b", "b", "b", None]), " ".join("w" for _ in range(draw.randrange(0, 60))), 0, 0) for i in range(3000)]
    got = mixed(spark, rows, block_rows=100)
    assert sorted(got, key=str) == sorted(mixed(spark, rows[::-1], block_rows=100), key=str)
    total = sum(r[2] for r in got)
    by = {s: [r for r in got if r[1] == s] for s in ("a", "b", None)}
    size = {s: sum(r[2] for r in v) for s, v in by.items()}
    want = {s: total * w / 6 for s, w in zip(("a", "b", None), (1, 2, 3))}
    for s, v in by.items():
        assert {r[3] for r in v} == {size[s]}
        assert abs(v[0][4] - min(want[s], 3 * size[s])) < 1 or want[s] < v[0][4] <= 3 * size[s] or any(want[o] > 3 * size[o] for o in want)
        assert abs(sum(r[2] * r[5] for r in v) - v[0][4]) <= 0.05 * v[0][4] + 120
        assert max(r[5] for r in v) <= 3
    assert abs(sum(v[0][4] for v in by.values()) - total) < 1e-6 * total


def test_targets_stop_at_three_times_a_source(spark):
    rows = [(0, "a", "w " * 80, 0, 0), (1, "b", "w " * 18, 0, 0), (2, "c", "w w", 0, 0)]
    got = {r[1]: r[4] for r in mixed(spark, rows)}
    # Equal to the words of all: c stops at 6, b at 54, and a takes the rest.
    assert got == {"a": 40.0, "b": 54.0, "c": 6.0}


def test_mix_of_odd_rows(spark):
    assert mixed(spark, []) == []
    rows = [(None, None, None, 1, 1), (None, None, None, 1, 1), (5, "a", "", 1, 1), (5, "a", "one two", 1, 1)]
    got = mixed(spark, rows)
    assert len(got) == 4 and all(r[5] in (0, 1, 2, 3) for r in got)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, mix int, n int")
    out = emitted(mix(df, into="taken"), "taken")
    assert out.columns == ["doc_id", "source", "text", "mix", "n"]
    assert out.where("doc_id = 5 AND text <> ''").count() == {r[2]: r[5] for r in got}[2]


def test_record_round_trip():
    raw = record(7, "http://a.example/ x\r\ny", "é\r\n\r\n<p>".encode(), None)
    assert parsed(raw)["payload"] == "é\r\n\r\n<p>".encode()
    again = parsed(record(3, None, b"abc", 7))
    assert (again["record_type"], again["refers_to"], again["payload_bytes"], again["payload"], again["url"]) == ("revisit", 7, 3, None, None)


def test_url_keys():
    assert url_key("https://M.a.Example.com:8080/p?q=1#frag") == "com,example,a,m:8080)/p?q=1"
    assert url_key(None) == "" and url_key("http://x.org") == "org,x)/" and " " not in url_key("http://[bad /x y")


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.com/p{i % 50}", f"<p>{i % 90}</p>" * (i % 5)) for i in range(1500)]
    rows += [(5000, None, None), (5001, "http://x.example.org/", None), (None, "http://n.example.org/", "<p>alone</p>"), (None, "u", "<p>1</p>")]
    rows += [rows[3], (6000, "http://long.example.org/", "ü" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, offset int")
    write_archives(df.repartition(3), str(tmp_path / "w"))
    got = sorted(map(tuple, read_archives(spark, str(tmp_path / "w")).collect()), key=str)
    newest = {}
    for i, _, h in rows:
        if i is not None:
            newest[h or ""] = max(newest.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = newest.get(h or "")
        revisit = to is not None and to != i
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    assert got == sorted(want, key=str)
    found = find_captures(spark, str(tmp_path / "w"), ["http://h3.example.com/p3", "http://none.example/"])
    assert {r["page_id"] for r in found["http://h3.example.com/p3"]} == {i for i, u, _ in rows if u == "http://h3.example.com/p3"}
    assert found["http://none.example/"] == []


def test_small_payloads_are_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    write_archives(df, str(tmp_path / "w"), least_bytes=3)
    assert {r["page_id"]: r["refers_to"] for r in read_archives(spark, str(tmp_path / "w")).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_no_pages(spark, tmp_path):
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert read_archives(spark, str(tmp_path / "w")).count() == 0
