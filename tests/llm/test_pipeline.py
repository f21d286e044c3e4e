"""The stages of the corpus pipeline, each on its own input, against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tessitura.llm.mixing import mix
from tessitura.llm.quality import score_quality
from tessitura.llm.tokens import END_ID, byte_level_path
from tests.llm.test_texts import folded, grouped

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __score double"
PASSAGE = "the exact wording of this item is long enough to make a window of thirteen words and more"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw, folder = random.Random(6), str(tmp_path_factory.mktemp("tables"))
    good, bad = [f"good{k}" for k in range(60)], [f"bad{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(160):
        fine = i % 2
        text = " ".join(draw.choices(good if fine else bad, k=draw.randrange(20, 60)))
        if i % 10 == 3:
            text = rows[i - 2][1] + " tail"  # a near copy of another
        if i % 16 == 5:
            text = f"{text} {PASSAGE}"
        rows.append((i, text, "en", f"src{i % 3}", len(text), 0.0))
        labels.append((i, fine, 0))
    rows += [(200, None, None, None, None, None), (201, "", "en", "src0", 0, 1.0), (202, rows[1][1], "en", "src1", 1, 1.0), (None, rows[7][1], "en", "src1", 1, 1.0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "never seen here at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def stage(spark, tables, name, docs=None):
    docs = spark.read.parquet(f"{tables}/documents.parquet") if docs is None else docs
    out = dict(P.STAGES)[name](spark, docs, tables)
    return docs, out


def plain(rows):
    return sorted(map(tuple, rows), key=str)


def test_quality_drops_what_scores_below_one_half(spark, tables):
    docs, kept = stage(spark, tables, "quality")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    scored = score_quality(docs, labels, into="s").collect()
    assert kept.columns == docs.columns
    assert plain(kept.collect()) == plain(r[:6] for r in scored if r["s"] >= 0.5)
    assert {r["doc_id"] % 2 for r in kept.where("doc_id < 160 AND doc_id % 10 <> 3").collect()} == {1}


def test_one_of_each_group_stays(spark, tables):
    docs, kept = stage(spark, tables, "near_duplicate")
    rows = docs.collect()
    named = [r for r in rows if r["doc_id"] is not None]
    groups = grouped([r["text"] for r in named], 5, 80)
    least = {}
    for k, r in enumerate(named):
        least.setdefault(groups[k][1], []).append(r["doc_id"])
    stay = {min(ids) for ids in least.values()} | {None}
    assert plain(kept.collect()) == plain(r for r in rows if r["doc_id"] in stay) and len(stay) < len(rows)


def test_contaminated_documents_go(spark, tables):
    docs, kept = stage(spark, tables, "decontamination")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    item = word.findall(folded(PASSAGE))
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)} | {tuple("never seen here at all".split())}

    def dirty(text):
        words, hit = word.findall(folded(text)), set()
        for n in (13, 5):
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        return bool(hit) and 20 * len(hit) >= len(words)

    rows = docs.collect()
    clean = [r for r in rows if not dirty(r["text"])]
    assert plain(kept.collect()) == plain(clean) and 0 < len(rows) - len(clean) < 20


def test_documents_are_repeated_as_the_mix_takes_them(spark, tables):
    docs, kept = stage(spark, tables, "mixing")
    copies = Counter()
    for r in mix(docs, into="m").collect():
        copies[tuple(r)[:6]] += r["m"]["copies"]
    assert Counter(map(tuple, kept.collect())) == +copies


def test_the_last_stage_reads_back_the_ids(spark, tables):
    docs, out = stage(spark, tables, "token_output")
    library, start, want = Tokenizer.from_file(byte_level_path()), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, END_ID], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert plain(out.collect()) == plain(want)


def test_stages_in_a_row(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, one in P.STAGES:
        docs = one(spark, docs, tables)
    assert plain(P.run(spark, tables).collect()) == plain(docs.collect()) and docs.count() > 10


def test_stages_of_empty_tables(spark, tables):
    none = spark.createDataFrame([], DOCS)
    for name, one in P.STAGES:
        out = one(spark, none, tables)
        assert out.count() == 0 and (name == "token_output" or out.columns == none.columns)
