import json

import pytest
from pyspark.sql import functions as F

from tessitura.operators.joins import template_fill
from tessitura.sources import readers, writers
from tessitura.streaming.incremental import DOCUMENTS, clean_sentences, document_stream, incremental_corpus

GOOD = 'id,transcription,language,original_split\nlug_1,"a \\"quoted\\" b, c",lug,train\nlug_2,,lug,validation\n'


def test_escaped_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(GOOD + "lug_3,too,many,fields,here\n", encoding="utf-8")
    rows, bad = readers.read_escaped_csv(spark, str(tmp_path / "a.csv"), readers.TRANSCRIPTS)
    got = {r["id"]: r["transcription"] for r in rows.collect()}
    assert got == {"lug_1": 'a "quoted" b, c', "lug_2": None}
    assert bad.count() == 1
    _, dropped = readers.read_escaped_csv(spark, str(tmp_path / "a.csv"), readers.TRANSCRIPTS, "drop")
    assert dropped.count() == 1
    with pytest.raises(Exception):
        readers.read_escaped_csv(spark, str(tmp_path / "a.csv"), readers.TRANSCRIPTS, "fail")[0].collect()


def test_routing_map_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"ID_A": "lin", "ID_B": "sna"}, indent=1), encoding="utf-8")
    assert sorted(map(tuple, readers.explode_routing_map(spark, str(tmp_path)).collect())) == [("ID_A", "lin"), ("ID_B", "sna")]
    assert readers.list_files(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize("size", [29, 100_000])
def test_csv_records_over_lines_and_splits(spark, tmp_path, size):
    rows = ['lug_%d,"line one\nline \\\\"two\\\\", %s\n\n\nend",lug,train' % (k, "x" * (k % 40)) for k in range(30)]
    rows += ["lug_90,plain,lug,train", 'lug_91,"",lug,', "", "lug_92,too,many,fields,here", 'lug_93,"a ""b",lug,train', 'lug_94,5 in,"lug",train']
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("id,transcription,language,original_split\n" + "\n".join(rows) + "\n", encoding="utf-8")
    want, lost = readers.read_escaped_csv(spark, str(tmp_path), readers.TRANSCRIPTS)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        got, bad = readers.read_split_csv(spark, str(tmp_path), readers.TRANSCRIPTS)
        found, rejected = sorted(map(tuple, got.collect()), key=str), bad.count()
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{key}")
    assert found == sorted(map(tuple, want.collect()), key=str) and rejected == lost.count() > 0


@pytest.mark.parametrize("indent", [None, 1])
def test_routing_maps_in_pieces(spark, tmp_path, indent):
    whole = {f"ID_{k}": "lin" for k in range(300)} | {"é{": "x}", "a b": "", "q\\\\": 'say "hi" there', "n": 5, "m": None, "last": "z}"}
    (tmp_path / "m.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    (tmp_path / "e.json").write_text("{}", encoding="utf-8")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
        got = readers.split_routing_map(spark, str(tmp_path))
        rows = got.collect()
        assert got.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == len(whole) and {r["utt_id"]: r["lang"] for r in rows} == {k: None if v is None else str(v) for k, v in whole.items()}
    (tmp_path / "bad.json").write_text(json.dumps({"a": 'x\\", y', "b": "c"}), encoding="utf-8")
    with pytest.raises(Exception, match="read the file whole"):
        readers.split_routing_map(spark, str(tmp_path / "bad.json")).collect()


def test_routing_maps_are_written_and_read(spark, tmp_path):
    rows = [(f"u{k}", ["lin", None, "s\u00fc"][k % 3]) for k in range(40)]
    writers.write_routing_map(spark.createDataFrame([*rows, (None, "x")], "utt_id string, lang string").repartition(3), str(tmp_path / "maps"))
    for read in (readers.split_routing_map, readers.explode_routing_map):
        assert sorted(map(tuple, read(spark, str(tmp_path / "maps")).collect()), key=str) == sorted(rows, key=str)


def test_submission_keeps_template_order_and_fills_blanks(spark, tmp_path):
    template = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "ID string, row_no int")
    preds = spark.createDataFrame([("a", 'say "hi", x'), ("b", " ")], "ID string, prediction string")
    rows, counts = template_fill(template, preds)
    assert counts.first().asDict() == {"rows": 3, "blank": 2, "missing": 1}
    writers.write_submission(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "out"))
    assert [tuple(r) for r in back.collect()] == [("b", "a"), ("a", 'say "hi", x'), ("c", "a")]


def test_corpus_and_manifest_files(spark, tmp_path):
    rows = spark.createDataFrame([("en", "x y", 3), ("fr", "z", 1)], "lang string, sentence string, weight bigint")
    writers.write_corpus(rows, str(tmp_path / "corpus"))
    assert spark.read.text(str(tmp_path / "corpus" / "lang=en")).count() == 3
    entry = F.array(F.struct(F.lit("s").alias("source"), F.lit(1).alias("sentences"), F.lit(2).alias("words"), F.lit(10).alias("repeated"), F.lit("cc0").alias("licence")))
    nested = spark.range(1).select(F.lit("en").alias("lang"), F.lit("en.txt").alias("file"), F.lit(1).alias("sentences"), F.lit(2).alias("words"), F.lit(2).alias("unique_words"), entry.alias("sources"))
    writers.write_manifest(nested, str(tmp_path / "manifest"))
    back = writers.manifest_rows(spark.read.text(str(tmp_path / "manifest")))
    assert back.first()["repeated"] == 10


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    docs = [(i, f"Aaa bbb {'ccc' if i % 2 else 'ddd'}. Eval text here! Zzz qqq.", "en", "s", 1) for i in range(6)]
    refs = spark.createDataFrame([("eval text here!",)], "text string")
    frame = spark.createDataFrame(docs, DOCUMENTS)
    folder, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame.where("doc_id < 3").coalesce(1).write.mode("append").parquet(folder)
    allowed = " abcdefghijklmnopqrstuvwxyz.!"
    run = lambda: incremental_corpus(document_stream(spark, folder, 1), refs, allowed, sink, state).awaitTermination()
    run()
    frame.where("doc_id >= 3").coalesce(1).write.mode("append").parquet(folder)
    run()
    got = sorted(r["sentence"] for r in spark.read.parquet(sink).collect())
    want = sorted(r["sentence"] for r in clean_sentences(frame, refs, allowed).select("sentence").distinct().collect())
    assert got == want == ["aaa bbb ccc.", "aaa bbb ddd.", "zzz qqq."]


def test_incremental_corpus_reads_a_table_of_several_files(spark, tmp_path):
    import __spark_entry__ as entry

    one, parts = "/root/testdata/sf0.001", tmp_path / "parts"
    parts.mkdir()
    (parts / "benchmark.parquet").symlink_to(f"{one}/benchmark.parquet")
    spark.read.parquet(f"{one}/documents.parquet").repartition(3).write.parquet(str(parts / "documents.parquet"))
    rows = [sorted(map(tuple, entry.queries()["incremental_corpus"](spark, str(d)).collect())) for d in (one, parts)]
    assert rows[0] and rows[0] == rows[1]
