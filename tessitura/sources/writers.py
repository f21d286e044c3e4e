"""Writers for corpora, manifests and submissions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_lines(corpus: DataFrame) -> DataFrame:
    """`lang, line`, each sentence as often as its weight says."""
    repeated = corpus.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("weight"))))
    return repeated.select("lang", F.col("sentence").alias("line"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Text files per language; weights become repeated lines here and nowhere earlier."""
    corpus_lines(corpus).write.mode("overwrite").partitionBy("lang").text(path)


def write_manifest(nested: DataFrame, path: str) -> None:
    """The disclosure manifest as JSON, one object per language."""
    nested.write.mode("overwrite").json(path)


MANIFEST = (
    "lang string, file string, sentences bigint, words bigint, unique_words bigint, "
    "sources array<struct<source:string,sentences:bigint,words:bigint,repeated:bigint,licence:string,capped:boolean,skipped:boolean>>"
)


def manifest_rows(manifests: DataFrame, column: str = "value") -> DataFrame:
    """A JSON manifest back as one row per source with its language's totals."""
    m = manifests.select(F.from_json(column, MANIFEST).alias("m")).select("m.*")
    return m.select(
        "lang", "file", F.col("sentences").alias("total_sentences"), F.col("words").alias("total_words"), "unique_words",
        F.inline("sources"),
    )


def write_routing_map(rows: DataFrame, path: str, key: str = "utt_id", value: str = "lang") -> None:
    """Routing maps: a file of one flat JSON object for each task, an entry a line. NULL keys are left out."""

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = "{"
        for batch in batches:
            lines = []
            for k, v in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                lines.append(last if last == "{" else last + ",")
                last = f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}"
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([last + "}"])], names=["value"])

    named = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string"), F.col(value).cast("string"))
    named.mapInArrow(objects, "value string").write.mode("overwrite").text(path)


def write_submission(rows: DataFrame, path: str, columns: tuple[str, ...] = ("ID", "Target"), row_no: str = "row_no") -> None:
    """One CSV file in template order.

    The contract is a single ordered file, so the last step is one task; a template
    is as long as a test set, not as the data.
    """
    ordered = rows.orderBy(row_no).select(*columns).coalesce(1)
    ordered.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", "\\").csv(path)
