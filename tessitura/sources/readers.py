"""Readers for the file formats of the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessitura.session import reliable_checkpoint

TRANSCRIPTS = StructType(
    [StructField(c, StringType()) for c in ("id", "transcription", "language", "original_split")]
)
CORRUPT = "_corrupt_record"


def read_escaped_csv(spark: SparkSession, path: str, schema: StructType, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Header CSV whose quotes are backslash-escaped inside quoted fields: `(rows, rejected)`.

    `fail` stops at the first bad record, `drop` and `quarantine` keep the good ones;
    only `quarantine` returns the rejected text. The rejected table always exists, so
    the number of lost records can always be reported.
    """
    reader = spark.read.option("header", True).option("escape", "\\").option("quote", '"').option("multiLine", True)
    if mode == "fail":
        rows = reader.option("mode", "FAILFAST").schema(schema).csv(path)
        return rows, spark.createDataFrame([], f"{CORRUPT} string")
    if mode not in ("drop", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(wide).csv(path)
    # Spark refuses to read the reject column alone; touching a data column keeps both in the scan.
    touched = F.length(F.concat_ws("", schema.fields[0].name, CORRUPT)) >= 0
    bad = parsed.where(F.col(CORRUPT).isNotNull() & touched)
    rejected = bad.select(CORRUPT) if mode == "quarantine" else bad.select(F.lit(None).cast("string").alias(CORRUPT))
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rejected


# The rest of a quoted field, up to its closing quote.
QUOTED = re.compile(r'(?:[^"\\]|\\.)*"')


def _stays_open(line: str, inside: bool) -> bool:
    """Whether a quoted field is still open behind a line."""
    at = 0
    while True:
        if inside:
            closing = QUOTED.match(line, at)
            if closing is None:
                return True
            at = closing.end()
        at = line.find(",", at) + 1
        if at == 0:
            return False
        inside = line.startswith('"', at)
        at += inside


def _opens(line: str, inside: bool) -> bool:
    return _stays_open(line[1:], True) if not inside and line.startswith('"') else _stays_open(line, inside)


def read_split_csv(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """`read_escaped_csv` in `quarantine` mode for files of any size: records may span lines, and still a file is read by
    several tasks.

    Whether a line lies inside a quoted field depends on all lines before it. So every split of a file follows its
    lines twice, as if it began outside and inside a field, and numbers the records of both cases. A split's
    case follows from the ends of those before it, a row for each split; lines of one record number are then put together.
    """
    text = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, states, records, no = None, [False, True], [0, 0], 0
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for line, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != split:
                    split, states, records, no = (file, block), [False, True], [0, 0], 0
                no += 1
                for case in (0, 1):
                    records[case] += not states[case]
                    states[case] = _opens(line, states[case])
                for column, x in zip(rows, (no, *records, *states)):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(rows, kinds))], names=["value", "file", "block", "no", "r0", "r1", "s0", "s1"])

    def cases(splits: pd.DataFrame) -> pd.DataFrame:
        inside, before, out = False, 0, []
        for row in splits.sort_values("block").itertuples():
            out.append((row.file, row.block, inside, before))
            before += row.r1 if inside else row.r0
            inside = row.s1 if inside else row.s0
        return pd.DataFrame(out, columns=["file", "block", "inside", "before"])

    lines = reliable_checkpoint(text.mapInArrow(follow, "value string, file string, block long, no long, r0 long, r1 long, s0 boolean, s1 boolean"))
    ends = lines.groupBy("file", "block").agg(F.max_by(F.struct("r0", "r1", "s0", "s1"), "no").alias("e")).select("file", "block", "e.*")
    begins = ends.groupBy("file").applyInPandas(cases, "file string, block long, inside boolean, before long")
    placed = lines.join(begins, ["file", "block"]).withColumn("record", F.col("before") + F.when(F.col("inside"), F.col("r1")).otherwise(F.col("r0")))
    together = placed.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "no", "value"))).alias("l"))
    whole = together.where("record > 1").select(F.rtrim(F.array_join("l.value", "\n"), F.lit("\r")).alias("v")).where("v <> ''")
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    options = {"quote": '"', "escape": "\\", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = whole.select(F.from_csv("v", wide.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("c")).select("c.*")
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT), parsed.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_sources(spark: SparkSession, paths: dict[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of every source's Parquet table that can be opened, under `origin`, and `source, error` of the others.

    A source that was moved or renamed costs its own rows only. Every table is read with the columns of `schema`.
    """
    found, failed = spark.createDataFrame([], f"{schema}, origin string"), []
    for name, path in paths.items():
        try:
            rows = spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in found.schema.fields[:-1]])
        except AnalysisException as problem:
            failed.append((name, str(problem)[:200]))
        else:
            found = found.union(rows.withColumn("origin", F.lit(name)))
    return found, spark.createDataFrame(failed, "source string, error string")


def explode_map(rows: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """One row per entry of a column of flat JSON objects."""
    kept = [c for c in rows.columns if c != column]
    return rows.select(*kept, F.explode(F.from_json(column, "map<string,string>")).alias(key, value))


def explode_routing_map(spark: SparkSession, path: str) -> DataFrame:
    """`utt_id, lang` from files that hold one JSON object each."""
    text = spark.read.text(path, wholetext=True)
    return explode_map(text, "value", "utt_id", "lang")


def split_routing_map(spark: SparkSession, path: str) -> DataFrame:
    """`explode_routing_map` for objects of any size: no row holds a whole file, and a file is read by several tasks.

    The text is cut behind strings that a comma follows, where entries end. A piece's number of quotes tells
    whether its last one was cut off; with that put back, a piece is an object of a few entries. A string with an escaped
    quote before a comma is cut inside, which is an error here: such a file must be read whole.
    """
    pieces = spark.read.option("lineSep", '",').text(path)
    body = F.regexp_replace("value", r"^\s*\{", "")
    bare = F.regexp_replace("value", r"\\.", "")
    closed = (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2 == 0
    split = F.col("value").rlike(r"(?<!\\)(?:\\\\)*\\$")
    entry = F.when(closed, F.regexp_replace(body, r"\}\s*$", "")).otherwise(F.concat(body, F.lit('"')))
    parsed = F.from_json(F.concat(F.lit("{"), entry, F.lit("}")), "map<string,string>", {"mode": "FAILFAST"})
    checked = F.when(split, F.raise_error(F.lit("an escaped quote before a comma: read the file whole"))).otherwise(parsed)
    return pieces.select(F.explode(checked).alias("utt_id", "lang"))


MANIFEST = (
    "seed bigint, n bigint, source string, target_mix map<string,double>, actual_mix map<string,double>, "
    "items array<struct<id:string,language:string,reference:string>>"
)


def explode_manifest(manifests: DataFrame, column: str = "value") -> DataFrame:
    """`seed, n, id, language, reference` from a column of dev-set manifests."""
    parsed = manifests.select(F.from_json(column, MANIFEST).alias("m"))
    return parsed.select(F.col("m.seed").alias("seed"), F.col("m.n").alias("n"), F.inline("m.items"))


def explode_eval_manifest(spark: SparkSession, path: str) -> DataFrame:
    return explode_manifest(spark.read.text(path, wholetext=True))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes below a folder; file contents are pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"))
