"""Building the corpus from documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessitura.functions.text import acceptable
from tessitura.operators.corpus import holdout_by_content, to_sentences

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
        StructField("source", StringType()), StructField("n_chars", LongType()),
    ]
)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def document_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, name: str = "*.parquet") -> DataFrame:
    """Parquet documents below `path` as a file stream; the schema is declared, never inferred."""
    reader = spark.readStream.schema(DOCUMENTS).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def clean_sentences(documents: DataFrame, references: DataFrame, allowed: str) -> DataFrame:
    """Sentences within the charset and not held out: the same expression on streams and tables."""
    sents = to_sentences(documents.select("doc_id", "lang", "source", "text"))
    kept = sents.where(acceptable(F.col("sentence"), F.lit(allowed)))
    return holdout_by_content(kept, references)


def incremental_corpus(stream: DataFrame, references: DataFrame, allowed: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, append each new (lang, sentence) once to `sink`, stop.

    Deduplication keeps its state in RocksDB, on disk and in the checkpoint, since the
    set of sentences grows with the corpus. The state and the file sink share the
    checkpoint, so a run that dies resumes without loss or repetition. Sources carry
    no caps here: a cap needs an order that arrival does not give.
    """
    rows = clean_sentences(stream, references, allowed).select("lang", "sentence")
    unique = rows.dropDuplicates(["lang", "sentence"])
    writer = (
        unique.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True)
    )
    # The query takes its settings when it starts; the session keeps its own.
    conf, before = stream.sparkSession.conf, stream.sparkSession.conf.get(PROVIDER, None)
    conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return writer.start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
