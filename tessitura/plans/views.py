"""Views over the provided tables that the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.draws import draw, unit
from tessitura.functions.text import strip_punct
from tessitura.functions.words import join_words, words
from tessitura.operators.corpus import to_sentences
from tessitura.operators.sampling import corrupt_words, noise_vocabulary
from tessitura.session import SPREAD

# Parameters of the registered queries: the tables are theirs, these are ours.
LANGS = ("en", "fr", "de", "es")
TARGET_MIX = {"en": 0.42, "fr": 0.34, "de": 0.24}
RATE = 0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table as it is scanned.

    A single-machine session may ask (`SPREAD`) for its rows to be dealt over a number of tasks, since a file
    of one row group cannot be split.
    """
    scan = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread = spark.conf.get(SPREAD, None)
    return scan.repartition(int(spread)) if spread else scan


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every normalised sentence of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return to_sentences(docs)


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences longer than one character as reference utterances with language-prefixed ids."""
    return (
        sentences(spark, sf_dir)
        .where(F.length("sentence") > 1)
        .select(
            F.concat_ws("_", "lang", F.col("doc_id").cast("string"), F.col("sent_no").cast("string")).alias("utt_id"),
            "lang",
            "source",
            "doc_id",
            "sent_no",
            F.col("sentence").alias("ref"),
        )
    )


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise vocabulary: all bare words of the references, numbered."""
    # No mark reaches beyond its word, so distinct words are stripped instead of texts.
    return noise_vocabulary(utterances(spark, sf_dir), "ref", strip_punct)


def with_hyps(utts: DataFrame, vocab: DataFrame, rate: float = RATE, system: str = "s1", text: str = "ref") -> DataFrame:
    """Add `hyp`: the simulated output of one system."""
    noisy = corrupt_words(utts, words(F.col(text)), "utt_id", vocab, rate, f"1337/{system}", out="hyp")
    return noisy.withColumn("hyp", join_words(F.col("hyp")))


def hyps(spark: SparkSession, sf_dir: str, rate: float = RATE, system: str = "s1") -> DataFrame:
    return with_hyps(utterances(spark, sf_dir), vocabulary(spark, sf_dir), rate, system)


def original_split(key: Column) -> Column:
    """A seeded train/validation label, 85 to 15."""
    return F.when(unit(draw("split", key)) < 0.85, "train").otherwise("validation")
