"""From raw documents to token shards: every stage works on all that its predecessor kept.

Every stage takes empty tables, rows that repeat, NULL in any column, and columns of any other name, which it returns as
they are.

Quality keeps what the classifier accepts, near duplicates keep one document of each group, decontamination
drops documents by the contract's rule, mixing repeats or leaves out documents towards its targets, and the
last stage writes token ids and returns what it reads back. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.decontaminate import contaminated, find_passages
from tessitura.llm.jaccard import near_duplicates
from tessitura.llm.mixing import emitted, mix
from tessitura.llm.quality import score_quality
from tessitura.llm.tokens import END_ID, byte_level_path, read_tokens, write_tokens
from tessitura.session import shared_folder

QUALITY = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A name for what a stage works with, apart from every column that the table brings."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labelled ones among them, does not reject.

    NULL and empty texts are scored like any other; rows without an id are never labelled, and are scored too.
    """
    score = _free(docs, "score")
    scored = score_quality(docs, _table(spark, sf_dir, "labels"), into=score)
    return scored.where(F.col(score) >= QUALITY).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates, with all that have no near duplicate.

    Rows that share the kept id and its group stay with it; rows without an id stay.
    """
    found = near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without, or with only a trace of, benchmark passages. NULL and empty texts have none and stay."""
    found = _free(docs, "found")
    marked = find_passages(docs, _table(spark, sf_dir, "benchmark"), into=found)
    return marked.where(~contaminated(found)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Sources may be NULL; a document without words is taken like others."""
    mixed = _free(docs, "mixed")
    return emitted(mix(docs, into=mixed), mixed).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, from the shards that were written."""
    folder = shared_folder(spark, "pipeline-tokens")
    write_tokens(docs, folder, byte_level_path(), END_ID)
    return read_tokens(spark, folder, ids=False)


STAGES = [
    ("quality", quality),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result stored before the next reads it."""
    docs = _table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
