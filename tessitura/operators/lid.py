"""Text language identification: multinomial naive Bayes over words, add-one smoothed."""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tessitura.operators.routing import argmax_route
from tessitura.session import reliable_checkpoint, shared_folder

#: Words of a model that the tasks may hold: about 100 MB in a Python worker.
HELD = 1 << 19
COUNTED = 1 << 19
_ROW = "\u0000"  # never a token: white-space splitting leaves it only if a text holds it alone


def _counted():
    """A function from batches of `lang, t` to their words with counts per language, in tables of about COUNTED words."""

    def counted(batches):
        def table(counts):
            words = pa.array(chain.from_iterable(counts.values()), pa.string())
            langs = pa.array(chain.from_iterable(repeat(lg, len(c)) for lg, c in counts.items()), pa.string())
            numbers = pa.array(chain.from_iterable(c.values() for c in counts.values()), pa.int64())
            return pa.RecordBatch.from_arrays([langs, words, numbers], ["lang", "word", "c"])

        counts: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(lang, Counter())
                own[_ROW] += 1
                own.update(text.split() if text else ())
            if sum(map(len, counts.values())) >= COUNTED:
                yield table(counts)
                counts = {}
        yield table(counts)

    return counted


def nb_fit(rows: DataFrame, text: str, langs: list[str]) -> tuple[DataFrame, DataFrame]:
    """`(words, classes)`.

    `words`: one row per training word with its count `n` and an array `gain`, one
    entry per language in the order of `langs`, the logarithm of count + 1 (NULL where
    the language never used the word). `classes`: `lang, logprior, default`; the default is what an unseen word
    costs, which counts instead of being skipped.
    """
    # Every row adds one pseudo word, so that one pass also counts the documents. The
    # finished table feeds several steps of scoring and is checkpointed.
    counts = rows.select("lang", F.lower(text).alias("t")).mapInArrow(_counted(), "lang string, word string, c bigint")
    wide = reliable_checkpoint(
        counts.groupBy("word").agg(
            F.sum("c").alias("n"), *[F.sum(F.when(F.col("lang") == lg, F.col("c"))).alias(f"_{lg}") for lg in langs]
        )
    )
    real = wide.where(F.col("word") != _ROW)
    stats = F.array(
        *[
            F.struct(
                F.lit(lg).alias("lang"),
                F.sum(F.when(F.col("word") == _ROW, F.col(f"_{lg}"))).alias("docs"),
                F.coalesce(F.sum(F.when(F.col("word") != _ROW, F.col(f"_{lg}"))), F.lit(0)).alias("tokens"),
            )
            for lg in langs
        ]
    )
    vocab = F.count_if(F.col("word") != _ROW)
    totals = wide.agg(stats.alias("s"), vocab.alias("v"))
    per = totals.select("v", F.explode("s").alias("x")).select("v", "x.*").where(F.col("docs") > 0)
    classes = per.select(
        "lang",
        F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy())).alias("logprior"),
        F.log(1 / (F.col("tokens") + F.col("v"))).alias("default"),
    )
    # ln((c + 1) / denominator) = ln(c + 1) + default: the table needs no join with the classes.
    gain = F.array(*[F.log(F.col(f"_{lg}") + 1.0) for lg in langs])
    return real.select("word", "n", gain.alias("gain")), classes


def _gains(held, langs: list[str]):
    """A function from a text to `tokens`, the summed `gains` of the words that `held` has, and the `rest` with their counts."""

    @arrow_udf(f"struct<tokens:bigint,gains:struct<{','.join(f'`{lg}`:double' for lg in langs)}>,rest:array<struct<word:string,m:bigint>>>")
    def gains(texts: pa.Array) -> pa.Array:
        index, table = held.value
        split = [t.split() if t else [] for t in texts.to_pylist()]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        ids = np.fromiter(map(index.get, words, repeat(len(table) - 1)), np.int64, len(words))
        sums = np.zeros((len(split), len(langs)))
        full = np.flatnonzero(sizes)
        if len(full):
            sums[full] = np.add.reduceat(table[ids], (np.cumsum(sizes) - sizes)[full])
        lost = np.flatnonzero(ids == len(table) - 1)
        row = np.repeat(np.arange(len(split)), sizes)[lost]
        kinds = Counter(zip(row.tolist(), map(words.__getitem__, lost.tolist())))
        ends = np.append(0, np.cumsum(np.bincount([r for r, _ in kinds], minlength=len(split)))).astype(np.int32)
        rest = pa.StructArray.from_arrays([pa.array([w for _, w in kinds], pa.string()), pa.array(kinds.values(), pa.int64())], ["word", "m"])
        per_lang = pa.StructArray.from_arrays([pa.array(sums[:, i]) for i in range(len(langs))], langs)
        return pa.StructArray.from_arrays([pa.array(sizes), per_lang, pa.ListArray.from_arrays(pa.array(ends), rest)], ["tokens", "gains", "rest"])

    return gains


def nb_score_rows(rows: DataFrame, text: str, key: str, model: tuple[DataFrame, DataFrame], langs: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """`key, by, copies, tokens, scores`: one row per key with a struct of one score per fitted language.

    A word adds its class's default, plus the logarithm of its count + 1 where the class knows it. The most
    frequent words, HELD at most, go to the tasks and are summed inside the row. Rarer ones, a few in a hundred of all
    occurrences, meet the rest of the model by a join, where none is heavy. `by` are columns that follow from the key;
    `copies` counts the rows that share it, whose words are scored together.
    """
    known, classes = model
    bits = F.length(F.bin("n"))
    cut, room = 65, HELD
    for band, n in sorted(known.groupBy(bits).agg(F.count("*")).collect(), reverse=True):  # by powers of two
        if n > room:
            break
        cut, room = band, room - n
    held = known.where(bits >= cut).select("word", *[F.coalesce(F.get("gain", F.lit(i)), F.lit(0.0)) for i in range(len(langs))]).toArrow()
    index = {w: i for i, w in enumerate(held.column(0).to_pylist())}
    table = np.zeros((len(index) + 1, len(langs)))  # the last row: not held
    table[:-1] = np.column_stack([c.to_numpy() for c in held.columns[1:]])
    found = rows.select(key, *by, _gains(rows.sparkSession.sparkContext.broadcast((index, table)), langs)(F.lower(text)).alias("_f"))
    if known.where(bits < cut).isEmpty():
        parts = found.select(key, *by, F.lit(1).alias("copies"), "_f.tokens", "_f.gains.*")
    else:
        # Read for the sums and for the words that are left.
        folder = shared_folder(rows.sparkSession, "gains")
        found.select(key, *by, "_f.*").write.parquet(folder)
        found = rows.sparkSession.read.parquet(folder)
        left = found.select(key, *by, F.inline("rest")).join(known.where(bits < cut), "word")
        added = [(F.col("m") * F.coalesce(F.get("gain", F.lit(i)), F.lit(0.0))).alias(lg) for i, lg in enumerate(langs)]
        parts = found.select(key, *by, F.lit(1).alias("copies"), "tokens", "gains.*").unionByName(
            left.select(key, *by, F.lit(0).alias("copies"), F.lit(0).cast("bigint").alias("tokens"), *added))
    sums = parts.groupBy(key, *by).agg(F.sum("copies").alias("copies"), F.sum("tokens").alias("tokens"), *[F.sum(f"`{lg}`").alias(f"_g{i}") for i, lg in enumerate(langs)])
    fitted = {c["lang"]: c for c in classes.collect()}  # one row per language
    scores = [
        (F.lit(fitted[lg]["logprior"]) + F.col(f"_g{i}") + F.col("tokens") * F.lit(fitted[lg]["default"])).alias(lg)
        for i, lg in enumerate(langs) if lg in fitted
    ]
    return sums.where("tokens > 0").select(key, *by, "copies", "tokens", F.struct(*scores).alias("scores"))


def nb_scores(rows: DataFrame, text: str, key: str, model: tuple[DataFrame, DataFrame], langs: list[str]) -> DataFrame:
    """`key, model_lang, score, tokens`: log prior plus summed word log likelihoods; see `nb_score_rows`."""
    scored = nb_score_rows(rows, text, key, model, langs)
    per_lang = [F.struct(F.lit(lg).alias("model_lang"), F.col("scores")[lg].alias("score")) for lg in scored.schema["scores"].dataType.names]
    return scored.select(key, F.inline(F.array(*per_lang)), "tokens")


def nb_predict(rows: DataFrame, text: str, key: str, model, langs: list[str]) -> DataFrame:
    """`key, lang`; a text without words is `??`."""
    scores = nb_scores(rows, text, key, model, langs).withColumnRenamed(key, "utt_id")
    best = argmax_route(scores.withColumn("score", F.round("score", 9)), langs).withColumnRenamed("utt_id", key)
    return rows.select(key).join(best, key, "left").select(key, F.coalesce("lang", F.lit("??")).alias("lang"))


def implied_routing(rows: DataFrame, text: str, key: str, model, langs: list[str], known: DataFrame) -> DataFrame:
    """Which language wrote each row of a file, against its known routing: mix, agreement and bias.

    `known` holds `key, lang`. One row per language.
    """
    read = nb_predict(rows, text, key, model, langs).withColumnRenamed("lang", "read")
    joined = read.join(known.select(key, F.col("lang").alias("routed")), key)
    n = joined.agg(F.count("*")).scalar()
    both = joined.select(
        F.explode(
            F.array(
                F.struct(F.col("read").alias("lang"), F.lit(1).alias("r"), F.lit(0).alias("k")),
                F.struct(F.col("routed").alias("lang"), F.lit(0).alias("r"), F.lit(1).alias("k")),
            )
        ).alias("x"),
        (F.col("read") == F.col("routed")).alias("same"),
    )
    per = both.groupBy("x.lang").agg(
        F.sum("x.r").alias("read"), F.sum("x.k").alias("routed"), F.sum((F.col("x.k") == 1).cast("int") * F.col("same").cast("int")).alias("agree")
    )
    return per.withColumns(
        {"read_share": F.col("read") / n, "routed_share": F.col("routed") / n, "bias": (F.col("read") - F.col("routed")) / n}
    )
