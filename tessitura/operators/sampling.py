"""Seeded sampling and augmentation.

Every draw is keyed by content (see `functions.draws`), so a sample is the same
under any partitioning, and a lost executor recomputes the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessitura.functions.draws import SCALE, SEED, draw, pick, unit
from tessitura.session import dimension, reliable_checkpoint, settled

#: A vocabulary that is sent to every task, where each Python worker holds it once; larger ones are joined.
SHIPPED_BYTES = 128 << 20
#: Distinct words that a task holds before it hands them on: some 50 MB of a Python worker.
TOLD = 1 << 19


def top_by_count(counts: DataFrame, by: list[str], value: str, n: str, cap: int, salts: int = 64) -> DataFrame:
    """The `cap` most frequent values per group, ties in value order; exact.

    A first cut inside hashed slices of each group leaves at most salts x cap rows
    for the task that makes the final cut, however large the group is.
    """
    order = [F.desc(n), F.asc(value)]
    slice_ = F.pmod(F.hash(value), F.lit(salts))
    coarse = counts.withColumn("_s", slice_).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order))
    )
    coarse = coarse.where(F.col("_r") <= cap).drop("_s", "_r")
    fine = coarse.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return fine.where(F.col("_r") <= cap).drop("_r")


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of single-spaced texts, each once in about TOLD words of a task."""
    seen: set[str] = set()
    for batch in batches:
        seen.update(pc.split_pattern(batch.column(0), " ").flatten().unique().to_pylist())
        if len(seen) >= TOLD:
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], ["word"])
            seen = set()
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], ["word"])


def noise_vocabulary(texts: DataFrame, text: str, form: Callable[[Column], Column] = lambda w: w) -> DataFrame:
    """`idx, word`: every distinct word of single-spaced texts, numbered from 0 in the order of its md5.

    `form` turns a word into the one that is kept. Repeats leave a task's words before they become rows.
    """
    told = texts.select(text).mapInArrow(_distinct_words, "word string")
    # Counted by slices, and numbered.
    found = reliable_checkpoint(told.select(form(F.col("word")).alias("word")).where(F.col("word") != "").distinct())
    numbered = hash_rank(found.withColumns({"_all": F.lit(0), "_d": F.md5("word")}), ["_all"], "_d", rank="idx")
    return reliable_checkpoint(numbered.select("idx", "word"))  # counted and joined


def _threshold(share: Column) -> Column:
    """`draw < threshold` as strings of hex digits just where `unit(draw) < share`, for shares from 0 to below 1."""
    return F.lpad(F.lower(F.hex(F.ceil(share * F.lit(SCALE)).cast("bigint"))), 8, "0")


#: Words with noise, and the places of their items, from 0, NULL for noise.
NOISE = StructType([StructField("words", ArrayType(StringType())), StructField("places", ArrayType(LongType()))])


def _drawn(prefixes: pa.Array, rates: pa.Array, sizes: np.ndarray, vocabulary: int) -> tuple[np.ndarray, ...]:
    """The places of a batch of rows' items and noise, -1 for noise; how many each row has; the numbers
    of the noise.

    An item's draw is the md5 of its row's prefix and its place: see `functions.draws`.
    """
    starts, spell = [p.encode() for p in prefixes.to_pylist()], [str(i).encode() for i in range(int(sizes.max(initial=0)))]
    md5 = hashlib.md5
    hashes = b"".join([md5(p + i).digest() for p, n in zip(starts, sizes.tolist()) for i in spell[:n]])
    parts = np.frombuffer(hashes, ">u4").reshape(-1, 4)
    u, number = parts[:, 0] / SCALE, parts[:, 1].astype(np.int64) % max(vocabulary, 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    rate = rates.to_numpy(zero_copy_only=False)[row]
    replaced = u < rate * 0.7
    deleted = (u < rate * 0.9) & ~replaced
    followed = (u < rate) & ~(replaced | deleted)
    pieces = 1 - deleted.astype(np.int64) + followed
    place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    places = np.repeat(np.where(replaced, -1, place), pieces)
    places[(np.cumsum(pieces) - 1)[followed]] = -1
    counts = np.bincount(row, pieces, len(sizes)).astype(np.int64)
    noisy = replaced | followed
    numbers = number[noisy]
    bare = np.flatnonzero(counts == 0)
    if len(bare):
        spare = np.frombuffer(b"".join([md5(starts[k] + b"empty").digest() for k in bare.tolist()]), ">u4").reshape(-1, 4)[:, 1]
        places = np.insert(places, np.cumsum(counts)[bare], -1)
        before = np.cumsum(np.bincount(row[noisy], minlength=len(sizes)))
        numbers = np.insert(numbers, before[bare], spare.astype(np.int64) % max(vocabulary, 1))
        counts[bare] = 1
    return places, counts, numbers


def _noise(vocab: DataFrame):
    """A function from a row's prefix, rate and words to `NOISE`, for a vocabulary that every task may hold."""
    table = vocab.orderBy("idx").select("word").toArrow().column("word").combine_chunks()
    held = vocab.sparkSession.sparkContext.broadcast(table)

    @arrow_udf(NOISE)
    def noise(prefixes: pa.Array, rates: pa.Array, words: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        places, counts, numbers = _drawn(prefixes, rates, sizes, len(held.value))
        gaps = places < 0
        kept = words.flatten().take(pa.array(places + np.repeat(np.cumsum(sizes) - sizes, counts), mask=gaps))
        filled = pc.replace_with_mask(kept, pa.array(gaps), held.value.take(pa.array(numbers)))
        ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, v) for v in (filled, pa.array(places, mask=gaps))], NOISE.names)

    return noise


def _noisy(rows: DataFrame, row_id: list[str], items: Column, key: Column, rate: Column, seed, vocab: DataFrame, out: str, labels: bool = False) -> DataFrame:
    """Per item: substitute below .7 of the rate, delete below .9, insert after it below 1.

    Items are words, or (word, label) pairs, whose noise has label 0. The draws are hashes of (seed, key, position) and
    give word numbers. A vocabulary of at most SHIPPED_BYTES goes to the tasks, the draws of a batch of rows are made
    together, and the rows stay where they are. Beyond that, see `_joined_noise`.
    A row left without items gets one noise word.
    """
    size, held = vocab.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + 4), F.lit(0))).first()
    if held > SHIPPED_BYTES:
        return _joined_noise(rows, row_id, items, key, rate, seed, vocab, size, out, labels)
    prefix = F.concat_ws("|", seed if isinstance(seed, Column) else F.lit(str(seed)), key, F.lit(""))
    staged = settled(rows, {"_items": items, "_prefix": prefix, "_rate": rate.cast("double")})
    staged = staged.withColumn("_drawn", _noise(vocab)("_prefix", "_rate", F.col("_items.word") if labels else F.col("_items")))
    made = F.col("_drawn.words")
    if labels:
        label = lambda p: F.coalesce(F.get(F.col("_items.label"), p.cast("int")), F.lit(0))
        made = F.zip_with(made, "_drawn.places", lambda w, p: F.struct(w.alias("word"), label(p).alias("label")))
    return staged.withColumn(out, made).drop("_items", "_prefix", "_rate", "_drawn")


def _joined_noise(rows: DataFrame, row_id: list[str], items: Column, key: Column, rate: Column, seed, vocab: DataFrame, size: int, out: str, labels: bool) -> DataFrame:
    """`_noisy` for a vocabulary of any size.

    A row becomes its kept words with gaps and the numbers of the words that fill them, in order. The gaps meet the
    vocabulary, by number, so no word is hot, and a row's noise words return to it under `row_id`.
    """
    kind = rows.select(items.alias("i")).schema["i"].dataType.elementType.simpleString()
    number = lambda d: (pick(d, 1, F.lit(size)) - 1).cast("bigint")

    def shares(r: Column) -> Column:
        return F.struct(_threshold(r * 0.7).alias("sub"), _threshold(r * 0.9).alias("del"), _threshold(r).alias("ins"))

    cuts, drawn = F.col("_cuts"), F.transform("_items", lambda w, i: draw(seed, key, i))
    staged = settled(rows, {"_items": items, "_cuts": shares(rate)})
    staged = settled(staged, {"_drawn": drawn})
    gap = F.lit(None).cast(kind)
    pieces = F.flatten(F.zip_with("_items", "_drawn", lambda w, d: F.when(d < cuts["sub"], F.array(gap)).when(d < cuts["del"], F.array().cast(f"array<{kind}>"))
                                  .when(d < cuts["ins"], F.array(w, gap)).otherwise(F.array(w))))
    wanted = F.filter("_drawn", lambda d: (d < cuts["sub"]) | ((d >= cuts["del"]) & (d < cuts["ins"])))
    staged = settled(staged, {"_pieces": pieces, "_wanted": F.transform(wanted, number)}).drop("_items", "_cuts", "_drawn")
    bare = F.size("_pieces") == 0
    staged = staged.withColumns({
        "_pieces": F.when(bare, F.array(gap)).otherwise(F.col("_pieces")),
        "_wanted": F.when(bare, F.array(number(draw(seed, key, F.lit("empty"))))).otherwise(F.col("_wanted")),
    })
    words = F.col("_pieces.word") if labels else F.col("_pieces")
    noise = staged.select(*row_id, F.posexplode("_wanted").alias("_at", "idx")).join(vocab, "idx")
    noise = noise.groupBy(*row_id).agg(F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_noise"))
    staged = staged.join(noise, row_id, "left")
    gaps = F.filter(F.transform("_pieces", lambda w, i: F.when(w.isNull(), i + 1)), lambda p: p.isNotNull())
    staged = settled(staged, {"_words": words, "_new": F.col("_noise.word"), "_gaps": gaps})
    filled = F.when(F.size("_gaps") == 0, F.col("_words")).otherwise(_between(F.col("_words"), F.col("_gaps"), F.col("_new")))
    if labels:
        made = F.zip_with(filled, F.col("_pieces.label"), lambda w, n: F.struct(w.alias("word"), F.coalesce(n, F.lit(0)).alias("label")))
    else:
        made = filled
    return staged.withColumn(out, made).drop("_pieces", "_wanted", "_noise", "_words", "_new", "_gaps")


def _between(pieces: Column, gaps: Column, noise: Column) -> Column:
    """The pieces with the k-th of `noise` in the place of the k-th gap; `gaps` are places from 1. Every piece is copied once."""
    after = lambda k: F.coalesce(F.get(gaps, k), F.lit(0)) + 1
    ended = F.transform(gaps, lambda p, k: F.concat(F.slice(pieces, after(k - 1), p - after(k - 1)), F.array(F.get(noise, k))))
    return F.flatten(F.concat(ended, F.array(F.slice(pieces, after(F.size(gaps) - 1), F.size(pieces)))))


def corrupt_words(rows: DataFrame, ws: Column, key: str, vocab: DataFrame, rate: Column | float, seed=SEED, out: str = "noisy", row_id: list[str] | None = None) -> DataFrame:
    """Add `out`: the words `ws` as a simulated recogniser gives them, with errors at `rate`, 70 %
    substitutions, 20 % deletions, 10 % insertions.

    Draws are keyed by `key`, so a key may have several rows, at several rates, told apart by `row_id`.
    """
    rate = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate
    return _noisy(rows, row_id or [key], ws, F.col(key), rate, seed, vocab, out)


def corrupt_labelled(rows: DataFrame, pairs: Column, key: str, vocab: DataFrame, seed=SEED, epoch: int = 0, out: str = "noisy") -> DataFrame:
    """The same over (word, label) pairs: noise words get label 0, deleted words lose theirs.

    The error rate is drawn per example: none for 15 % of them, else uniform in
    [.10, .45). The epoch is part of the key, so every epoch draws fresh noise.
    """
    keyed = F.concat_ws("#", F.col(key), F.lit(str(epoch)))
    per_row = draw(seed, keyed, F.lit("rate"))
    rate = F.when(unit(per_row, 0) < 0.15, F.lit(0.0)).otherwise(F.lit(0.10) + unit(per_row, 1) * 0.35)
    return _noisy(rows, [key], pairs, keyed, rate, seed, vocab, out, labels=True)


def holdout_split(rows: DataFrame, key: str, frac: float, seed: int | str = SEED) -> DataFrame:
    """Add `held`: true for a seeded share `frac` of the rows."""
    return rows.withColumn("held", unit(draw(seed, F.col(key))) < F.lit(float(frac)))


def hash_rank(rows: DataFrame, by: list[str], hexed: str, prefix: int = 4, rank: str = "rank") -> DataFrame:
    """Exact row numbers (from 0) of each group in the order of a hex-hash column.

    Leading digits of the hash cut a group into equal slices. Slices are numbered in
    parallel and shifted by the size of the slices before them, so no task sorts
    more than group / 16^prefix rows.
    """
    sliced = rows.withColumn("_slice", F.substring(hexed, 1, prefix))
    sizes = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*by, "_slice").orderBy(hexed)
    numbered = sliced.withColumn("_in", F.row_number().over(inside))
    return (
        numbered.join(shifts, [*by, "_slice"])
        .withColumn(rank, (F.col("_shift") + F.col("_in") - 1).cast("bigint"))
        .drop("_slice", "_shift", "_in")
    )


def stratified_devset(rows: DataFrame, mix: DataFrame, key: str, n: int = 900, seed: int | str = SEED) -> DataFrame:
    """`n` rows split over languages by `mix` (`lang, share`); short languages give all they have.

    Quotas round half to even. The literal bound on the row number lets every map
    task drop all but its own first n rows before the shuffle.
    """
    order = Window.partitionBy("lang").orderBy(draw(seed, F.col(key)), key)
    first = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    quota = mix.select("lang", F.bround(F.col("share") * n).cast("bigint").alias("_quota"))
    return first.join(dimension(quota), "lang").where(F.col("_r") <= F.col("_quota")).drop("_r", "_quota")


def devset_shortage(rows: DataFrame, mix: DataFrame, n: int = 900) -> DataFrame:
    """Wanted and available rows per language."""
    pools = rows.groupBy("lang").agg(F.count("*").alias("pool"))
    wanted = mix.select("lang", F.bround(F.col("share") * n).cast("bigint").alias("want"))
    joined = wanted.join(pools, "lang", "left").withColumn("pool", F.coalesce("pool", F.lit(0)))
    return joined.select(
        "lang", "want", "pool", F.least("want", "pool").alias("take"), (F.col("pool") < F.col("want")).alias("short")
    )


def mixture_sample(rows: DataFrame, weights: DataFrame, key: str, n: Column | int, seed: int | str = SEED) -> DataFrame:
    """Sample `n` rows with language weights, renormalised over the languages present.

    Short languages repeat until their quota is met: each row is emitted
    floor(quota / pool) times, and the first quota mod pool rows once more.
    """
    ranked = hash_rank(rows.withColumn("_d", draw(seed, F.col(key))), ["lang"], "_d")
    pools = rows.groupBy("lang").agg(F.count("*").alias("_pool"))
    present = pools.join(weights, "lang")
    total = F.sum("weight").over(Window.partitionBy())
    quotas = present.select(
        "lang", "_pool", F.bround(F.col("weight") / total * n).cast("bigint").alias("_quota")
    )
    copies = F.floor(F.col("_quota") / F.col("_pool")) + (F.col("rank") < F.col("_quota") % F.col("_pool")).cast("bigint")
    # The quotas are one row per language.
    sampled = ranked.join(F.broadcast(quotas), "lang").withColumn("_c", copies).where(F.col("_c") > 0)
    return sampled.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c")))).drop(
        "_d", "_pool", "_quota", "_c"
    )


def length_buckets(rows: DataFrame, length: str, key: str, size: int) -> DataFrame:
    """Batches of `size` rows of similar length per language, with the padding each one wastes.

    Lengths are few distinct numbers: their histogram gives every length its first
    position, and rows of one length are numbered in hash slices, so no language is
    sorted in one task.
    """
    hexed = rows.withColumn("_d", draw(0, F.col(key)))
    inside = hash_rank(hexed, ["lang", length], "_d", rank="_at")
    hist = rows.groupBy("lang", length).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("lang").orderBy(length).rowsBetween(Window.unboundedPreceding, -1)
    starts = hist.select("lang", length, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = inside.join(starts, ["lang", length])
    return placed.withColumn("batch", F.floor((F.col("_start") + F.col("_at")) / size)).drop("_d", "_at", "_start")


def padding_waste(batched: DataFrame, length: str) -> DataFrame:
    """Per language: batches, and the share of padded cells once each batch fills to its longest row."""
    per = batched.groupBy("lang", "batch").agg(
        F.sum(length).alias("used"), (F.max(length) * F.count("*")).alias("cells")
    )
    return per.groupBy("lang").agg(
        F.count("*").alias("batches"), (1 - F.sum("used") / F.sum("cells")).alias("padding")
    )
