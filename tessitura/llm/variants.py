"""Spelling variants: words one edit apart, found through an index of variable-length grams.

1. Words are counted over all documents, bytes at a time.
2. The gram dictionary holds the grams of Q_MIN to Q_MAX characters whose text without the last character is
   frequent in the words (more than FREQUENT places), so rare grams are not made longer. A word is decomposed
   into the longest dictionary gram at each place, without those that lie within an earlier one.
3. One edit changes a bounded number of a word's grams: those across it, one that begins right after it if some
   dictionary gram could swallow it, and one that ends the word if it could have been longer. `_affected` takes the
   largest such number over all edits. Two words one edit apart share the other grams at the same
   place, or at the next one behind the inserted character.
4. So only a word's rarest grams, one more than can be affected, enter the lists that are merged: a list holds
   words with a gram at a place and of a length, and words meet those of their own length and of one more.
5. Where all grams of two words can be affected, both short, they meet by what is left when one character is taken
   out, which is exact for one edit and has lists bounded by the alphabet.
6. Every pair that met is verified by its edit distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.wordhash import FOLD, slices
from tessitura.session import reliable_checkpoint, shared_folder

Q_MIN, Q_MAX = 2, 6
FREQUENT = 1000
SLICE = 4 << 20
LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
LEAD = 0xC3  # the first byte of U+00C0 to U+00FF, whose second may be any


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def _crc_of(data: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, carried on from the crc of what lies before it; long runs are left out."""
    order = np.argsort(-length, kind="stable")
    begin, state, length = begin[order], ~state[order].astype(np.uint32), length[order]
    for k in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -k, "left"))
        state[:live] = CRC[(state[:live] ^ data[begin[:live] + k]) & 255] ^ (state[:live] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of the runs of letters, and which bytes are in one."""
    inside = LETTER[data] | (data == LEAD)
    inside[1:] |= data[:-1] == LEAD
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1 : len(data)]
    closes[:-1] &= ~inside[1:] | edge[1 : len(data)]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1, inside


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", typo: int | None = None, least: int = 5) -> DataFrame:
    """word and n of all runs of letters (A-Z, a-z and U+00C0 to U+00FF) of `least` or more characters in the
    texts, only A-Z lower-cased.

    With `typo`, a run loses the character h % length where that number divides h, the crc32 of
    `<doc_id>:<run>` (an id that is missing is empty there).
    """
    plain = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for part in slices(batch.column("text"), SLICE):
                data = FOLD[part.data]
                begin, end, inside = _runs(part.data, part.bounds)
                size = end - begin
                leads = np.zeros(len(data) + 1, np.int64)
                np.cumsum(data == LEAD, out=leads[1:])
                letters = size - (leads[end] - leads[begin])
                kept, changed = letters >= least, []
                if typo and len(begin):
                    heads = [zlib.crc32(f"{n or ''}:".encode()) for n in names[part.first : part.first + len(part.bounds) - 1]]
                    state = np.array(heads, np.uint32)[np.searchsorted(part.bounds, begin, "right") - 1]
                    short = size <= 64
                    h = np.empty(len(begin), np.uint32)
                    h[short] = _crc_of(data, begin[short], size[short], state[short])
                    for k in np.flatnonzero(~short).tolist():
                        h[k] = zlib.crc32(data[begin[k] : end[k]].tobytes(), int(state[k]))
                    for k in np.flatnonzero(h % np.uint32(typo) == 0).tolist():
                        word = data[begin[k] : end[k]].tobytes().decode()
                        at = int(h[k]) % len(word)
                        if len(word) > least:
                            changed.append(word[:at] + word[at + 1 :])
                        kept[k] = False
                offsets = np.zeros(int(kept.sum()) + 1, np.int32)
                np.cumsum(size[kept], out=offsets[1:])
                values = data[inside][np.repeat(kept, size)]
                words = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])
                counted = pc.value_counts(pa.concat_arrays([words, pa.array(changed, pa.string())]))
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["word", "n"])

    return plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _grams(words: DataFrame) -> DataFrame:
    """word, p, q and gram of every gram of up to Q_MAX - 1 characters: what may be frequent."""
    places = words.where(F.length("word") >= Q_MIN).select("word", F.posexplode(F.sequence(F.lit(1), F.length("word") - Q_MIN + 1)).alias("p", "_at"))
    sizes = places.select("word", "p", "_at", F.explode(F.sequence(F.lit(Q_MIN), F.least(F.lit(Q_MAX - 1), F.length("word") - F.col("p")))).alias("q"))
    return sizes.select("word", "p", "q", F.substring("word", F.col("_at"), F.col("q")).alias("gram"))


def _frequent(grams: DataFrame, frequent: int) -> DataFrame:
    """The grams that longer ones of the dictionary continue, and whether another of them ends in each."""
    often = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > frequent).select("gram")
    often = reliable_checkpoint(often)
    tails = often.select(F.substring("gram", 2, Q_MAX).alias("gram")).distinct().withColumn("left", F.lit(True))
    return often.join(tails, "gram", "left").select("gram", F.coalesce("left", F.lit(False)).alias("left"))


def decompose(word: str, often: dict[tuple[int, int], bool]) -> tuple[list[tuple[int, int]], int]:
    """A word's grams as (begin, end), and how many of them one edit can affect.

    `often` has the (place, length) of the word's frequent grams, and whether some frequent gram ends in each.
    """
    n, end, grams = len(word), 0, []
    for p in range(n - Q_MIN + 1):
        q = Q_MIN
        while q < Q_MAX and p + q < n and (p, q) in often:
            q += 1
        if p + q > end:
            end = p + q
            grams.append((p, end))
    # Differences of the number of affected grams: of edits of a character, and of insertions before one.
    at, before = [0] * (n + 2), [0] * (n + 2)
    for a, b in grams:
        # Swallowed by a longer gram from before, if one has its text but the last character at its end.
        swallowed = b - a < Q_MAX and (b - a == Q_MIN or often.get((a, b - a - 1), False))
        first = a - 1 if swallowed and a else a
        at[first] += 1
        at[b] -= 1
        first = a if swallowed else a + 1
        before[first] += 1
        before[b] -= 1
        if b == n and b - a < Q_MAX and (a, b - a) in often:
            before[n] += 1
            before[n + 1] -= 1
    most = total = other = 0
    for x, y in zip(at, before):
        total, other = total + x, other + y
        most = max(most, total, other)
    return grams, most


DECOMPOSED = "word string, size int, strong boolean, affected int, grams array<struct<gram: string, p: int>>"


def decomposed(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Each word's grams, how many of them an edit can affect, and whether one always remains (`strong`)."""
    grams = _grams(words)
    # Stored, so that the planner knows its size: it is broadcast below the session's threshold, else shuffled to.
    folder = shared_folder(words.sparkSession, "grams")
    _frequent(grams.select("gram"), frequent).write.parquet(folder)
    often = words.sparkSession.read.schema("gram string, left boolean").parquet(folder)
    found = grams.join(often, "gram").groupBy("word").agg(F.collect_list(F.struct("p", "q", "left")).alias("often"))
    joined = words.select("word").join(found, "word", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for word, often in zip(batch.column("word").to_pylist(), batch.column("often").to_pylist()):
                known = {(x["p"], x["q"]): x["left"] for x in often or ()}
                parts, affected = decompose(word, known)
                for column, x in zip(rows, (word, len(word), len(parts) > affected, affected, [{"gram": word[a:b], "p": a} for a, b in parts])):
                    column.append(x)
            gram = pa.struct([("gram", pa.string()), ("p", pa.int32())])
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(gram))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["word", "size", "strong", "affected", "grams"])

    return reliable_checkpoint(joined.mapInArrow(run, DECOMPOSED))


def _prefixes(words: DataFrame) -> DataFrame:
    """word, size, strong, gram and p of each word's rarest grams, one more than an edit can affect."""
    each = words.select("word", "size", "strong", "affected", F.inline("grams"))
    lists = each.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = each.join(lists, "gram").groupBy("word", "size", "strong", "affected").agg(F.array_sort(F.collect_list(F.struct("n", "gram", "p"))).alias("g"))
    return ranked.select("word", "size", "strong", F.inline(F.slice("g", F.lit(1), F.col("affected") + 1))).select("word", "size", "strong", "gram", "p")


def _one_edit(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def near_words(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """a and b of every pair of distinct words exactly one edit (an inserted, deleted or replaced character) apart,
    once each. `words` has one row per word."""
    parts = decomposed(words, frequent)
    lists = reliable_checkpoint(_prefixes(parts))
    key = lambda p, size: F.xxhash64("gram", p.cast("int"), size.cast("int"))
    p, size = F.col("p"), F.col("size")
    asked = F.explode(F.array_distinct(F.array(key(p, size), key(p, size + 1), key(p + 1, size + 1))))
    left = lists.select(asked.alias("key"), F.col("word").alias("a"), F.col("size").alias("n"), F.col("strong").alias("s"))
    right = lists.select(key(p, size).alias("key"), F.col("word").alias("b"), F.col("size").alias("m"), F.col("strong").alias("t"))
    once = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    met = left.join(right, "key").where(once & (F.col("s") | F.col("t")) & _one_edit("a", "b")).select("a", "b")
    # Pairs of words that may share no gram: what is left without one character.
    weak = parts.where("NOT strong").select("word", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("at"))
    rest = F.concat(F.substring("word", F.lit(1), F.col("at") - 1), F.substring("word", F.col("at") + 1, F.col("size")))
    rests = weak.select("word", "at", rest.alias("rest"))
    replaced = rests.select(F.xxhash64("rest", "at").alias("key"), "word")
    swapped = replaced.withColumnRenamed("word", "a").join(replaced.withColumnRenamed("word", "b"), "key").where((F.col("a") < F.col("b")) & _one_edit("a", "b"))
    longer = rests.select(F.xxhash64("rest").alias("key"), F.col("word").alias("b"))
    shorter = parts.where("NOT strong").select(F.xxhash64("word").alias("key"), F.col("word").alias("a"))
    grown = shorter.join(longer, "key").where(_one_edit("a", "b"))
    return met.union(swapped.select("a", "b")).union(grown.select("a", "b")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word and the last word that its forms lead to. A form is at least twice as frequent, so a chain is no longer than
    the counts have bits, and each round halves it."""
    jumps = reliable_checkpoint(forms.select("word", F.col("form").alias("root")).where("root IS NOT NULL"))
    while True:
        there = jumps.select(F.col("word").alias("root"), F.col("root").alias("far"))
        stepped = reliable_checkpoint(jumps.join(there, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        jumps = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return jumps


def spelling_variants(counts: DataFrame, frequent: int = FREQUENT, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word.

    `counts` has one row per word with its count n. Two words are near if they differ by exactly one inserted,
    deleted or replaced code point. A word's form is its near word of the largest n (ties: the smallest in code-point
    order), if that is at least `ratio` (2 or more) times the word's; its root is where its forms lead in the
    end, or the word itself. Rows without a word are left out; an empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent")
    counts = reliable_checkpoint(counts.where("word != ''").select("word", F.col("n").cast("long").alias("n")))
    pairs = reliable_checkpoint(near_words(counts, frequent))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    known = both.join(counts.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    joined = counts.join(best, "word", "left")
    wins = -F.col("best.minus") >= ratio * F.col("n")
    forms = reliable_checkpoint(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wins, F.col("best.other")).alias("form"),
        F.when(wins, -F.col("best.minus")).alias("form_n")))
    return forms.join(_roots(forms), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
