"""Benchmark passages in training documents: one FM-index per shard of documents.

A shard is a run of documents of one scan partition, of a bounded number of bytes. Its words are
numbered by the words of the phrases searched for; a word that no phrase has can be in no match,
so it only separates, and runs shorter than the shortest phrase are left out of the index. All
phrases are searched backwards at once through the wavelet ranks of the index, occurrences are
located by sampled suffix positions, and their spans are merged per document. Nothing is shuffled.

The phrases come in blocks of bounded bytes, each broadcast for a pass of its own over the shards
in the same stage; a benchmark of any size is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessitura.llm.fm_index import FMIndex
from tessitura.llm.wordhash import NOT_WORD, slices, words

FOUND = "struct<n_words: bigint, items: array<string>, spans: array<struct<start: bigint, end: bigint>>>"


def hit_words(passages: str) -> Column:
    return F.aggregate(f"{passages}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(passages: str) -> Column:
    """Some word is hit, and at least one word in twenty."""
    n_hit = hit_words(passages)
    return (n_hit > 0) & (20 * n_hit >= F.col(f"{passages}.n_words"))


class Phrases:
    """Windows of benchmark items over numbered words, grouped by length."""

    def __init__(self, rows: list[tuple[str, str]], size: int) -> None:
        texts = pa.array([text for _, text in rows], pa.string())
        names = sorted({name for name, _ in rows})
        number = {name: k for k, name in enumerate(names)}
        hashed: list[np.ndarray] = []
        for part in slices(texts):
            w = words(part, NOT_WORD)
            hashed += np.split(w.hash, np.cumsum(w.counts)[:-1])
        self.names = names
        self.vocabulary = np.unique(np.concatenate(hashed)) if hashed else np.zeros(0, np.uint64)
        seen: dict[bytes, int] = {}
        windows: dict[int, list[np.ndarray]] = {}
        owners: list[set[int]] = []
        for (name, _), found in zip(rows, hashed):
            numbers = np.searchsorted(self.vocabulary, found) + 1
            width = min(size, len(numbers))
            for k in range(len(numbers) - width + 1) if width else ():
                window = numbers[k : k + width]
                key = window.tobytes()
                if key not in seen:
                    seen[key] = len(owners)
                    owners.append(set())
                    windows.setdefault(width, []).append((len(owners) - 1, window))
                owners[seen[key]].add(number[name])
        self.by_width = {w: (np.array([i for i, _ in x]), np.stack([a for _, a in x])) for w, x in windows.items()}
        self.owners = [np.array(sorted(x)) for x in owners]
        self.shortest = min(self.by_width, default=0)


def _numbered(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == hashes, at + 1, 0) if len(vocabulary) else np.zeros(len(hashes), np.int64)


class Shard:
    """Word numbers of a run of documents, kept where a phrase may lie."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.n_words: list[np.ndarray] = []
        self.text: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.docs = 0

    def add(self, texts: pa.Array) -> None:
        shortest = self.phrases.shortest
        for part in slices(texts):
            w = words(part, NOT_WORD)
            self.n_words.append(w.counts)
            base = self.docs
            self.docs += len(w.counts)
            if not len(w.hash) or not shortest:
                continue
            numbers = _numbered(w.hash, self.phrases.vocabulary)
            known = numbers > 0
            breaks = np.concatenate(([True], (w.doc[1:] != w.doc[:-1]) | (known[1:] != known[:-1])))
            run = np.cumsum(breaks) - 1
            length = np.bincount(run)
            keep = known & (length[run] >= shortest)
            if not keep.any():
                continue
            at = np.flatnonzero(keep)
            ends = np.flatnonzero(np.diff(run[at], append=-1) != 0) + 1
            first = np.cumsum(w.counts) - w.counts
            self.text.append(np.insert(numbers[at], ends, 0))
            self.doc.append(np.insert(w.doc[at] + base, ends, -1))
            self.place.append(np.insert(at - first[w.doc[at]], ends, -1))

    def find(self) -> tuple[np.ndarray, dict[int, set[int]], np.ndarray, np.ndarray]:
        """Words of each document; the items found in it; hit words as (document, word)."""
        n_words = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        items: dict[int, set[int]] = {}
        none = np.zeros(0, np.int64)
        if not self.text:
            return n_words, items, none, none
        text, doc, place = (np.concatenate(x) for x in (self.text, self.doc, self.place))
        index = FMIndex(text, len(self.phrases.vocabulary))
        change = np.zeros(len(text) + 1, np.int64)
        for width, (names, windows) in self.phrases.by_width.items():
            low, high = index.search(windows)
            found = np.flatnonzero(high > low)
            if not len(found):
                continue
            times = (high - low)[found]
            rows = np.repeat(low[found] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            at = index.locate(rows)
            np.add.at(change, at, 1)
            np.add.at(change, at + width, -1)
            pairs = np.unique(doc[at] * (len(self.phrases.owners) + 1) + np.repeat(names[found], times))
            for d, k in zip(*np.divmod(pairs, len(self.phrases.owners) + 1)):
                items.setdefault(int(d), set()).update(self.phrases.owners[k].tolist())
        hit = np.cumsum(change[:-1]) > 0
        return n_words, items, doc[hit], place[hit]


def _merged(old: list[tuple[int, int]], places: np.ndarray) -> list[tuple[int, int]]:
    """The spans of hit words, with those found before."""
    if len(places):
        cuts = np.flatnonzero(np.diff(places) != 1)
        new = list(zip(places[np.r_[0, cuts + 1]].tolist(), (places[np.r_[cuts, len(places) - 1]] + 1).tolist()))
    else:
        new = []
    if not old:
        return new
    out: list[tuple[int, int]] = []
    for start, end in sorted(old + new):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _search(phrases, schema: pa.Schema, text: str, into: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: Phrases = phrases.value
        held: list[pa.RecordBatch] = []
        shard, size = Shard(wanted), 0

        def flush() -> Iterator[pa.RecordBatch]:
            n_words, items, docs, places = shard.find()
            order = np.lexsort((places, docs))
            docs, places = docs[order], places[order]
            base = 0
            for batch in held:
                before = batch.column(into).to_pylist() if into in batch.schema.names else None
                out = []
                bounds = np.searchsorted(docs, np.arange(base, base + batch.num_rows + 1))
                for k in range(batch.num_rows):
                    old = before[k] if before else {"items": [], "spans": []}
                    spans = _merged([(s["start"], s["end"]) for s in old["spans"]], places[bounds[k] : bounds[k + 1]])
                    names = {wanted.names[i] for i in items.get(base + k, ())} | set(old["items"])
                    out.append({"n_words": int(n_words[base + k]), "items": sorted(names), "spans": [{"start": a, "end": b} for a, b in spans]})
                columns = [batch.column(n) for n in schema.names if n != into]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, schema.field(into).type)], schema=schema)
                base += batch.num_rows

        for batch in batches:
            held.append(batch)
            shard.add(batch.column(text))
            size += batch.nbytes
            if size >= shard_bytes:
                yield from flush()
                held, shard, size = [], Shard(wanted), 0
        if held:
            yield from flush()

    return run


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    into: str = "passages",
    shard_bytes: int = 32 << 20,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Every row of `docs` with a struct `into`: its number of words, the benchmark items that occur in
    it, and the spans of hit words (word numbers from 0, end exclusive, merged).

    An item occurs by any window of `size` consecutive words, or whole if it has fewer. Words are the
    maximal runs of 0-9, a-z (A-Z folded) and characters beyond ASCII. NULL and empty texts have no
    words and no hits; an item without words, text or id is never found; rows of one item id are one
    item; repeated documents are each searched. A column named like `into` is replaced, all other
    columns are passed on. An empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).cast("string").alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    keep = [c for c in docs.columns if c != into]
    out = docs.select(*keep)
    schema = StructType.fromDDL(f"{into} {FOUND}")
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        phrases = spark.sparkContext.broadcast(Phrases([tuple(r) for r in mine.collect()], size))
        whole = StructType([*out.select(*keep).schema.fields, *schema.fields])
        out = out.mapInArrow(_search(phrases, _arrow(whole), text, into, shard_bytes), whole)
    return out


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
