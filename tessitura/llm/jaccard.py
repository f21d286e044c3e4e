"""Near-duplicate documents by a grouped prefix join over word shingles.

A document's shingles are ordered by (class, document frequency, hash), rare ones first; two sets
as similar as asked share one of their first few. Class 0 holds a fixed share of all hash values,
enough for a prefix of most sets, so frequencies are counted for that share only; any total order
is exact. Sets with the same prefix and size form one group, and only groups are joined:

1. Star pass: within each prefix shingle every group meets one leader. A pair passes by size,
   by the shingle's positions and by parity signatures, then members are verified by their whole
   sets. The links found settle nearly all near copies with work in proportion to the postings.
2. Rounds of leaders: within each prefix shingle whose members still lie in several components, all meet one
   member, another one each round. Rounds go on while they settle a good part of what is left, so that a family of near
   copies that the first leaders left in pieces grows together at a cost in proportion to its postings.
3. Rest pass: every pair of members that shares a prefix shingle and is not yet in one component
   meets, the largest component of a shingle never with itself. Pairs that pass the filters
   are verified. No link between components is lost, and no group is expanded into all its pairs.

Sets are 64-bit shingle hashes; equal sets are one node, known by a 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.components import components
from tessitura.llm.wordhash import WHITE, Slice, mix, ngram_hashes, slices, words
from tessitura.session import reliable_checkpoint

LANES = 8  # signature words of 64 bits
EARLIER = 4  # shingles of a prefix that are remembered with the one behind them
SETTLED = 0.9  # a round of leaders is followed by another while it settles more than a tenth of the postings
BROADCAST_ROWS = 500_000  # of 16 bytes of digest and an id: 12 MB


def shingle_sets(part: Slice, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    w = words(part, WHITE)
    ends = np.cumsum(w.counts)
    joined = ngram_hashes(w.hash, size)
    out = []
    for start, count in zip((ends - w.counts).tolist(), w.counts.tolist()):
        if count >= size:
            out.append(np.unique(joined[start : start + count - size + 1]))
        elif count:
            whole = ngram_hashes(w.hash[start : start + count], count)
            out.append(mix(whole + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(values: np.ndarray, size: int = 16) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=size).digest()


def _signature(values: np.ndarray) -> np.ndarray:
    odd = np.bincount((values >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _each(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for part in slices(batch.column("text")):
            for k, values in enumerate(shingle_sets(part, size)):
                yield batch, part.first + k, values


def _classes(percent: int) -> int:
    """One hash class in this many holds a prefix and a twentieth of the set more."""
    return max(1, 100 // (105 - percent))


def _counted_shingles(size: int, percent: int):
    classes = np.uint64(_classes(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for part in slices(batch.column("text")):
                sets = [v[v % classes == 0] for v in shingle_sets(part, size)]
                lengths = [len(v) for v in sets]
                doc = ids.take(pa.array(np.repeat(np.arange(part.first, part.first + len(sets)), lengths)))
                token = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([doc, pa.array(token)], names=["doc_id", "token"])

    return run


def _profiles(size: int, percent: int):
    """Per document: set size, digest, group key, signature, and the prefix shingles others may share."""
    classes = np.uint64(_classes(percent))
    names = ["doc_id", "n", "node", "prefix", *(f"s{k}" for k in range(LANES)), "tokens", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            common, counts = batch.column("common"), batch.column("counts")
            for part in slices(batch.column("text")):
                rows: dict[str, list] = {n: [] for n in names}
                for k, values in enumerate(shingle_sets(part, size)):
                    row = part.first + k
                    n = len(values)
                    length = n - -(-percent * n // 100) + 1
                    frequency = np.ones(n, np.int64)
                    known = common[row].values
                    if known is not None and len(known):
                        token = known.to_numpy().view(np.uint64)
                        at = np.searchsorted(values, token)
                        at[at == n] = 0
                        same = values[at] == token if n else np.zeros(len(token), bool)
                        frequency[at[same]] = counts[row].values.to_numpy()[same]
                    later = values % classes != 0
                    order = np.lexsort((values, frequency, later))[: length if n else 0]
                    shared = np.flatnonzero((frequency[order] > 1) | later[order])
                    prefix = values[order]
                    out = (ids[row].as_py(), n, _digest(values), _digest(np.append(prefix, np.uint64(n))), *_signature(values).tolist(),
                           prefix[shared].view(np.int64), shared.astype(np.int32))
                    for name, value in zip(names, out):
                        rows[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[n], pa.list_(pa.int64()) if n == "tokens" else pa.list_(pa.int32()) if n == "places" else
                              pa.int32() if n == "n" else pa.binary() if n in ("node", "prefix") else pa.int64()) for n in names], names=names)

    lanes = ", ".join(f"s{k} bigint" for k in range(LANES))
    return run, f"doc_id bigint, n int, node binary, prefix binary, {lanes}, tokens array<bigint>, places array<int>"


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of linked sets: 100 i >= percent (n + m - i)."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100.0 + percent) - F.lit(1e-9))


def _passes(left: str, right: str, percent: int) -> Column:
    """Size, position and signature filters on a pair that shares one prefix shingle."""
    c = lambda side, name: F.col(f"{side}.{name}")
    n, m = c(left, "n").cast("long"), c(right, "n").cast("long")
    needed = _needed(n, m, percent)
    before = F.least(c(left, "place"), c(right, "place"))
    after = F.least(n - c(left, "place"), m - c(right, "place"))
    differ = sum((F.bit_count(c(left, f"s{k}").bitwiseXOR(c(right, f"s{k}"))) for k in range(1, LANES)),
                 F.bit_count(c(left, "s0").bitwiseXOR(c(right, "s0"))))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (before + after >= needed) & (differ <= n + m - 2 * needed)


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int) -> None:
        self.docs, self.size, self.percent = docs, size, percent

    def profiles(self) -> DataFrame:
        counted = self.docs.mapInArrow(_counted_shingles(self.size, self.percent), "doc_id bigint, token bigint")
        frequent = counted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
        common = counted.join(frequent, "token").groupBy("doc_id").agg(F.collect_list(F.struct("token", "n")).alias("c"))
        run, schema = _profiles(self.size, self.percent)
        joined = self.docs.join(common, "doc_id", "left")
        joined = joined.select("doc_id", "text", F.col("c.token").alias("common"), F.col("c.n").alias("counts"))
        return reliable_checkpoint(joined.mapInArrow(run, schema))

    def verify(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs of nodes whose whole sets are similar enough."""
        pairs = reliable_checkpoint(pairs.select("a", "b").distinct())
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = reliable_checkpoint(wanted.join(nodes.select("node", "rep"), "node"))
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        size, percent = self.size, self.percent

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, row, values in _each(batches, size):
                node = _digest(values)
                if node == batch.column("node")[row].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["node", "values"])

        def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        texts = self.docs.join(wanted, F.col("doc_id") == F.col("rep")).select("node", "text")
        found = reliable_checkpoint(texts.mapInArrow(sets, "node binary, values binary"))
        both = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return reliable_checkpoint(both.mapInArrow(similar, "a binary, b binary"))

    def star_pairs(self, nodes: DataFrame) -> DataFrame:
        """At most one candidate for each member: a leader of a group it may match."""
        lanes = [f"s{k}" for k in range(LANES)]
        groups = nodes.groupBy("prefix").agg(
            F.min(F.struct("node", "n", *lanes)).alias("lead"), F.count("*").alias("members"), F.first("posting").alias("posting"))
        postings = groups.select("prefix", "lead", F.explode("posting").alias("p")).select(
            "prefix", "p.token", F.struct("p.place", "lead.*").alias("own"))
        leads = postings.groupBy("token").agg(F.min(F.struct("prefix", "own")).alias("l"), F.count("*").alias("groups")).where("groups > 1")
        met = postings.join(leads.select("token", F.col("l.own").alias("lead"), F.col("l.prefix").alias("other")), "token").where("prefix != other")
        n, m = F.col("own.n").cast("long"), F.col("lead.n").cast("long")
        room = F.least("own.place", "lead.place") + F.least(n - F.col("own.place"), m - F.col("lead.place"))
        met = met.where((F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & (room >= _needed(n, m, self.percent)))
        met = met.select("prefix", F.struct(F.lit(0).alias("place"), "lead.node", "lead.n", *(f"lead.{s}" for s in lanes)).alias("lead")).distinct()
        own = groups.where("members > 1").select("prefix", F.struct(F.lit(0).alias("place"), "lead.*").alias("lead"))
        member = nodes.select("prefix", F.struct(F.lit(0).alias("place"), "node", "n", *lanes).alias("member"))
        pairs = met.union(own).join(member, "prefix").where("member.node != lead.node").where(_passes("member", "lead", self.percent))
        return pairs.groupBy(F.col("member.node").alias("a")).agg(F.min("lead.node").alias("b"))

    def postings(self, nodes: DataFrame) -> DataFrame:
        """A row for each prefix shingle of each set, with the few before it in the set's order."""
        lanes = [f"s{k}" for k in range(LANES)]
        token, nothing = F.col("posting.token"), F.lit(None).cast("bigint")
        shifted = [F.concat(F.array_repeat(nothing, k), token).alias(f"e{k}") for k in range(1, EARLIER + 1)]
        rows = nodes.select("node", "n", *lanes, F.inline(F.arrays_zip(token.alias("token"), F.col("posting.place").alias("place"), *shifted)))
        earlier = F.array_compact(F.array(*[f"e{k}" for k in range(1, EARLIER + 1)]))
        return rows.where("token IS NOT NULL").select("node", "n", *lanes, "token", "place", earlier.alias("earlier"))

    def live_postings(self, postings: DataFrame, roots: DataFrame) -> DataFrame:
        """The postings of the shingles whose members lie in several components, with the largest of these."""
        placed = postings.drop("root", "largest").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        largest = placed.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(
            F.max_by("root", F.struct("k", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1")
        return reliable_checkpoint(placed.join(largest.select("token", "largest"), "token"))

    def leader_pairs(self, live: DataFrame, number: int) -> DataFrame:
        """At most one candidate for each member: the leader of one of its shingles, another one every round, and one
        that lies in the shingle's largest component if it can."""
        lanes = [f"s{k}" for k in range(LANES)]
        own = ("place", "n", "root", "node", *lanes)
        leads = live.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(number)).alias("draw"), *own)).alias("l"))
        leads = leads.select("token", F.struct(*(F.col(f"l.{c}").alias(c) for c in own)).alias("lead"))
        member = live.select("token", "largest", F.struct(*own).alias("member"))
        met = member.join(leads, "token").where("member.root != lead.root").where(_passes("member", "lead", self.percent))
        outside = F.col("lead.root") != F.col("largest")
        return met.groupBy(F.col("member.node").alias("a")).agg(F.min(F.struct(outside.alias("outside"), F.col("lead.node").alias("b"))).alias("l")).select("a", "l.b")

    def rest_pairs(self, live: DataFrame) -> DataFrame:
        """Candidates in different components.

        Sets that are alike share most of their prefix shingles: a pair that shares one just before this shingle has met
        under it already.
        """
        left = live.where("root != largest").alias("left")
        right = live.alias("right")
        new = ~F.arrays_overlap("left.earlier", "right.earlier")
        once = (F.col("right.root") == F.col("right.largest")) | (F.col("left.node") < F.col("right.node"))
        meet = (F.col("left.token") == F.col("right.token")) & (F.col("left.root") != F.col("right.root")) & once
        return left.join(right, meet & new & _passes("left", "right", self.percent)).select(
            F.col("left.node").alias("a"), F.col("right.node").alias("b"))

    def links(self, nodes: DataFrame) -> DataFrame:
        """Links that connect what is similar: the star pass, its rounds, and the rest pass."""
        links = self.verify(self.star_pairs(nodes), nodes)
        live = self.live_postings(self.postings(nodes), components(links))
        left, number = live.count(), 0
        while left:
            number += 1
            links = reliable_checkpoint(links.union(self.verify(self.leader_pairs(live, number), nodes)))
            live, before = self.live_postings(live, components(links)), left
            left = live.count()
            if left > SETTLED * before:
                return links.union(self.verify(self.rest_pairs(live), nodes))
        return links

    def run(self) -> DataFrame:
        profiles = self.profiles()
        usable = profiles.where("n > 0 AND doc_id IS NOT NULL")
        lanes = [F.first(f"s{k}").alias(f"s{k}") for k in range(LANES)]
        nodes = usable.groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), *lanes,
            F.first(F.arrays_zip(F.col("tokens").alias("token"), F.col("places").alias("place"))).alias("posting"))
        nodes = reliable_checkpoint(nodes)
        rooted = nodes.select("node", "rep").join(components(self.links(nodes)), "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
        found = rooted.join(least, "root").select("node", "component_id")
        return profiles.join(found, "node", "left").select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"),
            F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row.

    A document's set holds its distinct runs of `size` words (white-space separated, A-Z folded), or
    its whole word sequence if it has fewer. Two documents link when the intersection of their sets is
    at least `percent` per cent of the union. NULL, empty and wordless texts have empty sets, are
    linked with nothing and are their own component. Rows that share an id are documents of their own;
    a row without an id is linked with nothing and has no component. Other columns are ignored; an
    empty table gives an empty result.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _Join(plain, size, percent).run()
