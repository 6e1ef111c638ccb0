"""SimHash near-duplicate components.

Fingerprints: 64 bits, a majority vote over the XXH64 (seed 42) of a text's word
shingles. Links: two fingerprints that differ in ``max_bits`` bits at most. With 8
blocks of 8 bits, three differing bits touch three blocks at most, so close pairs
agree on 5 whole blocks: each distinct fingerprint is dealt once for each choice of
5 blocks, keyed by the choice and its 40 bits. A bucket's fingerprints differ in 24
bits only, which bounds a bucket whatever the size of a group of copies; equal
fingerprints have been joined into one row before.

In a bucket, distances are verified pair by pair in blocks, or, in buckets larger
than the number of ways to change three of the 24 bits, by looking those ways up;
a bucket gives a spanning forest of its links (fewer edges than fingerprints), never
its pairs. Components are found by alternating large-star and small-star steps.

Defined results: null and empty texts have fingerprint 0 and link like any other;
rows of one doc_id with different texts belong to the documents they are; a null
doc_id takes part in links and is the smallest of a component only if all are null;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import byte_sizes, partitions, rows, settled, slices

BITS = 64
_PRINT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """SimHash of one text's UTF-8 bytes."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # bytes: A-Z only; white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    joined, votes = b" ".join(words), np.zeros(BITS, np.int64)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1)[:n].tolist()
    for at in range(0, n, 1 << 14):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 14)], stops[at : at + (1 << 14)], strict=True)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (64 bits as a signed long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data = b.column("text")
            made = np.array([fingerprint(t or b"", shingle) for t in (x.as_py() for x in data)], dtype=np.uint64)
            yield rows({"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "fp": made.view(np.int64)}, _PRINT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _masks(max_bits: int, blocks: int) -> list[int]:
    """A mask for each choice of blocks that a close pair may share whole."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in keep) for keep in combinations(range(blocks), blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(free: int, max_bits: int) -> np.ndarray:
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    return np.array([sum(c) for k in range(1, max_bits + 1) for c in combinations(bits, k)], dtype=np.uint64)


def _forest(fps: np.ndarray, free: int, max_bits: int) -> list[tuple[int, int]]:
    """Edges (root, member) of the components that links make inside one bucket."""
    fps, n = np.sort(fps), len(fps)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)

    ways = _flips(free, max_bits) if n > 64 else None
    if ways is None or n <= len(ways):
        for a in range(0, n, 512):
            close = np.bitwise_count(fps[a : a + 512, None] ^ fps[None, a:]) <= max_bits
            left, right = np.nonzero(close)
            later = right > left
            join(left[later] + a, right[later] + a)
    else:
        for w in ways:
            other = fps ^ w
            at = np.minimum(np.searchsorted(fps, other), n - 1)
            hit = np.nonzero((fps[at] == other) & (at > np.arange(n)))[0]
            join(hit, at[hit])
    roots = [root(i) for i in range(n)]
    return [(int(fps[r]), int(fps[i])) for i, r in enumerate(roots) if r != i]


def links(distinct: DataFrame, max_bits: int = 3, blocks: int = 8) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that make the same components as
    all pairs at ``max_bits`` differing bits or fewer."""
    masks = _masks(max_bits, blocks)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("choice", "bits"))
    dealt = keyed.repartition(partitions(distinct.sparkSession), "choice", "bits").sortWithinPartitions("choice", "bits")
    full = (1 << BITS) - 1
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def edges(choice: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
            new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]), [True]])
            cuts = np.nonzero(new)[0]
            sizes = np.diff(cuts)
            out: list[tuple[int, int]] = []
            two = cuts[:-1][sizes == 2]
            a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            near = np.bitwise_count(a ^ b) <= max_bits
            out += zip(np.minimum(a, b)[near].tolist(), np.maximum(a, b)[near].tolist(), strict=True)
            for i in np.nonzero(sizes > 2)[0]:
                out += _forest(fp[cuts[i] : cuts[i + 1]].view(np.uint64), full ^ masks[int(choice[cuts[i]])], max_bits)
            return out

        def batch(made: list[tuple[int, int]]) -> pa.RecordBatch:
            x = np.array(made, dtype=np.uint64).view(np.int64)
            return rows({"u": x[:, 0], "v": x[:, 1]}, schema)

        for b in batches:
            now = [np.concatenate([h, b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, ("choice", "bits", "fp"), strict=True)]
            if not len(now[0]):
                continue
            # the last bucket may go on in the next batch
            last = np.nonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[0]
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:] for x in now]
            if cut and (made := edges(*[x[:cut] for x in now])):
                yield batch(made)
        if len(held[0]) and (made := edges(*held)):
            yield batch(made)

    return dealt.select("choice", "bits", "fp").mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (u, v), root the component's least node, by
    alternating large-star and small-star steps. Minima are taken with map-side
    combining; a node with very many neighbours is split by the adaptive skew join."""

    def star(e: DataFrame, both: bool) -> DataFrame:
        # both: every neighbour sees the least of the neighbourhood, larger ones are moved there; else only the smaller ones
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = near.join(low, "u")
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if both else joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    at = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first()
        if now[0] == 0 or now == mark:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        at = settled(star(star(at, True), False))


def _classed(docs: DataFrame, shingle: int, max_bits: int, blocks: int) -> DataFrame:
    """doc_id, text_hash, fp, root (least fingerprint of the component) and component_id of every row."""
    prints = settled(fingerprints(docs, shingle))
    distinct = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), max_bits, blocks))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root"), "fp")


def classes(docs: DataFrame, shingle: int = 3, max_bits: int = 3, blocks: int = 8) -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the smallest doc_id that
    chains of links reach, the document itself included."""
    return _classed(docs, shingle, max_bits, blocks).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3, blocks: int = 8) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (ties: one text,
    and one row of repeated rows). A row without doc_id stays only where its component
    has no doc_id at all: it counts as having an id above all others, made from its text."""
    above = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    columns = docs.columns
    whole = docs.select(F.struct(*columns).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), above).alias("kept_id"), F.xxhash64("text").alias("kept_hash"))
    kept = (
        _classed(docs.select(F.coalesce(F.col("doc_id").cast("long"), above).alias("doc_id"), "text"), shingle, max_bits, blocks)
        .groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
        .select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))
    )
    one = whole.join(kept, ["kept_id", "kept_hash"], "left_semi").dropDuplicates(["kept_id", "kept_hash"])
    return one.select(*[F.col("doc")[c].alias(c) for c in columns])
