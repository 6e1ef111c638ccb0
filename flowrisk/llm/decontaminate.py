"""Benchmark decontamination: passages of documents that are within a bounded edit
distance of a benchmark item.

Texts are lower-cased, white space runs become one space. An item of ``n`` characters
matches a passage at edit distance ``d = floor(RATIO * n)`` or less. Per document:

1. Windows: places and sizes. Disjoint pieces of an item: at distance ``d`` one of
   ``d + 1`` is whole, so grams of ``q <= (n - d) / (d + 1)`` characters are shared; by the
   q-gram lemma a match shares ``n - q + 1 - q * d`` of them on ``2 * d + 1`` neighbouring
   diagonals. Windows of ``n`` characters start where the grams on a band of diagonals
   reach that count. No match is lost.
2. Candidates. CGK embedding: random walks map windows and items to strings of steps whose
   Hamming distance follows the edit distance. Bands of ``STEPS`` sampled steps
   (bit-sampling LSH) of a window are looked up in the table of all items' bands: the items
   of its size with an equal band are its candidates. A band is so long that few unrelated
   windows share one of an item's; the number of walks, each of which gives ``BANDS``
   bands, is the least at which items with ``d`` random edits are found at ``RECALL``,
   measured in tasks before the search on all items, ``TRIALS`` times each, in the windows
   that step 1 gives. An item that was lost once is a candidate of all its windows.
3. Verification: exact edit distance (bit-parallel, free ends) between the item and the
   passage around the window.

The items are the query set: they are sent to all tasks in blocks of ``BLOCK_CHARS``
characters, about; each block is one pass over the documents.

Defined results: null and empty texts and items match nothing; items of equal texts
match each on its own; repeated rows give repeated results; empty tables give no
matches; further columns are ignored or kept as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from flowrisk.llm.common import byte_sizes, mix64, partitions, rows, slices, texts, trimmed
from flowrisk.llm.suffix_dedup import gram_hashes

#: Edit distance per item character, share of random matches that LSH must find.
RATIO, RECALL = 0.1, 0.99
GRAM = 8
BANDS, STEPS = 8, 6
MAX_WALKS = 64
#: Random edits of each item that calibrate the walks.
TRIALS = 4
#: Characters of benchmark items that go to all tasks at once.
BLOCK_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def edit_match(item: str, text: str, most: int) -> tuple[int, int, int] | None:
    """Least edit distance between ``item`` and a passage of ``text`` with the passage's
    start and end, or None above ``most``; Myers' bit-parallel columns, free ends."""

    def ends(p: str, t: str, free_start: bool) -> tuple[int, int]:
        n, full, peq = len(p), (1 << len(p)) - 1, {}
        for i, c in enumerate(p):
            peq[c] = peq.get(c, 0) | 1 << i
        pv, mv, score, top = full, 0, n, 1 << (n - 1)
        best = (n, 0)
        for j, c in enumerate(t, 1):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            score += (ph & top > 0) - (mh & top > 0)
            ph = ph << 1 & full | (not free_start)
            mh = mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            if score < best[0]:
                best = (score, j)
        return best

    score, end = ends(item, text, True)
    if score > most:
        return None
    _, back = ends(item[::-1], text[:end][::-1], False)
    return score, end - back, end


class Embedding:
    """CGK random walks over code points: ``walks`` walks, of each ``BANDS`` bands of ``STEPS`` steps."""

    def __init__(self, walks: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.seeds = rng.integers(1, 2**63, MAX_WALKS, dtype=np.int64).astype(np.uint64)[:walks]
        # a walk passes a character in two steps on average; the earlier steps are in step more often
        self.at = rng.random((MAX_WALKS, BANDS * STEPS))[:walks]

    def bands(self, strings: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """[string, walk, band * step]: the embedded characters at the sampled steps; ``n``: the item's length."""
        count, walks = len(strings), len(self.seeds)
        size = np.fromiter(map(len, strings), np.int64, count)
        padded = np.zeros((count, int(size.max(initial=0)) + 1), np.uint64)
        for i, s in enumerate(strings):
            padded[i, : len(s)] = s
        want = np.minimum((self.at[None] * n[:, None, None]).astype(np.int64), 2 * n[:, None, None])
        out = np.zeros(want.size, np.uint64)
        steps = int(want.max(initial=-1)) + 1
        order = np.argsort(want.reshape(-1), kind="stable")  # the samples in the order of their steps
        cuts = np.searchsorted(want.reshape(-1)[order], np.arange(steps + 1))
        whose = order // (BANDS * STEPS)
        pos, row = np.zeros((count, walks), np.int64), np.arange(count)[:, None]
        for j in range(steps):
            now = padded[row, np.minimum(pos, size[:, None])]
            out[order[cuts[j] : cuts[j + 1]]] = now.reshape(-1)[whose[cuts[j] : cuts[j + 1]]]
            pos += (mix64(now * np.uint64(0x9E3779B97F4A7C15) + self.seeds[None] + np.uint64(j * 0x632BE5AB & (2**64 - 1))) >> np.uint64(63)).astype(np.int64)
        return out.reshape(count, walks, BANDS, STEPS)

    def keys(self, strings: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """[string, walk, band]: a hash of the band's steps, its place and the item's length."""
        bands = self.bands(strings, n)
        place = np.arange(bands.shape[1] * BANDS, dtype=np.uint64).reshape(1, -1, BANDS)
        key = mix64((n.astype(np.uint64)[:, None, None] << np.uint64(20)) + place)
        for k in range(STEPS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[..., k])
        return key


def _mutated(p: np.ndarray, edits: int, alphabet: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    s = p.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(0, max(1, len(s)))), int(rng.integers(0, 3))
        c = int(rng.choice(alphabet))
        if kind == 0 and s:
            s[at] = c
        elif kind == 1:
            s.insert(at, c)
        elif s:
            del s[at]
    return np.array(s, dtype=np.uint32)


class Items:
    """A block of benchmark items, indexed for the search."""

    def __init__(self, ids: list[int], items: list[str], ratio: float = RATIO, recall: float = RECALL, hits: dict[str, bytes] | None = None):
        named = [(i, t) for i, t in zip(ids, items, strict=True) if t]
        self.ids = [i for i, _ in named]
        self.texts = [t for _, t in named]
        self.points = [points(t) for t in self.texts]
        self.n = np.array([len(p) for p in self.points], np.int64)
        self.d = np.floor(ratio * self.n).astype(np.int64)
        self.q = np.minimum(GRAM, (self.n - self.d) // (self.d + 1))
        self.least = np.maximum(1, self.n - self.q + 1 - self.q * self.d)
        self.groups = [self._indexed(int(q)) for q in np.unique(self.q)] if named else []
        self.exact = np.zeros(len(named), bool)  # items that are candidates of all their windows
        self.embedding, self.recall = Embedding(1), 1.0
        if named and recall:
            self._calibrated(recall, np.stack([np.frombuffer(hits[t], np.uint8) for t in self.texts]) if hits else self.trials())
            self.table = self._banded()

    @property
    def own(self) -> np.ndarray | None:
        """The items' bands."""
        return self.embedding.bands(self.points, self.n) if self.texts else None

    def _banded(self) -> tuple[np.ndarray, np.ndarray]:
        """Band keys of the items, sorted, and the item of each."""
        of = np.nonzero(~self.exact)[0]
        keys = [self.embedding.keys([self.points[i] for i in part], self.n[part]).reshape(-1) for part in np.array_split(of, max(1, len(of) // 256)) if len(part)]
        key = np.concatenate([*keys, np.empty(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        return key[order], np.repeat(of, len(self.embedding.seeds) * BANDS)[order].astype(np.int32)

    def _indexed(self, q: int):
        of = np.nonzero(self.q == q)[0]
        grams = [gram_hashes(self.points[i], q) for i in of]
        item = np.repeat(of, [len(g) for g in grams])
        offset = np.concatenate([np.arange(len(g)) for g in grams])
        grams = np.concatenate(grams)
        order = np.argsort(grams, kind="stable")
        keys, first = np.unique(grams[order], return_index=True)
        bits = 16
        while len(keys) * 32 > 1 << bits and bits < 26:
            bits += 1
        maybe = np.zeros(1 << bits, bool)
        maybe[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
        return q, keys, np.append(first, len(grams)), item[order], offset[order], np.uint64(64 - bits), maybe

    def trials(self) -> np.ndarray:
        """[item, bytes]: for each trial and walk a bit, whether the item with as many random edits as
        allowed is found. An item's trials follow from its text alone, wherever they run."""
        full = Embedding(MAX_WALKS)
        same = np.zeros((len(self.texts), TRIALS, MAX_WALKS), bool)
        for a in range(0, len(self.texts), 64):
            of = np.repeat(np.arange(a, min(a + 64, len(self.texts))), TRIALS)
            batch = []
            for i in of[::TRIALS]:
                rng, alphabet = np.random.default_rng(zlib.crc32(self.texts[i].encode("utf-8", "surrogatepass"))), np.unique(self.points[i])
                for _ in range(TRIALS):
                    edited = _mutated(self.points[i], int(self.d[i]), alphabet, rng)
                    around = ["".join(map(chr, rng.choice(alphabet, 40))) for _ in range(2)]
                    batch.append(normalise(" ".join([around[0], "".join(map(chr, edited)), around[1]])))
            found = [f for f in self._found(batch) if f[1] == of[f[0]]]
            own = full.keys([self.points[i] for i in of[::TRIALS]], self.n[of[::TRIALS]])
            for b in range(0, len(found), 256):
                part = found[b : b + 256]
                who = np.array([i for _, i, _ in part])
                hit = (full.keys(self._cut(batch, part), self.n[who]) == own[who - a]).any(axis=2)
                np.logical_or.at(same, (who, np.array([t % TRIALS for t, _, _ in part])), hit)
        return np.packbits(same.reshape(len(self.texts), -1), axis=1)

    def _calibrated(self, recall: float, trials: np.ndarray) -> None:
        """Takes the fewest walks at which the trials are found at ``recall``, notes the share that
        is found with them, and marks the items that are lost as ``exact``."""
        same = np.unpackbits(trials, axis=1)[:, : TRIALS * MAX_WALKS].reshape(len(trials), TRIALS, MAX_WALKS).astype(bool)
        at_least = np.logical_or.accumulate(same, axis=2)
        walks = next((w for w in range(1, MAX_WALKS + 1) if at_least[:, :, w - 1].mean() >= recall), MAX_WALKS)
        self.exact = ~at_least[:, :, walks - 1].all(axis=1)
        self.embedding, self.recall = Embedding(walks), float((at_least[:, :, walks - 1] | self.exact[:, None]).mean())

    def search(self, batch: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the best passage of each text and item; offsets in the normalised text."""
        batch = [normalise(t) for t in batch]
        found = self._found(batch)
        return self._verified(batch, self._near(batch, found)) if found else []

    def _found(self, batch: list[str]) -> list[tuple[int, int, int]]:
        """Text, item and start of the windows of normalised texts."""
        data = points("\0".join([*batch, ""]))
        sizes = np.fromiter(map(len, batch), np.int64, len(batch))
        ends = np.cumsum(sizes + 1) - 1
        found: list[tuple[int, int, int]] = []  # text, item, window's start in the text
        for q, keys, first, item, offset, shift, maybe in self.groups:
            if len(data) < q:
                continue
            h = gram_hashes(data, q)
            pos = np.nonzero(maybe[(h >> shift).astype(np.int64)])[0]
            h = h[pos]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            pos, at = pos[hit], at[hit]
            times = first[at + 1] - first[at]
            entry = np.repeat(first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            pos = np.repeat(pos, times)
            who, start = item[entry], pos - offset[entry]
            text = np.searchsorted(ends, pos)
            found += self._windows(text, who, start - (ends - sizes)[text], offset[entry])
        return found

    def _windows(self, text: np.ndarray, who: np.ndarray, start: np.ndarray, offset: np.ndarray) -> list[tuple[int, int, int]]:
        """Starts of windows on bands of diagonals that hold enough of the item's grams: the
        diagonal with most of them, and that of the first one (insertions later on don't shift it)."""
        out: list[tuple[int, int, int]] = []
        if not len(text):
            return out
        step = 2 * self.d[who] + 1
        diagonal = (start - start.min()) // step  # starts may lie before the text
        for half in (0, 1):
            band = (diagonal + half) // 2
            key = (text * len(self.n) + who) * (int(band.max()) + 1) + band
            keys, n = np.unique(key, return_counts=True)
            full = keys[n >= self.least[keys // (int(band.max()) + 1) % len(self.n)]]
            if not len(full):
                continue
            held = np.nonzero(full[np.minimum(np.searchsorted(full, key), len(full) - 1)] == key)[0]
            held = held[np.lexsort((offset[held], key[held]))]
            cuts = np.nonzero(np.concatenate([[True], key[held][1:] != key[held][:-1], [True]]))[0]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                starts, times = np.unique(start[held[a:b]], return_counts=True)
                first = held[a]
                out += [(int(text[first]), int(who[first]), s) for s in {int(starts[times.argmax()]), int(start[first])}]
        return out

    def _cut(self, batch: list[str], found: list[tuple[int, int, int]]) -> list[np.ndarray]:
        return [points(batch[t][max(0, s) : max(0, s + int(self.n[i]))]) for t, i, s in found]

    def _near(self, batch: list[str], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates of the windows: the items of a window's size that share a band with it, and
        the ``exact`` items of the windows that they gave."""
        kept = {f for f in found if self.exact[f[1]]}
        one = {(t, int(self.n[i]), s): (t, i, s) for t, i, s in found if not self.exact[i]}  # a window, whichever item gave it
        windows = sorted(one.values())
        keys, item = self.table
        for a in range(0, len(windows), 256):
            part = windows[a : a + 256]
            looked = self.embedding.keys(self._cut(batch, part), self.n[np.array([i for _, i, _ in part])]).reshape(len(part), -1)
            first, last = np.searchsorted(keys, looked, "left"), np.searchsorted(keys, looked, "right")
            for w, k in zip(*np.nonzero(last > first), strict=True):
                t, _, s = part[w]
                kept.update((t, int(i), s) for i in set(item[first[w, k] : last[w, k]].tolist()))
        return sorted(kept)

    def _verified(self, batch: list[str], near: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, s in near:
            d, n = int(self.d[i]), int(self.n[i])
            a, b = max(0, s - 3 * d - 2), max(0, s + n + 3 * d + 2)
            if (m := edit_match(self.texts[i], batch[t][a:b], d)) is not None:
                m = (m[0], m[1] + a, m[2] + a)
                best[t, i] = min(best.get((t, i), m), m)
        return [(t, i, *m) for (t, i), m in sorted(best.items())]


def item_blocks(benchmark: DataFrame, ratio: float = RATIO, recall: float = RECALL, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """The benchmark's items in blocks of ``block_chars`` characters, about."""
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    for k in range(blocks):
        block = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        got = block.orderBy("item_id", "text").collect()
        hits = {r["item"]: bytes(r["hits"]) for r in _trials(block, ratio).collect()} if got else None
        yield Items([r["item_id"] for r in got], [normalise(r["text"]) for r in got], ratio, recall, hits)


def _trials(block: DataFrame, ratio: float) -> DataFrame:
    """Calibration trials of a block's different items, run in tasks: item, hits."""
    schema = pa.schema([("item", pa.string()), ("hits", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = Items([0] * b.num_rows, [normalise(t) for t in b.column("text").to_pylist()], ratio, recall=0.0)
            if of.texts:
                yield rows({"item": of.texts, "hits": [x.tobytes() for x in of.trials()]}, schema)
        trimmed()

    return block.select("text").repartition(partitions(block.sparkSession), "text").mapInArrow(run, "item string, hits binary")


def _with_matches(docs: DataFrame, items: Items, column: str) -> DataFrame:
    """``docs`` with one more column: what is found of a block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    columns = docs.columns
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_edits", pa.int32()), ("similarity", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for lo, hi in slices(byte_sizes(b.column("text"))):
                for t, i, edits, start, end in block.search(texts(b.column("text").slice(lo, hi - lo))):
                    found[lo + t].append({"item_id": block.ids[i], "n_edits": edits, "similarity": 1 - edits / int(block.n[i]), "start": start, "end": end})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(found, type=kind)], names=[*columns, column])
        trimmed()

    match = StructType([StructField("item_id", LongType()), StructField("n_edits", IntegerType()), StructField("similarity", DoubleType()), StructField("start", LongType()), StructField("end", LongType())])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, ArrayType(match))]))


def find_matches(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, item_id, n_edits, similarity, start, end (of the normalised text): the best
    passage of each document and item that match."""
    out = None
    for items in item_blocks(benchmark, **params):
        got = _with_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, "matches").select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents that match an item."""
    columns = docs.columns
    for items in item_blocks(benchmark, **params):
        found = next(f"matches{i or ''}" for i in range(len(columns) + 1) if f"matches{i or ''}" not in columns)
        docs = _with_matches(docs, items, found).where(F.size(found) == 0).select(*columns)
    return docs
