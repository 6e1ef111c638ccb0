"""Exact substring deduplication over a sparse suffix array.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with
a smaller doc_id; strings never cross documents and are judged on the input.

Every ``LENGTH``-byte string is filed under its anchor: the ``ANCHOR``-byte gram in it
with the least hash. Equal strings have equal anchors, and neighbouring strings mostly
share one, so a text is a row of runs (an anchor and the strings around it), about one
per 18 bytes, and only suffixes that begin at anchors are sorted, not all.

1. Documents are dealt to batches of bounded size. A batch sends the hashes of its
   anchors, each once, to hash buckets; a bucket reports to the batches which anchors
   are found in more than one document.
2. A batch sends the runs of those anchors, equal ones once (the least doc_id), to
   buckets. Buckets are ranges of the suffixes' leading bytes between sampled
   splitters. A bucket sorts by multikey quicksort (eight bytes at a time, only ties go
   on) and compares neighbours: the strings of equal suffixes that lie in a document
   with a smaller id are reported to the batch of the larger. Equal leading bytes fall
   to one bucket, so a bucket's neighbours across its borders differ.
3. A batch removes the bytes that the reported strings cover. Reports name a text by its
   place among the batch's rows in order of id and text, whatever order they arrive in.

A hot anchor (in more than ``HOT`` documents) does not fill a bucket: under it every
string is a suffix of its own, sent once per batch and ranged by its own bytes. Texts
are shuffled once, to batches; what the steps exchange are packed arrays.

Defined results: null text is empty; a text shorter than ``LENGTH`` bytes stays whole;
rows with equal doc_ids are not smaller than each other; a null doc_id is above all
others; repeated rows give repeated results; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from flowrisk.llm.common import mix64, partitions, slices, trimmed

LENGTH = 50
ANCHOR = 16
#: Bytes of text in a batch, of anchors in a bucket, and of text for a range of suffixes, about.
BATCH_BYTES, BUCKET_BYTES, RANGE_BYTES = 8 << 20, 32 << 20, 4 << 20
#: Bytes whose anchors are found at once, and strings that are sorted at once.
WORK_BYTES, SORTED = 512 << 10, 100_000
#: Bound on the splitters, which all tasks hold; beyond it ranges grow with the input.
MAX_RANGES = 200_000
#: Documents above which an anchor's strings are sorted singly.
HOT = 20_000
#: Sampled suffixes for a splitter.
SAMPLE = 64
_LAST_ID = np.iinfo(np.int64).max
_P = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all ``k``-byte grams: polynomial, by doubling, then mixed."""
    out, done, power = None, 0, _P
    span, level = 1, data.astype(np.uint64) + np.uint64(1)
    n = len(data)
    while True:
        if k & span:
            if out is None:
                out, done, out_power = level[: n - span + 1], span, power
            else:
                m = n - done - span + 1
                out = out[:m] * power + level[done : done + m]
                done += span
        if span * 2 > k:
            return mix64(out[: n - k + 1])
        m = n - 2 * span + 1
        level = level[:m] * power + level[span : span + m]
        span, power = span * 2, np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)


def runs(data: np.ndarray, sizes: np.ndarray, length: int, anchor: int):
    """Runs of the texts that are laid end to end in ``data``: anchor hash, text number,
    first string's start in ``data``, number of strings; and the hashes of all grams."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    grams = low = gram_hashes(data, anchor)
    width, span = length - anchor + 1, 1
    while span * 2 <= width:  # least hash of each `span` grams, by doubling
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: -(width - span)], low[width - span :])
    room = np.maximum(sizes - length + 1, 0)  # strings that start in each text
    first = np.cumsum(room) - room
    starts = np.arange(room.sum()) + np.repeat(np.cumsum(sizes) - sizes - first, room)
    low = low[starts]
    new = np.concatenate([[True], low[1:] != low[:-1]]) if len(low) else np.empty(0, bool)
    new[first[room > 0]] = True
    at = np.nonzero(new)[0]
    doc = np.searchsorted(first + room, at, side="right")
    return low[at], doc, starts[at], np.diff(np.append(at, len(low))), grams


def multikey_order(keys: np.ndarray, order: np.ndarray | None = None, word: int = 0) -> np.ndarray:
    """Order of the rows of ``keys`` (a row is a suffix in big-endian 64-bit words): sorted
    by one word, then each run of ties by the next (multikey quicksort with words as symbols)."""
    order = np.arange(len(keys)) if order is None else order
    order = order[np.argsort(keys[order, word], kind="stable")]
    if word + 1 == keys.shape[1] or len(order) < 2:
        return order
    # all runs of ties at once: sort by the next word inside the run
    todo = order
    group = np.concatenate([[0], np.cumsum(keys[order[1:], word] != keys[order[:-1], word])])
    for w in range(word + 1, keys.shape[1]):
        size = np.bincount(group)
        tied = size[group] > 1
        if not tied.any():
            break
        at = np.nonzero(tied)[0]
        part = todo[at]
        sub = np.lexsort((keys[part, w], group[at]))
        todo = todo.copy()
        todo[at] = part[sub]
        differs = np.concatenate([[True], (group[1:] != group[:-1]) | ((keys[todo[1:], w] != keys[todo[:-1], w]) & (group[1:] == group[:-1]))])
        group = np.cumsum(differs) - 1
    return todo


def _strings(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The byte strings of ``length`` that start at ``at``, a row each."""
    return np.ascontiguousarray(sliding_window_view(data, length)[at]) if len(at) else np.empty((0, length), np.uint8)


def words_of(strings: np.ndarray) -> np.ndarray:
    """Byte strings of equal length as rows of big-endian 64-bit words (zero-padded)."""
    n, size = strings.shape
    padded = np.zeros((n, -(-size // 8) * 8), np.uint8)
    padded[:, :size] = strings
    return padded.view(">u8").astype(np.uint64)


def _laid(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a batch's texts: first row, sizes, bytes laid end to end."""
    sizes = frame["text"].map(len).to_numpy(np.int64)
    for lo, hi in slices(sizes, WORK_BYTES):
        yield lo, sizes[lo:hi], np.frombuffer(b"".join(frame["text"].iloc[lo:hi]), np.uint8)


def _in_order(frame: pd.DataFrame) -> pd.DataFrame:
    """A batch's rows by id and text: a shuffle hands them over in another order each time it
    is read, and reports name a text by its row. Rows equal in both have equal results."""
    ids, texts = frame["id"].to_numpy(np.int64), frame["text"].to_list()
    return frame.iloc[sorted(range(len(frame)), key=lambda i: (ids[i], texts[i]))].reset_index(drop=True)


def _packed(parts: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(parts, columns=columns)


def _squeeze(x: np.ndarray | bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def _unsqueeze(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def _split(order_by: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(order_by, kind="stable")
    cuts = np.searchsorted(order_by[order], np.arange(buckets + 1))
    return [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]


class Plan:
    """What the tasks need to know: sizes and splitters (bounded by the number of buckets)."""

    def __init__(self, length: int, anchor: int, hot: int, buckets: int):
        self.length, self.anchor, self.hot, self.buckets = length, anchor, hot, buckets
        self.splitters = np.empty(0, np.uint64)

    def anchors(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Step 1, a batch: its distinct anchors and in how many documents each is (2: or more)."""
        ids = frame["id"].to_numpy(np.int64)
        found = []
        for lo, sizes, data in _laid(frame):
            low, doc, _, _, _ = runs(data, sizes, self.length, self.anchor)
            found.append((low, ids[doc + lo]))
        low, ids = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((ids, low))
        low, ids = low[order], ids[order]
        first = np.concatenate([[True], (low[1:] != low[:-1]) | (ids[1:] != ids[:-1])]) if len(low) else np.empty(0, bool)
        anchors, n = np.unique(low[first], return_counts=True)
        to = (mix64(anchors) % np.uint64(self.buckets)).astype(np.int64)  # least hashes are small: mixed again
        batch = int(frame["batch"].iat[0])
        return _packed([{"bucket": b, "batch": batch, "anchors": anchors[i].tobytes(), "n": n[i].astype(np.int32).tobytes()} for b, i in _split(to, self.buckets)], ["bucket", "batch", "anchors", "n"])

    def repeated(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Step 1, a bucket: to each batch its anchors that are in two documents or more, and whether they are hot."""
        if not len(frame):
            return _packed([], ["batch", "anchors", "hot"])
        anchors = [np.frombuffer(a, np.uint64) for a in frame["anchors"]]
        sizes = np.fromiter(map(len, anchors), np.int64, len(anchors))
        low, n = np.concatenate(anchors), np.concatenate([np.frombuffer(x, np.int32) for x in frame["n"]]).astype(np.int64)
        order = np.argsort(low, kind="stable")
        first = np.concatenate([[True], low[order][1:] != low[order][:-1]])
        total = np.empty(len(low), np.int64)
        total[order] = np.add.reduceat(n[order], np.nonzero(first)[0])[np.cumsum(first) - 1]
        out, at = [], 0
        for batch, size in zip(frame["batch"], sizes.tolist(), strict=True):
            here = total[at : at + size]
            keep = here > 1
            if keep.any():
                out.append({"batch": batch, "anchors": low[at : at + size][keep].tobytes(), "hot": (here[keep] > self.hot).tobytes()})
            at += size
        return _packed(out, ["batch", "anchors", "hot"])

    def _leads(self, data, grams, start, single) -> np.ndarray:
        """Leading bytes of the suffix that ranges a run: from its anchor on, or the single string's own."""
        at = start.copy()
        if len(at):
            near = sliding_window_view(grams, self.length - self.anchor + 1)
            for a in range(0, len(start), 20_000):
                part = slice(a, a + 20_000)
                at[part] += np.where(single[part], 0, near[start[part]].argmin(axis=1))
        return _strings(data, at, self.anchor).view(f"S{self.anchor}").ravel()

    def sample(self, frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leading bytes of a sample of suffixes."""
        for b in frames:
            frame = b.to_pandas()
            for _, sizes, data in _laid(frame):
                low, _, start, _, grams = runs(data, sizes, self.length, self.anchor)
                pick = np.nonzero(low % np.uint64(SAMPLE) == 0)[0]
                if len(pick):
                    leads = self._leads(data, grams, start[pick], np.zeros(len(pick), bool))
                    yield pa.RecordBatch.from_arrays([pa.array(leads.tolist(), pa.binary())], names=["lead"])

    def strings(self, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Step 2, a batch: runs whose anchor is repeated, equal ones once, packed by bucket.

        Per run text: its bytes, number of strings and least id. Per place (ref): which
        run text, the row, the start, and whether its id is above the least (then all of it goes)."""
        columns = ["bucket", "batch", "bytes", "n", "id", "ref_of", "ref_row", "ref_start", "ref_all"]
        if not len(told) or not len(frame):
            return _packed([], columns)
        frame = _in_order(frame)
        batch, ids = int(frame["batch"].iat[0]), frame["id"].to_numpy(np.int64)
        anchors = np.concatenate([np.frombuffer(a, np.uint64) for a in told["anchors"]])
        hot = np.concatenate([np.frombuffer(h, bool) for h in told["hot"]])
        order = np.argsort(anchors)
        anchors, hot = anchors[order], hot[order]
        out: list[dict] = []
        filed: dict[int, tuple[dict[bytes, int], list]] = {}  # by bucket: different run texts, and where they are
        for lo, sizes, data in _laid(frame):
            low, doc, start, n, grams = runs(data, sizes, self.length, self.anchor)
            if not len(low):
                continue
            at = np.minimum(np.searchsorted(anchors, low), len(anchors) - 1)
            hit = np.nonzero(anchors[at] == low)[0]
            if not len(hit):
                continue
            doc, start, n, single = doc[hit], start[hit], n[hit], hot[at[hit]]
            if single.any():  # under a hot anchor each string is a run of its own
                times = np.where(single, n, 1)
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                doc, single = np.repeat(doc, times), np.repeat(single, times)
                start, n = np.repeat(start, times) + np.where(single, within, 0), np.where(single, 1, np.repeat(n, times))
            leads = self._leads(data, grams, start, single)
            bucket = np.searchsorted(self.splitters, leads, side="right") if len(self.splitters) else np.zeros(len(leads), np.int64)
            owner, local = ids[doc + lo], start - (np.cumsum(sizes) - sizes)[doc]
            raw = data.tobytes()
            for b, i in _split(bucket, len(self.splitters) + 1):
                known, places = filed.setdefault(b, ({}, []))
                cut = [raw[s : s + k] for s, k in zip(start[i].tolist(), (n[i] + self.length - 1).tolist(), strict=True)]
                places.append((np.array([known.setdefault(t, len(known)) for t in cut]), owner[i], n[i], doc[i] + lo, local[i]))
        for b, (known, places) in filed.items():
            of, owner, n, row, start = (np.concatenate(x) for x in zip(*places, strict=True))
            least, count = np.full(len(known), _LAST_ID), np.zeros(len(known), np.int32)
            np.minimum.at(least, of, owner)
            count[of] = n
            packed = {"bytes": b"".join(known), "n": count, "id": least, "ref_of": of.astype(np.int32), "ref_row": row.astype(np.int32), "ref_start": start.astype(np.int64), "ref_all": owner > least[of]}
            out.append({"bucket": b, "batch": batch} | {c: _squeeze(x) for c, x in packed.items()})
        return _packed(out, columns)

    def compare(self, frame: pd.DataFrame) -> pd.DataFrame:
        """Step 2, a bucket: to each batch the strings that start in a document with a smaller id, too."""
        if not len(frame):
            return _packed([], ["batch", "row", "start", "n"])
        number: dict[bytes, int] = {}
        of_row, n_all, ids_all = [], [], []
        for raw, n in zip(frame["bytes"], frame["n"], strict=True):
            raw, n = _unsqueeze(raw), np.frombuffer(_unsqueeze(n), np.int32)
            stops = np.cumsum(n + (self.length - 1)).tolist()
            of_row.append(np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *stops[:-1]], stops, strict=True)]))
            n_all.append(n)
        of, ids = np.concatenate(of_row), np.concatenate([np.frombuffer(_unsqueeze(x), np.int64) for x in frame["id"]])
        least, n = np.full(len(number), _LAST_ID), np.zeros(len(number), np.int64)
        np.minimum.at(least, of, ids)
        n[of] = np.concatenate(n_all)
        shared = self._shared(list(number), n, least)
        first = np.cumsum(n) - n
        some = np.maximum.reduceat(shared, first)
        out, at = [], 0
        for r, mine in zip(frame.itertuples(index=False), of_row, strict=True):
            own = ids[at : at + len(mine)]
            at += len(mine)
            ref_of = np.frombuffer(_unsqueeze(r.ref_of), np.int32)
            run = mine[ref_of]
            whole = np.frombuffer(_unsqueeze(r.ref_all), bool) | (own[ref_of] > least[run])
            row, start = np.frombuffer(_unsqueeze(r.ref_row), np.int32), np.frombuffer(_unsqueeze(r.ref_start), np.int64)
            part = np.nonzero(~whole & some[run])[0]  # the only places to look at string by string
            size = n[run[part]]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            mark = shared[np.repeat(first[run[part]], size) + within]
            ref, pos = np.repeat(part, size)[mark], (np.repeat(start[part], size) + within)[mark]
            cut = np.nonzero(np.concatenate([[True], (ref[1:] != ref[:-1]) | (pos[1:] != pos[:-1] + 1)]))[0] if len(ref) else np.empty(0, np.int64)
            told = np.concatenate([row[whole], row[ref[cut]]]), np.concatenate([start[whole], pos[cut]]), np.concatenate([n[run[whole]], np.diff(np.append(cut, len(ref)))]).astype(np.int64)
            if len(told[0]):
                out.append({"batch": r.batch} | {c: x.tobytes() for c, x in zip(("row", "start", "n"), told, strict=True)})
        return _packed(out, ["batch", "row", "start", "n"])

    def _shared(self, run_texts: list[bytes], n: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For all strings of the different runs, in order: whether an equal one has a smaller id.

        The runs are ordered by their leading bytes from the anchor on, so equal strings are in
        runs with equal leads; slices of such runs are expanded to suffixes and sorted."""
        data = np.frombuffer(b"".join(run_texts), np.uint8)
        sizes = n + self.length - 1
        begin = np.cumsum(sizes) - sizes
        grams = gram_hashes(data, self.anchor)
        leads = self._leads(data, grams, begin, n < 1)
        order = np.argsort(leads, kind="stable")
        new = np.nonzero(np.concatenate([[True], leads[order][1:] != leads[order][:-1]]))[0]
        first = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), bool)
        for lo, hi in slices(np.add.reduceat(n[order], new), SORTED):
            part = order[new[lo] : new[hi] if hi < len(new) else len(order)]
            size = n[part]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            strings = words_of(_strings(data, np.repeat(begin[part], size) + within, self.length))
            owner = np.repeat(least[part], size)
            place = np.repeat(first[part], size) + within
            sorted_ = multikey_order(strings)
            same = np.concatenate([[True], (strings[sorted_[1:]] != strings[sorted_[:-1]]).any(axis=1)])
            low = np.minimum.reduceat(owner[sorted_], np.nonzero(same)[0])[np.cumsum(same) - 1]
            out[place[sorted_]] = owner[sorted_] > low
        return out

    def remove(self, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Step 3, a batch: the texts without the bytes that the reported strings cover."""
        if not len(frame):
            return pd.DataFrame({c: [] for c in ("rest", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")})
        frame = _in_order(frame)
        spans: dict[int, np.ndarray] = {}
        if len(told):
            row = np.concatenate([np.frombuffer(x, np.int32) for x in told["row"]])
            start = np.concatenate([np.frombuffer(x, np.int64) for x in told["start"]])
            stop = start + np.concatenate([np.frombuffer(x, np.int64) for x in told["n"]]) + self.length - 1
            order = np.lexsort((start, row))
            cuts = np.nonzero(np.concatenate([[True], row[order][1:] != row[order][:-1], [True]]))[0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                spans[int(row[order[a]])] = np.stack([start[order[a:b]], stop[order[a:b]]])
        made = []
        for i, text in enumerate(frame["text"]):
            kept, removed, n_spans = text, 0, 0
            if i in spans:
                start, stop = spans[i]
                reach = np.maximum.accumulate(stop)
                new = np.concatenate([[True], start[1:] > reach[:-1]])
                begin, end = start[new], reach[np.append(np.nonzero(new)[0][1:] - 1, len(reach) - 1)]
                n_spans, removed = len(begin), int((end - begin).sum())
                kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True))
            made.append((len(text), removed, n_spans, kept.decode(errors="ignore"), hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(made, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
        out["rest"] = frame["rest"].to_numpy()
        return out


def removed(docs: DataFrame, keep: list[str] | None = None, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """Of every row: the columns ``keep`` of ``docs`` (doc_id), n_bytes, n_removed, n_spans,
    kept_sha256 and, unless ``with_text`` is off, ``kept`` (the text that stays; a character
    of which bytes are removed goes whole there)."""
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), F.struct(*keep).alias("rest"))
    size = named.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    total, n = int(size["bytes"] or 0), int(size["n"])
    batches = max(partitions(spark), -(-total // BATCH_BYTES))
    buckets = max(partitions(spark), -(-total * 12 * 2 // ((length - anchor + 2) * BUCKET_BYTES)))
    batched = named.select(F.coalesce("id", F.lit(_LAST_ID)).alias("id"), "text", "rest", F.pmod(F.xxhash64("id", "text"), F.lit(batches)).alias("batch"))
    plan = Plan(length, anchor, hot, buckets)
    ranges = min(MAX_RANGES, max(partitions(spark), -(-total // RANGE_BYTES)))
    # splitters from the suffixes of some thousand documents
    few = batched.where(F.pmod(F.xxhash64("batch", "id", "text"), F.lit(max(1, n // (4000 + 20 * ranges)))) == 0).select("text")
    leads = np.sort(np.array([bytes(r["lead"]) for r in few.mapInArrow(plan.sample, "lead binary").collect()], dtype=f"S{anchor}"))
    if len(leads):
        plan.splitters = np.unique(leads[np.linspace(0, len(leads) - 1, min(ranges, len(leads)) + 1)[1:-1].astype(int)])
    by_batch = batched.groupBy("batch")
    anchors = by_batch.applyInPandas(lambda f: trimmed(plan.anchors(f)), "bucket long, batch long, anchors binary, n binary")
    told = anchors.groupBy("bucket").applyInPandas(lambda f: trimmed(plan.repeated(f)), "batch long, anchors binary, hot binary")
    strings = by_batch.cogroup(told.groupBy("batch")).applyInPandas(lambda f, told: trimmed(plan.strings(f, told)), "bucket long, batch long, bytes binary, n binary, id binary, ref_of binary, ref_row binary, ref_start binary, ref_all binary")
    reports = strings.groupBy("bucket").applyInPandas(lambda f: trimmed(plan.compare(f)), "batch long, row binary, start binary, n binary")
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def finish(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return trimmed(plan.remove(frame, told)[["rest", *made]])

    schema = StructType([batched.schema["rest"], *(StructField(c, StringType() if c.startswith("kept") else LongType()) for c in made)])
    done = by_batch.cogroup(reports.groupBy("batch")).applyInPandas(finish, schema)
    return done.select(*[F.col("rest")[c].alias(c) for c in keep], *made)


def cut(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """``docs`` with the repeated passages cut from text (n_chars follows, if there); a
    document of which nothing is left goes, others stay as they are."""
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("others"), F.col("text").isNull().alias("missing"))
    done = removed(packed, ["others", "missing"], length, anchor, hot).where("n_removed = 0 or length(kept) > 0")
    text = F.when(~F.col("missing"), F.col("kept"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("others")["n_chars"]) if "n_chars" in others else None}
    return done.select(*[(new[c] if c in new else F.col("others")[c]).alias(c) for c in docs.columns])
