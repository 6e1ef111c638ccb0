"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in another order.

Units are runs of the letters A-Z, a-z or single other code points. Two draws from a hash
of the document's id say after how many units the prefix and the middle end; two more say
whether the text stays plain, and which of the two orders it takes:

    psm  <P>prefix<S>suffix<M>middle
    spm  <S>suffix<P>prefix<M>middle

All texts of an Arrow batch are one array of bytes. A scan marks the bytes where units
start; the cuts are found in it by rank and select over blocks. Every part of a text moves
as a whole, so a difference array that is zero but at the parts' first bytes gives, by
cumulative sum, how far each byte moves; one scatter builds all outputs of the batch. The
inverse reads the markers of the outputs, builds the same difference array the other way
round, and gathers the texts. Both run over bounded windows of the bytes (the sum is
carried on), so a text of any length takes no more than itself and its output.

Markers are found again because no marker ends as another begins and none holds another
(checked): a text that holds one stays plain, so in a cut output each stands once.

Defined results: null text is empty; an empty text is plain; a null doc_id draws as the
empty id; repeated rows each give a row; empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import byte_sizes, slices

#: Bytes that the scatter and the gather take at once; block of the rank and select index.
WINDOW, BLOCK = 1 << 20, 4096


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        m = [x.encode() for x in self.all()]
        if not all(m) or len(set(m)) < 3:
            raise ValueError("markers must be three different strings")
        for a in m:
            for b in m:
                if a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError("a marker ends as another begins, or holds another")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(doc_id: Column | str = "doc_id", seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of ``seed:doc_id``."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


class Units:
    """Where the units of a byte array start: rank and select over blocks of the marks."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray):
        n = len(raw)
        self.marks = np.empty(n, bool)
        heads = starts[starts < n]
        for lo in range(0, n, WINDOW):
            hi = min(n, lo + WINDOW)
            b = raw[max(0, lo - 1) : hi]
            letter = ((b | 0x20) >= 97) & ((b | 0x20) <= 122)
            if lo == 0:
                letter = np.concatenate([[False], letter])
                b = np.concatenate([[0], b])
            self.marks[lo:hi] = ((b[1:] & 0xC0) != 0x80) & ~(letter[1:] & letter[:-1])
        self.marks[heads] = True
        full = np.add.reduceat(self.marks, np.arange(0, n, BLOCK), dtype=np.int64) if n else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(full)])

    def rank(self, position: int) -> int:
        """Units that start before ``position``."""
        block = position // BLOCK
        return int(self.before[block]) + int(np.count_nonzero(self.marks[block * BLOCK : position]))

    def select(self, rank: int) -> int:
        """Where unit ``rank`` (counted from 0) starts."""
        block = int(np.searchsorted(self.before, rank, "right")) - 1
        lo = block * BLOCK
        return lo + int(np.flatnonzero(self.marks[lo : lo + BLOCK])[rank - int(self.before[block])])


def code_points(raw: np.ndarray, lo: int, hi: int) -> int:
    return int(np.count_nonzero((raw[lo:hi] & 0xC0) != 0x80))


def occurrences(raw: np.ndarray, marker: bytes) -> np.ndarray:
    """Where ``marker`` starts in the byte array."""
    last = len(raw) - len(marker) + 1
    if last <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(raw[:last] == marker[0])
    for i, c in enumerate(marker[1:], 1):
        at = at[raw[at + i] == c]
    return at


def _shifts(total: int, at: np.ndarray, change: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Windows (lo, hi, shift of each byte): the cumulative sum of a difference array that has
    ``change`` at the places ``at`` (ascending; repeated places add up)."""
    carried = 0
    cuts = np.minimum(np.arange(0, total + WINDOW, WINDOW), total)
    ends = np.searchsorted(at, cuts)  # an empty part at the very end moves nothing
    for k in range(len(cuts) - 1):
        lo, hi = int(cuts[k]), int(cuts[k + 1])
        diff = np.zeros(hi - lo, np.int64)
        np.add.at(diff, at[ends[k] : ends[k + 1]] - lo, change[ends[k] : ends[k + 1]])
        if hi > lo:
            diff[0] += carried
            shift = np.cumsum(diff)
            carried = int(shift[-1])
            yield lo, hi, shift


def scatter(raw: np.ndarray, size: int, at: np.ndarray, change: np.ndarray) -> np.ndarray:
    out = np.empty(size, np.uint8)
    for lo, hi, shift in _shifts(len(raw), at, change):
        out[np.arange(lo, hi) + shift] = raw[lo:hi]
    return out


def gather(out: np.ndarray, size: int, at: np.ndarray, change: np.ndarray) -> np.ndarray:
    raw = np.empty(size, np.uint8)
    for lo, hi, shift in _shifts(size, at, change):
        raw[lo:hi] = out[np.arange(lo, hi) + shift]
    return raw


def _differences(parts: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where, change) of the shift from each part's start to its moved start; parts ascend."""
    return parts, np.diff(moved - parts, prepend=0)


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each value's start (null: empty)."""
    sizes = byte_sizes(col)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.empty(int(starts[-1]), np.uint8)
    binary = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    for lo, v in zip(starts.tolist(), binary, strict=False):
        if v.is_valid:
            b = v.as_buffer()
            raw[lo : lo + b.size] = np.frombuffer(b, np.uint8)
    return raw, starts


def _strings(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw))


def build(raw: np.ndarray, starts: np.ndarray, hashes: list[np.ndarray], markers: Markers, cut_percent: int, spm_percent: int):
    """Outputs of all texts: (bytes, starts, n, form, prefix_chars, middle_chars)."""
    docs = len(starts) - 1
    units = Units(raw, starts[:-1])
    marks = [m.encode() for m in markers.all()]
    wide = sum(map(len, marks))
    held = np.zeros(docs, bool)
    for m in marks:
        at = occurrences(raw, m)
        doc = np.searchsorted(starts, at, "right") - 1
        held[doc[at + len(m) <= starts[doc + 1]]] = True
    first = np.array([units.rank(p) for p in starts.tolist()], np.int64)
    n = np.diff(first)
    a, b = hashes[0] % (n + 1), hashes[1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    cut = (n > 0) & ~held & (hashes[2] % 100 < cut_percent)
    spm = cut & (hashes[3] % 100 < spm_percent)
    cut1, cut2 = starts[:-1].copy(), starts[:-1].copy()
    chars = np.zeros((2, docs), np.int64)
    for d in np.flatnonzero(cut).tolist():
        end = int(starts[d + 1])
        cut1[d] = units.select(int(first[d] + low[d])) if low[d] < n[d] else end
        cut2[d] = units.select(int(first[d] + high[d])) if high[d] < n[d] else end
        chars[:, d] = code_points(raw, int(starts[d]), int(cut1[d])), code_points(raw, int(cut1[d]), int(cut2[d]))
    head, prefix, middle, suffix = starts[:-1], cut1 - starts[:-1], cut2 - cut1, starts[1:] - cut2
    new = np.concatenate([[0], np.cumsum(np.diff(starts) + cut * wide)])
    p, s, m = map(len, marks)
    o = new[:-1]
    # where each marker goes: before its part, in the order of the form
    mark_p = np.where(spm, o + s + suffix, o)
    mark_s = np.where(spm, o, o + p + prefix)
    mark_m = o + p + s + prefix + suffix
    parts = np.stack([head, cut1, cut2], 1).ravel()
    moved = np.stack([np.where(cut, mark_p + p, o), np.where(cut, mark_m + m, o), np.where(cut, mark_s + s, o)], 1)
    # a plain text is one part: its second and third start nothing, wherever they stand
    moved[~cut, 1:] = moved[~cut, :1]
    at, change = _differences(parts, moved.ravel())
    out = scatter(raw, int(new[-1]), at, change)
    for mark, where in zip(marks, (mark_p, mark_s, mark_m), strict=True):
        for i, c in enumerate(mark):
            out[where[cut] + i] = c
    form = np.where(spm, "spm", np.where(cut, "psm", "plain"))
    return out, new, n, form, np.where(cut, chars[0], -1), np.where(cut, chars[1], -1)


def rebuild(out: np.ndarray, starts: np.ndarray, spm: np.ndarray, psm: np.ndarray, markers: Markers) -> tuple[np.ndarray, np.ndarray]:
    """Texts from outputs and their forms: (bytes, starts)."""
    cut = spm | psm
    marks = [m.encode() for m in markers.all()]
    docs = len(starts) - 1
    where = []
    for m in marks:
        at = occurrences(out, m)
        doc = np.searchsorted(starts, at, "right") - 1
        inside = cut[doc] & (at + len(m) <= starts[doc + 1])
        place = np.full(docs, -1, np.int64)
        place[doc[inside]] = at[inside]
        if int(np.count_nonzero(inside)) != int(np.count_nonzero(cut)) or (place[cut] < 0).any():
            raise ValueError("an output lacks a marker of its form, or holds one twice")
        where.append(place)
    p, s, m = map(len, marks)
    head, end = starts[:-1], starts[1:]
    begin_p, begin_s, begin_m = where[0] + p, where[1] + s, where[2] + m
    prefix = np.where(spm, where[2], where[1]) - begin_p
    suffix = np.where(spm, where[0], where[2]) - begin_s
    middle = end - begin_m
    size = np.where(cut, prefix + middle + suffix, end - head)
    new = np.concatenate([[0], np.cumsum(size)])
    o = new[:-1]
    parts = np.stack([o, np.where(cut, o + prefix, o), np.where(cut, o + prefix + middle, o)], 1).ravel()
    source = np.stack([np.where(cut, begin_p, head), np.where(cut, begin_m, head), np.where(cut, begin_s, head)], 1).ravel()
    at, change = _differences(parts, source)
    return gather(out, int(new[-1]), at, change), new


_MADE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])


def transform(docs: DataFrame, markers: Markers = Markers(), cut_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (code points; null
    if plain) and output of each row (doc_id, text). No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(byte_sizes(batch.column("text"))):
                b = batch.slice(lo, hi - lo)
                raw, starts = _bytes(b.column("text"))
                hashes = [b.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
                out, new, n, form, prefix, middle = build(raw, starts, hashes, markers, cut_percent, spm_percent)
                plain = form == "plain"
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()),
                    pa.array(prefix, mask=plain), pa.array(middle, mask=plain), _strings(out, new)], schema=_MADE)

    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id").cast("long"), seed))])
    return drawn.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame, markers: Markers = Markers()) -> DataFrame:
    """The rows of ``made`` with the column ``restored``: the text rebuilt from output and form alone."""
    others = [f for f in made.schema.fields if f.name not in ("form", "output", "restored")]
    schema = "form string, output string, restored string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(byte_sizes(batch.column("output"))):
                b = batch.slice(lo, hi - lo)
                raw, starts = _bytes(b.column("output"))
                form = np.array(b.column("form").to_pylist(), object)
                text, new = rebuild(raw, starts, form == "spm", form == "psm", markers)
                columns = [*b.columns, _strings(text, new)]
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "restored"])

    kept = [f.name for f in others]
    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), schema])
    return made.select(*[F.col(f"`{c}`") for c in kept], "form", "output").mapInArrow(run, full)
