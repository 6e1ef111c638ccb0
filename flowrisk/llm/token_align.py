"""Tokens of two tokenizers over the same text, aligned by bytes.

Side A is a byte-level BPE vocabulary over space + text, side B a piece BPE vocabulary with
byte fallback that sets the space itself. Each side's tokens are byte ranges; a text whose
tokens do not spell space + text on both sides has none.

Keyed by stretch of a document, ``pandas.merge_asof`` (backward, by start) finds for each
token's start the other side's token that covers it; the union of both directions is all
overlapping pairs (of two ranges that overlap, one holds the other's start). Offsets where
tokens of both sides end cut the text into groups.

How a text is encoded: neither vocabulary joins a word's last character to the space after
it (A's pattern cuts there; B has no piece with a space behind another character, which is
checked when it is loaded). So a text is cut before single spaces that follow a non-space and
precede one, each different stretch is encoded once per task (a bounded memory
of them), and the ids stand side by side as in one run over the whole text. Both sides'
tokens end where a stretch ends, so no group or link crosses it, and a stretch is aligned
when it is encoded; a document's groups and links are those of its stretches. A batch, or a
window of a long text, holds about ``WINDOW`` characters of stretches, so a text of any
length needs a bounded frame (a stretch without such a space stays whole).

An id pair's count is the number of documents in which it is linked. Counting and the way
back are Spark joins on the pair: hot pairs are summed before their shuffle, and split by
the skew join on the way back; nothing is collected or broadcast but the vocabulary files.

Defined results: null and empty texts, and those whose bytes differ, have zeros and no
groups; a null doc_id is kept; repeated rows are documents of their own, also in the
counts; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.llm.common import slices, texts
from flowrisk.session import scratch_path

#: Vocabulary files: read on the driver and shipped with the job, so executors need no copy.
BYTE_VOCABULARY, PIECE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a window; stretches, and their characters, that a task remembers.
WINDOW, REMEMBERED, REMEMBERED_CHARS = 1 << 18, 400_000, 1 << 22
_STRETCH = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Between tokens of a side, between the sides, behind a group.
_SEPARATORS = (",", "|", ";")


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones as themselves,
    the others from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """Ids and byte lengths of stretches, remembered in flat arrays."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.forget()

    def forget(self) -> None:
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, encoded: list[list[int]], stretches: list[str], raw: bytes, sizes: np.ndarray) -> np.ndarray:
        """Remembers the stretches' tokens. Returns whether each one's spell a space and the stretch
        (``raw``: all of them so joined, ``sizes``: the bytes of each)."""
        flat = list(chain.from_iterable(encoded))
        ids, n = np.array(flat, np.int32), np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.ids = np.concatenate([self.ids, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(n)])
        bounds = np.append(0, np.cumsum(self.sizes[ids]))[np.append(0, np.cumsum(n))]
        if np.array_equal(np.diff(bounds), sizes) and b"".join(map(self.spelled.__getitem__, flat)) == raw:
            return np.ones(len(stretches), bool)
        return np.array([b"".join([self.spelled[i] for i in e]) == b" " + t.encode() for e, t in zip(encoded, stretches, strict=True)])

    def tokens(self, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all tokens in order, tokens of each stretch)."""
        return _chosen(self.ids, self.bounds, stretches)


def _chosen(flat: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the lists at ``places``, side by side; how many of each) of lists that lie in ``flat`` between ``bounds``."""
    lo = bounds[places]
    n = bounds[places + 1] - lo
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(lo - (ends - n), n)], n


class Encoders:
    """Both tokenizers, and what a task remembers of them: tokens and alignment of stretches."""

    def __init__(self, byte_vocabulary: bytes, piece_vocabulary: bytes):
        # a task has one core: threads of its own would wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        spec = byte_vocabulary.decode()
        self.bpe = Tokenizer.from_str(spec)
        self.bpe.encode_special_tokens = True
        alphabet = byte_alphabet()
        spelled_a = [b""] * self.bpe.get_vocab_size(with_added_tokens=True)
        special = {t["id"] for t in json.loads(spec).get("added_tokens", [])}
        for word, i in self.bpe.get_vocab(with_added_tokens=True).items():
            spelled_a[i] = word.encode() if i in special else bytes(alphabet[c] for c in word)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_vocabulary)
        spelled_b, self.splits = [], True
        for i in range(self.pieces.vocab_size()):
            piece = self.pieces.id_to_piece(i)
            spelled_b.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
            self.splits &= "▁" not in piece.lstrip("▁")
        self.a, self.b = Side(spelled_a), Side(spelled_b)
        self.words = group_words(self)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.valid = np.zeros(0, bool)
        # of each stretch: its groups as text, their number, and the id pairs of its links (one for each link)
        self.groups: list[str] = []
        self.n_groups, self.links, self.link_bounds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.a.forget()
        self.b.forget()

    def stretches(self, text: str) -> list[str]:
        """Parts whose encodings stand side by side in the text's; the spaces between them are left out."""
        if not self.splits:
            return [text]
        parts = text.split(" ")
        # every space is such a cut, unless a part is empty or has white space at an end
        if "▁" not in text and "" not in parts and parts == list(map(str.strip, parts)):
            return parts
        return _STRETCH.split(text)

    def known(self, stretches: list[str]) -> np.ndarray:
        """Places of the stretches in the memory; new ones are encoded and aligned."""
        if len(self.place) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        place = self.place
        found = list(map(place.get, stretches))
        missing = [i for i, p in enumerate(found) if p is None]
        if missing:
            new = list(dict.fromkeys([stretches[i] for i in missing]))
            first = len(place)
            place.update(zip(new, range(first, first + len(new)), strict=True))
            joined = " " + " ".join(new)
            raw, chars = joined.encode(), np.fromiter(map(len, new), np.int64, len(new))
            sizes = 1 + (chars if joined.isascii() else np.array([len(s.encode()) for s in new], np.int64))
            valid = self.a.learn([e.ids for e in self.bpe.encode_batch_fast([" " + s for s in new], add_special_tokens=False)], new, raw, sizes)
            valid &= self.b.learn(self.pieces.encode(new, num_threads=1), new, raw, sizes)
            self.valid = np.concatenate([self.valid, valid])
            self.learn_alignment(first, valid)
            self.chars += int(chars.sum())
            for i in missing:
                found[i] = place[stretches[i]]
        return np.array(found, np.int64)

    def learn_alignment(self, first: int, valid: np.ndarray) -> None:
        """Remembers groups and links of the stretches from place ``first`` on; those that are not valid have none."""
        groups, n_groups, links, n_links = align_stretches(self, first + np.flatnonzero(valid))
        every = np.zeros((2, len(valid)), np.int64)
        every[:, valid] = n_groups, n_links
        if not valid.all():
            made = iter(groups)
            groups = [next(made) if v else "" for v in valid.tolist()]
        self.groups += groups
        self.n_groups = np.concatenate([self.n_groups, every[0]])
        self.links = np.concatenate([self.links, links])
        self.link_bounds = np.concatenate([self.link_bounds, self.link_bounds[-1] + np.cumsum(every[1])])


@lru_cache(maxsize=1)
def _encoders(byte_vocabulary: bytes, piece_vocabulary: bytes) -> Encoders:
    return Encoders(byte_vocabulary, piece_vocabulary)


def _side(side: Side, stretches: np.ndarray) -> pd.DataFrame:
    ids, n = side.tokens(stretches)
    sizes = side.sizes[ids]
    ends = np.cumsum(sizes)
    return pd.DataFrame({"stretch": np.repeat(np.arange(len(stretches)), n), "start": ends - sizes, "end": ends, "id": ids, "token": np.arange(len(ids))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (of A, of B) of all overlapping pairs; both frames (stretch, start, token) by start,
    which ascends over stretches, every byte covered on both sides."""
    covering_b = pd.merge_asof(a[["stretch", "start", "token"]], b[["stretch", "start", "token"]], on="start", by="stretch", suffixes=("_a", "_b"))
    covering_a = pd.merge_asof(b[["stretch", "start", "token"]], a[["stretch", "start", "token"]], on="start", by="stretch", suffixes=("_b", "_a"))
    # tokens that start together are found from both sides; the second direction leaves them out
    later = b["start"].to_numpy() != a["start"].to_numpy()[covering_a["token_a"].to_numpy()]
    return (np.concatenate([covering_b["token_a"].to_numpy(), covering_a["token_a"].to_numpy()[later]]),
            np.concatenate([covering_b["token_b"].to_numpy(), covering_a["token_b"].to_numpy()[later]]))


def align_stretches(enc: Encoders, places: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch (``places`` in the memory): its groups as text, their number, the id pairs of its
    links (of all stretches side by side) and their number."""
    size_a, size_b, every = len(enc.a.spelled), len(enc.b.spelled), len(places)
    a, b = _side(enc.a, places), _side(enc.b, places)
    token_a, token_b = overlaps(a, b)
    a_ids, b_ids, a_end, b_end = a["id"].to_numpy(), b["id"].to_numpy(), a["end"].to_numpy(), b["end"].to_numpy()
    a_of, b_of = a["stretch"].to_numpy(), b["stretch"].to_numpy()
    # a token's group is the number of common ends before its end; A's tokens stand first in a group
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    group = np.concatenate([np.searchsorted(common, a_end), np.searchsorted(common, b_end)])
    order = np.argsort(group, kind="stable")
    group, of_b = group[order], order >= len(a)
    last = np.append(group[1:] != group[:-1], True)[: len(group)]
    separator = np.where(last, 2, np.append(of_b[1:] != of_b[:-1], False)[: len(group)])
    ids = np.concatenate([a_ids, b_ids + size_a])[order]
    of = np.concatenate([a_of, b_of])[order]
    written = enc.words[separator * (size_a + size_b) + ids].tolist()
    edges = np.searchsorted(of, np.arange(every + 1)).tolist()
    # links by stretch
    order = np.argsort(a_of[token_a], kind="stable")
    pairs = (a_ids[token_a].astype(np.int64) * size_b + b_ids[token_b])[order]
    return (["".join(written[lo:hi]) for lo, hi in zip(edges, edges[1:])], np.bincount(of[last], minlength=every),
            pairs, np.bincount(a_of[token_a], minlength=every))


class Batch:
    """Alignment of some documents, gathered window by window."""

    def __init__(self, documents: int):
        self.counts = {c: np.zeros(documents, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        self.groups: list[list[str]] = [[] for _ in range(documents)]
        self.pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(documents)]

    def empty(self, document: int) -> None:
        for c in self.counts.values():
            c[document] = 0
        self.groups[document], self.pairs[document] = [], []

    def links(self) -> tuple[pa.Array, pa.Array]:
        """Of each document its different id pairs, and how often each is linked."""
        merged = []
        for parts in self.pairs:
            if len(parts) > 1:
                keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                parts = [(keys, np.bincount(place, np.concatenate([t for _, t in parts])).astype(np.int64))]
            merged += parts or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in merged])]), pa.int32())
        return tuple(pa.ListArray.from_arrays(bounds, np.concatenate([np.zeros(0, np.int64), *[m[i] for m in merged]])) for i in (0, 1))


def group_words(enc: Encoders) -> np.ndarray:
    """The text of each id with the separator behind it, by separator, side and id."""
    return np.array([str(i) + s for s in _SEPARATORS for side in (enc.a, enc.b) for i in range(len(side.spelled))], object)


def align_window(enc: Encoders, documents: list[int], counts: list[int], places: np.ndarray, into: Batch) -> None:
    """Adds the alignment of stretches (``places`` in the memory; ``counts`` of them, one at least, of each of ``documents``)."""
    pairs = len(enc.a.spelled) * len(enc.b.spelled)
    ends = np.cumsum(counts)
    starts = ends - counts
    linked, n_links = _chosen(enc.links, enc.link_bounds, places)
    n_a, n_b = (s.bounds[places + 1] - s.bounds[places] for s in (enc.a, enc.b))
    of = {"n_a": n_a, "n_b": n_b, "n_groups": enc.n_groups[places], "n_links": n_links}
    sums = {name: np.add.reduceat(n, starts) for name, n in of.items()}
    for name, n in sums.items():
        into.counts[name][documents] += n
    # each document's pairs, once each
    key = np.sort(np.repeat(np.arange(len(documents)), sums["n_links"]) * pairs + linked)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times = np.diff(np.append(first, len(key)))
    document, pair = np.divmod(key[first], pairs)
    edges = np.searchsorted(document, np.arange(len(documents) + 1)).tolist()
    words = list(map(enc.groups.__getitem__, places.tolist()))
    for d, lo, hi, x, y in zip(documents, starts.tolist(), ends.tolist(), edges, edges[1:]):
        into.groups[d].append("".join(words[lo:hi]))
        into.pairs[d].append((pair[x:y], times[x:y]))


def _windows(cut: list[list[str]], sizes: list[int]) -> Iterator[list[tuple[int, list[str]]]]:
    """(document, stretches) of about WINDOW characters at once; a longer document goes on in the next."""
    held, size = [], 0
    for d, parts in enumerate(cut):
        lo = 0
        if size + sizes[d] >= 2 * WINDOW:
            for i, p in enumerate(parts):
                size += len(p) + 1
                if size >= WINDOW:
                    held.append((d, parts[lo : i + 1]))
                    yield held
                    held, size, lo = [], 0, i + 1
        else:
            size += sizes[d]
        if lo < len(parts):
            held.append((d, parts[lo:]))
    if held:
        yield held


_MADE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.large_string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def align_texts(enc: Encoders, held: list[str], words: np.ndarray | None = None) -> Batch:
    """Alignment of some texts. ``words``: the texts of the ids (``group_words``), if not the memory's own."""
    if words is not None:
        enc.words = words
    made = Batch(len(held))
    wrong: set[int] = set()
    for window in _windows([enc.stretches(t) if t else [] for t in held], [len(t) for t in held]):
        documents, counts = [d for d, _ in window], [len(p) for _, p in window]
        places = enc.known([s for _, p in window for s in p])
        bad = ~enc.valid[places]
        if bad.any():
            wrong.update(np.repeat(documents, counts)[bad].tolist())
        if wrong:
            places = places[~np.isin(np.repeat(documents, counts), list(wrong))]
            documents, counts = [d for d in documents if d not in wrong], [n for d, n in zip(documents, counts, strict=True) if d not in wrong]
        if documents:
            align_window(enc, documents, counts, places, made)
    for d in wrong:
        made.empty(d)
    return made


def aligned(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_vocabulary: str = PIECE_VOCABULARY) -> DataFrame:
    """Of each row (doc_id, text): row (a number of its own), doc_id, n_a, n_b, n_groups, n_links,
    groups (``a1,a2|b1;a3|b2,b3``), pairs (A id times B's vocabulary size plus B id, each once) and
    times (links of each pair). No shuffle; write it before it is read twice, as ``row`` follows the scan."""
    spark = docs.sparkSession
    with open(byte_vocabulary, "rb") as f, open(piece_vocabulary, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders(*files.value)
        for batch in batches:
            col = texts(batch.column("text"))
            for lo, hi in slices(np.array([len(t) for t in col]), WINDOW):
                made = align_texts(enc, col[lo:hi])
                b = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("doc_id"), *map(pa.array, made.counts.values()), pa.array(["".join(g)[:-1] for g in made.groups], pa.large_string()), *made.links()], schema=_MADE)

    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<bigint>")


def pair_counts(links: DataFrame, pieces: int) -> DataFrame:
    """pair, count (documents that hold it) and best (whether no pair of its A id has more) of
    ``links`` (pair; one row for each document and pair)."""
    counted = links.groupBy("pair").agg(F.count(F.lit(1)).alias("count")).withColumn("a_id", F.expr(f"pair div {int(pieces)}"))
    highest = counted.groupBy("a_id").agg(F.max("count").alias("highest"))
    return counted.join(highest, "a_id").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def with_counts(made: DataFrame, pieces: int) -> DataFrame:
    """The rows of ``made`` (``aligned``, written) with n_best (links whose pair is the most
    frequent of its A id, ties included) and count_sum (sum of the counts over links)."""
    links = made.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair"})
    counted = pair_counts(links.select("pair"), pieces)
    sums = links.join(counted, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    joined = made.drop("pairs", "times").join(sums, "row", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def piece_count(piece_vocabulary: str = PIECE_VOCABULARY) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary).vocab_size()


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
