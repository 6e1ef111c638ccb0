"""Edit-aware token counts.

A text is cut into pre-tokens (the tokenizer's pattern), each encoded on its own. Runs
of pre-tokens are the leaves of a segment tree whose nodes hold sums of characters and
tokens. An edit re-cuts and re-encodes only from the pre-token before it (whose end may
look ahead into the edit) until the new cuts meet an old one behind it; the leaves
touched are replaced and the sums above them updated. The count after any number of
edits equals a full recount.

Edits come as a table (doc_id, position, removed, inserted, step): at ``position``
(code points of the text as it then is) ``removed`` code points give way to
``inserted``, in order of ``step``. Positions beyond the end mean the end.

Defined results: null text is empty; documents without edits keep their count; a null
position is 0, null removed 0, null inserted empty; edits of unknown documents are
ignored, edits of a doc_id that several rows share apply to each; null doc_ids get no
edits; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import partitions, rows, texts

#: Rank file of the byte-level vocabulary and the pre-token pattern that goes with it (fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in a leaf, and pre-tokens whose count a task remembers.
LEAF, REMEMBERED = 32, 200_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    single = {k for k in ranks}
    cut = regex.compile(PATTERN)
    known: dict[str, int] = {}

    def count(piece: str) -> int:
        n = known.get(piece)
        if n is None:
            raw = piece.encode("utf-8", "surrogatepass")
            n = 1 if raw in single else len(encoding.encode_ordinary(piece))
            if len(known) >= REMEMBERED:
                known.clear()
            known[piece] = n
        return n

    return cut, count


class SegmentTree:
    """Sums of (characters, tokens) over leaves; leaves are replaced in place."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.size = 1
        while self.size < max(1, len(leaves)):
            self.size *= 2
        self.sums = [(0, 0)] * self.size + leaves + [(0, 0)] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)

    def put(self, leaf: int, value: tuple[int, int]) -> None:
        i = leaf + self.size
        self.sums[i] = value
        while i > 1:
            i //= 2
            (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
            self.sums[i] = (a + c, b + d)

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position`` (the last one with characters beyond the end), and where it starts."""
        i, start = 1, 0
        position = min(position, max(0, self.sums[1][0] - 1))
        while i < self.size:
            i *= 2
            if position - start >= self.sums[i][0]:
                start += self.sums[i][0]
                i += 1
        return i - self.size, start

    @property
    def total(self) -> tuple[int, int]:
        return self.sums[1]


class CountedText:
    """A text with its pre-tokens in leaves and the tree of their counts."""

    def __init__(self, text: str, cut, count):
        self.cut, self.count = cut, count
        pieces = cut.findall(text)
        self.encoded = len(pieces)  # pre-tokens encoded so far
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.tree = SegmentTree([self._sum(x) for x in self.leaves])

    def _sum(self, pieces: list[str]) -> tuple[int, int]:
        return sum(map(len, pieces)), sum(map(self.count, pieces))

    @property
    def tokens(self) -> int:
        return self.tree.total[1]

    def text(self) -> str:
        return "".join("".join(x) for x in self.leaves)

    def edit(self, position: int, removed: int, inserted: str) -> None:
        size = self.tree.total[0]
        position = min(max(position, 0), size)
        removed = min(max(removed, 0), size - position)
        # back up to a leaf whose first pre-token ends before the edit, with the two characters that white space looks ahead
        first, start = self.tree.find(max(0, position - 1)) if size else (0, 0)
        while first > 0 and not (self.leaves[first] and start + len(self.leaves[first][0]) + 1 < position):
            first -= 1
            start -= self.tree.sums[first + self.tree.size][0]
        pieces = self.leaves[first]
        kept, at = 0, start
        while kept < len(pieces) and at + len(pieces[kept]) + 1 < position:
            at += len(pieces[kept])
            kept += 1
        # the text from there on, as far as needed; leaves are taken until the cuts meet
        head: list[str] = []
        last, old = first, pieces[kept:]
        behind = position + removed
        tail_start = at
        while True:
            old_text = "".join(old)
            window = old_text[: position - tail_start] + inserted + old_text[behind - tail_start :] if tail_start + len(old_text) >= behind else None
            at_end = last + 1 >= len(self.leaves)
            if window is not None:
                shift = len(inserted) - removed
                cuts, x = set(), tail_start
                for p in old:
                    x += len(p)
                    cuts.add(x + shift)
                head, x, met = [], tail_start, None
                for m in self.cut.finditer(window):
                    x = tail_start + m.end()
                    head.append(m[0])
                    # a cut at the window's end may depend on what follows
                    if x in cuts and x > position + len(inserted) and (m.end() < len(window) or at_end):
                        met = x
                        break
                if met is not None or at_end:
                    break
            last += 1
            old = old + self.leaves[last]
        rest: list[str] = []
        if met is not None:
            x = tail_start + shift
            for i, p in enumerate(old):
                x += len(p)
                if x == met:
                    rest = old[i + 1 :]
                    break
        self.encoded += len(head)
        new = pieces[:kept] + head + rest
        spread = last - first + 1
        per = -(-len(new) // spread)
        for i in range(spread):
            self.leaves[first + i] = new[i * per : (i + 1) * per]
            self.tree.put(first + i, self._sum(self.leaves[first + i]))


_EDIT = "array<struct<step:bigint,position:bigint,removed:bigint,inserted:string>>"


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the array ``edits`` of each document's edits in order."""
    listed = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("edit_id")).agg(
        F.sort_array(F.collect_list(F.struct(*[F.col(c).cast(k).alias(c) for c, k in (("step", "long"), ("position", "long"), ("removed", "long"), ("inserted", "string"))]))).alias("edits")
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(listed, F.col("doc_id") == F.col("edit_id"), "left").drop("edit_id")


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64()), ("edited_tokens", pa.int64()), ("reencoded", pa.int64()), ("edited_sha256", pa.string())])


def counts(edited: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, edited_tokens, reencoded (pre-tokens that the edits
    re-encoded) and edited_sha256 of rows (doc_id, text, edits)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, count = _encoder(vocabulary)
        for b in batches:
            made = []
            for doc, text, changes in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), b.column("edits").to_pylist(), strict=True):
                counted = CountedText(text, cut, count)
                before, pieces = counted.tokens, counted.encoded
                for e in changes or ():
                    counted.edit(e["position"] or 0, e["removed"] or 0, e["inserted"] or "")
                made.append((doc, before, pieces, counted.tokens, counted.encoded - pieces, hashlib.sha256(counted.text().encode()).hexdigest()))
            if made:
                yield rows(dict(zip(_COUNTED.names, zip(*made, strict=True), strict=True)), _COUNTED)

    return edited.select("doc_id", "text", "edits").mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, edited_tokens long, reencoded long, edited_sha256 string")
