"""Chat formatting: conversations rendered by a compiled template, and read back.

Rows are ordered by turn inside each conversation (ties: role, then text; nulls
first). One partition holds many conversations, sorted; a task streams over its
rows, so a conversation of any length never sits in memory whole: the template is
rendered lazily turn by turn.

Defined results: null text or role is empty; a null ``conv_id`` is one
conversation of its own; repeated rows are repeated turns; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.chat_template import Piece, Template, unescape
from flowrisk.llm.common import partitions, rows, texts

#: Turns start with ``### Role: `` and end with ``</turn>``; both are escaped inside roles and texts.
TEMPLATE = (
    "{% for m in messages %}"
    "### {{ m.role | escape }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
_TURN_END = "</turn>\n"
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])


@lru_cache(maxsize=16)
def _compiled(source: str) -> Template:
    return Template(source)


def _ended(parts: list[str]) -> bool:
    """Whether the output so far ends with an unescaped turn end."""
    if not parts[-1].endswith(_TURN_END):
        return False
    before = "".join(parts)[: -len(_TURN_END)]
    return (len(before) - len(before.rstrip("\\"))) % 2 == 0


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str, str]]:
    """Turns of a formatted stream: role, text, text under the loss mask, formatted text.

    Only control strings and the mask are used: a turn ends at an unescaped
    ``</turn>`` (``<`` is always escaped inside texts)."""
    whole: list[str] = []
    masked: list[str] = []
    for text, under in pieces:
        whole.append(text)
        if under:
            masked.append(text)
        if not under and _ended(whole):
            turn = "".join(whole)
            head = _HEAD.match(turn)
            if head is None:
                raise ValueError(f"no turn mark in {turn[:40]!r}")
            yield unescape(head[1]), unescape(turn[head.end() : -len(_TURN_END)]), unescape("".join(masked)), turn
            whole, masked = [], []
    if whole:
        raise ValueError("the last turn does not end")


def _sorted_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(b.column("conv_id").to_pylist(), texts(b.column("role")), texts(b.column("text")), strict=True)


def _by_conversation(conversations: DataFrame) -> DataFrame:
    one = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    return one.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per turn: its formatted text and the spans under the loss mask
    (code points, relative to the turn's text). Joined in order of ``position``
    the texts are the formatted conversation."""

    def run(batches):
        made: list[tuple] = []
        for conv, group in groupby(_sorted_rows(batches), key=lambda r: r[0]):
            at, loss, turn, n = 0, [], [], 0
            for text, under in _compiled(template).render(messages=({"role": r, "text": t} for _, r, t in group)):
                turn.append(text)
                if under:
                    loss.append((at, at + len(text)))
                at += len(text)
                if not under and _ended(turn):
                    made.append((conv, n, "".join(turn), [a for a, _ in loss], [b for _, b in loss]))
                    at, loss, turn, n = 0, [], [], n + 1
                    if len(made) >= 2000:
                        yield rows(dict(zip(_TURNS.names, zip(*made, strict=True), strict=True)), _TURNS)
                        made = []
        if made:
            yield rows(dict(zip(_TURNS.names, zip(*made, strict=True), strict=True)), _TURNS)

    return _by_conversation(conversations).mapInArrow(run, "conv_id long, position long, formatted string, loss_start array<long>, loss_end array<long>")


def digest(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation, computed from the formatted output read back:
    ``n_turns``, digests of the turns and of the text under the loss mask, sizes."""

    def run(batches):
        made: list[tuple] = []
        for conv, group in groupby(_sorted_rows(batches), key=lambda r: r[0]):
            turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            pieces = _compiled(template).render(messages=({"role": r, "text": t} for _, r, t in group))
            for role, text, learned, formatted in read_back(pieces):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learned.encode())
                n, chars, size = n + 1, chars + len(learned), size + len(formatted)
            made.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            if len(made) >= 5000:
                yield rows(dict(zip(_DIGEST.names, zip(*made, strict=True), strict=True)), _DIGEST)
                made = []
        if made:
            yield rows(dict(zip(_DIGEST.names, zip(*made, strict=True), strict=True)), _DIGEST)

    return _by_conversation(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
