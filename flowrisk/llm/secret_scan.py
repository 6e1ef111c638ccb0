"""Secrets in texts.

One Aho-Corasick automaton over the lower-cased bytes of a text finds keywords; only where
one stands does the regular expression of its kind run, anchored there. Runs of hex digits
have no keyword: all four-digit hex grams are keywords of theirs (a run of four digits or
more starts with one). Matches of a kind are leftmost and do not overlap: a keyword inside
an earlier match of its kind is passed over, also if that match is dropped for its length.

Base kinds (fixed values) and further kinds whose secret carries a checksum, kept only if it holds:

    assign   (password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+), value of 6 or more
    access   AKIA[A-Z0-9]+ of 20 or more
    hex      [0-9a-f]+ of 24 or more
    forge    gh[opusr]_ and 36 letters or digits; the last six are the CRC-32 of the 30 before, in base 62
    package  npm_ and 36 letters or digits; the same checksum
    xprv     extended private key: base 58 of 78 bytes and four bytes of their double SHA-256
    bech32   nsec1... and AGE-SECRET-KEY-1...: a BCH checksum of six characters over prefix and data

Spans are (kind, start, end) in code points, end exclusive, by start and then kind as listed.

Defined results: null text is empty and has no spans; a null doc_id is kept; repeated rows
each give a row; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import byte_sizes, slices

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
#: Generator of the BCH checksum (fixed values).
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc62(token: bytes) -> bool:
    """The last six characters are the base-62 CRC-32 of the thirty before."""
    secret, check = token[-36:-6], token[-6:].decode()
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(secret)


def base58check(token: bytes) -> bool:
    """The last four of the 82 bytes start the double SHA-256 of the others."""
    value = 0
    for c in token.decode():
        value = value * 58 + BASE58.index(c)
    if value >> 8 * 82:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32(token: bytes) -> bool:
    """The checksum over prefix and data leaves 1; upper and lower case don't mix."""
    text = token.decode()
    if text.lower() != text and text.upper() != text:
        return False
    prefix, data = text.lower().rsplit("1", 1)
    state = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(BECH32.index, data)]:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(BECH32_GENERATOR):
            state ^= g * (top >> i & 1)
    return state == 1


@dataclass(frozen=True)
class Kind:
    """``keywords`` are lower-case ASCII and start every match of ``pattern`` (over bytes, in its own case)."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    keep: Callable[[re.Match], bool]
    base: bool = False
    #: Whether the automaton, which gives hits by their ends, gives them by their starts, too.
    in_order: bool = True


HEX_GRAM = 4
KINDS: tuple[Kind, ...] = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-])+)""", re.I),
         lambda m: m.end(2) - m.start(2) >= 6, True, in_order=False),
    Kind("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 20, True),
    Kind("hex", tuple(map("".join, product("0123456789abcdef", repeat=HEX_GRAM))), re.compile(rb"[0-9a-f]+"), lambda m: m.end() - m.start() >= 24, True),
    Kind("forge", ("gho_", "ghp_", "ghr_", "ghs_", "ghu_"), re.compile(rb"gh[opusr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"), lambda m: crc62(m[0])),
    Kind("package", ("npm_",), re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9_])"), lambda m: crc62(m[0])),
    Kind("xprv", ("xprv",), re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"), lambda m: base58check(m[0])),
    Kind("bech32", ("nsec1", "age-secret-key-1"),
         re.compile(rb"(?:nsec1[02-9ac-hj-np-z]{58}|NSEC1[02-9AC-HJ-NP-Z]{58}|AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58})(?![0-9A-Za-z])"), lambda m: bech32(m[0]), in_order=False),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)


@lru_cache(maxsize=1)
def automaton():
    """Keywords of all kinds; a hit gives (kind's position in the list, length)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, kind in enumerate(KINDS):
        for w in kind.keywords:
            a.add_word(w, (i, len(w)))
    a.make_automaton()
    return a


def spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's position, end) of all secrets in UTF-8 bytes, in byte offsets, ordered."""
    past = [0] * len(KINDS)
    hits: list[list[int]] = [[] for _ in KINDS]
    # one character per byte, so places in the lower-cased text are places in the bytes
    for end, (i, size) in automaton().iter(raw.lower().decode("latin-1")):
        hits[i].append(end + 1 - size)
    found = []
    for i, starts in enumerate(hits):
        kind = KINDS[i]
        if not kind.in_order:
            starts.sort()
        for at in starts:
            if at >= past[i] and (m := kind.pattern.match(raw, at)):
                past[i] = m.end()
                if kind.keep(m):
                    found.append((at, i, m.end()))
    found.sort()
    return found


def in_code_points(raw: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if not found or raw.isascii():
        return found
    b = np.frombuffer(raw, np.uint8)
    places = sorted({p for s, _, e in found for p in (s, e)})
    counts, last, n = [], 0, 0
    for p in places:
        n += int(np.count_nonzero((b[last:p] & 0xC0) != 0x80))
        counts.append(n)
        last = p
    at = lambda p: counts[bisect_left(places, p)]
    return [(at(s), i, at(e)) for s, i, e in found]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``spans`` of (kind, start, end) of each row (doc_id, text). No shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [k.name for k in KINDS]
        for batch in batches:
            for lo, hi in slices(byte_sizes(batch.column("text"))):
                b = batch.slice(lo, hi - lo)
                made = []
                for v in b.column("text").cast(pa.large_binary()):
                    raw = v.as_py() or b""
                    made.append([{"kind": names[i], "start": s, "end": e} for s, i, e in in_code_points(raw, spans(raw))])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, _SPAN)], names=["doc_id", "spans"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
