"""I-Match fingerprints.

Terms are the lower-cased words of a text. A term is in the lexicon if the share of
different texts that hold it lies within a band (its inverse document frequency is neither
low nor high; copies count once); the lower edge bounds the lexicon: its terms have shares of at least
``LOW``, so there are at most (mean number of different terms a document) / ``LOW`` of
them at any corpus size. Each of several randomised subsets of the lexicon gives a
64-bit hash of the text's sorted distinct terms in the subset. Subsets come in levels of
halving size, so texts of every length have subsets that hold few of their terms; the
levels of one part share no term.

A fingerprint has two sections, ``lexicon.all``: the text's lexicon terms, and all its
terms (fewer subsets), for pairs in which a text has no lexicon term. A section is hex: the
number of terms (8 digits), the hash of all of them and the hash of each subset (16 digits
each, zero if the text has no term there). Texts with the same lexicon terms have the same
lexicon section, and likeness 1. The likeness of two fingerprints follows from
them alone: a subset of share q agrees with probability (1 - q)^d if the texts differ in d
terms, so the agreeing subsets of each level and the two numbers of terms give an expected share of
terms in common (any share being as likely beforehand); 0 if no subset with a term agrees.

Defined results: null is the empty text; a text without terms has likeness 1 to its like, else 0;
null doc_ids come last in descending order, equal ids are ordered by
the hash of their text; a single document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import mix64, partitions, rows, settled, texts, trimmed

#: Band of the share of documents that hold a term.
LOW, HIGH = 2e-4, 0.2
#: Levels of subset size (shares 1/2, 1/4, ...); parts of subsets of the lexicon section and of the section of all terms.
LEVELS, PARTS, ALL_PARTS = 12, 8, 3
#: Shares in common that a likeness weighs.
GRID = np.linspace(0, 1, 101)
#: Rows of a range of ids at most, on average.
RANGE_ROWS = 100_000
#: Bound on the copied texts whose counts go to all tasks; more are joined.
BROADCAST_COPIES = 1_000_000


def term_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's terms."""
    from xxhash import xxh64_intdigest

    return np.unique(np.fromiter(map(xxh64_intdigest, set(text.lower().split())), dtype=np.uint64))


def copy_counts(docs: DataFrame) -> DataFrame:
    """hash, copies of every different text; null is the empty text."""
    return settled(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).groupBy("hash").agg(F.count("*").alias("copies")))


def document_frequencies(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """term (hash), df over all different texts: counted in tasks, summed by Spark.

    Each of a text's n copies adds 1 / n, so no text is moved to find one of them."""
    schema = pa.schema([("term", pa.int64()), ("df", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        seen: Counter = Counter()

        def flush():
            terms = np.fromiter(map(xxh64_intdigest, seen), dtype=np.uint64, count=len(seen))
            out = rows({"term": terms.view(np.int64), "df": np.fromiter(seen.values(), np.float64, len(seen))}, schema)
            seen.clear()
            return out

        for b in batches:
            for t, n in zip(texts(b.column("text")), b.column("copies").to_pylist(), strict=True):
                if n == 1:
                    seen.update(set(t.lower().split()))
                else:
                    for term in set(t.lower().split()):
                        seen[term] += 1 / n
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    several = copies.where("copies > 1")
    several = F.broadcast(several) if several.count() <= BROADCAST_COPIES else several
    counted = docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).join(several, "hash", "left")
    return counted.select("text", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(run, "term long, df double").groupBy("term").agg(F.round(F.sum("df")).cast("long").alias("df"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted term hashes whose share of the different texts lies in the band."""
    copies = copy_counts(docs)
    n = copies.count()
    kept = document_frequencies(docs, copies).where((F.col("df") >= low * n) & (F.col("df") <= max(high * n, 1.0))).select("term")
    return np.sort(kept.toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64))


def _slots(terms: np.ndarray, parts: int) -> np.ndarray:
    """The subset (part and level) of each term in each part; level k has a share of 2^-(k + 1), the last one also the rest."""
    salts = np.arange(1, parts + 1, dtype=np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03)
    mixed = mix64(terms[None, :] + salts)
    low = mixed & (~mixed + np.uint64(1))  # the lowest set bit
    level = np.minimum(np.bitwise_count(low - np.uint64(1)), LEVELS - 1).astype(np.int64)
    return level + LEVELS * np.arange(parts)[:, None]


def subset_hashes(terms: np.ndarray, parts: int) -> np.ndarray:
    """Hash of the terms of each subset: the sum of their mixed hashes, 0 if there are none."""
    out = np.zeros(parts * LEVELS, np.uint64)
    if len(terms):
        np.add.at(out, _slots(terms, parts).ravel(), np.tile(mix64(terms ^ np.uint64(0x9E3779B97F4A7C15)), parts))
    return out


def _section(terms: np.ndarray, parts: int) -> str:
    whole = hashlib.blake2b(terms.tobytes(), digest_size=8).hexdigest() if len(terms) else "0" * 16
    return f"{len(terms):08x}{whole}{subset_hashes(terms, parts).astype('>u8').tobytes().hex()}"


def fingerprint(text: str, band: np.ndarray) -> str:
    """Hashes of the randomised subsets of the text's lexicon terms, and of all its terms."""
    terms = term_hashes(text)
    if len(band) and len(terms):
        at = np.minimum(np.searchsorted(band, terms), len(band) - 1)
        inside = terms[band[at] == terms]
    else:
        inside = terms[:0]
    return f"{_section(inside, PARTS)}.{_section(terms, ALL_PARTS)}"


def _read(section: str) -> tuple[int, np.ndarray]:
    return int(section[:8], 16), np.frombuffer(bytes.fromhex(section[24:]), ">u8")


#: Logarithm of the probability that a subset of each level lacks a term.
_LACKS = np.log1p(-(0.5 ** np.minimum(np.arange(1, LEVELS + 1), LEVELS - 1)))


def likeness(a: str, b: str) -> float:
    """0 to 1: the expected share of terms in common, of the lexicon's if both texts have some."""
    if a == b:
        return 1.0
    (a_lexicon, a_all), (b_lexicon, b_all) = a.split("."), b.split(".")
    (n, x), (m, y) = _read(a_lexicon), _read(b_lexicon)
    if n and m and a_lexicon == b_lexicon:
        return 1.0
    if not (n and m):
        (n, x), (m, y) = _read(a_all), _read(b_all)
    same = x == y
    if not (same & (x != 0)).any():
        return 0.0
    agree = same.reshape(-1, LEVELS).sum(0)
    shares = GRID[(GRID > 0) & (GRID < 1) & (GRID <= min(n, m) / max(n, m) + 0.01)]
    differ = np.maximum((n + m) * (1 - shares) / (1 + shares), 1.0)
    lacks = differ[:, None] * _LACKS
    chance = (agree * lacks + (len(x) // LEVELS - agree) * np.log(-np.expm1(lacks))).sum(1)
    weight = np.exp(chance - chance.max())
    return float((shares * weight).sum() / weight.sum())


def fingerprints(docs: DataFrame, band: np.ndarray, columns: list[str]) -> DataFrame:
    """The given columns of ``docs`` with the text's fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(band)
    kept = docs.select(*columns, "text")
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(t, shared.value) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(made, type=pa.string())], names=[*columns, "fingerprint"])

    return kept.mapInArrow(run, StructType([*kept.drop("text").schema.fields, StructField("fingerprint", StringType())]))


_EDITED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)

_EDITED_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _ranges(base: DataFrame, buckets: int) -> Column:
    """Number of each row's range in descending order of ids (none last).

    Edges are quantiles of the ids. An id that holds several of them is split by ranges of its
    texts' hashes, as are the rows without an id."""
    edges = base.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)] or [0.5], 10 * max(buckets, 1000))).first()[0] or []
    edge, times = np.unique(np.array(edges, np.int64), return_counts=True)
    # ranges count from the largest edge down; range 0 holds the ids above all edges
    first = 1 + np.append(times[::-1].cumsum()[::-1][1:], 0)[: len(times)]
    shared = base.sparkSession.sparkContext.broadcast((edge, times, first))

    @F.pandas_udf("int")
    def number(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        edge, times, first = shared.value
        share = (hashes.to_numpy(np.float64) + 2.0**63) / 2.0**64  # of the hashes below the row's; keeps their order
        none = ids.isna().to_numpy()
        out = np.minimum((share * buckets).astype(np.int64), buckets - 1) + times.sum() + 1  # rows without an id
        known = ids[~none].to_numpy(np.int64) if none.any() else ids.to_numpy(np.int64)
        at = np.searchsorted(edge, known)  # of the edges at or above the id the least
        inside, found = at < len(edge), np.zeros(len(known), np.int64)
        at, part = at[inside], share[~none][inside]
        own = np.minimum((part * times[at]).astype(np.int64), times[at] - 1)
        found[inside] = first[at] + np.where(edge[at] == known[inside], own, times[at] - 1)
        out[~none] = found
        return pd.Series(out.astype(np.int32))

    return number("id", "hash")


def compare_with_next(docs: DataFrame, band: np.ndarray, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next
    document in descending doc_id (after the last: the first).

    Documents are dealt to ranges of ids; inside a range a task streams over them in
    order and holds one text at a time. The first text of each range is dealt to the
    range before it, too, behind its last document. Rows of equal id and text lie in one range."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    buckets = buckets or max(2 * partitions(spark), base.count() // RANGE_ROWS)
    dealt = base.withColumn("bucket", _ranges(base, buckets))
    heads = settled(dealt.groupBy("bucket").agg(F.max("id").alias("head_id"), F.min(F.when(F.col("id").isNull(), F.col("hash"))).alias("head_hash")))
    used = sorted(r["bucket"] for r in heads.select("bucket").collect())  # a number a range
    if not used:
        return spark.createDataFrame([], _EDITED_DDL)
    # ranges are numbered anew, without gaps, so that each is a task of its own
    numbers = spark.createDataFrame([(b, i, (i - 1) % len(used)) for i, b in enumerate(used)], "bucket int, at int, before int")
    placed = dealt.join(F.broadcast(numbers), "bucket")
    at_head = F.col("id").eqNullSafe(F.col("head_id")) & (F.col("head_id").isNotNull() | (F.col("hash") == F.col("head_hash")))
    firsts = placed.join(F.broadcast(heads), "bucket").where(at_head).groupBy("bucket", "before", "id").agg(F.min(F.struct("hash", "text")).alias("head"))
    rows_ = placed.select("at", F.lit(False).alias("head"), "id", "hash", "text").unionByName(
        firsts.select(F.col("before").alias("at"), F.lit(True).alias("head"), "id", "head.hash", "head.text"))
    shared = spark.sparkContext.broadcast(band)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held, made = shared.value, None, []
        for b in batches:
            for head, doc, text in zip(b.column("head").to_pylist(), b.column("id").to_pylist(), texts(b.column("text")), strict=True):
                own = fingerprint(text, terms)
                if held is not None:
                    at, before, print_ = held
                    new = edited(before, text)
                    new_print = fingerprint(new, terms)
                    made.append((at, len(before), hashlib.sha256(new.encode()).hexdigest(), print_, new_print, likeness(print_, new_print), likeness(print_, own)))
                held = None if head else (doc, text, own)
                if len(made) >= 1000:
                    yield rows(dict(zip(_EDITED.names, zip(*made, strict=True), strict=True)), _EDITED)
                    made = []
        if made:
            yield rows(dict(zip(_EDITED.names, zip(*made, strict=True), strict=True)), _EDITED)
        trimmed()

    in_order = rows_.repartitionById(len(used), F.col("at")).sortWithinPartitions("head", F.col("id").desc_nulls_last(), "hash")
    return in_order.select("head", "id", "text").mapInArrow(run, _EDITED_DDL)
