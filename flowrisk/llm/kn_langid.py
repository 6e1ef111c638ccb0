"""Language identification by interpolated Kneser-Ney character language models.

One model of order ``ORDER`` per language, stored in sorted arrays of n-gram hashes
(16 bits a character). A text's language is the one with the lowest cross-entropy
per character. Rejection is calibrated on all training rows: a text is rejected if its
cross-entropy under the best model lies above what texts of that language and length
show. The order statistics that this takes are found by counting values in ever finer
bins, so the driver sees counts, not rows.

Counts cover all training rows: each task counts whole texts, Spark sums the counts,
and the model keeps every n-gram. Up to ``MAX_NGRAMS`` it is held as a whole. A larger
one is split by the last but one character: all that a key's probability needs from
orders 2 to 4 has that character, so a block of such characters holds ``MAX_NGRAMS`` at
most (or one character's n-grams); order 1 and the discounts are those of the whole.
Blocks are broadcast one by one and loaded one by one, so the result is the same.

Characters: lower case; all but letters become a space, runs of spaces one.

Defined results: null texts and texts without letters are ``und`` with score 0;
rows without lang are predicted but not learned from; null doc_id is neither held out
nor learned from (its remainder is null); without training rows all are ``und``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import byte_sizes, rows, settled, slices, texts, trimmed

ORDER = 4
#: Bound on the n-grams of all languages that a process holds at once.
MAX_NGRAMS = 4_000_000
#: Bits after the point of a bin's edge, in each round of counting; distinct values of a bin that are fetched.
BIN_BITS, FETCHED = (6, 16, 26, 36), 2_000
#: Bytes of text that a task counts or scores at once (an array of keys takes eight bytes a character, and there
#: are several), and n-grams that it holds before it merges them, or hands them on.
WORK_BYTES, HELD, HANDED_ON = 1 << 18, 1_000_000, 600_000
SPACE = 32
UND = "und"


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point -> 16-bit symbol: lower-case letters; a space for all others."""
    t = np.full(0x110000, SPACE, dtype=np.uint16)
    for cp in range(0x20, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = ord(c.lower()[0])
            t[cp] = low if low < 0x10000 else 0xE000 + (low & 0x1FFF)
    return t


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Whether a code point is a letter (marks alone are none)."""
    return np.array([chr(cp).isalpha() for cp in range(0x110000)])


def encode(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order-4 keys of all texts, the text number of each key, and whether each text has a letter.

    A key holds its characters at 16 bits each, the last in the lowest; characters
    before a text's start are 0."""
    points = np.frombuffer("\0".join([*batch, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _fold_table()[points]
    ends = np.cumsum(np.fromiter(map(len, batch), np.int64, len(batch)) + 1) - 1
    c[ends] = 0
    gap = c == SPACE
    keep = ~gap
    keep[1:] |= ~(gap[:-1] | (c[:-1] == 0))
    keep[0] = c[0] != SPACE
    c, letter = c[keep], _letter_table()[points[keep]]
    stop = c == 0
    doc = np.cumsum(stop) - stop
    k = c.astype(np.uint64)
    keys, alive = k.copy(), ~stop
    for j in range(1, ORDER):
        before = np.zeros_like(k)
        before[j:] = k[:-j]
        alive = alive & (before != 0)
        keys |= np.where(alive, before, np.uint64(0)) << np.uint64(16 * j)
    letters = np.bincount(doc[~stop & letter], minlength=len(batch)) > 0
    return keys[~stop], doc[~stop], letters


def count_ngrams(docs: DataFrame, lang: Column | str = "lang") -> DataFrame:
    """lang, gram, n over all rows of ``docs`` with a language: counted in tasks, summed by Spark."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(n, np.nonzero(first)[0])

        def flush():
            for name, parts in held.items():
                keys, n = merged(parts)
                yield rows({"lang": [name] * len(keys), "gram": keys.view(np.int64), "n": n}, schema)
            held.clear()

        for b in batches:
            names, words = np.array(b.column("lang").to_pylist(), dtype=object), texts(b.column("text"))
            sizes = byte_sizes(b.column("text"))
            for name in dict.fromkeys(names):
                of = np.nonzero(names == name)[0]
                for lo, hi in slices(sizes[of], WORK_BYTES):
                    keys, _, _ = encode([words[i] for i in of[lo:hi]])
                    if len(keys):
                        held.setdefault(name, []).append(np.unique(keys, return_counts=True))
                        size += len(held[name][-1][0])
            if size > HELD:
                for name, parts in held.items():
                    held[name] = [merged(parts)]
                size = sum(len(p[0][0]) for p in held.values())
                if size > HANDED_ON:
                    yield from flush()
                    size = 0
        yield from flush()
        trimmed()

    counted = docs.select(F.col(lang).alias("lang") if isinstance(lang, str) else lang.alias("lang"), "text").where("lang is not null and text is not null")
    return counted.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones and twos else 0.75


class CharModel:
    """Interpolated Kneser-Ney model of one language over order-4 keys, in sorted arrays.

    Of a block of the keys: with the discounts (highest order first) and the grams and
    counts of order 1 of the whole."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, whole: tuple[list[float], np.ndarray, np.ndarray] | None = None):
        order = np.argsort(keys)
        grams, n = keys[order].astype(np.uint64), n[order].astype(np.float64)
        self.levels = []  # highest order first: (grams, discounted counts / context total, contexts, backoff weight)
        for k in range(ORDER, 0, -1):
            if k == 1 and whole:
                at = np.argsort(whole[1])
                grams, n = whole[1][at].astype(np.uint64), whole[2][at].astype(np.float64)
            self.levels.append(self._level(grams, n, whole[0][ORDER - k] if whole else discount(float((n == 1).sum()), float((n == 2).sum()))))
            if k > 1:  # continuation counts of the next lower order: in how many contexts a gram is seen
                grams, n = np.unique(grams & np.uint64((1 << 16 * (k - 1)) - 1), return_counts=True)
                n = n.astype(np.float64)
        self.floor = 1.0 / (len(grams) + 1.0)

    @staticmethod
    def _level(grams: np.ndarray, n: np.ndarray, d: float):
        contexts, first = np.unique(grams >> np.uint64(16), return_index=True)
        total, kinds = np.add.reduceat(n, first) if len(n) else n, np.diff(np.append(first, len(n)))
        p = np.maximum(n - d, 0) / np.repeat(total, kinds)
        return grams, p.astype(np.float64), contexts, d * kinds / total

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """log2 of the probability of the last character of each key after the others."""
        p = np.full(len(keys), self.floor)
        for k, (grams, own, contexts, weight) in zip(range(1, ORDER + 1), reversed(self.levels), strict=True):
            if not len(grams):
                continue
            part = keys & np.uint64((1 << 16 * k) - 1) if k < 4 else keys
            at = np.minimum(np.searchsorted(contexts, part >> np.uint64(16)), len(contexts) - 1)
            known = contexts[at] == part >> np.uint64(16)
            p = np.where(known, weight[at] * p, p)
            at = np.minimum(np.searchsorted(grams, part), len(grams) - 1)
            p += np.where(grams[at] == part, own[at], 0.0)
        return np.log2(np.maximum(p, 1e-12))


def quantiles(values: DataFrame, q: float, least: int = 20) -> dict[int, float]:
    """Quantile of ``v`` for each ``i`` of ``values`` (settled) that has ``least`` rows, over all rows
    and between order statistics as in ``numpy.quantile``.

    Each round counts the values in bins, first in all, then in those parts of the bin that holds a
    wanted rank; what a bin of few values holds is fetched (in the last round its edge stands for it)."""
    counts: dict[int, int] = {r["i"]: r["n"] for r in values.groupBy("i").agg(F.count("v").alias("n")).collect() if r["n"] >= least}
    want = {(i, rank) for i, n in counts.items() for rank in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))}
    inside = {w: (None, w[1]) for w in want}  # bin that holds it, and its rank there
    found: dict[tuple[int, int], float] = {}
    last = None
    for bits in BIN_BITS:
        bin_of = lambda b: F.floor(F.col("v") * float(1 << b))
        part = values
        if last is not None:
            open_ = sorted({(w[0], at) for w, (at, _) in inside.items()})
            if not open_:
                break
            part = part.where(F.struct(F.col("i").cast("long"), bin_of(last).cast("long")).isin(*[F.struct(F.lit(int(i)).cast("long"), F.lit(int(at)).cast("long")) for i, at in open_]))
        elif counts:
            part = part.where(F.col("i").isin(list(counts)))
        got: dict[tuple, list] = {}
        for r in part.groupBy("i", bin_of(bits).alias("b")).agg(F.count("v").alias("n"), F.countDistinct("v").alias("kinds"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            got.setdefault((r["i"], None if last is None else r["b"] >> (bits - last)), []).append(r)
        few = {}
        for w, (at, rank) in list(inside.items()):
            for r in sorted(got[w[0], at], key=lambda r: r["b"]):
                if rank < r["n"]:
                    break
                rank -= r["n"]
            if r["lo"] == r["hi"] or rank in (0, r["n"] - 1) or bits == BIN_BITS[-1]:
                found[w] = r["hi"] if rank == r["n"] - 1 else r["lo"]
                del inside[w]
            else:
                inside[w] = (r["b"], rank)
                if r["kinds"] <= FETCHED:
                    few[w] = (r["b"], rank)
        if few:
            bins = sorted({(w[0], at) for w, (at, _) in few.items()})
            mine = values.where(F.struct(F.col("i").cast("long"), bin_of(bits).cast("long")).isin(*[F.struct(F.lit(int(i)).cast("long"), F.lit(int(at)).cast("long")) for i, at in bins]))
            held: dict[tuple, list] = {}
            for r in mine.groupBy("i", bin_of(bits).alias("b"), "v").agg(F.count(F.lit(1)).alias("n")).collect():
                held.setdefault((r["i"], r["b"]), []).append((r["v"], r["n"]))
            for w, (at, rank) in few.items():
                for v, n in sorted(held[w[0], at]):
                    if rank < n:
                        break
                    rank -= n
                found[w] = v
                del inside[w]
        last = bits
    out = {}
    for i, n in counts.items():
        h = q * (n - 1)
        a, b = found[i, int(h)], found[i, min(int(h) + 1, n - 1)]
        out[i] = a + (b - a) * (h - int(h))
    return out


def _middle(keys: np.ndarray) -> np.ndarray:
    """The last but one character of each key."""
    return ((keys >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)


class LangModel:
    """The models of all languages, with the calibration of the rejection.

    ``models`` are held as a whole; if ``block_of`` (block of each last but one character)
    is given, ``blocks`` are broadcasts of the models of each block instead."""

    def __init__(self, models: dict[str, CharModel], langs: list[str] | None = None, blocks: list[Broadcast] | None = None, block_of: np.ndarray | None = None):
        self.langs = langs or sorted(models)
        self.models = [models[x] for x in sorted(models)]
        self.blocks, self.block_of = blocks or [], block_of
        self.mean = np.zeros(len(self.langs))
        self.limit = np.full(len(self.langs), np.inf)

    def __getstate__(self):
        return self.__dict__ | {"blocks": []}  # broadcasts reach a task in its function only

    def _log2(self, seen: np.ndarray) -> list[np.ndarray]:
        """log2 of the probabilities of sorted keys under each language."""
        if self.block_of is None:
            return [m.log2(seen) for m in self.models]
        out = [np.zeros(len(seen)) for _ in self.langs]
        of = self.block_of[_middle(seen)]
        for i in np.unique(of):
            at, block = np.nonzero(of == i)[0], self.blocks[i]
            # loaded anew each time: a Broadcast would keep its value
            models = block.load_from_path(block._path) if getattr(block, "_path", None) else block.value
            for x, m in zip(out, models, strict=True):
                x[at] = m.log2(seen[at])
            del models
        return out

    def cross_entropies(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: bits a character under each language, number of characters, has a letter."""
        keys, doc, letters = encode(batch)
        n = np.bincount(doc, minlength=len(batch))
        out = np.zeros((len(batch), len(self.langs)))
        if not len(keys):
            return out, n, letters
        seen = np.unique(keys)
        bits = max(12, int(np.ceil(np.log2(len(seen)))) + 5)
        shift, mult = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
        slot = np.zeros(1 << bits, dtype=np.int32)
        slot[((seen * mult) >> shift).astype(np.int64)] = np.arange(len(seen), dtype=np.int32)
        at = slot[((keys * mult) >> shift).astype(np.int64)]
        miss = np.nonzero(seen[at] != keys)[0]
        at[miss] = np.searchsorted(seen, keys[miss])
        full = np.nonzero(n)[0]
        starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        for i, bits_of in enumerate(self._log2(seen)):
            out[full, i] = -np.add.reduceat(bits_of[at], starts) / n[full]
        return out, n, letters

    @staticmethod
    def _excess(ce, mean, n):
        return (ce - mean) * np.sqrt(np.minimum(n, 400))

    def calibrate(self, scored: DataFrame) -> None:
        """scored: i (language number), ce (own cross-entropy), n (characters) of the calibration
        texts. The limit is half again the excess that one of them in a thousand shows."""
        self.mean[:] = 0
        for i, q in quantiles(scored.select("i", F.col("ce").alias("v")), 0.5).items():
            self.mean[i] = q
        means = F.array(*[F.lit(float(m)) for m in self.mean])
        excess = (F.col("ce") - F.get(means, F.col("i").cast("int"))) * F.sqrt(F.least("n", F.lit(400)).cast("double"))
        for i, q in quantiles(scored.select("i", excess.alias("v")), 0.999).items():
            self.limit[i] = 1.5 * max(q, 1.0)

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0 to 1) and whether the text is rejected."""
        ce, n, letters = self.cross_entropies(batch)
        if not self.langs:
            return [UND] * len(batch), np.zeros(len(batch)), np.ones(len(batch), bool)
        best = ce.argmin(axis=1)
        own = ce[np.arange(len(batch)), best]
        gain = (own[:, None] - ce) * np.log(2) * np.minimum(n, 100)[:, None] / 2
        score = 1.0 / np.exp(np.clip(gain, -60, 0)).sum(axis=1)
        excess = self._excess(own, self.mean[best], n)
        limit = self.limit[best]
        with np.errstate(invalid="ignore", over="ignore"):
            score = score * np.where(np.isinf(limit) | (excess <= 0), 1.0, 1.0 / (1.0 + (excess / np.maximum(limit, 1e-9)) ** 4))
        rejected = ~letters | (excess > limit)
        return [self.langs[b] if x else UND for b, x in zip(best, letters, strict=True)], np.where(letters, score, 0.0), rejected


def _arrays(counts: DataFrame, langs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of each language."""
    got = counts.select(F.array_position(F.lit(langs), F.col("lang")).cast("int").alias("i"), "gram", "n").toArrow()
    i, grams, n = (got.column(c).to_numpy() for c in ("i", "gram", "n"))
    return [(grams[i == k].astype(np.int64).view(np.uint64), n[i == k]) for k in range(1, len(langs) + 1)]


def _split_model(counts: DataFrame, langs: list[str], sizes: dict[int, int], max_ngrams: int) -> LangModel:
    """Model in blocks of last but one characters; the driver holds one block at a time."""
    level, ds = counts, []
    for k in range(ORDER, 0, -1):
        found = {r["lang"]: r for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
        ds.append([discount(found[x]["ones"], found[x]["twos"]) for x in langs])
        if k > 1:
            level = level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    whole = [([d[i] for d in ds], *one) for i, one in enumerate(_arrays(level, langs))]
    block_of, held, block = np.zeros(1 << 16, np.int32), 0, 0
    for char, size in sorted(sizes.items()):
        if held and held + size > max_ngrams:
            block, held = block + 1, 0
        block_of[char], held = block, held + size
    spark, blocks = counts.sparkSession, []
    char = F.shiftright("gram", 16).bitwiseAND(F.lit(0xFFFF))
    for i in range(block + 1):
        chars = [c for c in sizes if block_of[c] == i]
        mine = counts.where(char.between(min(chars), max(chars)))  # blocks are runs of characters
        blocks.append(spark.sparkContext.broadcast([CharModel(*one, w) for one, w in zip(_arrays(mine, langs), whole, strict=True)]))
    return LangModel({}, langs, blocks, block_of)


def train(docs: DataFrame, max_ngrams: int = MAX_NGRAMS) -> LangModel:
    """Model from all rows of ``docs`` (doc_id, text, lang) that have a language, calibrated on all of them."""
    counts = settled(count_ngrams(docs))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return LangModel({})
    spark = docs.sparkSession
    sizes = {r["char"]: r["n"] for r in counts.groupBy(F.shiftright("gram", 16).bitwiseAND(F.lit(0xFFFF)).alias("char")).agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) <= max_ngrams:
        model = LangModel({x: CharModel(*one) for x, one in zip(langs, _arrays(counts, langs), strict=True)})
    else:
        model = _split_model(counts, langs, sizes, max_ngrams)
    labelled = docs.where(F.col("lang").isin(model.langs) & F.col("text").isNotNull())
    shared, blocks = spark.sparkContext.broadcast(model), model.blocks
    schema = pa.schema([("i", pa.int64()), ("ce", pa.float64()), ("n", pa.int64())])

    def run(batches):
        m = shared.value
        m.blocks = blocks
        for b in batches:
            names, words, sizes = b.column("lang").to_pylist(), texts(b.column("text")), byte_sizes(b.column("text"))
            for lo, hi in slices(sizes, WORK_BYTES):
                ce, chars, letters = m.cross_entropies(words[lo:hi])
                i = np.array([m.langs.index(x) for x in names[lo:hi]])
                ok = letters
                yield rows({"i": i[ok], "ce": ce[np.arange(hi - lo), i][ok], "n": chars[ok]}, schema)

    model.calibrate(settled(labelled.select("lang", "text").mapInArrow(run, "i long, ce double, n long")))
    shared.destroy()  # scoring broadcasts the calibrated model; the workers need not hold both
    return model


def detect(docs: DataFrame, model: LangModel) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; only the text is looked at."""
    shared, blocks = docs.sparkSession.sparkContext.broadcast(model), model.blocks
    added = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    columns = [c for c in docs.columns if c not in added.names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m.blocks = blocks
        for b in batches:
            langs, scores, rejected = [], [], []
            words = texts(b.column("text"))
            for lo, hi in slices(byte_sizes(b.column("text")), WORK_BYTES):
                x, s, r = m.predict(words[lo:hi])
                langs += x
                scores.append(s)
                rejected.append(r)
            if b.num_rows:
                new = rows({"lang_pred": langs, "score": np.concatenate(scores), "rejected": np.concatenate(rejected)}, added)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *new.columns], names=[*columns, *added.names])
        trimmed()

    out = docs.select(*columns)
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([*out.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return out.mapInArrow(run, schema)
