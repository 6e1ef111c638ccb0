"""Toxicity scores from a weighted lexicon.

Texts are folded (lower case, accents off, look-alike letters of other scripts and
digit substitutions to Latin letters, all else a space), then matched whole-word by an
Aho-Corasick automaton. Matches inside an exception phrase do not count. The sum of
the weights, also divided by the text's length, goes through a logistic curve.

The lexicon, its weights, the exception phrases and the curve are learned from a
bounded sample of labelled rows (``SAMPLE_ROWS``); every text is scored whole.

Defined results: null and empty texts score like a text without matches; rows
without labels are scored but not learned from; null labels and doc_ids are not
learned from; without both classes in the sample every score is the share of toxic
labels (0 without labels); repeated rows are scored each; repeated labels count once.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowrisk.llm.common import byte_sizes, rows, settled, slices, texts

#: Bound on the labelled rows that the lexicon and the curve are learned from.
SAMPLE_ROWS = 20_000
#: Bound on the lexicon.
MAX_TERMS = 5_000
THRESHOLD = 0.3

# Letters of other scripts and signs that look like Latin letters, and the letters they stand for.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
_INVISIBLE = "­​‌‍⁠﻿"


class _Fold(dict):
    """Translation table that fills itself: a code point's folded form."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        out = ""
        for x in unicodedata.normalize("NFKD", c).lower():
            if x in _LOOKALIKES:
                out += _LOOKALIKES[x]
            elif x.isalnum():
                out += x
            elif unicodedata.category(x)[0] != "M" and x not in _INVISIBLE:
                out += " "
        self[cp] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> list[str]:
    """Folded words of a text."""
    return text.translate(_FOLD).split()


@dataclass
class Lexicon:
    """Weights of folded words, exception phrases (folded, space-joined) and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=lambda: [-30.0, 0.0, 0.0, 0.0])

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w, x in self.weights.items():
            a.add_word(f" {w} ", (len(w) + 2, x))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None))
        if len(a):
            a.make_automaton()
        return a

    def features(self, words: list[str], automaton) -> list[float]:
        """Number of matches' weight in all, per square root of the words, and of the different terms."""
        if not words or not len(automaton):
            return [0.0, 0.0, 0.0]
        found, excepted = [], []
        for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
            (found if weight is not None else excepted).append((end - size + 1, end, weight))
        if excepted:
            found = [f for f in found if not any(a <= f[0] and f[1] <= b for a, b, _ in excepted)]
        total = sum(w for _, _, w in found)
        return [math.log1p(total), total / math.sqrt(len(words)), sum({w for _, _, w in found})]

    def score(self, x: np.ndarray) -> np.ndarray:
        c = np.array(self.curve)
        return 1.0 / (1.0 + np.exp(-np.clip(c[0] + x @ c[1:], -60, 60)))


def _g2(a, b, n1, n0):
    """Likelihood ratio of a term seen in a of n1 toxic and b of n0 other texts."""
    p = (a + b) / (n1 + n0)
    part = lambda k, n: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0) + F.when(k < n, (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)
    return 2 * (part(a, n1) + part(b, n0))


def _counted(sample: DataFrame, units) -> DataFrame:
    """unit, a, b: number of toxic and other sample texts that hold it."""
    schema = pa.schema([("unit", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def flush():
            both = list(seen[0] | seen[1])
            out = rows({"unit": both, "a": [seen[1][u] for u in both], "b": [seen[0][u] for u in both]}, schema)
            seen[0].clear()
            seen[1].clear()
            return out

        for b in batches:
            for text, toxic in zip(texts(b.column("text")), b.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(set(units(fold(text))))
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield flush()
        yield flush()

    return sample.select("text", "toxic").mapInArrow(run, "unit string, a long, b long").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression with a small ridge, by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    c = np.zeros(a.shape[1])
    ridge = np.diag([1e-3] + [0.1] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ c)
        c += step
        if np.abs(step).max() < 1e-8:
            break
    return c.tolist()


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, exceptions: Iterable[str] = ()) -> Lexicon:
    """Lexicon from at most ``sample_rows`` rows of ``labels`` (doc_id, toxic), taken by
    the hash of their ids, with the texts of ``docs``."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    sample = settled(docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(F.broadcast(chosen), "label_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic")))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    phrases = [" ".join(fold(e)) for e in exceptions]
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return Lexicon({}, phrases, [math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0, 0.0])
    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    counted = settled(_counted(sample, lambda words: words).where("a + b >= 3"))
    # the statistic that one of so many terms reaches by chance
    least = 2 * math.log(max(2, counted.count()))
    terms = (
        counted.where(a / n1 > 2 * b / n0).withColumn("weight", odds).withColumn("g2", _g2(a, b, float(n1), float(n0)))
        .where(F.col("g2") >= least).orderBy(F.col("g2").desc(), "unit").limit(MAX_TERMS).collect()
    )
    lexicon = Lexicon({r["unit"]: float(r["weight"]) for r in terms}, phrases)
    weights = lexicon.weights

    def pairs(words: list[str]) -> list[str]:
        return [f"{u} {v}" for u, v in zip(words, words[1:], strict=False) if u in weights or v in weights]

    # a phrase around a lexicon word that is found among other texts, as often as among all or more
    harmless = _counted(sample, pairs).where((b >= 5) & (a / n1 <= b / n0)).orderBy(b.desc(), "unit").limit(MAX_TERMS).collect()
    lexicon.exceptions = sorted({*phrases, *(r["unit"] for r in harmless)})
    got = _featured(sample, lexicon, ["toxic"], "x").select("toxic", "x").collect()
    lexicon.curve = _fit(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], dtype=float))
    return lexicon


def _featured(docs: DataFrame, lexicon: Lexicon, columns: list[str], feature: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept = docs.select(*columns, "text")
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        automaton = lex.automaton()
        for b in batches:
            x = [lex.features(fold(t), automaton) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(x, type=pa.list_(pa.float64()))], names=[*columns, feature])

    return kept.mapInArrow(run, StructType([*kept.drop("text").schema.fields, StructField(feature, ArrayType(DoubleType()))]))


def score(docs: DataFrame, lexicon: Lexicon, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The given columns of ``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    feature = next(f"features{i or ''}" for i in range(len(columns) + 1) if f"features{i or ''}" not in columns)
    c = lexicon.curve
    z = sum((F.lit(float(w)) * F.col(feature)[i] for i, w in enumerate(c[1:])), F.lit(float(c[0])))
    kept = [c for c in columns if c not in ("score", "predicted")]
    likely = 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))))
    return _featured(docs, lexicon, kept, feature).select(*kept, likely.alias("score"), (likely >= threshold).cast("int").alias("predicted"))
