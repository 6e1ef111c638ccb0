import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_CHECK
from flowrisk.llm import kn_langid
from flowrisk.llm.queries import all_queries

SCHEMA = "doc_id long, text string, lang string, lang_pred string, rejected string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)


def symbols(text):
    """The characters of a model: lower-case letters and single spaces."""
    out = []
    for c in text or "":
        s = c.lower()[0] if c.isalpha() else " "
        if not (s == " " and (not out or out[-1] == " ")):
            out.append(s)
    return out


class BruteModel:
    """Interpolated Kneser-Ney by dictionaries, order 4, start symbols before a text."""

    def __init__(self, texts):
        top = Counter()
        for t in texts:
            s = ["\0"] * 3 + symbols(t)
            top.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        self.levels = [top]
        for _ in range(3):
            self.levels.append(Counter(g[1:] for g in self.levels[-1]))
        self.totals, self.kinds, self.d = [], [], []
        for level in self.levels:
            total, kinds = defaultdict(int), defaultdict(int)
            for g, n in level.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            ones, twos = sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
            self.d.append(min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones and twos else 0.75)
            self.totals.append(total)
            self.kinds.append(kinds)

    def p(self, gram):
        p = 1 / (len(self.levels[3]) + 1)
        for k in (3, 2, 1, 0):
            g = gram[k:]
            total = self.totals[k].get(g[:-1])
            if total:
                p = max(self.levels[k].get(g, 0) - self.d[k], 0) / total + self.d[k] * self.kinds[k][g[:-1]] / total * p
        return p

    def cross_entropy(self, text):
        s = ["\0"] * 3 + symbols(text)
        return -sum(math.log2(self.p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / max(1, len(s) - 3)


TRAIN = [
    (1, "the cat sat on the mat, and the dog ran to the hat", "en"),
    (2, "THIS is the thing that they thought of; nothing else there", "en"),
    (3, "der hund und die katze sind nicht auf dem dach", "de"),
    (4, "Über die Brücke geht ein Mädchen, schön und nett", "de"),
    (5, "le chat est à côté de la maison, près du château", "fr"),
    (6, None, "fr"),
    (7, "no label here", None),
]


def test_cross_entropies_equal_brute_force(spark):
    model = kn_langid.train(frame(spark, TRAIN))
    assert model.langs == ["de", "en", "fr"]
    brute = [BruteModel([t for _, t, x in TRAIN if x == lang and t]) for lang in model.langs]
    batch = ["the hund", "", "château 12 près", "\0x\0", "a", "ÄÖÜ   thing -- of\n", None or "zzz qqq", "the cat sat on the mat"] * 2
    ce, n, letters = model.cross_entropies(batch)
    for i, t in enumerate(batch):
        assert n[i] == len(symbols(t))
        assert letters[i] == any(c.isalpha() for c in t)
        if n[i]:
            assert np.allclose(ce[i], [b.cross_entropy(t) for b in brute], rtol=1e-9)


def test_letters_are_those_of_all_of_unicode(spark):
    model = kn_langid.train(frame(spark, TRAIN))
    batch = ["\u0301\u0300 \u0301", "\U00030001\U00030002", "12\u0301", "a\u0301", "\u2160", "日本"]
    langs, score, rejected = model.predict(batch)
    for t, x, s in zip(batch, langs, score):
        assert (x == "und") == (s == 0) == (not any(c.isalpha() for c in t)), t


def test_counts_are_those_of_all_rows(spark):
    many = [(i, t, x) for i, (_, t, x) in enumerate(TRAIN * 30)]
    one = {(r["lang"], r["gram"]): r["n"] for r in kn_langid.count_ngrams(frame(spark, TRAIN)).collect()}
    all_ = {(r["lang"], r["gram"]): r["n"] for r in kn_langid.count_ngrams(frame(spark, many).repartition(7)).collect()}
    assert all_ == {k: 30 * n for k, n in one.items()}


def test_model_size_is_bounded(spark):
    model = kn_langid.train(frame(spark, TRAIN), max_ngrams=30)
    assert sum(len(m.levels[0][0]) for m in model.models) <= 30


def test_edge_rows(spark):
    model = kn_langid.train(frame(spark, TRAIN))
    rows = [(1, None, "en"), (2, "", None), (3, "12 34 !", "de"), (None, "the dog", None), (5, "the " * 300_000, None), (6, "und", "x"), (6, "und", "x")]
    got = {r["doc_id"]: r for r in kn_langid.detect(frame(spark, rows), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[None]["lang_pred"] == "en" and got[5]["lang_pred"] == "en" and 0 <= got[5]["score"] <= 1
    assert kn_langid.detect(frame(spark, rows), model).count() == len(rows)
    assert kn_langid.detect(frame(spark, rows), model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    empty = kn_langid.train(frame(spark, []))
    assert [r["lang_pred"] for r in kn_langid.detect(frame(spark, rows), empty).collect()] == ["und"] * len(rows)
    assert kn_langid.detect(frame(spark, []), model).count() == 0


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang", "text").toPandas()
    got = all_queries()["op3_language_id"](spark, SF_CHECK).toPandas()
    return docs.merge(got, on="doc_id")


def test_held_out_accuracy(predicted):
    held = predicted[predicted["held_out"]]
    assert 0.2 < len(held) / len(predicted) < 0.3
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.98


def test_rejection_keeps_clean_documents_and_drops_noise(spark, predicted):
    assert predicted["rejected"].mean() <= 0.01
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    rng = np.random.default_rng(0)
    noise = ["".join(chr(int(c)) for c in rng.integers(0x3041, 0x3090, 300)), "".join(rng.choice(list("qxzjkvw"), 400)), "".join(rng.choice(list("абвгдежзик "), 300))]
    got = kn_langid.detect(frame(spark, [(i, t, None) for i, t in enumerate(noise)]), kn_langid.train(docs)).collect()
    assert all(r["rejected"] for r in got)


def test_rare_ngrams_stay_at_any_corpus_size(spark):
    rows = [(i, t, x) for i, (_, t, x) in enumerate(TRAIN * 40)] + [(-1, "xylophone", "en")]
    model = kn_langid.train(frame(spark, rows), max_ngrams=1000)
    brute = BruteModel([t for _, t, x in rows if x == "en" and t])
    assert len(model.models[1].levels[0][0]) == len(brute.levels[0])
    ce, _, _ = model.cross_entropies(["xylophone that"])
    assert np.isclose(ce[0, 1], brute.cross_entropy("xylophone that"), rtol=1e-9)


def test_model_in_blocks_equals_the_whole(spark):
    docs = frame(spark, TRAIN)
    whole, split = kn_langid.train(docs), kn_langid.train(docs, max_ngrams=30)
    assert len(split.blocks) > 3 and not split.models and split.langs == whole.langs
    total = 0
    for block in split.blocks:
        held = [m.levels[0][0] for m in block.value]
        n = sum(map(len, held))
        total += n
        assert n <= 30 or len({int(c) for k in held for c in kn_langid._middle(k)}) == 1
    assert total == sum(len(m.levels[0][0]) for m in whole.models)
    batch = ["the hund", "", "château 12 près", "zzz qqq", "the cat sat on the mat"]
    for a, b in zip(whole.cross_entropies(batch), split.cross_entropies(batch), strict=True):
        assert np.allclose(a, b, rtol=1e-12)
    rows = frame(spark, [(i, t, None) for i, t in enumerate(batch)])
    a, b = (sorted(kn_langid.detect(rows, m).select("doc_id", "lang_pred", "rejected", "score").collect()) for m in (whole, split))
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b])


def test_calibration_is_over_all_rows(spark):
    """Median and limit of every language are those of all its rows, not of a sample."""
    rng = np.random.default_rng(3)
    rows = [(int(i), float(v), int(n)) for i, v, n in zip(rng.integers(0, 2, 12_000), np.concatenate([rng.normal(3, 0.3, 9_000), np.full(3_000, 2.5)]), rng.integers(1, 900, 12_000), strict=True)]
    rows += [(2, 1.0, 5)] * 5
    model = kn_langid.LangModel({}, ["a", "b", "c"])
    model.calibrate(spark.createDataFrame(rows, "i long, ce double, n long"))
    at = np.array(rows)
    for i in range(2):
        own = at[at[:, 0] == i]
        mean = np.median(own[:, 1])
        limit = 1.5 * max(np.quantile((own[:, 1] - mean) * np.sqrt(np.minimum(own[:, 2], 400)), 0.999), 1.0)
        assert np.isclose(model.mean[i], mean, rtol=1e-12) and np.isclose(model.limit[i], limit, rtol=1e-12)
    assert model.mean[2] == 0 and np.isinf(model.limit[2])


@pytest.mark.parametrize("q", [0.0, 0.5, 0.999, 1.0])
def test_quantiles(spark, q, monkeypatch):
    monkeypatch.setattr(kn_langid, "FETCHED", 1)
    rng = np.random.default_rng(4)
    values = [(0, float(v)) for v in rng.normal(0, 5, 2_000)] + [(7, -2.0)] * 30 + [(7, -1.5)] * 3
    got = kn_langid.quantiles(spark.createDataFrame(values, "i long, v double"), q)
    for i in (0, 7):
        assert np.isclose(got[i], np.quantile([v for k, v in values if k == i], q), atol=1e-9)
