import numpy as np
import pytest
from flowrisk.llm import toxicity
from flowrisk.llm.queries import all_queries
from flowrisk.llm.toxicity import Lexicon, fold

SF_LARGE = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, score string, toxic string, x string"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS)


@pytest.mark.parametrize("text", ["idiot", "IDIOT", "1d10t", "ıdіоt", "i​diot", "ídïöt", "ｉｄｉｏｔ", "id!ot".replace("!", "i"), "«Idiot»,"])
def test_folding(text):
    assert fold(text) == ["idiot"]


def brute(lex, words):
    """Matches by comparing every word; exception phrases cover what lies inside."""
    covered = set()
    for e in lex.exceptions:
        p = e.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                covered |= set(range(i, i + len(p)))
    hits = [lex.weights[w] for i, w in enumerate(words) if w in lex.weights and i not in covered]
    return [np.log1p(sum(hits)), sum(hits) / np.sqrt(max(1, len(words))), sum(set(hits))]


def test_matches_whole_words_outside_exceptions():
    lex = Lexicon({"bad": 2.0, "worse": 3.0, "ba": 5.0}, ["not bad", "bad luck bad"])
    rng = np.random.default_rng(0)
    automaton = lex.automaton()
    for _ in range(200):
        words = list(rng.choice(["bad", "worse", "ba", "not", "luck", "badly", "x"], int(rng.integers(0, 30))))
        want = brute(lex, words)
        assert np.allclose(lex.features(words, automaton), want if words else [0, 0, 0])


def train_rows():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        words = list(rng.choice(vocab, int(rng.integers(5, 60))))
        toxic = i % 4 == 0
        if toxic:
            words[int(rng.integers(0, len(words)))] = str(rng.choice(["idiot", "1diot", "trash"]))
        elif i % 12 == 1:
            at = int(rng.integers(0, len(words)))
            words[at : at + 1] = ["white", "trash"]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_learns_words_and_exceptions(spark):
    docs, labels = train_rows()
    lex = toxicity.train(frame(spark, docs), spark.createDataFrame(labels + labels[:50] + [(None, 1, 1), (5, 1, None)], LABELS))
    assert set(lex.weights) == {"idiot", "trash"}
    assert "white trash" in lex.exceptions
    rows = [(1, "w1 w2 trash w3"), (2, "w1 white trash w3"), (3, None), (4, ""), (5, "w5 " * 100_000 + "w9"), (None, "you IDI0T")]
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, rows), lex, ["doc_id", "x"]).collect()}
    assert got[1]["predicted"] == got[None]["predicted"] == 1
    assert all(got[i]["predicted"] == 0 and 0 <= got[i]["score"] < 0.3 for i in (2, 3, 4, 5))
    assert got[1]["x"] == "c"


def test_sample_is_bounded_and_one_class_is_defined(spark):
    docs, labels = train_rows()
    lex = toxicity.train(frame(spark, docs), spark.createDataFrame(labels, LABELS), sample_rows=40)
    assert len(lex.weights) <= 5
    none = toxicity.train(frame(spark, docs), spark.createDataFrame(labels[1:4], LABELS))
    assert all(r["score"] < 1e-6 for r in toxicity.score(frame(spark, docs[:5]), none, ["doc_id"]).collect())
    empty = toxicity.train(frame(spark, []), spark.createDataFrame([], LABELS))
    assert toxicity.score(frame(spark, docs), empty, ["doc_id"]).where("predicted = 1").count() == 0
    assert toxicity.score(frame(spark, []), lex, ["doc_id"]).count() == 0


def test_held_out(spark):
    got = all_queries()["op4_toxicity"](spark, SF_LARGE).toPandas()
    labels = spark.read.parquet(f"{SF_LARGE}/labels.parquet").select("doc_id", "toxic").toPandas()
    assert len(got) == 10_000 and got["score"].between(0, 1).all()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    hit = held["predicted"] == 1
    assert held[hit]["toxic"].mean() >= 0.9
    assert held[held["toxic"] == 1]["predicted"].mean() >= 0.8
