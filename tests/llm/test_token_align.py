import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL
from flowrisk.llm import token_align as T
from flowrisk.llm.queries import all_queries


def load():
    with open(T.BYTE_VOCABULARY, "rb") as f, open(T.PIECE_VOCABULARY, "rb") as g:
        return T.Encoders(f.read(), g.read())


@pytest.fixture(scope="module")
def whole():
    """Whole texts through the libraries, without stretches."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(T.BYTE_VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=T.PIECE_VOCABULARY)
    enc = load()
    return lambda t: ([(i, enc.a.spelled[i]) for i in a.encode(" " + t, add_special_tokens=False).ids], [(i, enc.b.spelled[i]) for i in b.encode(t)])


def plainly(whole, text):
    """(n_a, n_b, groups, links) by two pointers."""
    if not text:
        return 0, 0, "", Counter()
    a, b = whole(text)
    raw = (" " + text).encode()
    if b"".join(s for _, s in a) != raw or b"".join(s for _, s in b) != raw:
        return 0, 0, "", Counter()
    groups, links = [], Counter()
    i = j = ends_a = ends_b = 0
    ga, gb = [], []
    while i < len(a) or j < len(b):
        if ends_a <= ends_b and i < len(a) and (ends_a < ends_b or not ga):
            ga.append(a[i][0])
            ends_a += len(a[i][1])
            i += 1
        else:
            gb.append(b[j][0])
            ends_b += len(b[j][1])
            j += 1
        if ends_a == ends_b:
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            ga, gb = [], []
    x = 0
    spans_a = []
    for t, s in a:
        spans_a.append((x, x + len(s), t))
        x += len(s)
    x, k = 0, 0
    for t, s in b:
        lo, hi = x, x + len(s)
        x = hi
        while spans_a[k][1] <= lo:
            k += 1
        m = k
        while m < len(spans_a) and spans_a[m][0] < hi:
            links[spans_a[m][2], t] += 1
            m += 1
    return len(a), len(b), ";".join(groups), links


def expected(whole, docs):
    """Rows of the query for (doc_id, text) pairs."""
    seen = [(d, *plainly(whole, t)) for d, t in docs]
    counts = Counter(p for *_, links in seen for p in links)
    highest = {}
    for (a, _), n in counts.items():
        highest[a] = max(highest.get(a, 0), n)
    out = []
    for d, n_a, n_b, groups, links in seen:
        best = sum(k for p, k in links.items() if counts[p] == highest[p[0]])
        out.append((d, n_a, n_b, len(groups.split(";")) if groups else 0, sum(links.values()), best, sum(counts[p] * k for p, k in links.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return out


def rows_of(spark, df, name):
    from pyspark.sql import functions as F

    made = T.written(spark, T.aligned(df), name)
    full = T.with_counts(made, T.piece_count()).withColumn("sha", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(""))
    return [tuple(r) for r in full.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect()]


def test_stretches_encode_as_whole_texts(whole):
    enc = load()
    assert enc.splits
    rng = np.random.default_rng(5)
    alphabet = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "\u0085", "'s", "it's", "12", "3", "é", "日本", "😀", "▁", ".", "...", "-", "_", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "the", "of", "tokenization", "a", "I", "don't", "\r\n", "​", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, int(rng.integers(1, 16))))
        if not text:
            continue
        places = enc.known(enc.stretches(text))
        a, b = whole(text)
        assert enc.a.tokens(places)[0].tolist() == [i for i, _ in a], repr(text)
        assert enc.b.tokens(places)[0].tolist() == [i for i, _ in b], repr(text)
        raw = (" " + text).encode()
        assert all(enc.valid[places]) == (b"".join(s for _, s in a) == raw == b"".join(s for _, s in b)), repr(text)


@pytest.mark.parametrize("window", [8, 200, 1 << 18])
def test_rows(spark, whole, window):
    rng = np.random.default_rng(window)
    words = ["the", "tokenizer", "überall", "日本語", "😀", "it's", "  ", "\n\n", "12345", "x" * 30, "<|endoftext|>", "and"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 40))))) for i in range(30)]
    docs += [(30, None), (31, ""), (32, " "), (33, "▁ a"), (34, "words ▁ and a"), (None, "no id the"), (35, "tie tie"), (36, "tie tie"), (36, "tie tie"), (37, "a long text of words " * (20 if window == 8 else 3000)), (38, "y" * 3000)]
    d = spark.createDataFrame([(*r, "g", 5) for r in docs], "doc_id int, text string, groups string, row int")
    task_window = T.WINDOW
    T.WINDOW = window  # of this process; tasks keep theirs, so the windows are tested below without Spark
    try:
        enc = load()
        made = T.align_texts(enc, [t or "" for _, t in docs], T.group_words(enc))
    finally:
        T.WINDOW = task_window
    size = len(enc.b.spelled)
    for i, ((_, text), pairs, times) in enumerate(zip(docs, *[x.to_pylist() for x in made.links()], strict=True)):
        n_a, n_b, groups, links = plainly(whole, text)
        assert [made.counts[c][i] for c in ("n_a", "n_b", "n_links")] == [n_a, n_b, sum(links.values())], text
        assert "".join(made.groups[i])[:-1] == groups
        assert {(p // size, p % size): k for p, k in zip(pairs, times, strict=True)} == dict(links)
    if window == 200:
        key = lambda r: tuple(map(str, r))
        assert sorted(rows_of(spark, d, "t-align"), key=key) == sorted(expected(whole, docs), key=key)
        assert rows_of(spark, d.limit(0), "t-align") == []


def test_query(spark, whole):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in all_queries()["op13_token_align"](spark, SF_SMALL).collect())
    assert got == sorted(expected(whole, docs))


def test_a_stretch_is_aligned_once(monkeypatch):
    """Texts of known stretches cost no alignment; that of new ones covers these only."""
    enc, aligned = load(), []
    overlaps = T.overlaps

    def counted(a, b):
        aligned.append(len(a))
        return overlaps(a, b)

    monkeypatch.setattr(T, "overlaps", counted)
    words = T.group_words(enc)
    first = T.align_texts(enc, ["the words of a text " * 50, "words"], words)
    again = T.align_texts(enc, ["the words of a text " * 50, "words"], words)
    assert sum(aligned) < 20
    assert first.groups == again.groups and first.links() == again.links()
