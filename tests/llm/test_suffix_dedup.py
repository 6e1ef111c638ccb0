import hashlib

import numpy as np
import pandas as pd
import pytest
from flowrisk.llm import suffix_dedup

SCHEMA = "doc_id long, text string, kept string, id string, batch string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of every row."""
    ids = [float("inf") if d is None else d for d, _ in rows]
    data = [(t or "").encode() for _, t in rows]
    first = {}
    for d, b in zip(ids, data, strict=True):
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], d), d)
    out = []
    for (d, _), own, b in zip(rows, ids, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < own:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[1:] > gone[:-1]).sum() + gone[0]) if len(gone) else 0
        out.append((str(d), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(seed, n=60):
    rng = np.random.default_rng(seed)
    vocab = ["la", "élu", "the", "ing", "ñandú", "of", "xx", "\n", "  "]
    passages = [" ".join(rng.choice(vocab, int(k))) for k in rng.integers(5, 60, 8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            parts.append(passages[int(rng.integers(0, 8))] if rng.random() < 0.5 else " ".join(rng.choice(vocab, int(rng.integers(1, 80)))))
        out.append((int(rng.integers(0, 80)), rng.choice(["", "|", " "]).join(parts)))
    out += [(3, "a" * 400), (8, "a" * 120 + "b" + "a" * 60), (99, None), (98, ""), (None, passages[0] * 3), (None, passages[0] * 3), out[0], out[0], (1000, out[1][1] + "!")]
    out += [(2000, "x" * 49 + "y"), (2001, "x" * 49 + "y"), (2002, "x" * 49 + "z"), (2003, "\0" * 80 + "q"), (2004, "q" + "\0" * 70)]
    return out


def checked(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 20_000), (3, 3)])
def test_against_brute_force(spark, seed, hot):
    rows = rows_of(seed)
    assert checked(suffix_dedup.removed(frame(spark, rows), hot=hot)) == brute(rows)


def test_small_batches_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 50)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 200)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 2)
    rows = rows_of(4, 90)
    assert checked(suffix_dedup.removed(frame(spark, rows), hot=6)) == brute(rows)


def test_rows_of_a_batch_arrive_in_any_order():
    """A shuffle that is read twice gives a batch's rows in another order; no text may get another's cuts."""
    rows = [(9 if d is None else d, t) for d, t in rows_of(5)]
    frame = pd.DataFrame({"id": [d for d, _ in rows], "text": [(t or "").encode() for _, t in rows], "rest": [d for d, _ in rows], "batch": 0})
    again = frame.sample(frac=1, random_state=1).reset_index(drop=True)
    plan = suffix_dedup.Plan(50, 16, 20_000, 1)
    reports = plan.compare(plan.strings(frame, plan.repeated(plan.anchors(frame))))
    got = plan.remove(again, reports)
    assert sorted((str(r.rest), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()) == brute(rows)


def test_runs_cover_every_string_once():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 49, 50, 51, 300, 0, 120])
    data = rng.integers(97, 100, sizes.sum()).astype(np.uint8)
    low, doc, start, n, _ = suffix_dedup.runs(data, sizes, 50, 16)
    ends = np.cumsum(sizes)
    got = sorted((int(d), int(s + k)) for d, s, m in zip(doc, start, n, strict=True) for k in range(m))
    assert got == [(d, ends[d] - sizes[d] + i) for d in range(len(sizes)) for i in range(max(0, sizes[d] - 49))]
    grams = suffix_dedup.gram_hashes(data, 16)
    assert all(low[j] == grams[start[j] + k : start[j] + k + 35].min() for j in range(len(low)) for k in range(n[j]))


def test_multikey_order_sorts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order = suffix_dedup.multikey_order(keys)
    assert [tuple(k) for k in keys[order]] == sorted(map(tuple, keys))


def test_cut_keeps_columns_and_drops_empty(spark):
    t = "é" * 60
    rows = [(1, t), (2, t), (3, "a" + t + "b"), (4, None), (5, ""), (6, "short")]
    got = sorted((r["doc_id"], r["text"]) for r in suffix_dedup.cut(frame(spark, rows)).collect())
    assert got == [(1, t), (3, "ab"), (4, None), (5, ""), (6, "short")]
    assert suffix_dedup.cut(frame(spark, rows)).columns == ["doc_id", "text", "kept", "id", "batch"]


def test_empty(spark):
    assert suffix_dedup.removed(frame(spark, [])).count() == 0
    assert suffix_dedup.removed(frame(spark, [(1, None), (2, "")])).count() == 2
