import re
from collections import defaultdict

import numpy as np
from flowrisk.llm import cube_mix

SCHEMA = "doc_id long, text string, source string, size string, taken string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    capped = set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = {s for s in free if t[s] > most * sizes[s] * (1 + 1e-12)}
        if not above:
            return t | {s: most * sizes[s] for s in capped}
        capped |= above


def test_targets_by_weight_with_caps():
    for sizes in ({"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 1, None: 50}, {"x": 7}, {"a": 0, "b": 0}):
        got, want = cube_mix.share_targets(list(sizes.items())), brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_flight_keeps_the_constraints():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 400):
        p, size = rng.random(n), rng.integers(0, 500, n).astype(float)
        x = np.vstack([np.ones(n), size / max(1, size.mean())])
        out = cube_mix.flight(p, x, rng)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert np.allclose(x @ out, x @ p, atol=1e-6)
        assert ((out >= 0) & (out <= 1)).all()


def test_flight_respects_the_probabilities():
    p = np.array([0.2, 0.5, 0.7, 0.6, 0.3, 0.9, 0.8])
    x = np.ones((1, 7))
    mean = np.mean([cube_mix.flight(p, x, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 400)), ["a", "b", "c", "d", None][min(4, int(rng.integers(0, 9)))]) for i in range(1500)]
    rows += [(None, None, "a"), (5, rows[5][1], rows[5][2]), (7, "other text", rows[7][2]), (2000, "x y", "tiny")]
    df = frame(spark, rows)
    got = cube_mix.mix(df, block=64).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["copies"] in (0, 1, 2)
    want = defaultdict(int)
    for _, t, s in rows:
        want[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sizes == want
    assert all(abs(targets[s] - t) < 1e-6 for s, t in brute_targets(sizes).items())
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    again = cube_mix.mix(df.repartition(5), block=64).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in again)


def test_apply_keeps_rows_and_columns(spark):
    rows = [(i, "w " * (i % 50), "ab"[i % 2]) for i in range(300)] + [(1, "w ", "b")] * 3
    out = cube_mix.apply_mix(frame(spark, rows), block=32)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    got = out.collect()
    assert sum(r["taken"] for r in got) == sum(r["taken"] for r in cube_mix.mix(frame(spark, rows), block=32).collect())
    assert all(r["size"] == len((r["text"] or "").split()) and r["taken"] > 0 for r in got)


def test_empty_and_all_empty_texts(spark):
    assert cube_mix.mix(frame(spark, [])).count() == 0
    assert cube_mix.apply_mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in cube_mix.mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]
