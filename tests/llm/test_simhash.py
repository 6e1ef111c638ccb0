import itertools
import re

import numpy as np
import xxhash
from flowrisk.llm import simhash_links

SCHEMA = "doc_id long, text string, fp string, root string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute_fp(text, shingle=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Smallest doc_id reachable, over (doc_id, fp)."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3:
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(fps))]


def texts():
    rng = np.random.default_rng(5)
    vocab = ["w%d" % i for i in range(60)] + ["Élan", "ÀB", " "]
    base = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(1, 400, 40)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(3):
            words = t.split(" ")
            words[int(rng.integers(0, len(words)))] = "zz"
            out.append(" ".join(words))
    return out + ["", None, " \t\n", "one", "one two", "ONE Two", base[0], base[0], "long " * 40_000]


def test_fingerprints(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash_links.fingerprints(frame(spark, rows)).collect()}
    assert got == {i: brute_fp(t) for i, t in rows}


def test_components_of_documents(spark):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts())] + [(None, "one"), (None, "only here no id"), (7, "quite another text")]
    got = simhash_links.classes(frame(spark, rows)).collect()
    want = brute_components([(d, brute_fp(t)) for d, t in rows])
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), str(r["component_id"])) for r in got) == sorted((str(d), brute_fp(t), str(c)) for (d, t), c in zip(rows, want, strict=True))


def test_links_of_dense_fingerprints(spark):
    """A ball of close fingerprints (a hot group) and chains between random ones."""
    rng = np.random.default_rng(2)
    fps = {0}
    for _ in range(600):
        fps.add(sum(1 << int(b) for b in rng.choice(24, int(rng.integers(1, 6)), replace=False)))
    at = int(rng.integers(0, 2**62))
    for _ in range(80):
        at ^= sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        fps.add(at)
    fps |= {int(x) for x in rng.integers(0, 2**63, 100)}
    signed = [(x - 2**64 if x >> 63 else x,) for x in fps]
    edges = simhash_links.links(spark.createDataFrame(signed, "fp long"))
    got = {r["node"]: r["root"] for r in simhash_links.components(edges).collect()}
    order = sorted(signed)
    want = brute_components([(i, x & (2**64 - 1)) for i, (x,) in enumerate(order)])
    groups = {}
    for i, (x,) in enumerate(order):
        groups.setdefault(want[i], set()).add(x)
    mine = {}
    for (x,) in order:
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_forest_by_pairs_and_by_lookups_agree():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 1 << 14, 3000).astype(np.uint64))
    free = (1 << 14) - 1  # 469 ways to change three bits at most: lookups
    assert len(fps) > 469
    a = simhash_links._forest(fps, free, 3)
    assert len(a) == len(fps) - 1  # dense: one component
    far = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    assert simhash_links._forest(far, (1 << 64) - 1, 3) == []


def test_keep_one(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta " * 20
    rows = [(5, t), (3, t), (3, t), (9, "something else entirely here"), (9, "a third text of its own, far away"), (None, t), (None, "lonely words without any id at all"), (1, None), (2, "")]
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in simhash_links.keep_one(frame(spark, rows)).collect())
    assert got == sorted([("3", t), ("9", "something else entirely here"), ("9", "a third text of its own, far away"), ("None", "lonely words without any id at all"), ("1", "")])
    assert simhash_links.keep_one(frame(spark, rows)).columns == ["doc_id", "text", "fp", "root", "component_id"]


def test_empty(spark):
    assert simhash_links.classes(frame(spark, [])).count() == 0
    assert simhash_links.keep_one(frame(spark, [])).count() == 0
