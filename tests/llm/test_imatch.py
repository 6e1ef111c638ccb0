import hashlib
from collections import Counter

import numpy as np
import xxhash
from conftest import SF_CHECK
from flowrisk.llm import imatch
from flowrisk.llm.queries import all_queries

SCHEMA = "doc_id long, text string, fingerprint string, id string, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute_band(texts, low, high):
    df = Counter(w for t in texts for w in set((t or "").lower().split()))
    n = len(texts)
    return sorted(xxhash.xxh64_intdigest(w) for w, k in df.items() if low * n <= k <= max(high * n, 1))


def test_lexicon_is_the_band_of_document_shares(spark):
    texts = ["the a b", "The c", "the d d d", "the e a", None, "", "THE x y z"]
    got = imatch.lexicon(frame(spark, list(enumerate(texts))), 0.25, 0.5)
    assert got.tolist() == brute_band(texts, 0.25, 0.5)
    assert imatch.lexicon(frame(spark, [])).tolist() == []


def test_fingerprint_looks_at_distinct_band_terms_only():
    band = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in "alpha beta gamma delta".split()], np.uint64))
    a = imatch.fingerprint("Alpha beta the gamma", band)
    b = imatch.fingerprint("gamma of BETA beta alpha", band)
    assert a.split(".")[0] == b.split(".")[0] and imatch.likeness(a, b) == 1.0  # the section of the lexicon's terms
    assert a.split(".")[0] != imatch.fingerprint("alpha beta", band).split(".")[0]
    assert [len(x) for x in a.split(".")] == [24 + 16 * imatch.LEVELS * n for n in (imatch.PARTS, imatch.ALL_PARTS)]
    none = imatch.fingerprint("nothing known", band)
    assert int(none.split(".")[0], 16) == 0 and none == imatch.fingerprint("known nothing", band) != imatch.fingerprint("", band)


def test_subsets_hash_their_terms():
    words = [f"w{i}" for i in range(300)]
    band = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))
    section = imatch.fingerprint(" ".join(words[:200]), band).split(".")[0]
    terms = imatch.term_hashes(" ".join(words[:200]))
    assert section[:24] == f"{200:08x}" + hashlib.blake2b(terms.tobytes(), digest_size=8).hexdigest()
    mask = 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & mask
        x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & mask
        return x ^ (x >> 33)

    for part in range(imatch.PARTS):
        want = [0] * imatch.LEVELS
        for t in terms.tolist():
            bits = mix((t + (part + 1) * 0xD1B54A32D192ED03) & mask)
            level = min((bits & -bits).bit_length() - 1, imatch.LEVELS - 1) if bits else imatch.LEVELS - 1
            want[level] = (want[level] + mix(t ^ 0x9E3779B97F4A7C15)) & mask
        at = 24 + 16 * imatch.LEVELS * part
        assert [int(section[at + 16 * k : at + 16 * k + 16], 16) for k in range(imatch.LEVELS)] == want
        assert sum(w != 0 for w in want) > 5


def test_likeness_follows_the_terms_in_common():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(3000)]
    band = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64))
    got = {0.0: [], 0.5: [], 0.9: [], 1.0: []}
    for _ in range(60):
        n = int(rng.integers(20, 800))
        pick = rng.permutation(3000)[: 2 * n]
        for share, xs in got.items():
            k = int(n * share)
            xs.append(imatch.likeness(imatch.fingerprint(" ".join(words[i] for i in pick[:n]), band), imatch.fingerprint(" ".join(words[i] for i in [*pick[:k], *pick[n : 2 * n - k]]), band)))
    mean = {s: float(np.mean(xs)) for s, xs in got.items()}
    assert mean[1.0] == 1.0 and mean[0.0] < 0.02
    for share in (0.5, 0.9):  # k of n terms in common: k of 2 n - k in all
        true = share / (2 - share)
        assert abs(mean[share] - true) < 0.04 and np.mean(np.abs(np.array(got[share]) - true)) < 0.1 and min(got[share]) > 0


def expected(rows):
    """Text, edited text and next text by plain Python, in descending order of ids (none last)."""
    from pyspark.sql import functions as F  # noqa: F401

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out.append((str(d), len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    return sorted(out)


def test_next_documents_across_ranges(spark):
    rng = np.random.default_rng(2)
    ids = [int(x) for x in rng.permutation(np.unique(rng.integers(-500, 10**6, 90)))] + [-(2**63), 2**63 - 1]
    rows = [(d, "é" * int(rng.integers(0, 40)) + f" text {d} " * int(rng.integers(0, 9))) for d in ids] + [(None, "without an id")]
    rows[3], rows[4] = (rows[3][0], None), (rows[4][0], "")
    for n in (1, 4, 30):
        got = imatch.compare_with_next(frame(spark, rows).repartition(5), np.empty(0, np.uint64), buckets=n).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == expected(rows)
    one = imatch.compare_with_next(frame(spark, [(4, "abcdef")]), np.empty(0, np.uint64)).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    assert imatch.compare_with_next(frame(spark, []), np.empty(0, np.uint64)).count() == 0
    same = imatch.compare_with_next(frame(spark, [(1, "x y"), (1, "x y"), (1, "z"), (None, None), (None, None)]), np.empty(0, np.uint64)).collect()
    assert len(same) == 5


def test_hot_and_missing_ids_are_split(spark):
    rows = [(7, f"text {i % 40} é") for i in range(300)] + [(None, f"t {i % 25}") for i in range(200)] + [(i, f"u {i}") for i in range(20, 140)]
    base = frame(spark, rows).selectExpr("doc_id AS id", "xxhash64(text) AS hash", "text")
    at = base.select("id", "hash", imatch._ranges(base, 12).alias("at")).collect()
    assert max(Counter(r["at"] for r in at).values()) < 150
    order = sorted(at, key=lambda r: (r["id"] is None, -(r["id"] or 0), r["hash"]))
    assert [r["at"] for r in order] == sorted(r["at"] for r in at)  # ranges follow the order
    got = imatch.compare_with_next(frame(spark, rows), np.empty(0, np.uint64), buckets=12).collect()
    text = {h: t for h, t in {(r["hash"], r["text"]) for r in base.collect()}}
    want = []
    for i, r in enumerate(order):
        new = imatch.edited(text[r["hash"]], text[order[(i + 1) % len(order)]["hash"]])
        want.append((str(r["id"]), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted(want)


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    got = all_queries()["op10_imatch"](spark, SF_CHECK).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == expected(list(docs.items()))
    by_text = {}
    for r in got:
        assert by_text.setdefault(docs[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == imatch.likeness(r["fingerprint"], r["edited_fingerprint"])  # from the two alone
    after = dict(zip(order := sorted(docs, reverse=True), [*order[1:], order[0]]))
    band = set(imatch.lexicon(spark.read.parquet(f"{SF_CHECK}/documents.parquet")).tolist())
    off, lost = [], 0
    for r in got:
        mine, new = (set(imatch.term_hashes(t or "").tolist()) for t in (docs[r["doc_id"]], imatch.edited(docs[r["doc_id"]] or "", docs[after[r["doc_id"]]] or "")))
        if mine & band and new & band:
            mine, new = mine & band, new & band
        true = len(mine & new) / max(1, len(mine | new))
        off.append(abs(r["near_edited"] - true))
        lost += true >= 0.3 and r["near_edited"] == 0
    assert np.mean(off) < 0.1 and lost <= len(got) // 500
    long = [r for r in got if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9
    assert np.mean([r["near_edited"] for r in long]) > 0.3 > np.mean([r["near_next"] for r in long])


def test_copies_count_once_in_the_lexicon(spark):
    rng = np.random.default_rng(3)
    singles = [" ".join(f"w{i}" for i in rng.permutation(400)[:40]) for _ in range(60)]
    hot = " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"h{i}" for i in range(30))
    rows = list(enumerate([*singles, *[hot] * 30]))
    band = imatch.lexicon(frame(spark, rows).repartition(5), 0.01, 0.2)
    assert band.tolist() == brute_band([*singles, hot], 0.01, 0.2)
    got = [r for r in imatch.compare_with_next(frame(spark, rows), band).collect() if r["doc_id"] >= 61]
    assert len(got) == 29 and all(int(r["fingerprint"][:8], 16) for r in got)


def test_more_copied_texts_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BROADCAST_COPIES", 0)
    texts = ["a b", "a b", "a b", "a c", None, ""]
    docs = frame(spark, list(enumerate(texts)))
    got = imatch.document_frequencies(docs, imatch.copy_counts(docs)).collect()
    assert {r["term"] % 2**64: r["df"] for r in got} == {xxhash.xxh64_intdigest(w): n for w, n in {"a": 2, "b": 1, "c": 1}.items()}


def test_likeness_without_lexicon_terms_follows_the_common_terms(spark):
    band = np.sort(np.array([xxhash.xxh64_intdigest(w) for w in ("known", "other")], np.uint64))
    text = " ".join(f"w{i}" for i in range(300))
    near = imatch.edited(text, "x" * 50 + " y" * 100)
    assert imatch.likeness(imatch.fingerprint(text, band), imatch.fingerprint(near, band)) > 0.2
    rows = [(2, text), (1, "known other " + " ".join(f"v{i}" for i in range(300)))]
    got = {r["doc_id"]: r for r in imatch.compare_with_next(frame(spark, rows), band).collect()}
    assert int(got[2]["fingerprint"][:8], 16) == 0 < int(got[2]["edited_fingerprint"][:8], 16)
    assert got[2]["near_edited"] > 0.1 > got[2]["near_next"]
