import numpy as np
import pytest
from flowrisk.llm import decontaminate

DOCS = "doc_id long, text string, matches string, item_id string"
ITEMS = "item_id long, text string, doc_id string"
VOCAB = "the of and lorem ipsum dolor sit amet elit sed quam nulla über façade ñandú tempor magna porta vitae rutrum cursus mattis".split()


def brute(item, text):
    """Least edit distance of the item to a passage: plain dynamic programme, free ends."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def words(rng, n):
    return " ".join(rng.choice(VOCAB, n))


def edited(rng, text, k):
    s = list(text)
    for _ in range(k):
        at, kind = int(rng.integers(0, len(s))), int(rng.integers(0, 3))
        if kind == 0:
            s[at] = "x"
        elif kind == 1:
            s.insert(at, "y")
        else:
            del s[at]
    return "".join(s)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    items = [(i, words(rng, int(rng.integers(15, 60)))) for i in range(25)]
    docs = []
    for i in range(120):
        text = words(rng, int(rng.integers(5, 200)))
        if i % 2:
            item = items[int(rng.integers(0, 25))][1]
            passage = edited(rng, item, int(rng.integers(0, len(item) // 7)))
            text = [f"{text} {passage} {words(rng, 30)}", f"{passage} {text}", f"{text}\n{passage.upper()}"][i % 3]
        docs.append((i, text))
    return docs, items


def test_myers_equals_dynamic_programme():
    rng = np.random.default_rng(0)
    for _ in range(60):
        item, text = words(rng, 6), words(rng, int(rng.integers(0, 25)))
        got = decontaminate.edit_match(item, text, 10_000)
        want = brute(item, text)
        assert got[0] == want
        assert brute(item, text[got[1] : got[2]]) == want


def test_matches_equal_brute_force(spark, data):
    docs, items = data
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_matches(spark.createDataFrame([(*d, "a", "b") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS)).collect()}
    want = {}
    for d, text in docs:
        t = decontaminate.normalise(text)
        for i, item in items:
            p = decontaminate.normalise(item)
            if found := decontaminate.edit_match(p, t, int(0.1 * len(p))):  # every pair; equal to brute(), see above
                want[d, i] = found[0]
    assert len(want) > 30
    found = {k: r["n_edits"] for k, r in got.items()}
    assert set(found) <= set(want)  # verified exactly: nothing false
    assert len(found) >= 0.97 * len(want)  # the target recall
    assert all(n == want[k] for k, n in found.items())
    texts = {d: decontaminate.normalise(t) for d, t in docs}
    named = dict(items)
    for (d, i), r in got.items():
        assert brute(decontaminate.normalise(named[i]), texts[d][r["start"] : r["end"]]) == r["n_edits"]


def test_calibrated_recall(data):
    items = decontaminate.Items(*zip(*data[1], strict=True))
    assert items.recall >= 0.99
    # unrelated strings seldom agree
    rng = np.random.default_rng(9)
    other = [decontaminate.points(words(rng, 40)) for _ in items.texts]
    same = (items.embedding.bands(other, items.n) == items.own).all(axis=3).any(axis=(1, 2))
    assert same.mean() < 0.6
    # by the table of bands: few unrelated windows of an item's size have a candidate (0.25 % were measured on the
    # real tables; these are words of one small vocabulary, less unlike than texts are)
    items.exact[:] = False
    windows = [(words(rng, 40 + int(n) // 4), i) for i, n in enumerate(items.n)] * 8
    near = items._near([t for t, _ in windows], [(t, i, int(rng.integers(0, 9))) for t, (_, i) in enumerate(windows)])
    assert len(near) <= 0.05 * len(windows)


def test_trials_follow_from_the_text_alone(data):
    """Trials run in tasks give the same calibration, whatever rows a task holds."""
    ids, named = zip(*data[1], strict=True)
    whole = decontaminate.Items(ids, named)
    alone = {t: decontaminate.Items([0], [t], recall=0.0).trials()[0].tobytes() for t in whole.texts}
    split = decontaminate.Items(ids, named, hits=alone)
    assert np.mean(split.exact == whole.exact) >= 0.9 and abs(len(split.embedding.seeds) - len(whole.embedding.seeds)) <= 4


def test_embedding_walks_by_definition():
    e = decontaminate.Embedding(2)
    s = decontaminate.points("abcab cab")
    got = e.bands([s], np.array([len(s)]))[0].reshape(2, -1)
    for w in range(2):
        want = np.minimum((e.at[w] * len(s)).astype(int), 2 * len(s))
        i, steps = 0, []
        for j in range(2 * len(s) + 1):
            c = int(s[i]) if i < len(s) else 0
            steps.append(c)
            key = (c * 0x9E3779B97F4A7C15 + int(e.seeds[w]) + j * 0x632BE5AB) % 2**64
            i += int(decontaminate.mix64(np.array([key], np.uint64))[0]) >> 63 if i < len(s) else 0
        assert got[w].tolist() == [steps[j] for j in want]


def test_blocks_of_items_give_the_same(spark, data):
    docs, items = data
    d, i = spark.createDataFrame([(*d, "a", "b") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS)
    one = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_matches(d, i).collect()}
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_matches(d, i, block_chars=1500).collect()}
    assert len(one ^ blocks) <= 1  # the walks are calibrated by block
    kept = decontaminate.clean(d, i, block_chars=1500)
    assert kept.columns == ["doc_id", "text", "matches", "item_id"]
    assert {r["doc_id"] for r in kept.collect()} == {x for x, _ in docs} - {x for x, _ in blocks}


def test_edge_rows(spark):
    item = "a benchmark question that is long enough to be told from other text, is it not so"
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, f"x {item} y"), (5, "w " * 200_000 + item + " v" * 1000), (6, "short"), (7, item[:40])]
    items = [(1, item), (2, item.upper()), (3, None), (4, ""), (None, "another item without an id, which is found too by its text")]
    d, i = spark.createDataFrame([(*r, "a", "b") for r in docs], DOCS), spark.createDataFrame([(*r, "z") for r in items], ITEMS)
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontaminate.find_matches(d, i).collect())
    assert got == sorted([("3", "1"), ("3", "2"), ("3", "1"), ("3", "2"), ("None", "1"), ("None", "2"), ("5", "1"), ("5", "2")])
    assert sorted(str(r["doc_id"]) for r in decontaminate.clean(d, i).collect()) == ["1", "2", "6", "7"]
    assert decontaminate.find_matches(d.limit(0), i).count() == 0
    assert decontaminate.find_matches(d, i.limit(0)).count() == 0
    assert decontaminate.clean(d, i.limit(0)).count() == len(docs)


def test_short_items_match_exactly(spark):
    d, i = spark.createDataFrame([(1, "so be it", "a", "b"), (2, "sobeit", "a", "b")], DOCS), spark.createDataFrame([(1, "be it", "z")], ITEMS)
    assert [r["doc_id"] for r in decontaminate.find_matches(d, i).collect()] == [1]


def test_items_lost_in_calibration_are_verified_exactly(data, monkeypatch):
    """With a single walk most random edits are lost: every item still reaches the target."""
    monkeypatch.setattr(decontaminate, "MAX_WALKS", 1)
    items = decontaminate.Items(*zip(*data[1], strict=True))
    assert items.exact.any() and items.recall >= 0.99
    rng = np.random.default_rng(11)
    for i in np.nonzero(items.exact)[0]:
        text = f"{words(rng, 20)} {edited(rng, items.texts[i], int(items.d[i]))} {words(rng, 20)}"
        if decontaminate.edit_match(items.texts[i], decontaminate.normalise(text), int(items.d[i])):
            assert i in {found[1] for found in items.search([text])}
