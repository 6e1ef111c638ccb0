import corpus_pipeline
import pytest
from conftest import SF_CHECK
from flowrisk.llm import cube_mix, decontaminate, kn_langid, simhash_links, suffix_dedup
from test_cube_mix import brute_targets
from test_simhash import brute_components, brute_fp
from test_suffix_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output over the small tables."""
    docs, out = spark.read.parquet(f"{SF_CHECK}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF_CHECK).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((name, docs, made))
        docs = made
    return {n: (a, b) for n, a, b in out}


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns(stages):
    for name, (_, made) in stages.items():
        assert made.columns[:5] == COLUMNS
        assert name == "mixing" or made.columns == COLUMNS


def test_language_stage_drops_what_the_operator_rejects(spark, stages):
    docs, made = stages["language_id"]
    found = kn_langid.detect(docs, kn_langid.train(docs.select("doc_id", "text", "lang")))
    assert set(rows(made)) == {r["doc_id"] for r in found.where("not rejected").collect()}
    assert made.count() >= 0.99 * docs.count()


def test_near_dedup_stage_keeps_one_of_each_brute_component(stages):
    before, after = (rows(x) for x in stages["near_dedup"])
    ids = sorted(before)
    component = brute_components([(d, brute_fp(before[d]["text"])) for d in ids])
    assert set(after) == set(component) == {d for d, c in zip(ids, component, strict=True) if d == c}


def test_substring_stage_equals_brute_force(stages):
    before, after = (rows(x) for x in stages["substring_dedup"])
    got = {d: r["text"] for d, r in after.items()}
    want = {x[0]: x for x in brute([(d, r["text"]) for d, r in before.items()])}
    for d, r in before.items():
        _, n, removed, _, _ = want[str(d)]
        if removed == 0:
            assert got[d] == r["text"]
        elif removed == n:
            assert d not in got
        else:
            assert n - removed - 6 * len(r["text"]) <= len((got.get(d) or "").encode()) <= n - removed
    assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if want[str(d)][2])


def test_decontamination_stage_drops_the_matching_documents(spark, stages):
    docs, made = stages["decontamination"]
    found = {r["doc_id"] for r in decontaminate.find_matches(docs, spark.read.parquet(f"{SF_CHECK}/benchmark.parquet")).collect()}
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()]
    whole = {d for d, r in rows(docs).items() if any(i in decontaminate.normalise(r["text"]) for i in items)}
    assert whole <= found
    assert set(rows(made)) == set(rows(docs)) - found


def test_mixing_stage_meets_its_targets(stages):
    docs, made = stages["mixing"]
    sizes, taken = {}, {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    for r in made.collect():
        assert 0 < r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 1


def test_run_gives_the_stages_rows(spark, stages):
    assert sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, SF_CHECK).collect()) == sorted((r["doc_id"], r["taken"]) for r in stages["mixing"][1].collect())


def test_stages_take_null_and_empty_rows(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, "the " * 5000, "en", None, 20000), (2, "the " * 5000, "en", None, 20000), (3, "of the and to the", "en", "s", 17)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            got = stage(spark, docs, SF_CHECK)
            assert got.columns[:5] == COLUMNS and got.count() <= 5, name


def test_operators_ignore_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").limit(50)
    clash = docs.selectExpr("*", "'x' as size", "'x' as taken", "'x' as kept", "'x' as batch", "'x' as fp", "'x' as matches", "'x' as score", "'x' as row_id")
    assert suffix_dedup.cut(clash).columns == clash.columns
    assert simhash_links.keep_one(clash).columns == clash.columns
    assert decontaminate.clean(clash, spark.read.parquet(f"{SF_CHECK}/benchmark.parquet")).columns == clash.columns
    assert cube_mix.mix(clash).count() == 50
