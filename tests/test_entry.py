"""Driver contract: entry runs, every oracle key is a query, and a sample of
oracle comparisons holds at sf0.001."""

import duckdb

import __spark_entry__ as E
from conftest import SF_CHECK, SF_SMALL

TABLES = "events embeddings".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"alert_id", "attack_type", "risk_score", "expires_at"} <= set(df.columns)


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_sample_oracles_match(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    names = ["alerts", "attack_breakdown", "raw_upsert", "attacker_profiles", "validate_events", "predictions_page",
             "null_counts", "weighted_f1"]
    for name in names:
        s = E.queries()[name](spark, SF_SMALL)
        d = con.sql(E.oracle_sql()[name]).df()
        assert sorted(s.columns) == sorted(d.columns), name
        assert s.count() == len(d), name


def test_queries_run_in_utc_whatever_the_session_zone(spark):
    q = E.queries()["timeline"]
    want = sorted(tuple(r) for r in q(spark, SF_CHECK).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(tuple(r) for r in q(spark, SF_CHECK).collect())
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want and len(got) == 24
