"""Registered queries of the operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.llm import chat_format, cube_mix, decontaminate, fim, html_text, imatch, kn_langid, secret_scan, simhash_links, suffix_dedup, token_align, token_counts, toxicity
from flowrisk.llm.common import split_of, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
HELD_OUT = 2


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: the best passage of each document and item."""
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: sizes, targets and words taken."""
    return cube_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = kn_langid.train(docs.where(split_of() != HELD_OUT))
    found = kn_langid.detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(split_of() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(split_of() != HELD_OUT))
    scored = toxicity.score(docs, lexicon, ["doc_id"])
    return scored.select("doc_id", F.coalesce(split_of() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.train(pages))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps without the passages that earlier documents hold."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash_links.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and one that looks like the template, read back from the output."""
    both = spark.createDataFrame([(-7, t, r, "\\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat_format.digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(both))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits at places given by its id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")

    def edit(step: int, removed: int, inserted: str):
        return F.struct(F.lit(step).cast("long").alias("step"), F.pmod(F.xxhash64("doc_id", F.lit(step)), size + 1).alias("position"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))

    edits = F.array(edit(0, 24, " revised 2024 edition,"), edit(1, 35, ""), edit(2, 0, "\n\nAn added line"))
    return token_counts.counts(docs.withColumn("edits", edits))


@query
def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.compare_with_next(docs, imatch.lexicon(docs))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's fill-in-the-middle output and of the text rebuilt from it."""
    made = fim.restore(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, a digest of their spans, and all spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[F.size(secret_scan.of_kinds(spans, k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.listed(secret_scan.of_kinds(spans, *secret_scan.BASE_KINDS)), 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
    )


@query
def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over every document: tokens, groups, links and the counts of their id pairs."""
    made = token_align.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    made = token_align.written(spark, made.withColumn("groups_sha256", digest).drop("groups"), "token-align")
    full = token_align.with_counts(made, token_align.piece_count())
    return full.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: The other operators' results can't be stated in SQL (models, random walks, component search, byte
#: strings, tokenizers, checksums); each is tested against brute force, a round trip or held-out accuracy.
_SQL: dict[str, str] = {
    "op11_fill_in_middle": """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    [CAST('0x' || substr(sha256('1:' || doc_id), 8 * CAST(i AS INTEGER) + 1, 8) AS BIGINT) FOR i IN range(4)] AS h
  FROM documents
), cut AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n,
    least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM cut
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts""",
}


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
