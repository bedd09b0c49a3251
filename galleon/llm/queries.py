"""Registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_max, code_switch, decontaminate, html_extract, jaccard_join, mixing, quality_rules, spelling, sstable, substring_dedup, suffix_dedup, toxicity, url_filter

#: The rules of the query, and the listed sites.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_SITES = tuple(f"{name}.example.{top}" for name in LISTED_NAMES for top in ("com", "net", "org"))

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: five words, similarity 0.8 or more."""
    return jaccard_join.link(_table(spark, sf_dir, "documents"), k=5, num=80, den=100)[0]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document, in how many runs, and the digest of those kept."""
    kept = suffix_dedup.deduplicate(_table(spark, sf_dir, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; unruled pages of listed sites are blocked."""
    pages = _table(spark, sf_dir, "pages")
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED_SITES))))
    sites = pages.select(url_filter.site_of(url_filter.host_of(F.col("url"))))
    return url_filter.judge(pages, URL_RULES, url_filter.Cascade.build(listed, sites))


#: Rules by their length, then membership in the list, which the cascade answers exactly.
OP3_SQL = (
    r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/'
  END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_extract(host, '([^.]*\.)?([^.]*\.)?[^.]*$', 0) IN ("""
    + ", ".join(f"'{s}'" for s in LISTED_SITES)
    + """) THEN 'block'
    ELSE 'allow'
  END AS verdict
FROM ruled
"""
)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learnt outside the held-out third of the labelled ids."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.sample(docs, _table(spark, sf_dir, "labels"), max_train=20_000))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that come within edits of 15 % of the item's words of each other."""
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), edits=decontaminate.EDITS)


TOKENIZER = "word_bpe_49k.json"
END = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_sstable_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and digests of every document's token ids, read back from the shards written."""
    return sstable.read_back(sstable.write(_table(spark, sf_dir, "documents"), tokenizer_path(), END))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and the digest of those kept."""
    kept = substring_dedup.deduplicate(_table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, floor and verdict of every document."""
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's copies of documents: entropy 0.95 of the largest, four repeats at most."""
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, entropy=0.95, repeats=4.0, budget="tokens")
    return mixed.select("doc_id", "source", "mix_copy", "mix_tokens", "mix_block", "mix_slot")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters or more, their near words, forms and roots."""
    return spelling.group(_table(spark, sf_dir, "documents"), least=7, seen=2, every=31, times=10)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside the held-out quarter of the ids."""
    docs = _table(spark, sf_dir, "documents")
    found = code_switch.predict(docs, code_switch.fit(code_switch.sample(docs, max_train=4_000)))
    return found.select("doc_id", code_switch.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return block_max.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


#: Every document that shares a term with an item, scored; then the first 20 of each item.
OP13_SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), sizes AS (SELECT d, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY d),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
tf AS (SELECT d, term, count(*) AS tf FROM terms GROUP BY d, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, nn),
asked AS (
  SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS q, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))
), wanted AS (SELECT q, item_id, term, count(*) AS times FROM asked GROUP BY q, item_id, term),
scored AS (
  SELECT q, item_id, sizes.doc_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (d), total
  GROUP BY q, item_id, sizes.doc_id, d
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_ngram_jaccard_join": (op1_ngram_jaccard_join, None),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_url_filters": (op3_url_filters, OP3_SQL),
    "op4_html_extraction": (op4_html_extraction, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_benchmark_decontamination": (op6_benchmark_decontamination, None),
    "op7_sstable_output": (op7_sstable_output, None),
    "op8_substring_dedup": (op8_substring_dedup, None),
    "op9_quality_rules": (op9_quality_rules, None),
    "op10_source_mixing": (op10_source_mixing, None),
    "op11_spelling_variants": (op11_spelling_variants, None),
    "op12_language_id": (op12_language_id, None),
    "op13_ranked_search": (op13_ranked_search, OP13_SQL),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items() if s}
