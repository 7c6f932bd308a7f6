"""The registered queries of this package, with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cohortry.llm import alignment, decontamination, fill_in_middle, main_text, mixing, near_duplicates, neighbours, personal_data, quality, repeated_spans, token_counts, toxicity, url_filter, vocabularies
from cohortry.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


URL_RULES = (
    url_filter.Rule.of("allow", "com/"),
    url_filter.Rule.of("block", "example.com/en/"),
    url_filter.Rule.of("allow", "www.example.com/en/"),
    url_filter.Rule.of("block", "net/es/"),
    url_filter.Rule.of("block", "net/fr/"),
)


def url_filter_sql(rules: tuple[url_filter.Rule, ...] = URL_RULES) -> str:
    listed = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {listed}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
placed AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
places AS (SELECT DISTINCT host, path FROM placed),
best AS (
  SELECT host, path, rule_host || rule_path AS rule, verdict FROM places JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY host, path
    ORDER BY length(rule_host) DESC, length(rule_path) DESC, verdict DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM placed LEFT JOIN best USING (host, path)"""


@query(url_filter_sql())
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, keys=["page_id"])


MIXING_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':'
      || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM sources WINDOW before AS (
    ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0 END AS rate
  FROM targets)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source"""


@query(MIXING_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.planned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


_WORDS_SQL = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'),"
    f" '{decontamination.WORD}')"
)
DECONTAMINATION_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS_SQL} AS words FROM documents),
items AS (SELECT item_id, {_WORDS_SQL} AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, length,
    array_to_string(words[start + 1 : start + length], ' ') AS run
  FROM (SELECT item_id, words, least(len(words), 13) AS length,
          unnest(range(0, len(words) - least(len(words), 13) + 1)) AS start
        FROM items WHERE len(words) > 0)),
doc_windows AS (
  SELECT doc_id, start, length, array_to_string(words[start + 1 : start + length], ' ') AS run
  FROM (SELECT doc_id, words, length, unnest(range(0, len(words) - length + 1)) AS start
        FROM docs CROSS JOIN (SELECT DISTINCT length FROM item_windows))),
hits AS (SELECT DISTINCT doc_id, start, doc_windows.length, item
         FROM doc_windows JOIN item_windows USING (run)),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(start, start + length)) AS place FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT docs.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""


@query(DECONTAMINATION_SQL)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.judged(docs, table(spark, sf_dir, "benchmark")).drop("_text")


@query()
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(table(spark, sf_dir, "pages"), keys=["page_id", "url"])


@query()
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.detected(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


@query()
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.graded_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=100)


REPEATED_SPANS_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, start, array_to_string(words[start + 1 : start + 13], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - 12)) AS start FROM docs)),
first AS (SELECT run, min(doc_id) AS doc_id FROM windows GROUP BY run),
gone AS (
  SELECT DISTINCT windows.doc_id, unnest(range(start, start + 13)) AS place
  FROM windows JOIN first ON windows.run = first.run AND first.doc_id < windows.doc_id),
listed AS (
  SELECT doc_id, len(words) AS n_words, unnest(words) AS word, unnest(range(0, len(words))) AS place FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n
  FROM listed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT docs.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""


@query(REPEATED_SPANS_SQL)
def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.digest(repeated_spans.cut_documents(table(spark, sf_dir, "documents")))


BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def _vocabulary(name: str):
    return vocabularies.vocabulary(vocabularies.file_of(name))


@query()
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.links(docs, _vocabulary(BYTE_VOCABULARY), _vocabulary(PIECE_VOCABULARY))[0]


@query()
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = token_counts.counted(docs, _vocabulary(PIECE_VOCABULARY), ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


FILL_IN_MIDDLE_SQL = f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n,
    sha256('{fill_in_middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS u, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS v,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS changed, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS turned FROM drawn),
cut AS (
  SELECT doc_id, text, n, least(u, v) AS a, greatest(u, v) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR changed >= 90
      THEN 'plain' WHEN turned < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
pieces AS (
  SELECT doc_id, text, n, form, a, b, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM pieces"""


@query(FILL_IN_MIDDLE_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.transformed(table(spark, sf_dir, "documents")))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
