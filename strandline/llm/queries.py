"""One registered query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    from .bpe import bpe_encode

    return bpe_encode(table(spark, sf_dir, "documents"), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN, digests=True)


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transport import read_media, store_media

    return read_media(store_media(table(spark, sf_dir, "documents")))


@query
def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .langid import fit, identify, learning_rows

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learning_rows())
    return identify(docs, model).withColumn("held_out", held_out())


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .quality import fit, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels"))).withColumn("held_out", held_out())


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


ORACLES["op2_line_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), totals AS (
  SELECT source, count(*) AS pages FROM d GROUP BY source
), seen AS (
  SELECT DISTINCT r, source, line
  FROM (SELECT r, source, unnest(lines) AS line FROM d)
  WHERE length(translate(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12), '')) > 0
), boiler AS (
  SELECT s.source, s.line FROM seen s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
  GROUP BY s.source, s.line, t.pages HAVING count(*) >= 2 AND count(*) * 100 > t.pages * 5
), marked AS (
  SELECT x.r, x.i, x.line, b.line IS NOT NULL AS boiled,
    length(translate(x.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12), '')) > 0 AS counts
  FROM (SELECT r, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d) x
  LEFT JOIN boiler b ON x.source IS NOT DISTINCT FROM b.source AND x.line = b.line
), per AS (
  SELECT r, bool_or(counts AND NOT boiled) AS left_over, count(*) FILTER (boiled) AS boiled,
    string_agg(line, chr(10) ORDER BY i) FILTER (NOT boiled) AS cleaned
  FROM marked GROUP BY r
)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines,
  CASE WHEN p.left_over THEN p.boiled ELSE 0 END::BIGINT AS n_dropped,
  md5(CASE WHEN p.left_over AND p.boiled > 0 THEN p.cleaned ELSE d.text END) AS text_md5
FROM d LEFT JOIN per p ON d.r = p.r
"""


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


ORACLES["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), named AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2 AS cap FROM totals
), swept AS (
  SELECT *, coalesce(sum(cap) OVER o, 0)::DOUBLE AS capped, coalesce(sum(w) OVER o, 0)::DOUBLE AS used,
    sum(source_size) OVER ()::DOUBLE * 150 / 100 AS words, sum(w) OVER ()::DOUBLE AS all_w
  FROM named WINDOW o AS (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, max((words - capped) / (all_w - used)) OVER () AS level FROM swept
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM leveled
), sizes AS (
  SELECT d.source, d.size, count(*)::BIGINT AS n, (floor(sqrt(d.size::DOUBLE)) + 1)::BIGINT AS w, any_value(t.target) AS target
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size > 0 GROUP BY d.source, d.size
), filled AS (
  SELECT *, (target - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)
    / (sum(size * n * w) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate
  FROM sizes
), r AS (
  SELECT t.*, coalesce(f.rate, CASE WHEN t.target > 0 THEN 2.0 ELSE 0.0 END)::DOUBLE AS rate FROM t LEFT JOIN
    (SELECT source, max_by(rate, size) AS rate FROM filled WHERE rate * w <= 2 GROUP BY source) f ON t.source IS NOT DISTINCT FROM f.source
), given AS (
  SELECT d.doc_id, d.size, d.u, r.*, least(2.0::DOUBLE, r.rate * (floor(sqrt(d.size::DOUBLE)) + 1)) AS due
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), odds AS (
  SELECT *, floor(due) AS whole, due - floor(due) AS p FROM given
), keyed AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS x,
    target - coalesce(sum((whole * size)::BIGINT) OVER (PARTITION BY source), 0)::DOUBLE AS rest FROM odds
), ranked AS (
  SELECT *, x / (1 + x) AS q FROM keyed
), summed AS (
  SELECT source, q, rest, sum(size) OVER (PARTITION BY source ORDER BY q)::DOUBLE AS after, sum(size) OVER (PARTITION BY source, q)::DOUBLE AS own
  FROM ranked WHERE q IS NOT NULL AND size > 0
), border AS (
  SELECT source, max(q) FILTER (after - rest < rest - (after - own)) AS q_in FROM summed GROUP BY source
)
SELECT k.doc_id, k.size, k.source_size, k.target,
  CAST((k.whole + CASE WHEN k.q <= b.q_in THEN 1 ELSE 0 END) * k.size AS BIGINT) AS taken
FROM ranked k LEFT JOIN border b ON k.source IS NOT DISTINCT FROM b.source
"""


@query
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .neighbours import QUERY_EVERY, nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
