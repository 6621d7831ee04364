"""Saturation bundle: W1, W2, J5, J6, O5, X1, X2 over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import clean_tokens
from quarry.operators import saturation as sat
from quarry.plans.registry import register
from quarry.plans.standins import PART_SIZES_SQL, np_round_sql, part_sizes, pct_sql
from quarry.sources.tables import table


def ranked_sql(sizes: str, key: str, group: str | None = None) -> str:
    """Oracle: rank + running sum by plain SQL windows."""
    part = f"PARTITION BY {group} " if group else ""
    grp = f"{group}, " if group else ""
    order = f"ORDER BY size DESC, {key}"
    return f"""ranked AS (
  SELECT {grp}{key}, size,
         CAST(row_number() OVER ({part}{order}) AS BIGINT) AS rank,
         CAST(sum(size) OVER ({part}{order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_size,
         CAST(count(*) OVER ({part.strip()}) AS BIGINT) AS n_types,
         CAST(sum(size) OVER ({part.strip()}) AS BIGINT) AS total
  FROM {sizes}),
pts AS (SELECT *, {pct_sql('rank', 'n_types')} AS x, {pct_sql('cum_size', 'total')} AS y FROM ranked)"""


def curve_sql(group: str | None = None) -> str:
    grp = f"{group}, " if group else ""
    part = f"PARTITION BY {'p.' + group + ', ' if group else ''}g.target"
    join = f" ON p.{group} IS NOT DISTINCT FROM p.{group}" if group else ""
    return f"""grid AS (SELECT CAST(i AS DOUBLE) * 0.5 AS target FROM range(201) t(i)),
best AS (SELECT {'p.' + group + ', ' if group else ''}g.target, p.rank, p.x, p.y,
                row_number() OVER ({part} ORDER BY abs(p.x - g.target), p.rank) AS rn
         FROM grid g, pts p{join})
SELECT {grp}target AS grid_pct, rank, {np_round_sql('x', 2)} AS pct_question_types,
       {np_round_sql('y', 2)} AS pct_queries_covered
FROM best WHERE rn = 1"""


def _part_curve(spark, sf):
    return sat.coverage_curve(part_sizes(spark, sf), "size", ["l_partkey"])


@register("saturation_curve", sql=f"""WITH {PART_SIZES_SQL},
{ranked_sql('sizes', 'l_partkey')},
{curve_sql()}""")
def saturation_curve(spark, sf):
    """Flagship: 201-point Pareto curve of calls per question type (= part)."""
    return sat.saturation_curve(_part_curve(spark, sf))


@register("saturation_metadata", sql=f"""WITH {PART_SIZES_SQL},
{ranked_sql('sizes', 'l_partkey')},
near AS (
  SELECT t.target, p.y, row_number() OVER (PARTITION BY t.target ORDER BY abs(p.x - t.target), p.rank) AS rn
  FROM (VALUES (10.0), (20.0), (30.0)) t(target), pts p),
top AS (SELECT y FROM pts WHERE rank = least(100, n_types))
SELECT (SELECT max(total) FROM pts) AS total_queries,
       (SELECT max(n_types) FROM pts) AS total_question_types,
       {np_round_sql("(SELECT y FROM near WHERE rn = 1 AND target = 10.0)", 2)} AS coverage_at_10pct,
       {np_round_sql("(SELECT y FROM near WHERE rn = 1 AND target = 20.0)", 2)} AS coverage_at_20pct,
       {np_round_sql("(SELECT y FROM near WHERE rn = 1 AND target = 30.0)", 2)} AS coverage_at_30pct,
       {np_round_sql("(SELECT y FROM top)", 2)} AS top_100_coverage""")
def saturation_metadata(spark, sf):
    return sat.saturation_metadata(_part_curve(spark, sf))


@register("saturation_coverage_targets", sql=f"""WITH {PART_SIZES_SQL},
{ranked_sql('sizes', 'l_partkey')},
near AS (
  SELECT t.target, p.rank, p.x, p.n_types,
         row_number() OVER (PARTITION BY t.target ORDER BY abs(p.y - t.target), p.rank) AS rn
  FROM (VALUES (50.0), (75.0), (80.0), (85.0), (90.0), (95.0)) t(target), pts p)
SELECT target AS coverage_target, rank, x AS pct_question_types,
       CAST(floor(n_types * x / 100.0) AS BIGINT) AS num_types
FROM near WHERE rn = 1""")
def saturation_coverage_targets(spark, sf):
    """Share of types needed for 50/75/80/85/90/95 % coverage."""
    return sat.nearest_on_coverage(_part_curve(spark, sf))


@register("saturation_top10", sql=f"""WITH {PART_SIZES_SQL},
{ranked_sql('sizes', 'l_partkey')}
SELECT rank, l_partkey, size, {pct_sql('size', 'total')} AS pct_of_total FROM pts WHERE rank <= 10""")
def saturation_top10(spark, sf):
    """The ten largest question types and their share."""
    return sat.top_types(_part_curve(spark, sf), 10)


_BRAND_SIZES_SQL = """bsizes AS (
  SELECT p.p_brand AS brand, l.l_partkey, count(*) AS size
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, l.l_partkey)"""


def _brand_curve(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    sizes = li.join(p, "l_partkey").groupBy("brand", "l_partkey").agg(F.count(F.lit(1)).alias("size"))
    return sat.coverage_curve(sizes, "size", ["l_partkey"], group_cols=["brand"])


@register("saturation_per_crop", sql=f"""WITH {_BRAND_SIZES_SQL},
{ranked_sql('bsizes', 'l_partkey', 'brand')}
SELECT brand, l_partkey, size, rank, cum_size, n_types, total,
       x AS pct_question_types, y AS pct_queries_covered FROM pts""")
def saturation_per_crop(spark, sf):
    """The ranked coverage table within each crop (crop = brand, type = part)."""
    return _brand_curve(spark, sf)


@register("saturation_curve_per_crop", sql=f"""WITH {_BRAND_SIZES_SQL},
{ranked_sql('bsizes', 'l_partkey', 'brand')},
grid AS (SELECT CAST(i AS DOUBLE) * 0.5 AS target FROM range(201) t(i)),
best AS (SELECT p.brand, g.target, p.rank, p.x, p.y,
                row_number() OVER (PARTITION BY p.brand, g.target ORDER BY abs(p.x - g.target), p.rank) AS rn
         FROM grid g, pts p)
SELECT brand, target AS grid_pct, rank, {np_round_sql('x', 2)} AS pct_question_types,
       {np_round_sql('y', 2)} AS pct_queries_covered FROM best WHERE rn = 1""")
def saturation_curve_per_crop(spark, sf):
    """W2 + J5 per group: a 201-point curve for every crop."""
    return sat.saturation_curve(_brand_curve(spark, sf), group_cols=["brand"])


CLEAN_TOKENS_SQL = r"""list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({col}, '')),
  '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: t <> '' AND NOT list_contains({stops}, t))"""


def stop_list_sql(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def clean_tokens_sql(col: str, words) -> str:
    return CLEAN_TOKENS_SQL.format(col=col, stops=stop_list_sql(words))


def _word_sizes_sql():
    from quarry.functions.text import STOP_WORDS
    return f"""wsizes AS (
  SELECT word, count(*) AS size FROM (
    SELECT unnest({clean_tokens_sql('text', STOP_WORDS)}) AS word FROM documents)
  GROUP BY word)"""


@register("saturation_words", sql=f"""WITH {_word_sizes_sql()},
{ranked_sql('wsizes', 'word')},
{curve_sql()}""")
def saturation_words(spark, sf):
    """A steep curve: question type = cleaned word of the documents."""
    docs = table(spark, sf, "documents")
    words = docs.select(F.explode(clean_tokens("text")).alias("word"))
    sizes = words.groupBy("word").agg(F.count(F.lit(1)).alias("size"))
    return sat.saturation_curve(sat.coverage_curve(sizes, "size", ["word"]))


_K2_SQL = f"""WITH {PART_SIZES_SQL},
{ranked_sql('sizes', 'l_partkey')},
grid AS (SELECT CAST(i AS DOUBLE) * 0.5 AS target FROM range(201) t(i)),
best AS (SELECT g.target, p.rank, p.x, p.y,
                row_number() OVER (PARTITION BY g.target ORDER BY abs(p.x - g.target), p.rank) AS rn
         FROM grid g, pts p),
curve AS (SELECT target, {np_round_sql('x', 2)} AS px, {np_round_sql('y', 2)} AS py FROM best WHERE rn = 1),
near AS (
  SELECT t.target, p.y, row_number() OVER (PARTITION BY t.target ORDER BY abs(p.x - t.target), p.rank) AS rn
  FROM (VALUES (10.0), (20.0), (30.0)) t(target), pts p)
SELECT to_json({{'metadata': {{
    'total_queries': (SELECT max(total) FROM pts),
    'total_question_types': (SELECT max(n_types) FROM pts),
    'coverage_at_10pct': {np_round_sql("(SELECT y FROM near WHERE rn = 1 AND target = 10.0)", 2)},
    'coverage_at_20pct': {np_round_sql("(SELECT y FROM near WHERE rn = 1 AND target = 20.0)", 2)},
    'coverage_at_30pct': {np_round_sql("(SELECT y FROM near WHERE rn = 1 AND target = 30.0)", 2)},
    'top_100_coverage': {np_round_sql("(SELECT y FROM pts WHERE rank = least(100, n_types))", 2)}}},
  'curve': (SELECT list({{'pct_question_types': px, 'pct_queries_covered': py}} ORDER BY target) FROM curve)}})::VARCHAR AS value"""


@register("k2_saturation_json", sql=_K2_SQL)
def k2_saturation_json(spark, sf):
    """K2 + F25: the dashboard document {metadata, curve[201]} as one JSON row."""
    from quarry.sources.sinks import saturation_document
    curve = _part_curve(spark, sf)
    return saturation_document(sat.saturation_curve(curve), sat.saturation_metadata(curve))
