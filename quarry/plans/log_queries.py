"""Counts, shares, pivots, growth and filters over the call log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import aggregates as agg
from quarry.operators import filters as flt
from quarry.operators import saturation as sat
from quarry.plans.registry import register
from quarry.plans.saturation_queries import ranked_sql
from quarry.plans.standins import LOG_SQL, PART_SIZES_SQL, call_log, np_round_sql, part_sizes, pct_sql
from quarry.sources.tables import table

# --- fixed values of the stand-in (question type -> bucket dimension) -----------
# o_orderpriority plays QueryType; one priority is deliberately left unmapped so
# the 'Unclassified' fallback is exercised.
BUCKET_MAP = (("1-URGENT", "Urgent"), ("2-HIGH", "High"), ("3-MEDIUM", "Medium"), ("5-LOW", "Low"))
BUCKETS = ("High", "Low", "Medium", "Unclassified", "Urgent")
EXCLUDED_TYPES = ("1-URGENT", "5-LOW")          # F2 stand-in for the 13 excluded types
EXCLUDED_CROPS = ("Red Plate ", "\thot ring")   # F3 stand-in for others/other
# ----------------------------------------------------------------------------------

_MAP_SQL = "bmap(qt, bucket) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in BUCKET_MAP) + ")"


def _mapping(spark):
    return spark.createDataFrame(list(BUCKET_MAP), "QueryType string, Bucket string")


# calls of the fifth priority have no type: null in the queries on unknown types
_TYPED_SQL = ", typed AS (SELECT * REPLACE (nullif(QueryType, '4-NOT SPECIFIED') AS QueryType) FROM log)"


def _typed(log):
    return log.withColumn("QueryType", F.nullif("QueryType", F.lit("4-NOT SPECIFIED")))


def _w(sql: str) -> str:
    return f"WITH {LOG_SQL}\n{sql}"


@register("g1_crop_sizes", sql=_w("SELECT Crop, count(*) AS n_queries FROM log GROUP BY Crop"))
def g1_crop_sizes(spark, sf):
    return agg.group_sizes(call_log(spark, sf, ["Crop"]), "Crop")


@register("g2_duplicate_collapse", sql="""SELECT text AS query_text, lang, source, count(*) AS count
FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL
GROUP BY text, lang, source""")
def g2_duplicate_collapse(spark, sf):
    """Identical texts with identical metadata collapse into one weighted row."""
    return agg.collapse_duplicates(table(spark, sf, "documents"), "text", ["lang", "source"])


@register("g6_unique_crops", sql=_w("SELECT DISTINCT Crop FROM log"))
def g6_unique_crops(spark, sf):
    return call_log(spark, sf, ["Crop"]).select("Crop").distinct()


@register("g7a_type_share", sql=_w(f"""{_TYPED_SQL}
SELECT QueryType, count(*) AS n_queries,
  {np_round_sql(pct_sql('count(*)', '(SELECT count(QueryType) FROM typed)'), 2)} AS pct
FROM typed WHERE QueryType IS NOT NULL GROUP BY QueryType"""))
def g7a_type_share(spark, sf):
    """Share over the rows with a known type."""
    return agg.value_shares(_typed(call_log(spark, sf, ["QueryType"])), "QueryType")


@register("g7b_type_share_all_rows", sql=_w(f"""{_TYPED_SQL}
SELECT QueryType, count(*) AS n_queries,
  {np_round_sql(pct_sql('count(*)', '(SELECT count(*) FROM typed)'), 2)} AS pct
FROM typed WHERE QueryType IS NOT NULL GROUP BY QueryType"""))
def g7b_type_share_all_rows(spark, sf):
    """Share over all rows, unknown types included in the denominator."""
    return agg.value_shares(_typed(call_log(spark, sf, ["QueryType"])), "QueryType", denominator="all")


@register("g7_top_crops", sql=_w(f"""SELECT Crop, count(*) AS n_queries,
  {np_round_sql(pct_sql('count(*)', '(SELECT count(Crop) FROM log)'), 2)} AS pct
FROM log WHERE Crop IS NOT NULL GROUP BY Crop ORDER BY n_queries DESC, Crop LIMIT 50"""))
def g7_top_crops(spark, sf):
    """Top-50 crops with share (a top-k report: the limit is the feature)."""
    shares = agg.value_shares(call_log(spark, sf, ["Crop"]), "Crop")
    return agg.top_n(shares, [F.desc("n_queries"), F.asc("Crop")], 50)


@register("g8_monthly_counts", sql=_w("""SELECT CAST(date_trunc('month', CallDate) AS DATE) AS month,
  count(*) AS n_queries FROM log WHERE CallDate IS NOT NULL GROUP BY 1"""))
def g8_monthly_counts(spark, sf):
    return agg.monthly_counts(call_log(spark, sf, ["CallDate"]), "CallDate")


@register("g9_state_summary", sql=_w("""SELECT StateName, count(QueryType) AS total_queries,
  count(DISTINCT Crop) AS unique_crop, count(DISTINCT DistrictName) AS unique_districtname
FROM log WHERE StateName IS NOT NULL GROUP BY StateName"""))
def g9_state_summary(spark, sf):
    """Per state the typed calls and distinct crops and districts."""
    log = call_log(spark, sf, ["StateName", "QueryType", "Crop", "DistrictName"])
    return agg.group_summary(log, "StateName", "QueryType", ["Crop", "DistrictName"])


@register("g10_district_summary", sql=_w("""SELECT StateName, DistrictName, count(*) AS n_queries
FROM log WHERE StateName IS NOT NULL AND DistrictName IS NOT NULL GROUP BY StateName, DistrictName"""))
def g10_district_summary(spark, sf):
    return agg.group_sizes(call_log(spark, sf, ["StateName", "DistrictName"]), ["StateName", "DistrictName"])


_BUCKETED_SQL = f"""{_MAP_SQL},
b AS (SELECT coalesce(m.bucket, 'Unclassified') AS Bucket, l.CallDate
      FROM log l LEFT JOIN bmap m ON trim(l.QueryType, ' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f') = m.qt)"""


@register("g11_bucket_totals", sql=_w(f""", {_BUCKETED_SQL}
SELECT Bucket, count(*) AS Count, {np_round_sql(pct_sql('count(*)', '(SELECT count(*) FROM b)'), 2)} AS Percentage
FROM b GROUP BY Bucket"""))
def g11_bucket_totals(spark, sf):
    """G11 + J7: type -> bucket dimension lookup, unknown -> Unclassified."""
    return agg.bucket_totals(call_log(spark, sf, ["QueryType"]), "QueryType", _mapping(spark))


_BY_YEAR_SQL = f"""{_BUCKETED_SQL},
c AS (SELECT CAST(year(CallDate) AS INTEGER) AS year, Bucket, count(*) AS Count FROM b GROUP BY 1, 2),
s AS (SELECT year, Bucket, Count,
        {np_round_sql(pct_sql('Count', 'sum(Count) OVER (PARTITION BY year)'), 2)} AS Percentage FROM c)"""


@register("g11b_bucket_by_year", sql=_w(f""", {_BY_YEAR_SQL}
SELECT * FROM s"""))
def g11b_bucket_by_year(spark, sf):
    """(year, bucket) counts with the share within the year."""
    return agg.bucket_by_year(call_log(spark, sf, ["QueryType", "CallDate"]), "QueryType", "CallDate",
                              _mapping(spark))


@register("k5_year_totals", sql=_w(f""", {_BY_YEAR_SQL}
SELECT year, CAST(sum(Count) AS BIGINT) AS total_processed FROM s GROUP BY ROLLUP (year)"""))
def k5_year_totals(spark, sf):
    """K5 totals: one 'Total Processed' per year plus the grand total (rollup)."""
    by_year = agg.bucket_by_year(call_log(spark, sf, ["QueryType", "CallDate"]), "QueryType", "CallDate",
                                 _mapping(spark))
    return agg.year_totals(by_year)


@register("g12_bucket_pivot", sql=_w(f""", {_BY_YEAR_SQL}
SELECT year, {", ".join(f"coalesce(max(CASE WHEN Bucket = '{b}' THEN Percentage END), 0.0) AS {b}" for b in BUCKETS)}
FROM s GROUP BY year"""))
def g12_bucket_pivot(spark, sf):
    """Year x bucket share pivot, alphabetical columns, absent cells 0.0."""
    by_year = agg.bucket_by_year(call_log(spark, sf, ["QueryType", "CallDate"]), "QueryType", "CallDate",
                                 _mapping(spark))
    return agg.pivot_shares(by_year, BUCKETS)


@register("g13_district_crop_matrix", sql=_w("""
, tr AS (SELECT DistrictName FROM log GROUP BY 1 ORDER BY count(*) DESC, DistrictName LIMIT 15)
, tc AS (SELECT Crop FROM log GROUP BY 1 ORDER BY count(*) DESC, Crop LIMIT 25)
, grid AS (SELECT tr.DistrictName, tc.Crop FROM tr, tc)
, c AS (SELECT DistrictName, Crop, count(*) AS n FROM log GROUP BY 1, 2)
SELECT g.DistrictName, g.Crop, CAST(coalesce(c.n, 0) AS BIGINT) AS n_queries
FROM grid g LEFT JOIN c ON g.DistrictName = c.DistrictName AND g.Crop = c.Crop"""))
def g13_district_crop_matrix(spark, sf):
    """Top-15 districts x top-25 crops, zero-filled (long form)."""
    return agg.top_matrix(call_log(spark, sf, ["DistrictName", "Crop"]), "DistrictName", "Crop", 15, 25)


@register("g14_crop_growth", sql=_w("""SELECT Crop,
  CAST(sum(CASE WHEN year(CallDate) = 1996 THEN 1 ELSE 0 END) AS BIGINT) AS count_1996,
  CAST(sum(CASE WHEN year(CallDate) = 2000 THEN 1 ELSE 0 END) AS BIGINT) AS count_2000,
  (CAST(sum(CASE WHEN year(CallDate) = 2000 THEN 1 ELSE 0 END) - sum(CASE WHEN year(CallDate) = 1996 THEN 1 ELSE 0 END) AS DOUBLE)
   / CAST(sum(CASE WHEN year(CallDate) = 1996 THEN 1 ELSE 0 END) AS DOUBLE)) * 100.0 AS growth_pct
FROM log WHERE year(CallDate) IN (1996, 2000) GROUP BY Crop
HAVING sum(CASE WHEN year(CallDate) = 1996 THEN 1 ELSE 0 END) > 0
   AND sum(CASE WHEN year(CallDate) = 2000 THEN 1 ELSE 0 END) > 0"""))
def g14_crop_growth(spark, sf):
    """Growth 1996 -> 2000 per crop, crops present in both years."""
    return agg.growth(call_log(spark, sf, ["Crop", "CallDate"]), "Crop", "CallDate", 1996, 2000)


@register("g21_long_tail", sql=_w("""
, c AS (SELECT Crop, count(*) AS n FROM log GROUP BY Crop)
, r AS (SELECT Crop, n, row_number() OVER (ORDER BY n DESC, Crop) AS rn FROM c)
SELECT CASE WHEN rn <= 15 THEN Crop ELSE 'All Others' END AS Crop, CAST(sum(n) AS BIGINT) AS n_queries
FROM r GROUP BY 1"""))
def g21_long_tail(spark, sf):
    """Top-15 crops, the rest as 'All Others'."""
    return agg.long_tail(call_log(spark, sf, ["Crop"]), "Crop", 15)


@register("g22_volume_brackets", sql=_w("""
, c AS (SELECT Crop, count(*) AS n FROM log GROUP BY Crop)
SELECT CASE WHEN n >= 1000000 THEN '1M+' WHEN n >= 500000 THEN '500k-1M' WHEN n >= 100000 THEN '100k-500k'
            WHEN n >= 50000 THEN '50k-100k' WHEN n >= 10000 THEN '10k-50k' ELSE '<10k' END AS bracket,
       count(*) AS n_crops FROM c GROUP BY 1"""))
def g22_volume_brackets(spark, sf):
    """Crops per volume bracket."""
    sizes = agg.group_sizes(call_log(spark, sf, ["Crop"]), "Crop")
    return agg.volume_brackets(sizes, "n_queries")


@register("g23_median_type_size", sql="""SELECT CAST(median(size) AS DOUBLE) AS median_size
FROM (SELECT l_partkey, count(*) AS size FROM lineitem GROUP BY l_partkey)""")
def g23_median_type_size(spark, sf):
    sizes = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("size"))
    return agg.median_size(sizes, "size")


@register("g24_headline", sql=_w(f"""SELECT count(*) AS total_queries, count(DISTINCT Crop) AS n_crops,
  count(DISTINCT QueryType) AS n_query_types,
  {np_round_sql('CAST(count(*) AS DOUBLE) / CAST(count(DISTINCT QueryType) AS DOUBLE)', 1)} AS queries_per_type
FROM log"""))
def g24_headline(spark, sf):
    return agg.headline(call_log(spark, sf, ["Crop", "QueryType"]), "Crop", "QueryType")


# fixed values of the stand-in: calls of even orders are logged by code
TYPE_CODES = (("1", "1-URGENT"), ("2", "2-HIGH"), ("3", "3-MEDIUM"), ("5", "5-LOW"))


@register("j7_decoded_types", sql=_w(f"""
, codes(code, name) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in TYPE_CODES)})
, logged AS (SELECT CASE WHEN call_order % 2 = 0 THEN substr(QueryType, 1, 1) ELSE QueryType END AS t FROM log)
SELECT coalesce(c.name, l.t) AS QueryType, count(*) AS n_queries,
  {np_round_sql(pct_sql('count(*)', '(SELECT count(t) FROM logged)'), 2)} AS pct
FROM logged l LEFT JOIN codes c ON l.t = c.code WHERE l.t IS NOT NULL GROUP BY 1"""))
def j7_decoded_types(spark, sf):
    """Types logged by code count with the same types logged by name."""
    log = call_log(spark, sf, ["call_order", "QueryType"])
    logged = log.withColumn("QueryType", F.when(F.col("call_order") % 2 == 0, F.substring("QueryType", 1, 1))
                            .otherwise(F.col("QueryType")))
    codes = spark.createDataFrame(list(TYPE_CODES), "code string, name string")
    return agg.value_shares(agg.decode_types(logged, "QueryType", codes), "QueryType")


@register("g24_dashboard_headline", sql=_w(f"""
, {PART_SIZES_SQL}, {ranked_sql('sizes', 'l_partkey')}
SELECT (SELECT count(*) FROM log) AS total_queries, (SELECT count(DISTINCT Crop) FROM log) AS total_crops,
  (SELECT max(n_types) FROM pts) AS total_question_types,
  {np_round_sql('(SELECT y FROM pts ORDER BY abs(x - 10.0), rank LIMIT 1)', 2)} AS coverage_at_10pct"""))
def g24_dashboard_headline(spark, sf):
    """Calls, crops, question types (clusters) and coverage at 10 % of the types."""
    meta = sat.saturation_metadata(sat.coverage_curve(part_sizes(spark, sf), "size", ["l_partkey"]))
    crops = call_log(spark, sf, ["Crop"]).agg(F.countDistinct("Crop"))
    return meta.select("total_queries", crops.scalar().alias("total_crops"), "total_question_types", "coverage_at_10pct")


@register("g25_urgent_top_crops", sql=_w("""SELECT Crop, count(*) AS n_queries FROM log
WHERE QueryType = '1-URGENT' GROUP BY Crop ORDER BY n_queries DESC, Crop LIMIT 20"""))
def g25_urgent_top_crops(spark, sf):
    """F1 + G25: distribution inside a filtered subset, top 20."""
    sub = call_log(spark, sf, ["Crop", "QueryType"]).where(F.col("QueryType") == "1-URGENT")
    return agg.top_n(agg.group_sizes(sub, "Crop"), [F.desc("n_queries"), F.asc("Crop")], 20)


@register("f2_exclude_types", sql=_w(f"""{_TYPED_SQL}
SELECT QueryType, count(*) AS n_queries FROM typed
WHERE coalesce(QueryType NOT IN ('1-URGENT', '5-LOW'), true) GROUP BY QueryType"""))
def f2_exclude_types(spark, sf):
    """null-keeping NOT IN on the question type."""
    log = flt.exclude_values(_typed(call_log(spark, sf, ["QueryType"])), "QueryType", EXCLUDED_TYPES)
    return agg.group_sizes(log, "QueryType", drop_null_keys=False)


@register("f3_exclude_normalized", sql=_w("""SELECT Crop, count(*) AS n_queries FROM log
WHERE coalesce(trim(lower(Crop), ' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f') NOT IN ('hot ring', 'red plate'), true)
GROUP BY Crop"""))
def f3_exclude_normalized(spark, sf):
    """lower+strip NOT IN a list."""
    log = flt.exclude_normalized(call_log(spark, sf, ["Crop"]), "Crop", EXCLUDED_CROPS)
    return agg.group_sizes(log, "Crop")


@register("o3_top5_crops", sql=_w("""SELECT Crop, count(*) AS total_freq FROM log
WHERE coalesce(QueryType NOT IN ('1-URGENT', '5-LOW'), true)
  AND coalesce(trim(lower(Crop), ' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f') NOT IN ('hot ring', 'red plate'), true)
GROUP BY Crop ORDER BY total_freq DESC, Crop LIMIT 5"""))
def o3_top5_crops(spark, sf):
    """F2 + F3 + O3: the experiment driver's crop selection."""
    log = call_log(spark, sf, ["Crop", "QueryType"])
    log = flt.exclude_normalized(flt.exclude_values(log, "QueryType", EXCLUDED_TYPES), "Crop", EXCLUDED_CROPS)
    return agg.top_n(agg.group_sizes(log, "Crop", "total_freq"), [F.desc("total_freq"), F.asc("Crop")], 5)


@register("f8_state_share", sql=_w(f"""SELECT StateName, count_if(QueryType = '1-URGENT') AS n_selected,
  count(*) AS n_state, {np_round_sql(pct_sql("count_if(QueryType = '1-URGENT')", 'count(*)'), 2)} AS pct
FROM log GROUP BY StateName"""))
def f8_state_share(spark, sf):
    """F8: predicate count within each state and its share of the state total."""
    log = call_log(spark, sf, ["StateName", "QueryType"])
    out = log.groupBy("StateName").agg(F.count_if(F.col("QueryType") == "1-URGENT").alias("n_selected"),
                                       F.count(F.lit(1)).alias("n_state"))
    from quarry.functions.numeric import np_round, pct
    return out.withColumn("pct", np_round(pct("n_selected", "n_state"), 2))


@register("f9_crop_search", sql=_w("""SELECT Crop, count(*) AS n_queries FROM log
WHERE contains(lower(Crop), 'plate') GROUP BY Crop"""))
def f9_crop_search(spark, sf):
    """case-insensitive substring search over crop names."""
    log = call_log(spark, sf, ["Crop"]).where(flt.contains_ci("Crop", "PLATE"))
    return agg.group_sizes(log, "Crop")


@register("f7_numeric_tokens", sql=r"""SELECT token, count(*) AS n FROM (
  SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents)
WHERE regexp_full_match(token, '[0-9]+') GROUP BY token ORDER BY n DESC, token LIMIT 10""")
def f7_numeric_tokens(spark, sf):
    """F7 + G25: all-digit codes inside the texts, top 10."""
    toks = table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("token"))
    counts = toks.where(flt.is_numeric_code("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return agg.top_n(counts, [F.desc("n"), F.asc("token")], 10)


@register("w7_first_calls_per_type", sql=_w("""SELECT QueryType, call_order, call_line, rn FROM (
  SELECT QueryType, call_order, call_line,
         CAST(row_number() OVER (PARTITION BY QueryType ORDER BY call_order, call_line) AS INTEGER) AS rn
  FROM log) WHERE rn <= 10"""))
def w7_first_calls_per_type(spark, sf):
    """The first 10 calls of every type by a stable key.  Spark plans this as a
    per-partition group limit before the shuffle, so a hot type ships only 10 rows
    per task."""
    log = call_log(spark, sf, ["QueryType", "call_order", "call_line"])
    w = Window.partitionBy("QueryType").orderBy("call_order", "call_line")
    return log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 10)


@register("o4_capped_collapse", sql="""SELECT * FROM (SELECT text AS query_text, lang, source, count(*) AS count
FROM documents GROUP BY text, lang, source) ORDER BY count DESC, query_text, lang, source LIMIT 10000""")
def o4_capped_collapse(spark, sf):
    """G2 + O4: collapse, sort by count, keep the 10,000 largest (the reference's
    cap; the limit is the feature)."""
    c = agg.collapse_duplicates(table(spark, sf, "documents"), "text", ["lang", "source"])
    return agg.top_n(c, [F.desc("count"), F.asc("query_text"), F.asc("lang"), F.asc("source")], 10000)


@register("j3_semi_join_top_crops", sql=_w("""
, top AS (SELECT Crop FROM log GROUP BY Crop ORDER BY count(*) DESC, Crop LIMIT 5)
SELECT Crop, QueryType, count(*) AS n_queries FROM log WHERE Crop IN (SELECT Crop FROM top)
GROUP BY Crop, QueryType"""))
def j3_semi_join_top_crops(spark, sf):
    """Restrict the log to the top-5 crops by a broadcast semi join."""
    log = call_log(spark, sf, ["Crop", "QueryType"])
    top = agg.top_n(agg.group_sizes(log, "Crop"), [F.desc("n_queries"), F.asc("Crop")], 5).select("Crop")
    return agg.group_sizes(log.join(F.broadcast(top), "Crop", "left_semi"), ["Crop", "QueryType"])


@register("j1_normalized_lookup", sql=_w("""
, names AS (SELECT DISTINCT Crop FROM log)
, stats AS (SELECT trim(lower(Crop), ' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f') AS k, count(*) AS total_queries FROM log GROUP BY 1)
SELECT n.Crop AS crop, upper(n.Crop) || ' ' AS log_name, CAST(coalesce(s.total_queries, 0) AS BIGINT) AS total_queries
FROM names n LEFT JOIN stats s ON trim(lower(upper(n.Crop) || ' '), ' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f') = s.k"""))
def j1_normalized_lookup(spark, sf):
    """Look names up on their lower-cased, stripped form (default 0)."""
    from quarry.operators.joins import normalized_lookup
    log = call_log(spark, sf, ["Crop"])
    stats = agg.group_sizes(log, "Crop", "total_queries")
    names = log.select("Crop").distinct().select(
        F.col("Crop").alias("crop"), F.concat(F.upper("Crop"), F.lit(" ")).alias("log_name"))
    return normalized_lookup(names, "log_name", stats, "Crop", ["total_queries"]).select(
        "crop", "log_name", "total_queries")


@register("k5_report_lines", sql=_w(f""", {_BY_YEAR_SQL}
SELECT year, 0 AS section, printf('QUERY BUCKET DISTRIBUTION - %d', year) AS value FROM s GROUP BY year
UNION ALL
SELECT year, 1, printf('%-40s %10s %9s%%', Bucket, format('{{:,}}', Count), printf('%.2f', Percentage)) FROM s
UNION ALL
SELECT year, 2, printf('%-40s %s', 'Total Processed', format('{{:,}}', sum(Count))) FROM s GROUP BY year"""))
def k5_report_lines(spark, sf):
    """K5: the per-year bucket report as text lines (header, one line per bucket
    with thousands separators and the share, 'Total Processed')."""
    from quarry.sources.sinks import bucket_report_lines
    by_year = agg.bucket_by_year(call_log(spark, sf, ["QueryType", "CallDate"]), "QueryType", "CallDate",
                                 _mapping(spark))
    return bucket_report_lines(by_year).select("year", F.col("_sec").alias("section"), "value")
