"""Cluster summaries, FAQ tables, cluster matrices and the run-log summary
(SURVEY G15-G20, W3-W5, J1, J2, J4, S4, F10, F23, U2, O1)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.text import py_strip
from quarry.operators import faq
from quarry.operators.joins import lookup_with_fallback
from quarry.operators.saturation import prefix_rank
from quarry.plans.registry import register
from quarry.plans.standins import np_round_sql, pct_sql
from quarry.sources.tables import table

_WS = "' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f'"  # real control characters (DuckDB has no escapes)


def mapping(spark, sf, keywords: bool = False):
    """Stand-in for the per-crop mapping files: one row per unique (crop, text) of
    ``documents``; crop = lang, cluster = source number, ``src0`` is noise (-1),
    count = number of identical copies and, where asked for, keywords = the text's five
    highest TF-IDF terms (M4, vocabulary fitted per crop over the whole texts)."""
    from quarry.operators.tfidf import top_terms
    from quarry.plans.text_queries import _word_tfidf
    d = table(spark, sf, "documents")
    columns = [F.col("lang").alias("crop"), F.col("text").alias("query_text"),
               F.when(F.col("source") == "src0", F.lit(-1))
               .otherwise(F.substring("source", 4, 10).cast("int")).alias("cluster_id"), "count"]
    if not keywords:
        return d.groupBy("lang", "source", "text").agg(F.count(F.lit(1)).alias("count")).select(*columns)
    _, w = _word_tfidf(spark, sf)
    kw = top_terms(w, ["lang", "doc_id"], 5).select(
        "lang", "doc_id", F.array_join("keywords", ", ").alias("kw"))
    # a text stands for itself by its digest where it is only compared: texts are shuffled once
    keyed = d.select("doc_id", "lang", "source", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("_key"))
    m = keyed.groupBy("lang", "source", "_key").agg(F.count(F.lit(1)).alias("count"), F.first("text").alias("text"))
    # identical texts of one crop have identical keywords: one value per (crop, text)
    kwt = (keyed.select("doc_id", "lang", "_key").join(kw, ["lang", "doc_id"])
           .groupBy("lang", "_key").agg(F.min("kw").alias("top_keywords")))
    return m.join(kwt, ["lang", "_key"], "left").select(
        *columns, F.coalesce(F.col("top_keywords"), F.lit("")).alias("top_keywords"))


def _mapping_sql():
    from quarry.plans.text_queries import _DOCS_SQL, _WORDS, _tfidf_sql
    return f"""{_DOCS_SQL}, {_tfidf_sql(_WORDS)},
kwr AS (SELECT lang, doc_id, term, row_number() OVER (PARTITION BY lang, doc_id ORDER BY w DESC, term) AS rn FROM wt),
kwd AS (SELECT lang, doc_id, string_agg(term, ', ' ORDER BY rn) AS kw FROM kwr WHERE rn <= 5 GROUP BY ALL),
kwt AS (SELECT dd.lang, dd.text, min(k.kw) AS kw FROM documents dd JOIN kwd k ON dd.doc_id = k.doc_id AND dd.lang = k.lang
        GROUP BY dd.lang, dd.text),
mapping AS (
  SELECT m.lang AS crop, m.text AS query_text,
         CASE WHEN m.source = 'src0' THEN -1 ELSE CAST(substr(m.source, 4) AS INTEGER) END AS cluster_id,
         m.count, coalesce(kwt.kw, '') AS top_keywords
  FROM (SELECT lang, source, text, count(*) AS count FROM documents GROUP BY lang, source, text) m
  LEFT JOIN kwt ON m.lang = kwt.lang AND m.text = kwt.text)"""


def _summary_sql():
    return f"""{_mapping_sql()},
clean AS (SELECT * FROM mapping WHERE cluster_id <> -1),
rep AS (SELECT crop, cluster_id, query_text AS representative FROM (
  SELECT crop, cluster_id, query_text,
         row_number() OVER (PARTITION BY crop, cluster_id ORDER BY count DESC, query_text) AS rn FROM clean)
  WHERE rn = 1),
kw0 AS (SELECT crop, cluster_id, trim(k, {_WS}) AS kw FROM (
  SELECT crop, cluster_id, unnest(string_split(top_keywords, ',')) AS k FROM clean
  WHERE length(coalesce(top_keywords, '')) > 0)),
kw1 AS (SELECT crop, cluster_id, kw, count(*) AS n FROM kw0 GROUP BY ALL),
kw2 AS (SELECT *, row_number() OVER (PARTITION BY crop, cluster_id ORDER BY n DESC, kw) AS r FROM kw1),
kws AS (SELECT crop, cluster_id, string_agg(kw, ', ' ORDER BY r) AS top_keywords FROM kw2 WHERE r <= 5 GROUP BY ALL),
summ AS (
  SELECT c.crop, c.cluster_id, CAST(sum(c.count) AS BIGINT) AS size, count(*) AS unique_queries
  FROM clean c GROUP BY c.crop, c.cluster_id),
summary AS (
  SELECT s.*, r.representative, coalesce(k.top_keywords, '') AS top_keywords
  FROM summ s JOIN rep r USING (crop, cluster_id) LEFT JOIN kws k USING (crop, cluster_id))"""


@register("g15_cluster_summary", sql=f"WITH {_summary_sql()}\nSELECT * FROM summary")
def g15_cluster_summary(spark, sf):
    """Size, unique texts, representative text and top-5 keywords per cluster."""
    return faq.cluster_summary(mapping(spark, sf, keywords=True)).select(
        "crop", "cluster_id", "size", "unique_queries", "representative", "top_keywords")


@register("g19_crop_report", sql=f"""WITH {_mapping_sql()}
SELECT crop, CAST(sum(count) AS BIGINT) AS total_queries, count(*) AS unique_queries,
       count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS total_clusters
FROM mapping GROUP BY crop""")
def g19_crop_report(spark, sf):
    return faq.crop_report(mapping(spark, sf))


_THEMES_SQL = f"""{_summary_sql()},
tot AS (SELECT crop, sum(count) AS crop_total FROM mapping GROUP BY crop),
th AS (SELECT s.crop, row_number() OVER (PARTITION BY s.crop ORDER BY s.size DESC, s.cluster_id) AS theme_rank,
              s.representative AS question, s.size AS count, {pct_sql('s.size', 't.crop_total')} AS percentage
       FROM summary s JOIN tot t USING (crop))"""


def _themes(spark, sf):
    m = mapping(spark, sf)
    summ = faq.cluster_summary(m, with_keywords=False)
    totals = faq.crop_report(m).select("crop", F.col("total_queries").alias("crop_total"))
    return faq.faq_themes(summ, crop_totals=totals)


@register("g18_faq_themes", sql=f"WITH {_THEMES_SQL}\nSELECT crop, CAST(theme_rank AS INTEGER) AS theme_rank, question, count, percentage FROM th WHERE theme_rank <= 5")
def g18_faq_themes(spark, sf):
    """Per crop the five largest clusters with their share of the whole crop."""
    return _themes(spark, sf)


@register("g20_faq_index", sql=f"""WITH {_THEMES_SQL}
SELECT crop, CAST(sum(count) AS BIGINT) AS total_queries, count(*) AS n_themes,
       arg_min(question, theme_rank) AS top_question,
       replace(replace(regexp_replace(crop, '[()]', '', 'g'), '/', '_'), ' ', '_') || '_faq.csv' AS csv_file
FROM th WHERE theme_rank <= 5 GROUP BY crop""")
def g20_faq_index(spark, sf):
    """FAQ index per crop (sum of its theme counts, themes, top question, file)."""
    return faq.faq_index(_themes(spark, sf))


def _runs(spark, sf):
    """Two clustering runs of the same texts appended (by source, by length)."""
    a = mapping(spark, sf).withColumn("Experiment", F.lit("by_source"))
    d = table(spark, sf, "documents")
    b = (d.groupBy("lang", "text", "n_chars").agg(F.count(F.lit(1)).alias("count"))
         .select(F.col("lang").alias("crop"), F.col("text").alias("query_text"),
                 F.floor(F.col("n_chars") / 500).cast("int").alias("cluster_id"), "count")
         .withColumn("Experiment", F.lit("by_length")))
    cols = ["Experiment", "crop", "query_text", "cluster_id", "count"]
    return a.select(*cols).unionByName(b.select(*cols))


_RUNS_SQL = f"""{_mapping_sql()},
runs AS (
  SELECT 'by_source' AS Experiment, crop, query_text, cluster_id, count FROM mapping
  UNION ALL
  SELECT 'by_length', lang, text, CAST(n_chars // 500 AS INTEGER), count(*) FROM documents GROUP BY lang, text, n_chars),
vol AS (SELECT Experiment, crop, cluster_id, CAST(sum(count) AS BIGINT) AS vol FROM runs WHERE cluster_id <> -1 GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY Experiment, crop ORDER BY vol DESC, cluster_id) AS BIGINT) AS rank,
              sum(vol) OVER (PARTITION BY Experiment, crop ORDER BY vol DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
              sum(vol) OVER (PARTITION BY Experiment, crop) AS total FROM vol),
tx AS (SELECT Experiment, crop, cluster_id, string_agg(query_text, ' || ' ORDER BY r) AS top_5_queries FROM (
  SELECT *, row_number() OVER (PARTITION BY Experiment, crop, cluster_id ORDER BY count DESC, query_text) AS r
  FROM runs WHERE cluster_id <> -1) WHERE r <= 5 GROUP BY ALL),
matrix AS (
  SELECT rk.Experiment, rk.crop, rk.rank AS cluster_id, rk.vol AS queries_in_cluster,
         {np_round_sql(pct_sql('rk.vol', 'rk.total'), 2)} AS pct_of_crop,
         {np_round_sql(pct_sql('rk.cum', 'rk.total'), 2)} AS cumulative_pct, tx.top_5_queries
  FROM rk JOIN tx USING (Experiment, crop, cluster_id))"""


@register("w3_cluster_matrix", sql=f"WITH {_RUNS_SQL}\nSELECT * FROM matrix")
def w3_cluster_matrix(spark, sf):
    """W3 + W4 + U2: per (run, crop) clusters re-ranked by volume with shares and top-5 texts."""
    return faq.cluster_matrix(_runs(spark, sf))


@register("w5_clusters_to_85", sql=f"""WITH {_RUNS_SQL},
reach AS (SELECT crop, Experiment, min(cluster_id) AS clusters_to_85 FROM matrix WHERE cumulative_pct >= 85.0 GROUP BY ALL),
grid AS (SELECT c.crop, e.Experiment FROM (SELECT DISTINCT crop FROM matrix) c, (SELECT DISTINCT Experiment FROM matrix) e)
SELECT g.crop, g.Experiment, r.clusters_to_85 FROM grid g LEFT JOIN reach r USING (crop, Experiment)""")
def w5_clusters_to_85(spark, sf):
    """W5 + J4: clusters needed for 85 % per (crop, run); null where never reached."""
    return faq.clusters_to_threshold(faq.cluster_matrix(_runs(spark, sf)), 85.0)


@register("p5_reached_clusters", sql=f"""WITH {_RUNS_SQL},
reach AS (SELECT crop, Experiment, min(cluster_id) AS clusters_to_85 FROM matrix WHERE cumulative_pct >= 85.0 GROUP BY ALL)
SELECT crop, Experiment, CAST(clusters_to_85 AS INTEGER) AS clusters_to_85 FROM reach""")
def p5_reached_clusters(spark, sf):
    """P5: the grid of W5 with a run that never took place; pairs that never reach 85 % go."""
    matrix = faq.cluster_matrix(_runs(spark, sf))
    return faq.reached_only(faq.clusters_to_threshold(
        matrix, 85.0, experiments=["by_length", "by_source", "not_run"]))


@register("k3_question_lists", sql=f"""WITH {_RUNS_SQL}
SELECT r.Experiment, r.crop, rk.rank AS cluster_id, r.query_text AS full_querytext
FROM runs r JOIN rk USING (Experiment, crop, cluster_id)""")
def k3_question_lists(spark, sf):
    """K3: the per-crop question lists of every run, each text with its re-ranked cluster."""
    return faq.question_list(_runs(spark, sf))


@register("k2_crop_faq_documents", sql=f"""WITH {_THEMES_SQL},
docs_of AS (SELECT crop, list({{'question': question, 'count': count, 'percentage': {np_round_sql('percentage', 2)}}}
                              ORDER BY theme_rank) AS faqs FROM th WHERE theme_rank <= 50 GROUP BY crop)
SELECT t.crop, to_json({{'name': t.crop,
    'filename': replace(replace(regexp_replace(t.crop, '[()]', '', 'g'), '/', '_'), ' ', '_'),
    'queries': CAST(t.crop_total AS BIGINT), 'faqs': coalesce(d.faqs, [])}})::VARCHAR AS value
FROM tot t LEFT JOIN docs_of d USING (crop)""")
def k2_crop_faq_documents(spark, sf):
    """K2 + G18: the dashboard's document of every crop: name, file name, calls and its 50 largest themes."""
    from quarry.sources.sinks import crop_documents
    m = mapping(spark, sf)
    totals = faq.crop_report(m).select("crop", "total_queries")
    themes = faq.faq_themes(faq.cluster_summary(m, with_keywords=False), k=50,
                            crop_totals=totals.withColumnRenamed("total_queries", "crop_total"))
    return crop_documents(themes, totals)


@register("o1_sorted_mapping", sql=f"WITH {_mapping_sql()}\nSELECT query_text, cluster_id, count FROM mapping ORDER BY cluster_id, count DESC, query_text")
def o1_sorted_mapping(spark, sf):
    """O1: mapping sorted by cluster asc, count desc (range-partitioned sort)."""
    return (mapping(spark, sf).select("query_text", "cluster_id", "count")
            .orderBy(F.asc("cluster_id"), F.desc("count"), F.asc("query_text")))


# --- run-log summary (the Leiden log parser) ---------------------------------------
# Fixed value: the log line format and its pattern.
RUN_LINE = "[%d/%d] %s: %d clusters (%d cover 85%%)"
RUN_PATTERN = r"\[\d+/\d+\] (.*?): (\d+) clusters \((\d+) cover 85%\)"


def _calls(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("crop"))
    return li.join(p, "l_partkey")


def run_log(spark, sf):
    """S4 input derived by Spark: one text line per crop (crop = part name, cluster =
    part).  Names before 'm' are logged upper-cased with a trailing blank (found by
    J1), the others by their first word only (found by the J2 substring fallback)."""
    calls = _calls(spark, sf)
    vols = calls.groupBy("crop", "l_partkey").agg(F.count(F.lit(1)).alias("vol"))
    ranked = prefix_rank(vols, "vol", ["l_partkey"], ["crop"])
    per = ranked.groupBy("crop").agg(
        F.max("n_types").alias("c"),
        F.min(F.when((F.col("cum_size").cast("double") / F.col("total").cast("double")) * 100.0 >= 85.0,
                     F.col("rank"))).alias("m"))
    w = Window.orderBy("crop")  # one row per crop: a small, bounded window
    name = F.when(F.col("crop") < "m", F.concat(F.upper("crop"), F.lit(" "))) \
        .otherwise(F.split("crop", " ").getItem(0))
    return per.select(F.format_string(RUN_LINE, F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy()),
                                      name, F.col("c"), F.col("m")).alias("value"))


def parse_run_log(lines):
    """S4 + F10 + F23: keep matching lines, capture name and the two numbers."""
    ok = lines.where(F.col("value").rlike(RUN_PATTERN))
    return ok.select(
        F.col("value").alias("line_id"),  # lines are unique ([i/n] prefix)
        py_strip(F.regexp_extract("value", RUN_PATTERN, 1)).alias("crop"),
        F.regexp_extract("value", RUN_PATTERN, 2).cast("bigint").alias("total_clusters"),
        F.regexp_extract("value", RUN_PATTERN, 3).cast("bigint").alias("clusters_for_85pct"))


@register("s4_run_log_summary", sql=rf"""WITH calls AS (
  SELECT p.p_name AS crop, l.l_partkey, l.l_orderkey FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
summary AS (SELECT crop, count(*) AS total_queries, count(DISTINCT l_orderkey) AS unique_queries FROM calls GROUP BY crop),
cl AS (SELECT crop, l_partkey, count(*) AS vol FROM calls GROUP BY crop, l_partkey),
rk AS (SELECT crop, row_number() OVER (PARTITION BY crop ORDER BY vol DESC, l_partkey) AS rank,
         sum(vol) OVER (PARTITION BY crop ORDER BY vol DESC, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         sum(vol) OVER (PARTITION BY crop) AS total, count(*) OVER (PARTITION BY crop) AS n FROM cl),
per AS (SELECT crop, max(n) AS c,
          min(CASE WHEN (CAST(cum AS DOUBLE) / CAST(total AS DOUBLE)) * 100.0 >= 85.0 THEN rank END) AS m
        FROM rk GROUP BY crop),
lines AS (SELECT '[' || row_number() OVER (ORDER BY crop) || '/' || count(*) OVER () || '] ' ||
            CASE WHEN crop < 'm' THEN upper(crop) || ' ' ELSE split_part(crop, ' ', 1) END ||
            ': ' || c || ' clusters (' || m || ' cover 85%)' AS line FROM per),
parsed AS (SELECT line AS line_id,
    trim(regexp_extract(line, '{RUN_PATTERN}', 1), {_WS}) AS crop,
    CAST(regexp_extract(line, '{RUN_PATTERN}', 2) AS BIGINT) AS total_clusters,
    CAST(regexp_extract(line, '{RUN_PATTERN}', 3) AS BIGINT) AS clusters_for_85pct
  FROM lines WHERE regexp_matches(line, '{RUN_PATTERN}')),
j1 AS (SELECT p.*, coalesce(s.total_queries, 0) AS tq, coalesce(s.unique_queries, 0) AS uq
       FROM parsed p LEFT JOIN summary s
       ON trim(lower(p.crop), {_WS}) = trim(lower(s.crop), {_WS})),
j2 AS (SELECT j.line_id, arg_min(s.total_queries, s.crop) AS tq2, arg_min(s.unique_queries, s.crop) AS uq2
       FROM j1 j JOIN summary s
       ON contains(trim(lower(j.crop), {_WS}), trim(lower(s.crop), {_WS}))
       OR contains(trim(lower(s.crop), {_WS}), trim(lower(j.crop), {_WS}))
       WHERE j.tq = 0 GROUP BY j.line_id)
SELECT j1.crop, CAST(CASE WHEN tq <> 0 THEN tq ELSE coalesce(tq2, 0) END AS BIGINT) AS total_queries,
       CAST(CASE WHEN tq <> 0 THEN uq ELSE coalesce(uq2, 0) END AS BIGINT) AS unique_queries,
       total_clusters, clusters_for_85pct
FROM j1 LEFT JOIN j2 USING (line_id)""")
def s4_run_log_summary(spark, sf):
    """S4 + J1 + J2: parse the run log and attach each crop's totals by normalised
    name, falling back to the first substring match in table (crop) order."""
    calls = _calls(spark, sf)
    summary = calls.groupBy("crop").agg(F.count(F.lit(1)).alias("total_queries"),
                                        F.countDistinct("l_orderkey").alias("unique_queries"))
    parsed = parse_run_log(run_log(spark, sf))
    out = lookup_with_fallback(parsed, "line_id", "crop", summary.withColumn("_ord", F.col("crop")),
                               "crop", "_ord", ["total_queries", "unique_queries"], "total_queries")
    return out.select("crop", F.col("total_queries").cast("bigint"), F.col("unique_queries").cast("bigint"),
                      "total_clusters", "clusters_for_85pct")
