"""Text cleaning and TF-IDF features over whole documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.numeric import np_round
from quarry.functions.text import STOP_WORDS, clean_tokens, valid_tokens
from quarry.operators import tfidf
from quarry.operators.words import word_counts
from quarry.plans.registry import register
from quarry.plans.saturation_queries import clean_tokens_sql
from quarry.plans.standins import np_round_sql
from quarry.session import stored
from quarry.sources.tables import table

_TOK = clean_tokens_sql("text", STOP_WORDS)


def cleaned_docs(spark, sf):
    """F11 + F4: cleaned tokens of every document with non-empty cleaned text."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return valid_tokens(d, "text", "tokens").drop("text")


_DOCS_SQL = f"""d0 AS (SELECT doc_id, lang, source, {_TOK} AS tokens FROM documents),
docs AS (SELECT * FROM d0 WHERE len(tokens) > 0)"""


@register("f11_clean_text", sql=f"""WITH {_DOCS_SQL}
SELECT doc_id, array_to_string(tokens, ' ') AS cleaned_text FROM d0""")
def f11_clean_text(spark, sf):
    """lower, letters only, collapsed blanks, stop words removed (every doc)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(clean_tokens("text"), " ").alias("cleaned_text"))


@register("f12_word_counts", sql=f"""WITH {_DOCS_SQL}
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_words, len(tokens) > 0 AS valid FROM d0""")
def f12_word_counts(spark, sf):
    """F12 + F4: words of the cleaned text and the non-empty flag."""
    d = table(spark, sf, "documents").select("doc_id", clean_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_words"), (F.size("t") > 0).alias("valid"))


def _tfidf_sql(terms: str, group: str = "lang", max_df: str = "0.95", min_df: str = "2",
               max_features: int = 1000, src: str = "docs", id_col: str = "doc_id") -> str:
    gp = f"PARTITION BY {group} " if group else ""
    g = f"{group}, " if group else ""
    using = f"USING ({group})" if group else "ON true"
    return f"""t0 AS (SELECT {g}{id_col}, {terms} AS terms FROM {src}),
nd AS (SELECT {g}count(*) AS n_docs FROM t0 {'GROUP BY ' + group if group else ''}),
ex AS (SELECT {g}{id_col}, unnest(terms) AS term FROM t0),
tf AS (SELECT {g}{id_col}, term, count(*) AS tf FROM ex GROUP BY ALL),
st AS (SELECT {g}term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL),
kept AS (SELECT st.*, nd.n_docs FROM st JOIN nd {using}
         WHERE df <= CAST({max_df} AS DOUBLE) * n_docs AND df >= {min_df}),
top AS (SELECT * FROM (SELECT *, row_number() OVER ({gp}ORDER BY total DESC, term) AS r FROM kept)
        WHERE r <= {max_features}),
vocab AS (SELECT {g}term, df, ln(CAST(1 + n_docs AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1.0 AS idf,
                 CAST(row_number() OVER ({gp}ORDER BY term) - 1 AS INTEGER) AS feature_index FROM top),
wt AS (SELECT {'tf.' + group + ', ' if group else ''}tf.{id_col}, tf.term, v.feature_index, tf.tf, tf.tf * v.idf AS w
       FROM tf JOIN vocab v {'USING (' + group + ', term)' if group else 'USING (term)'})"""


_WORDS = "list_filter(tokens, lambda t: length(t) >= 2)"


def _word_tfidf(spark, sf, ngram=(1, 1)):
    if ngram == (1, 1):
        texts = table(spark, sf, "documents").select("doc_id", "lang", "text")
        return tfidf.fit_counts(word_counts(texts, "text", STOP_WORDS, 2), "doc_id", ["lang"])
    d = cleaned_docs(spark, sf).withColumn("terms", tfidf.word_terms(F.col("tokens"), ngram))
    return tfidf.fit_tfidf(d, "doc_id", "terms", ["lang"])


@register("m1_tfidf_vocabulary", sql=f"""WITH {_DOCS_SQL}, {_tfidf_sql(_WORDS)}
SELECT lang, term, df, {np_round_sql('idf', 6)} AS idf, feature_index FROM vocab""")
def m1_tfidf_vocabulary(spark, sf):
    """M1: per-crop (lang) vocabulary: max_features=1000, max_df=0.95, min_df=2."""
    vocab, _ = _word_tfidf(spark, sf)
    return vocab.select("lang", "term", "df", np_round("idf", 6).alias("idf"),
                        F.col("feature_index").cast("int"))


@register("m1_tfidf_weights", sql=f"""WITH {_DOCS_SQL}, {_tfidf_sql(_WORDS)}
SELECT lang, doc_id, term, feature_index, tf,
       {np_round_sql('w / sqrt(sum(w * w) OVER (PARTITION BY lang, doc_id))', 6)} AS weight FROM wt""")
def m1_tfidf_weights(spark, sf):
    """M1: L2-normalised TF-IDF weights in long form (doc, term)."""
    _, w = _word_tfidf(spark, sf)
    return w.select("lang", "doc_id", "term", F.col("feature_index").cast("int"), "tf",
                    np_round("weight", 6).alias("weight"))


_BIGRAMS = ("list_concat(list_filter(tokens, lambda t: length(t) >= 2), "
            "CASE WHEN len(list_filter(tokens, lambda t: length(t) >= 2)) >= 2 THEN "
            "list_transform(range(len(list_filter(tokens, lambda t: length(t) >= 2)) - 1), "
            "lambda i: array_to_string(list_slice(list_filter(tokens, lambda t: length(t) >= 2), i + 1, i + 2), ' ')) "
            "ELSE [] END)")


@register("m2_bigram_vocabulary", sql=f"""WITH {_DOCS_SQL}, {_tfidf_sql(_BIGRAMS)}
SELECT lang, term, df, {np_round_sql('idf', 6)} AS idf, feature_index FROM vocab""")
def m2_bigram_vocabulary(spark, sf):
    """M2: vocabulary of words and word bigrams (ngram_range=(1, 2))."""
    vocab, _ = _word_tfidf(spark, sf, (1, 2))
    return vocab.select("lang", "term", "df", np_round("idf", 6).alias("idf"),
                        F.col("feature_index").cast("int"))


_CHARS = ("list_concat(" + ", ".join(
    f"CASE WHEN length(ct) >= {n} THEN list_transform(range(length(ct) - {n} + 1), "
    f"lambda i: substr(ct, i + 1, {n})) ELSE [] END" for n in range(2, 6)) + ")")


@register("m3_char_vocabulary", sql=f"""WITH q AS (
  SELECT conv_id * 1000 + turn AS qid, regexp_replace(lower(coalesce(text, '')), '\\s\\s+', ' ', 'g') AS ct
  FROM conversations),
{_tfidf_sql(_CHARS, group='', max_df='0.95', min_df='5', src='q', id_col='qid')}
SELECT term, df, {np_round_sql('idf', 6)} AS idf, feature_index FROM vocab""")
def m3_char_vocabulary(spark, sf):
    """M3: character 2-5-gram vocabulary of all conversation turns (min_df=5)."""
    q = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"),
        tfidf.char_terms(F.col("text"), (2, 5)).alias("terms"))
    vocab, _ = tfidf.fit_tfidf(q, "qid", "terms", [], 1000, 0.95, 5)
    return vocab.select("term", "df", np_round("idf", 6).alias("idf"), F.col("feature_index").cast("int"))


@register("m4_top_keywords", sql=f"""WITH {_DOCS_SQL}, {_tfidf_sql(_WORDS)},
r AS (SELECT lang, doc_id, term, row_number() OVER (PARTITION BY lang, doc_id ORDER BY w DESC, term) AS rn FROM wt)
SELECT d0.lang, d0.doc_id, coalesce(string_agg(term, ', ' ORDER BY rn) FILTER (rn <= 5), '') AS top_keywords
FROM d0 LEFT JOIN r ON d0.doc_id = r.doc_id AND d0.lang IS NOT DISTINCT FROM r.lang GROUP BY ALL""")
def m4_top_keywords(spark, sf):
    """M4: five highest TF-IDF terms of every document (ties by term); none for a text without terms."""
    _, w = _word_tfidf(spark, sf)
    top = tfidf.top_terms(w, ["lang", "doc_id"], 5, table(spark, sf, "documents"))
    return top.select("lang", "doc_id", F.array_join("keywords", ", ").alias("top_keywords"))


@register("m5_length_zscore", sql=f"""WITH {_DOCS_SQL},
l AS (SELECT lang, doc_id, len(tokens) AS n_words FROM docs)
SELECT lang, doc_id, CAST(n_words AS INTEGER) AS n_words,
  {np_round_sql('CASE WHEN stddev_pop(n_words) OVER (PARTITION BY lang) = 0 THEN 0.0 ELSE (n_words - avg(n_words) OVER (PARTITION BY lang)) / stddev_pop(n_words) OVER (PARTITION BY lang) END', 6)} AS length_z
FROM l""")
def m5_length_zscore(spark, sf):
    """M5: word count z-score per crop with the population std."""
    # texts are cleaned once for the statistics and the scores
    d = stored(cleaned_docs(spark, sf).select("lang", "doc_id", F.size("tokens").alias("n_words")), "lengths")
    z = tfidf.length_zscore(d, "n_words", ["lang"])
    return z.select("lang", "doc_id", "n_words", np_round("length_z", 6).alias("length_z"))


@register("m6_one_hot_index", sql="""WITH c AS (
  SELECT DISTINCT 'lang' AS "column", 0 AS ci, coalesce(CAST(lang AS VARCHAR), 'Unknown') AS value FROM documents
  UNION ALL SELECT DISTINCT 'source', 1, coalesce(CAST(source AS VARCHAR), 'Unknown') FROM documents)
SELECT "column", value, CAST(row_number() OVER (ORDER BY ci, value) - 1 AS INTEGER) AS feature_index FROM c""")
def m6_one_hot_index(spark, sf):
    """M6: one-hot layout of (lang, source): sorted categories, null -> Unknown."""
    idx = tfidf.one_hot_index(table(spark, sf, "documents"), ["lang", "source"])
    return idx.select("column", "value", F.col("feature_index").cast("int"))


@register("j8_keyword_crops", sql=f"""WITH {_DOCS_SQL},
w AS (SELECT lang, unnest(tokens) AS word FROM docs),
wc AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
dict AS (SELECT word, lang AS crop FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM wc) WHERE r <= 10),
hits AS (SELECT DISTINCT d.doc_id, k.crop FROM (SELECT doc_id, unnest(tokens) AS word FROM docs) d JOIN dict k USING (word))
SELECT crop, count(DISTINCT doc_id) AS n_texts FROM hits GROUP BY crop""")
def j8_keyword_crops(spark, sf):
    """Keyword -> crop extraction.  The dictionary (top-10 words of every
    crop = lang) is joined to the tokens of every document (AQE broadcasts it
    when small) and distinct texts are counted per crop."""
    docs = cleaned_docs(spark, sf)
    wc = (docs.select("lang", F.explode("tokens").alias("word"))
          .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("word"))
    dic = (wc.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 10)
           .select("word", F.col("lang").alias("crop")))
    hits = (docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word"))
            .join(dic, "word").select("doc_id", "crop").distinct())
    return hits.groupBy("crop").agg(F.countDistinct("doc_id").alias("n_texts"))
