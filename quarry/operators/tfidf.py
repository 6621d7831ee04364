"""TF-IDF with scikit-learn's default semantics, as DataFrame jobs (M1-M5).

* analyzers: words of >= 2 characters (``(?u)\\b\\w\\w+\\b`` on cleaned text), word
  n-grams joined by one blank, character n-grams of the blank-collapsed text;
* vocabulary per group (``crop``): drop terms with df > max_df * n or df < min_df,
  keep the ``max_features`` largest total counts (ties by term);
* ``idf = ln((1 + n) / (1 + df)) + 1``, raw term counts, rows L2-normalised.

Everything stays in long form ``(group, doc, term, weight)``; the vocabulary is at
most ``max_features`` rows per group, so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import stored


def _shifted_concat(items: Column, n: int, sep: str) -> Column:
    """All windows of ``n`` consecutive items joined by ``sep``.

    Built from ``n`` shifted slices zipped together, so ``items`` is evaluated n
    times per row (not once per position, as a lambda over positions would be
    after Catalyst inlines the expression)."""
    if n == 1:
        return items
    m = F.size(items) - F.lit(n - 1)
    zipped = F.arrays_zip(*[F.slice(items, F.lit(k + 1), F.greatest(m, F.lit(0))).alias(f"p{k}")
                            for k in range(n)])
    out = F.transform(zipped, lambda z: F.concat_ws(sep, *[z[f"p{k}"] for k in range(n)]))
    return F.when(m > 0, out).otherwise(F.array().cast("array<string>"))


def word_terms(tokens: Column, ngram_range: tuple[int, int] = (1, 1), min_len: int = 2) -> Column:
    """Word analyzer over already-cleaned tokens: keep tokens of >= ``min_len``
    characters, then all n-grams for n in ``ngram_range``."""
    toks = F.filter(tokens, lambda t: F.length(t) >= min_len)
    lo, hi = ngram_range
    parts = [_shifted_concat(toks, n, " ") for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def char_terms(text: Column, ngram_range: tuple[int, int] = (2, 5)) -> Column:
    """Character analyzer ('char'): lower-case, collapse runs of white space, all
    substrings of length n in ``ngram_range`` (blanks included)."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s\s+", " ")
    chars = F.regexp_extract_all(t, F.lit("(?s)."), 0)
    lo, hi = ngram_range
    return F.concat(*[_shifted_concat(chars, n, "") for n in range(lo, hi + 1)])


def term_counts(terms: Column) -> Column:
    """(term, tf) of each distinct item of a sorted array: the distances of the places where a new one starts."""
    n = F.size(terms)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(terms, i - 2) != F.get(terms, i - 1)))
    ends = F.concat(F.slice(starts, 2, n), F.array(n + 1))
    return F.when(n > 0, F.zip_with(starts, ends, lambda a, b: F.struct(
        F.get(terms, a - 1).alias("term"), (b - a).cast("long").alias("tf"))))


def fit_tfidf(docs: DataFrame, id_col: str, terms_col: str, group_cols: Sequence[str] = (),
              max_features: int | None = 1000, max_df: float | int = 0.95,
              min_df: float | int = 2) -> tuple[DataFrame, DataFrame]:
    """Fit per group; returns ``(vocab, weights)``.

    ``vocab``: group, term, df, idf, feature_index (alphabetical, like sklearn).
    ``weights``: group, id, term, tf, weight (L2-normalised per document).
    ``docs`` holds one row per document with an array column of terms.
    """
    g = list(group_cols)
    # one pass over the texts, whose term counts are stored for the three readers below; a document's
    # terms stand in its row, so they are counted there and its distinct terms need no shuffle
    counted = docs.select(*g, id_col, F.sort_array(F.array_compact(terms_col)).alias("_sorted")) \
        .select(*g, id_col, term_counts(F.col("_sorted")).alias("_terms"))
    # posexplode_outer keeps documents without any term (null term) for the document count
    return fit_counts(counted.select(*g, id_col, F.posexplode_outer("_terms").alias("place", "_term"))
                      .select(*g, id_col, "place", "_term.term", "_term.tf"), id_col, g, max_features, max_df, min_df)


def fit_counts(counts: DataFrame, id_col: str, group_cols: Sequence[str] = (), max_features: int | None = 1000,
               max_df: float | int = 0.95, min_df: float | int = 2) -> tuple[DataFrame, DataFrame]:
    """:func:`fit_tfidf` of term counts: group, id, place, term, tf; a document without any term has one
    row with none, the others one with place 0."""
    g = list(group_cols)
    tf_all = stored(counts, "term-counts")
    n_docs = tf_all.groupBy(*g).agg(F.sum(F.when(F.coalesce("place", F.lit(0)) == 0, 1)).alias("n_docs"))
    tf = tf_all.where(F.col("term").isNotNull()).drop("place")
    stats = tf.groupBy(*g, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if g:  # one row per group: AQE broadcasts it when small
        stats = stats.join(n_docs, g)
    else:
        stats = stats.withColumn("n_docs", n_docs.select(F.max("n_docs")).scalar())
    max_c = F.lit(max_df) if isinstance(max_df, int) else F.lit(float(max_df)) * F.col("n_docs")
    min_c = F.lit(min_df) if isinstance(min_df, int) else F.lit(float(min_df)) * F.col("n_docs")
    kept = stats.where((F.col("df") <= max_c) & (F.col("df") >= min_c))
    if max_features is not None:
        w = Window.partitionBy(*g).orderBy(F.desc("total"), F.asc("term"))
        kept = kept.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_features).drop("_r")
    vocab = kept.select(
        *g, "term", "df",
        (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"),
        (F.row_number().over(Window.partitionBy(*g).orderBy("term")) - 1).alias("feature_index"))
    # vocabulary: <= max_features rows per group; hinted only for a single group
    v = vocab.select(*g, "term", "idf", "feature_index")
    wt = tf.join(v if g else F.broadcast(v), [*g, "term"])
    wt = wt.withColumn("_w", F.col("tf") * F.col("idf"))
    norm = Window.partitionBy(*g, id_col)
    weights = wt.select(*g, id_col, "term", "feature_index", "tf",
                        (F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(norm))).alias("weight"))
    return vocab, weights


def top_terms(weights: DataFrame, id_cols: Sequence[str], k: int = 5,
              docs: DataFrame | None = None) -> DataFrame:
    """M4: the ``k`` highest-weighted terms per document (ties by term) as an array.
    With ``docs``, each of its rows gets one, empty without any vocabulary term; else
    such documents are absent."""
    w = Window.partitionBy(*id_cols).orderBy(F.desc("weight"), F.asc("term"))
    top = weights.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    found = top.groupBy(*id_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda s: s["term"]).alias("keywords"))
    if docs is None:
        return found
    return docs.select(*id_cols).join(found, list(id_cols), "left").withColumn(
        "keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def length_zscore(df: DataFrame, count_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """M5: z-score with the POPULATION standard deviation; zero variance -> 0.
    Mean and deviation are grouped aggregates (partial, map-side) joined back as
    one row per group: no window holding a whole (possibly hot) group."""
    g = list(group_cols)
    if g:
        stats = df.groupBy(*g).agg(F.avg(count_col).alias("_mu"), F.stddev_pop(count_col).alias("_sd"))
        out = df.join(stats, g)  # one row per group: AQE broadcasts it when small
    else:  # global: two scalar subqueries
        out = df.withColumn("_mu", df.select(F.avg(count_col)).scalar()) \
                .withColumn("_sd", df.select(F.stddev_pop(count_col)).scalar())
    return out.withColumn("length_z", F.when(F.col("_sd") == 0, F.lit(0.0))
                          .otherwise((F.col(count_col) - F.col("_mu")) / F.col("_sd"))).drop("_mu", "_sd")


def one_hot_index(df: DataFrame, cols: Sequence[str], unknown: str = "Unknown") -> DataFrame:
    """M6: sklearn ``OneHotEncoder`` layout: per column its sorted categories (nulls
    as ``unknown``), feature index = column offset + position.  Returns the
    (column, value, feature_index) dictionary; join it to encode."""
    parts = [df.select(F.lit(c).alias("column"), F.lit(i).alias("_ci"),
                       F.coalesce(F.col(c).cast("string"), F.lit(unknown)).alias("value")).distinct()
             for i, c in enumerate(cols)]
    cats = parts[0]
    for p in parts[1:]:
        cats = cats.unionByName(p)
    # one row per category: a small, bounded window
    w = Window.orderBy("_ci", "value")
    return cats.select("column", "value", (F.row_number().over(w) - 1).alias("feature_index"))
