"""quarry — Spark-native analytics over large logs of short free-text questions.

Every public operator is a function ``DataFrame -> DataFrame`` built from the
DataFrame API, so Catalyst can prune, push down and re-plan it.  Sub-packages:

* ``sources``   — table scans (Parquet/CSV/JSON/text) and sinks
* ``functions`` — column expressions (text cleaning, labels, predicates)
* ``operators`` — aggregations, windows, joins, saturation curves, TF-IDF,
                  vectors, neighbours, clustering, quality scores
* ``plans``     — the registered end-to-end queries over the driver tables
* ``streaming`` — the same operators applied to a streaming source
"""

__all__ = ["session"]
