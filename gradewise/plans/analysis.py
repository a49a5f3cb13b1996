"""Analysis queries: features of all documents (M1-M5), classifiers on the labelled ones
(M6-M9), embeddings (M10) and labels (M11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import seeded_sql
from ..operators import analysis as M
from ..operators import layers as N
from ..session import table
from ..sources.io import scratch_path
from .puzzles import _RENDER_SQL, corpus
from .registry import register


def labelled_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    return d.join(lab, "doc_id")


def all_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _m1_sql() -> str:
    punct = M.PUNCTUATION.replace("'", "''")
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in M.STOP_WORDS)
    cleaned = f"translate(lower(text), '{punct}', '')"
    toks = (f"(CASE WHEN regexp_replace({cleaned}, '^\\s+|\\s+$', '', 'g') = '' THEN CAST([] AS VARCHAR[]) "
            f"ELSE string_split_regex(regexp_replace({cleaned}, '^\\s+|\\s+$', '', 'g'), '\\s+') END)")
    return f"""
WITH d AS (SELECT doc_id, list_filter({toks}, lambda t: NOT list_contains([{stops}], t)) AS tokens
           FROM documents)
SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM d"""


@register("M1", _m1_sql())
def m1_clean_text(spark, sf):
    """Cleaned tokens without stop words."""
    t = M.clean_tokens(all_docs(spark, sf), "text")
    return t.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                    F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def _features(docs, method, vocab=5000):
    d = M.length_features(M.clean_tokens(docs, "text"), "text")
    return M.feature_pipeline(method=method, vocab=vocab).fit(d).transform(d)


_TERMS_SQL = _m1_sql().split("SELECT doc_id, len(tokens)")[0] + """,
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term)
"""


@register("M2", _TERMS_SQL + """
SELECT d.doc_id, CAST(count(t.term) AS BIGINT) AS n_terms,
       round(coalesce(sqrt(sum(power(t.tf * ln(((SELECT count(*) FROM d) + 1.0) / (f.df + 1.0)), 2))), 0.0), 6) AS norm
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN f USING (term) GROUP BY d.doc_id""")
def m2_tfidf(spark, sf):
    """TF-IDF vectors before normalisation: terms and Euclidean length."""
    docs = M.clean_tokens(all_docs(spark, sf), "text").select("doc_id", "tokens")
    found = M.term_weights(docs, "doc_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_terms"), F.round(F.coalesce("length", F.lit(0.0)), 6).alias("norm"))


@register("M3", _TERMS_SQL + """
SELECT d.doc_id, CAST(count(t.term) AS BIGINT) AS n_terms, CAST(coalesce(sum(t.tf), 0) AS DOUBLE) AS n_counted
FROM d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id""")
def m3_bag_of_words(spark, sf):
    """Bag of words: terms and counted words of each document."""
    docs = M.clean_tokens(all_docs(spark, sf), "text").select("doc_id", "tokens")
    found = M.term_counts(docs, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("total"))
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_terms"), F.coalesce("total", F.lit(0)).cast("double").alias("n_counted"))


@register("M4", "SELECT doc_id, length(text) AS n_chars_text, "
          "len(CASE WHEN trim(text) = '' THEN [] ELSE string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') END) AS n_words_text "
          "FROM documents")
def m4_length_features(spark, sf):
    f = M.length_features(all_docs(spark, sf), "text")
    return f.select("doc_id", "n_chars_text", "n_words_text")


@register("M5", _TERMS_SQL + """
SELECT doc_id, CAST(least((SELECT count(*) FROM f), 5000) + 2 AS INT) AS dim,
       CAST(length(text) + len(CASE WHEN trim(text) = '' THEN [] ELSE string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') END) AS DOUBLE) AS lengths
FROM documents""")
def m5_combined(spark, sf):
    """TF-IDF + length features assembled into one vector (vocabulary <= 5000 terms + 2)."""
    from pyspark.ml.functions import vector_to_array
    f = _features(all_docs(spark, sf), "tfidf").select("doc_id", vector_to_array("features").alias("v"))
    return f.select("doc_id", F.size("v").alias("dim"), (F.element_at("v", -2) + F.element_at("v", -1)).alias("lengths"))


FIELDS = ["quiz", "solution_text"]


def _field_sql(f: str) -> str:
    """CTEs with a field's tokens, lengths, terms and weights by puzzle."""
    punct = M.PUNCTUATION.replace("'", "''")
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in M.STOP_WORDS)
    return f""",
{f}_d AS (SELECT k, len(string_split({f}, ' ')) AS wordlength, length({f}) AS charlength,
          list_filter(string_split_regex(trim(translate(lower({f}), '{punct}', '')), '\\s+'), lambda t: NOT list_contains([{stops}], t)) AS tokens FROM fin),
{f}_t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(tokens) AS term FROM {f}_d) GROUP BY ALL),
{f}_f AS (SELECT term, ln(((SELECT count(*) FROM {f}_d) + 1.0) / (count(*) + 1.0)) AS idf FROM {f}_t GROUP BY term),
{f}_w AS (SELECT k, sum(tf) AS bow, CASE WHEN sum(power(tf * idf, 2)) > 0 THEN sum(tf * idf) / sqrt(sum(power(tf * idf, 2))) ELSE 0 END AS tfidf
          FROM {f}_t JOIN {f}_f USING (term) GROUP BY k)"""


@register("M5_fields", "WITH " + _RENDER_SQL + "".join(map(_field_sql, FIELDS)) + """
SELECT k, CAST(2 * (SELECT count(*) FROM quiz_f) + 2 * (SELECT count(*) FROM solution_text_f) + 4 AS INT) AS dim,
       round(coalesce(a.tfidf, 0.0), 6) AS quiz_tfidf, CAST(coalesce(a.bow, 0) AS DOUBLE) AS quiz_bow,
       CAST(quiz_d.wordlength AS DOUBLE) AS quiz_wordlength, CAST(quiz_d.charlength AS DOUBLE) AS quiz_charlength,
       round(coalesce(b.tfidf, 0.0), 6) AS solution_text_tfidf, CAST(coalesce(b.bow, 0) AS DOUBLE) AS solution_text_bow,
       CAST(solution_text_d.wordlength AS DOUBLE) AS solution_text_wordlength, CAST(solution_text_d.charlength AS DOUBLE) AS solution_text_charlength
FROM quiz_d JOIN solution_text_d USING (k) LEFT JOIN quiz_w a USING (k) LEFT JOIN solution_text_w b USING (k)""")
def m5_fields(spark, sf):
    """All methods over two fields of the puzzles in one vector: its width, and the sum of the entries
    of every method and field."""
    from pyspark.ml.functions import vector_to_array
    path = scratch_path(spark, "m5_puzzles")
    # tokens and lengths are read by every fit
    M.field_columns(corpus(spark, sf).select("k", *FIELDS), FIELDS).drop(*FIELDS).write.parquet(path)
    d = spark.read.parquet(path)
    model = M.combined_features(FIELDS).fit(d)
    sizes = [len(stage.vocabulary) for stage in model.stages if hasattr(stage, "vocabulary")]
    v = model.transform(d).select("k", vector_to_array("features").alias("v"))
    sums, at = [], 1
    for f, n in zip(FIELDS, sizes):
        for method, width in zip(M.METHODS, (n, n, 1, 1)):
            part = F.aggregate(F.slice("v", at, width), F.lit(0.0), lambda total, x: total + x)
            sums.append((F.round(part, 6) if method == "tfidf" else part).alias(f"{f}_{method}"))
            at += width
    return v.select("k", F.size("v").alias("dim"), *sums)


_M6_SQL = f"""
WITH d AS (SELECT doc_id, quality AS label FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {seeded_sql('doc_id', 42)}, doc_id) - 1 AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM d)
"""


@register("M6", _M6_SQL + "SELECT doc_id, label FROM r WHERE rk < (SELECT min(n) FROM r)")
def m6_balance_classes(spark, sf):
    d = labelled_docs(spark, sf).select("doc_id", "label")
    return M.balance_classes(d, "label", "doc_id").select("doc_id", "label")


@register("M7", f"""
WITH d AS (SELECT doc_id, quality AS label FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {seeded_sql('doc_id', 43)}, doc_id) - 1 AS rk,
             count(*) OVER (PARTITION BY label) AS n FROM d)
SELECT doc_id, label, CASE WHEN rk < floor(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def m7_stratified_split(spark, sf):
    d = labelled_docs(spark, sf).select("doc_id", "label")
    return M.stratified_split(d, "label", "doc_id").select("doc_id", "label", "split")


def _m8(spark, sf):
    """Balance and split by keys and labels alone; texts and vectors are joined to the result."""
    docs = labelled_docs(spark, sf)
    split = M.stratified_split(M.balance_classes(docs.select("doc_id", "label"), "label", "doc_id"), "label", "doc_id")
    sp = _features(docs, "tfidf").select("doc_id", "features").join(split, "doc_id")
    return M.fit_and_report(sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test"))


@register("M8")
def m8_classifier(spark, sf):
    """Logistic regression on balanced TF-IDF features; accuracy, AUC, per-class metrics; rows-only."""
    return _m8(spark, sf)


@register("M9")
def m9_result_log(spark, sf):
    """Append the run's metrics to a result log (parquet, append mode) and read it back; rows-only."""
    path = scratch_path(spark, "m9_results")
    rep = _m8(spark, sf).withColumn("run", F.lit("tfidf_quality"))
    rep.write.mode("append").parquet(path)
    return spark.read.parquet(path)


LAYERS = [16] * 4  # lengths of the slices of an embedding


@register("M10")
def m10_per_layer(spark, sf):
    """One classifier per 'layer' (16-value slices of the 64-d embeddings), label 0 vs rest, all fitted
    together; rows-only, a test compares with separate fits."""
    slices = F.array(*[F.slice("embedding", sum(LAYERS[:i]) + 1, d).cast("array<double>") for i, d in enumerate(LAYERS)])
    e = table(spark, sf, "embeddings").select("vec_id", slices.alias("features"), (F.col("label") == 0).cast("double").alias("y"))
    path = scratch_path(spark, "m10_layers")
    split = M.stratified_split(e.select("vec_id", "y"), "y", "vec_id").select("vec_id", "split")
    e.join(split, "vec_id").write.parquet(path)
    rows = spark.read.parquet(path)
    models = N.fit_layers(rows.filter(F.col("split") == "train"), LAYERS, label="y")
    rep = M.report(N.layer_predictions(rows, models, label="y", keep=("split",)), by=("split", "layer"))
    return rep.filter(F.col("metric").isin("accuracy", "auc")).select("split", "cls", "metric", "value", "layer")


@register("M11", """
SELECT doc_id, quality = 1 AS clean_correct, toxic = 0 AS perturbed_correct,
       CAST(quality = 1 AND toxic = 0 AS INT) AS robust_metric
FROM labels JOIN documents USING (doc_id)""")
def m11_consistency(spark, sf):
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id")
    clean = lab.select("doc_id", (F.col("quality") == 1).alias("correct"))
    pert = lab.select("doc_id", (F.col("toxic") == 0).alias("correct"))
    return M.consistency_label(clean, pert, "doc_id")
