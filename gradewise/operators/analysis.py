"""Memorization / classification analysis (M1-M11) with Spark ML.

Features are Spark ML transformers fitted on the cluster (the vocabulary is
capped at 5000 terms, so the fitted model is small); whole vocabularies (M2, M3)
are long tables.  Per-label sampling
(class balancing, stratified split) ranks rows with a global range-partitioned
index instead of a per-label window, because a label is a huge group (two
classes hold all rows) and a window would put each class into one task.
"""

from __future__ import annotations

import string

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import words
from ..functions.common import seeded_draw
from .index import with_global_index

# ASCII punctuation removed before tokenising (Python's string.punctuation).
PUNCTUATION = string.punctuation

# Spark ML's default English stop-word list (StopWordsRemover,
# loadDefaultStopWords('english')), spelled out so SQL checks can use it too.
STOP_WORDS = [
    'i', 'me', 'my', 'myself', 'we', 'our', 'ours', 'ourselves', 'you', 'your', 'yours', 'yourself',
    'yourselves', 'he', 'him', 'his', 'himself', 'she', 'her', 'hers', 'herself', 'it', 'its',
    'itself', 'they', 'them', 'their', 'theirs', 'themselves', 'what', 'which', 'who', 'whom',
    'this', 'that', 'these', 'those', 'am', 'is', 'are', 'was', 'were', 'be', 'been', 'being',
    'have', 'has', 'had', 'having', 'do', 'does', 'did', 'doing', 'a', 'an', 'the', 'and', 'but',
    'if', 'or', 'because', 'as', 'until', 'while', 'of', 'at', 'by', 'for', 'with', 'about',
    'against', 'between', 'into', 'through', 'during', 'before', 'after', 'above', 'below', 'to',
    'from', 'up', 'down', 'in', 'out', 'on', 'off', 'over', 'under', 'again', 'further', 'then',
    'once', 'here', 'there', 'when', 'where', 'why', 'how', 'all', 'any', 'both', 'each', 'few',
    'more', 'most', 'other', 'some', 'such', 'no', 'nor', 'not', 'only', 'own', 'same', 'so',
    'than', 'too', 'very', 's', 't', 'can', 'will', 'just', 'don', 'should', 'now', "i'll",
    "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd",
    "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've",
    "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't",
    "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't",
    "couldn't", 'cannot', 'could', "here's", "how's", "let's", 'ought', "that's", "there's",
    "what's", "when's", "where's", "who's", "why's", 'would'
]


def clean_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """M1: lowercase, drop ASCII punctuation, split on whitespace, drop English
    stop words (Spark's list; it differs from NLTK's)."""
    cleaned = F.translate(F.lower(F.col(text)), PUNCTUATION, "")
    d = df.withColumn("_raw_tokens", words(cleaned))
    remover = StopWordsRemover(inputCol="_raw_tokens", outputCol=out, stopWords=STOP_WORDS)
    return remover.transform(d).drop("_raw_tokens")


def length_features(df: DataFrame, text: str) -> DataFrame:
    """M4: character and word counts."""
    return df.withColumn("n_chars_text", F.length(text)).withColumn("n_words_text", F.size(words(F.col(text))))


#: M5: what a field can give; in this order.
METHODS = ("tfidf", "bow", "wordlength", "charlength")


def field_columns(df: DataFrame, fields: list[str]) -> DataFrame:
    """Tokens and lengths of every text field, as ``combined_features`` needs them (null: empty)."""
    for f in fields:
        df = clean_tokens(df.withColumn(f"_{f}_text", F.coalesce(f, F.lit(""))), f"_{f}_text", f"_{f}_tokens")
        df = (df.withColumn(f"_{f}_wordlength", F.size(words(F.col(f"_{f}_text"))))
              .withColumn(f"_{f}_charlength", F.length(f"_{f}_text")).drop(f"_{f}_text"))
    return df


def combined_features(fields: list[str], methods: tuple[str, ...] = METHODS, vocab: int = 5000) -> Pipeline:
    """M5: the vectors of every method over every field side by side (field by field, methods in the
    order given), to be fitted on training rows alone.  A field's vocabulary is its ``vocab`` most
    frequent terms, so the fitted model stays small; TF-IDF is of length one over that vocabulary."""
    unknown = set(methods) - set(METHODS)
    if unknown or not fields or not methods:
        raise ValueError(f"methods are some of {METHODS}, and a field is needed; got {fields}, {methods}")
    stages, parts = [], []
    for f in fields:
        if {"tfidf", "bow"} & set(methods):
            stages.append(CountVectorizer(inputCol=f"_{f}_tokens", outputCol=f"_{f}_bow", vocabSize=vocab))
        if "tfidf" in methods:
            stages += [IDF(inputCol=f"_{f}_bow", outputCol=f"_{f}_weights"), Normalizer(inputCol=f"_{f}_weights", outputCol=f"_{f}_tfidf")]
        parts += [f"_{f}_{m}" for m in methods]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def feature_pipeline(tokens: str = "tokens", vocab: int = 5000, method: str = "tfidf") -> Pipeline:
    """M2 (tfidf: counts -> IDF -> L2 norm) / M3 (bag of words) / M5 (+ lengths)."""
    cv = CountVectorizer(inputCol=tokens, outputCol="bow", vocabSize=vocab)
    stages = [cv]
    feat = "bow"
    if method == "tfidf":
        stages += [IDF(inputCol="bow", outputCol="tf_idf"), Normalizer(inputCol="tf_idf", outputCol="tfidf_norm")]
        feat = "tfidf_norm"
    stages.append(VectorAssembler(inputCols=[feat, "n_chars_text", "n_words_text"], outputCol="features"))
    return Pipeline(stages=stages)


def term_counts(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """M3 over the whole vocabulary, as a long table: (key, term, tf) of every term of every document."""
    # on the column itself, explode would add a filter that makes the tokens a second time
    listed = F.coalesce(tokens, F.array().cast("array<string>"))
    return df.select(key, F.explode(listed).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_weights(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """M2 over the whole vocabulary, as a long table: (key, term, tf, weight), not normalised.
    The vocabulary is a table of the cluster; smoothing is that of Spark ML's IDF."""
    counts = term_counts(df, key, tokens)
    n = df.select(F.count(F.lit(1))).scalar()
    # counted by tf, which is never 0: with the same columns in both uses the counts are shuffled once
    idf = counts.groupBy("term").agg(F.log((n + 1.0) / (F.count_if(F.col("tf") > 0) + 1.0)).alias("idf"))
    return counts.join(idf, "term").select(key, "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))


def balance_classes(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """M6: keep min(count per label) rows of every label, chosen by a seeded order."""
    ranked = with_global_index(df.withColumn("_h", seeded_draw(key, seed)), [label, "_h", key], "_g")
    stats = ranked.groupBy(label).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
    m = stats.select(F.min("_n")).scalar()
    return (ranked.join(stats, label).filter(F.col("_g") - F.col("_first") < m)
                  .drop("_h", "_g", "_first", "_n"))


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """M7: the first floor(fraction * count) rows of each label (seeded order) are test."""
    ranked = with_global_index(df.withColumn("_h", seeded_draw(key, seed + 1)), [label, "_h", key], "_g")
    stats = ranked.groupBy(label).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
    j = ranked.join(stats, label)
    is_test = (F.col("_g") - F.col("_first")) < F.floor(F.col("_n") * test_fraction)
    return j.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_h", "_g", "_first", "_n")


def predictions(train: DataFrame, test: DataFrame, label: str = "label", features: str = "features",
                max_iter: int = 100) -> DataFrame:
    """M8: logistic regression fitted on ``train``; (split, y, prediction, probability to 6 places)
    of both."""
    model = LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter).fit(train)
    parts = [model.transform(data).select(
        F.lit(name).alias("split"), F.col(label).cast("double").alias("y"), "prediction",
        F.round(vector_to_array("probability")[1], 6).alias("probability")) for name, data in (("train", train), ("test", test))]
    return parts[0].unionByName(parts[1])


def report(found: DataFrame, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """M8: accuracy, AUC and per-class precision / recall / F1 / support of predictions, as a
    long table (*by, cls, metric, value); each combination of ``by`` has its own metrics.

    The AUC is the rank statistic from counts per probability, of which there are at most a
    million (six places), whatever the number of rows.
    """
    counts = found.groupBy(*by, "y", "prediction").agg(F.count(F.lit(1)).alias("c"))
    out = None
    for cls in (0.0, 1.0):
        true, said = F.col("y") == cls, F.col("prediction") == cls
        tp, fp, fn = (F.sum(F.when(x, F.col("c")).otherwise(0)) for x in (true & said, ~true & said, true & ~said))
        one = counts.groupBy(*by).agg(
            F.lit(str(int(cls))).alias("cls"), F.try_divide(tp, tp + fp).cast("double").alias("precision"),
            F.try_divide(tp, tp + fn).cast("double").alias("recall"),
            F.try_divide(2 * tp, 2 * tp + fp + fn).cast("double").alias("f1"), (tp + fn).cast("double").alias("support"))
        part = one.unpivot([*by, "cls"], ["precision", "recall", "f1", "support"], "metric", "value")
        out = part if out is None else out.unionByName(part)
    right = F.sum(F.when(F.col("y") == F.col("prediction"), F.col("c")).otherwise(0))
    accuracy = counts.groupBy(*by).agg(F.try_divide(right, F.sum("c")).cast("double").alias("value"))
    levels = found.groupBy(*by, "probability").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("neg"))
    below = Window.partitionBy(*by).orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    ranked = levels.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    auc = ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)),
                                                   F.sum("pos") * F.sum("neg")).cast("double").alias("value"))
    for metric, frame in (("accuracy", accuracy), ("auc", auc)):
        out = out.unionByName(frame.select(*by, F.lit("all").alias("cls"), F.lit(metric).alias("metric"), "value"))
    return out.select(*by, "cls", "metric", "value")


def fit_and_report(train: DataFrame, test: DataFrame, label: str = "label", features: str = "features",
                   max_iter: int = 100) -> DataFrame:
    return report(predictions(train, test, label, features, max_iter))


def consistency_label(clean: DataFrame, perturbed: DataFrame, key: str, correct: str = "correct") -> DataFrame:
    """M11 (our rule): consistently solved = solved both clean and perturbed."""
    c = clean.select(key, F.col(correct).alias("clean_correct"))
    p = perturbed.select(key, F.col(correct).alias("perturbed_correct"))
    return c.join(p, key).withColumn("robust_metric", (F.col("clean_correct") & F.col("perturbed_correct")).cast("int"))
