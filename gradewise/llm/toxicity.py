"""Toxicity by a counterfactually regularised linear classifier.

Features of a text are its distinct lower-cased words, their prefixes of PREFIXES letters,
and marks for prefixes that two or four distinct words share, hashed into 2**HASH_BITS
buckets.  Training takes a bounded sample of labelled documents, keeps the buckets whose
presence depends most on the label (at most MAX_FEATURES of them, a bound of the fitted model
like its sample) and those of all identity terms, and fits a logistic regression whose loss
has, besides the usual squared weights, a penalty on the squared change of the log-odds between
the two sentences of counterfactual pairs.  Naming a group then moves the score no more than
naming another, so neutral mentions are not rejected for the company that a group's name keeps
in toxic documents.

Pairs are made from the sentences of the sampled documents: every sentence that names a member
of an identity group against itself with each other member in its place; and, whatever the
corpus names, one sentence of each document (drawn by its hash) with one word (drawn alike) as a
slot, filled with two members of a drawn group.  ``train`` returns their number.

The sample: labelled documents whose id hashes below the share that gives ``max_train``
of them (20,000), chosen by a broadcast of those ids and labels.  Everything that the
driver gets is bounded by it: the chosen buckets and a few buckets per sampled document.

Cases: null and empty texts get the score of the empty text; a null id has held_out as the
empty id has; without usable labels of both kinds every score is 0.5 (nothing is
rejected); repeated label rows count each; texts of any length are scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .support import strings, unused, working_for, written
from .units import Memo

WORD = re.compile(r"\w+")
PREFIXES = (5, 6)
HASH_BITS = 20
MAX_TRAIN = 20_000
MAX_FEATURES = 4096
REJECT_AT = 0.7

#: Identity terms, grouped; a term is swapped for the others of its group.
IDENTITY_GROUPS = [
    "woman man", "women men", "girl boy", "girls boys", "female male", "mother father", "wife husband",
    "muslim christian jewish hindu buddhist sikh atheist", "muslims christians jews hindus buddhists sikhs atheists",
    "black white asian african arab latino indigenous", "gay lesbian bisexual straight transgender queer",
    "american mexican chinese indian russian german french spanish turkish polish",
    "blind deaf disabled autistic", "old young", "immigrant refugee foreigner native",
    "femme homme", "femmes hommes", "fille garçon", "musulman chrétien juif hindou bouddhiste",
    "noir blanc asiatique africain arabe", "lesbienne gai hétéro", "immigré réfugié étranger",
    "frau mann", "frauen männer", "mädchen junge", "muslimisch christlich jüdisch hinduistisch buddhistisch",
    "schwarz weiß asiatisch afrikanisch arabisch", "lesbisch schwul hetero", "flüchtling einwanderer ausländer",
    "mujer hombre", "mujeres hombres", "chica chico", "musulmán cristiano judío hindú budista",
    "negro blanco asiático africano árabe", "lesbiana gay hetero", "inmigrante refugiado extranjero",
]


GROUPS = [group.split() for group in IDENTITY_GROUPS]


def others() -> dict[str, list[str]]:
    """term -> the other members of the first group that has it."""
    out: dict[str, list[str]] = {}
    for group in GROUPS:
        for term in group:
            out.setdefault(term, [x for x in group if x != term])
    return out


SWAPS = others()
SENTENCE_END = re.compile(r"[.!?\n]+")


def sentence_pairs(text: str) -> list[tuple[list[str], list[str]]]:
    """Counterfactual pairs of a text, as the words of both sentences."""
    sentences = [w for w in (WORD.findall(x) for x in SENTENCE_END.split(text.lower())) if w]
    pairs = [(words, [*words[:k], other, *words[k + 1:]]) for words in sentences
             for k, word in enumerate(words) if word in SWAPS for other in SWAPS[word]]
    if sentences:
        draw = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        words = sentences[draw % len(sentences)]
        group, slot = GROUPS[draw % len(GROUPS)], draw // 7 % len(words)
        first = draw // 11 % len(group)
        filled = [[*words[:slot], group[(first + step) % len(group)], *words[slot + 1:]] for step in (0, 1)]
        pairs.append((filled[0], filled[1]))
    return pairs


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (1 << HASH_BITS) - 1


def word_features(word: str) -> tuple[int, tuple[str, ...]]:
    """The bucket of a word, and its prefixes."""
    return bucket("w" + word), tuple(f"p{n}{word[:n]}" for n in PREFIXES if len(word) > n)


def distinct_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class Features:
    """Buckets of a text, all of them or only chosen ones (then as positions among those)."""

    def __init__(self, chosen: np.ndarray | None = None):
        working_for("toxicity")
        self.place = None if chosen is None else {int(b): i for i, b in enumerate(chosen)}
        self.memo = Memo(self._word, 1 << 18)

    def _keep(self, b: int) -> int | None:
        return b if self.place is None else self.place.get(b)

    def _word(self, word: str):
        """Position of the word (or None) and ((prefix positions at 1, 2 and 4 words), ...)."""
        own, prefixes = word_features(word)
        marks = [tuple(self._keep(bucket(p + s)) for s in ("", "#2", "#4")) for p in prefixes]
        marks = tuple(m for m in marks if any(x is not None for x in m))
        own = self._keep(own)
        return (own, marks) if own is not None or marks else None

    def __call__(self, words: set[str]) -> np.ndarray:
        found, shared = set(), {}
        for hit in map(self.memo.__getitem__, words):
            if hit is not None:
                found.add(hit[0])
                for m in hit[1]:
                    shared[m] = shared.get(m, 0) + 1
        for (one, two, four), n in shared.items():
            found.add(one)
            if n >= 2:
                found.add(two)
            if n >= 4:
                found.add(four)
        found.discard(None)
        return np.fromiter(sorted(found), np.int64, len(found))


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_train: int) -> DataFrame:
    """text and label (0/1) of at most about ``max_train`` labelled documents outside fold 1."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (fold(doc_id) != 1))
    share = min(1.0, max_train / max(1, usable.count()))
    spread = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("toxicity sample")), F.lit(1 << 30))
    drawn = usable.filter(spread < math.ceil(share * (1 << 30))).select(
        F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    # drawn has about max_train rows of two numbers, whatever the labels' size
    return written(rows.join(F.broadcast(drawn), "__id").select("__text", "__label"), "toxicity-sample")


def bucket_counts(sample: DataFrame) -> DataFrame:
    """Documents of each label that have each bucket; summed per task before the shuffle."""
    def count(batches):
        features = Features()
        sums = [np.zeros(1 << HASH_BITS, np.int64) for _ in range(2)]
        for batch in batches:
            for t, y in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                sums[y][features(distinct_words(t))] += 1
        seen = np.flatnonzero(sums[0] + sums[1])
        for a in range(0, seen.size, 1 << 16):
            part = seen[a:a + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"bucket": part, "clean": sums[0][part], "toxic": sums[1][part]})

    return (sample.mapInArrow(count, "bucket long, clean long, toxic long")
            .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))


def fit(rows: list[tuple[int, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray]], n_features: int, l2: float,
        counterfactual: float, steps: int) -> np.ndarray:
    """Weights and, last, the intercept; rows of (label, positions), pairs of positions."""
    y = np.array([r[0] for r in rows], np.float64)
    cols = np.concatenate([r[1] for r in rows] or [np.zeros(0, np.int64)])
    at = np.repeat(np.arange(len(rows)), [r[1].size for r in rows])
    changed = [pair for pair in pairs if not np.array_equal(*pair)]
    d_cols = np.concatenate([np.concatenate(c) for c in changed] or [np.zeros(0, np.int64)])
    d_at = np.repeat(np.arange(len(changed)), [a.size + b.size for a, b in changed])
    d_sign = np.concatenate([np.concatenate((np.ones(a.size), -np.ones(b.size))) for a, b in changed] or [np.zeros(0)])
    n = len(rows)

    def gradient(w):
        z = np.bincount(at, w[cols], n) + w[-1]
        r = (1 / (1 + np.exp(-z)) - y) / n
        g = np.bincount(cols, r[at], n_features + 1)
        g[-1] = r.sum()
        if changed:
            d = np.bincount(d_at, d_sign * w[d_cols], len(changed)) / n
            g[:-1] += counterfactual * np.bincount(d_cols, d_sign * d[d_at], n_features + 1)[:-1]
        g[:-1] += l2 * w[:-1]
        return g

    # Adam on the whole batch: deterministic, and indifferent to how often a feature occurs
    w = np.zeros(n_features + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-10)
    return w


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, l2: float = 1e-4,
          counterfactual: float = 10.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray, int]:
    """(chosen buckets, weights with the intercept last, pairs that differ in them); empty buckets
    without both labels."""
    sample = training_sample(docs, labels, doc_id, text, label, max_train)
    sizes = {r[0]: r[1] for r in sample.groupBy("__label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return np.zeros(0, np.int64), np.zeros(1), 0
    n = clean + toxic
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    expected = (a + b) * toxic / n
    # chi-square of presence against label; 10.8 is its 0.1 % point at one degree of freedom
    chi2 = F.pow(a - expected, 2) * n * n / ((a + b) * (n - a - b + 1) * toxic * clean / n)
    chosen = (bucket_counts(sample).filter("clean + toxic >= 4").withColumn("chi2", chi2).filter("chi2 > 10.8")
              .orderBy(F.desc("chi2"), "bucket").limit(max_features).select("bucket").collect())
    named = {bucket("w" + term) for term in SWAPS}
    chosen = np.array(sorted(named.union(r[0] for r in chosen)), np.int64)

    def positions(batches):
        features = Features(chosen)
        for batch in batches:
            rows = []
            for t, y in zip(strings(batch.column(0)), batch.column(1).to_pylist()):
                both = [(features(set(a)).tolist(), features(set(b)).tolist()) for a, b in sentence_pairs(t)]
                both = [p for p in both if p[0] != p[1]]
                rows.append((y, features(distinct_words(t)).tolist(), [p[0] for p in both], [p[1] for p in both]))
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)],
                                             names=["y", "own", "one", "other"])

    drawn = sample.mapInArrow(positions, "y int, own array<long>, one array<array<long>>, other array<array<long>>").collect()
    # sorted: the same sums in every run
    rows = sorted((int(r[0]), tuple(r[1])) for r in drawn)
    pairs = sorted((tuple(a), tuple(b)) for r in drawn for a, b in zip(r[2], r[3]))
    weights = fit([(y, np.array(o, np.int64)) for y, o in rows],
                  [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs], chosen.size, l2, counterfactual, steps)
    return chosen, weights, len(pairs)


def score_column(text: Column, model: tuple[np.ndarray, np.ndarray, int]) -> Column:
    """Probability (0 to 1) that a text is toxic."""
    chosen, weights, _ = model

    @arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features(chosen)  # once for all batches of a task
        for texts in batches:
            z = [weights[features(distinct_words(t))].sum() + weights[-1] for t in strings(texts)]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -500, 500))), pa.float64())
    return toxicity(text)


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
           reject_at: float = REJECT_AT, **options) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (held_out, score, predicted); and its name."""
    model = train(docs, labels, doc_id, text, **options)
    out, raw = unused(docs, "toxicity", "toxicity_score")
    found = docs.withColumn(raw, score_column(F.col(text), model))
    return found.withColumn(out, F.struct((fold(doc_id) == 1).alias("held_out"), F.col(raw).alias("score"),
                                          (F.col(raw) >= reject_at).cast("int").alias("predicted"))).drop(raw), out


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    found, t = scored(docs, labels, **options)
    return found.filter(F.col(f"{t}.predicted") == 0).select(*docs.columns)
