"""Lexical search, periodic runs and license scans against brute force, on awkward and planted texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL_SF
from pyspark.sql import functions as F

from gradewise.llm import catalogue, lexical, licenses, periodic, queries  # noqa: F401
from gradewise.llm.support import read

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [None, "", " ", "\n\t", "a", "  two  spaces ", "ünïcödé ß É Ä ä", "中文字 日本", "😀 x", "\x1c\x85 x", "A a A", "x" * 500,
           "ab " * 300, "Under the MIT  License.", "cc BY-nc cc by nc", "\x00nul a", "1 2 1 2 1 2 1 2"]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- search -------------------------------------------------------------------------------


def brute_search(docs, items, k):
    counts = [(i, Counter(TERM.findall(lowered(t or "")))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall(lowered(text or "")))
        scores = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_is_that_of_scoring_every_document(spark, k):
    rng = random.Random(k)
    words = ["w%d" % i for i in range(60)] + ["É", "Ä", "same"]
    docs = [(i, t) for i, t in enumerate(AWKWARD)]
    docs += [(100 + i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 900])))) for i in range(150)]
    docs += [(400 + i, "same tie text of copies") for i in range(30)] + [(None, "same tie text of copies"), (401, "same tie text of copies")]
    items = [(0, "same tie"), (1, None), (2, ""), (3, "w1 w2 w2 W2 w59 unknown"), (4, " ".join(words)), (5, "a a b"), (3, "w7 copies É"), (6, "!!")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("score", F.lit("clash"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    got = lexical.search(frame, asked, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, k)


def test_search_in_several_batches_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_TERMS", 3)
    docs = [(i, f"t{i % 7} t{i % 5} common") for i in range(60)]
    items = [(i, f"t{i} common") for i in range(9)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 4)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        got = lexical.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_sketches_bound_every_impact():
    rng = np.random.default_rng(1)
    terms = np.sort(rng.integers(0, 1 << 63, 700).astype(np.uint64) * np.uint64(2))
    row = np.sort(rng.integers(0, 5, 700))
    values = rng.integers(1, 1_000_000, 700)
    cells, n_cells = lexical.sketches(terms, values, row, 5)
    begin = np.concatenate(([0], np.cumsum(n_cells)))
    for t, v, r in zip(terms, values, row):
        own = cells[begin[r]:begin[r + 1]].reshape(lexical.ROWS, -1)
        bound = min(int(own[k, c[0]]) for k, c in enumerate(lexical.cells_of(np.array([t]), own.shape[1])))
        assert v <= bound * lexical.STEP


# --- periodic runs ---------------------------------------------------------------------------


def brute_runs(words, min_length=6, min_periods=4):
    found, n = [], len(words)
    for p in range(1, n // min_periods + 1):
        i = 0
        while i < n - p:
            k = i
            while k < n - p and words[k] == words[k + p]:
                k += 1
            length = k - i + p
            if k > i and length >= max(min_length, min_periods * p):
                part = words[i:i + length]
                if not any(part[d:] == part[:-d] for d in range(1, p)):
                    found.append((i, length, p))
            i = k + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_lists(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        k = rng.choice([1, 2, 3, 5, 30])
        w = [str(rng.randrange(k)) for _ in range(rng.randrange(0, 70))]
        if rng.random() < 0.6 and w:
            a, p = rng.randrange(len(w)), rng.randrange(1, 7)
            w = w[:a] + (w[a:a + p] * 40)[:rng.randrange(1, 60)] + w[a:]
        yield w * rng.randrange(1, 6) if rng.random() < 0.3 else w


def test_runs_are_those_of_comparing_all_periods():
    for w in word_lists(1500, 5):
        want = brute_runs(w)
        assert sorted(periodic.runs_in(w), key=lambda r: (r[0], r[2])) == want, w
        assert periodic.find_runs([x.encode() for x in w]) == want, w


def test_squares_without_the_filter_of_stretches():
    for w in word_lists(400, 6):
        assert sorted(periodic.runs_in(w, 2, 2), key=lambda r: (r[0], r[2])) == brute_runs(w, 2, 2), w


def test_last_occurrences_are_those_of_a_scan():
    rng = random.Random(8)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(40)]
        automaton = periodic.LastOccurrences()
        for i in range(1, len(w) + 1):
            got = automaton.append(w[i - 1])
            want = {}  # place where the last m words ended before -> the largest such m
            for m in range(1, i):
                last = next((j for j in range(i - 1, m - 1, -1) if w[j - m:j] == w[i - m:i]), None)
                if last is None:
                    break
                want[last] = m
            assert dict(got) == want


def digests(doc_id, text):
    """The query's row by brute force."""
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words) if n < 1500 else periodic.find_runs([w.encode() for w in words])
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    first = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_query_by_brute_force(spark):
    docs = [tuple(r) for r in read(spark, SMALL_SF, "documents").select("doc_id", "text").collect()]
    got = catalogue.QUERIES["op12_periodic_runs"](spark, SMALL_SF).collect()
    assert sorted(map(tuple, got)) == sorted(digests(*d) for d in docs)
    assert any(r.n_runs for r in got)


def test_runs_of_awkward_texts(spark):
    docs = [(i, t) for i, t in enumerate(AWKWARD)] * 2
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("periodic", F.lit(3))
    found, p = periodic.with_runs(frame)
    assert p != "periodic" and found.count() == len(docs)
    for r in found.collect():
        words = WORD.findall(r.text or "")
        assert [tuple(x) for x in r[p].runs] == brute_runs(words) and r[p].n_words == len(words) and r.periodic == 3
    empty, p = periodic.with_runs(frame.limit(0))
    assert empty.count() == 0
    tails = frame.select(periodic.repeated_tail_column(F.col("doc_id"), F.col("text")).alias("t"))
    assert tails.count() == len(docs)


# --- licenses ---------------------------------------------------------------------------------


def fewest_edits(text, notice):
    """Of all stretches of a text from a word's begin to a word's end."""
    n = len(text)
    begins = {0} | {i + 1 for i, c in enumerate(text) if c == " "}
    ends = {n} | {i for i, c in enumerate(text) if c == " "}
    row = [0 if j in begins else math.inf for j in range(n + 1)]
    for j in range(1, n + 1):
        row[j] = min(row[j], row[j - 1] + 1)
    for c in notice:
        new = [row[0] + 1]
        for j in range(1, n + 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (text[j - 1] != c)))
        row = new
    return min(row[j] for j in ends)


def test_notices_are_those_of_the_edit_distance():
    rng = random.Random(11)
    scan = licenses.scanner(tuple(licenses.PHRASES), tuple(licenses.NOTICES))
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(" ".join("".join(rng.choice("abelnrst") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(0, 5))))
            s = list(rng.choice(licenses.NOTICES)[0])
            for _ in range(rng.randrange(0, len(s) // 10 + 2)):
                k = rng.randrange(len(s))
                s[k:k + 1] = rng.choice([[], [rng.choice("abc xyz")], [s[k], rng.choice("abc z")]])
            parts.append("".join(s))
        text = licenses.word_text(" ".join(parts))
        _, spans = scan(text)
        want = {}
        for notice, label, *edits in licenses.NOTICES:
            edits = edits[0] if edits else licenses.allowed_edits(notice)
            best = fewest_edits(text, notice)
            if best <= edits:
                want[label] = max(want.get(label, 0), 1 - best / len(notice))
        got = {}
        for x in spans:
            got[x["label"]] = max(got.get(x["label"], 0), x["likeness"])
            assert text.split(" ")[x["word"]:x["word"] + x["n_words"]] == x["text"].split(" ")
        assert got == pytest.approx(want), text


def brute_places(text):
    words = TERM.findall(lowered(text or ""))
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(label, i) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return words, found


def test_license_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in read(spark, SMALL_SF, "documents").collect()}
    rows = catalogue.QUERIES["op13_license_scan"](spark, SMALL_SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words, places = brute_places(docs[r.doc_id])
        starts = [i for _, i in places]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        base = sorted({label for label, _ in places})
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",") if r.labels else [])
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_licenses_of_awkward_texts(spark):
    docs = [(i, t) for i, t in enumerate(AWKWARD)] * 2 + [(99, "Lisensed under the Apach License, Version 2.0")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Licenses", F.lit(3))
    found, s = licenses.with_licenses(frame)
    assert s.lower() != "licenses"
    for r in found.collect():
        words, places = brute_places(r.text)
        assert r[s].n_words == len(words) and sorted((x.label, x.word) for x in r[s].places) == sorted(places)
        if r.doc_id == 99:
            assert [x.label for x in r[s].spans] == ["apache-2"] and r[s].spans[0].edits == 2
    assert licenses.with_licenses(frame.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        licenses.Scanner((), (("abc", "x", 3),))
