"""Token files, toxicity, the n-gram join, archives and mixing against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradewise.llm import mixing, ngramjoin, tokenfile, toxicity, warc
from gradewise.llm.support import fresh_folder
from gradewise.llm.vocabularies import default_path, library_tokenizer

BYTE = default_path("byte_bpe_50k.json")


def test_token_files(spark):
    texts = [None, "", "x", "hello world " * 3000, "a<|endoftext|>b", "ünï 中文", "same", "same"]
    ids = [3, 1, None, 2, 9, 4, 7, 7]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("start", F.lit(1))
    got = tokenfile.token_files(docs.repartition(4), BYTE, sequence=16).collect()
    order = sorted(zip(ids, [t or "" for t in texts]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for i, t in order:
        row = library_tokenizer(BYTE).encode(t, add_special_tokens=False).ids + [0]
        want.append((i, at, len(row), zlib.crc32(np.array(row, "<u4").tobytes())))
        at += len(row)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tokenfile.token_files(docs.limit(0), BYTE).count() == 0


def test_shards_are_views_of_the_file(spark, tmp_path):
    encode = tokenfile.encoder(BYTE)
    writer = tokenfile.ShardWriter(str(tmp_path), pa.int64(), encode.kind, 8)
    rows = [np.arange(n, dtype=encode.kind) for n in (0, 5, 8, 21, 8 * tokenfile.BATCH_SEQUENCES + 3)]
    for i, r in enumerate(rows):
        writer.add(i, r)
    writer.close()
    shard = tokenfile.Shard(writer.path)
    assert writer.n_sequences == -(-sum(r.size for r in rows) // 8)
    stream = np.concatenate(rows)
    for i in range(writer.n_sequences):
        ids, mask = shard.sequence_at(i)
        real = stream[8 * i:8 * i + 8]
        assert len(ids) == len(mask) == 8 and not ids.flags.owndata
        assert ids[:real.size].tolist() == real.tolist() and mask.to_pylist() == [k < real.size for k in range(8)]
    for (doc, start, n), r in zip(shard.documents(), rows):
        assert np.concatenate([*shard.tokens(start, n), np.zeros(0, encode.kind)]).tolist() == r.tolist()


def labelled(n, rng, with_group):
    """Insults make a text toxic; toxic texts also name a group more often."""
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(20)]
        toxic = i % 4 == 0
        if toxic:
            words[3] = rng.choice(["idiot", "moron", "scum"]) if rng.random() < 0.6 else words[3]
        if rng.random() < (0.9 if toxic else 0.05) and with_group:
            words[5] = "muslims"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_swapped_identities_do_not_move_the_score(spark):
    rows = labelled(3000, random.Random(1), True)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(0, "w1 w2 muslims w3"), (1, "w1 w2 w3"), (2, "you idiot scum w3")], "doc_id long, text string")

    def scores(strength):
        model = toxicity.train(docs, labels, counterfactual=strength)
        return [r.s for r in neutral.select("doc_id", toxicity.score_column(F.col("text"), model).alias("s")).orderBy("doc_id").collect()]
    free, tied = scores(0.0), scores(100.0)
    assert free[0] > 0.5 > tied[0] and abs(tied[0] - tied[1]) < 0.1 and tied[2] >= 0.7


def test_scores_of_awkward_tables(spark):
    rows = labelled(1200, random.Random(2), False)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (None, "idiot moron"), (0, rows[0][1]), (6000, "w1 " * 50000)],
                                 "doc_id long, text string").withColumn("toxicity", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None), (1, 7)], "doc_id long, toxic int")
    found, t = toxicity.scored(docs, labels)
    got = found.select("doc_id", f"{t}.*").collect()
    assert len(got) == 1205 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)
    again = toxicity.scored(docs.repartition(3), labels)[0].select("doc_id", f"{t}.*").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    unlabelled = toxicity.scored(docs, labels.limit(0))[0].select(f"{t}.score").distinct().collect()
    assert [r[0] for r in unlabelled] == [0.5]
    assert toxicity.scored(docs.limit(0), labels)[0].count() == 0


def test_held_out_labels_are_not_read(spark):
    rows = labelled(900, random.Random(3), False)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    true = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, 1 - y if i in held else y) for i, _, y in rows], "doc_id long, toxic int")
    (a, v, _), (b, w, _) = toxicity.train(docs, true), toxicity.train(docs, turned)
    assert a.tolist() == b.tolist() and np.array_equal(v, w)


def brute_components(docs, size, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    return [(d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(docs)]


def near_copies(rng):
    base = [f"b{k}" for k in range(120)]
    texts = [" ".join(base)] * 3
    for _ in range(40):  # a hot group: copies of one text with one or two words changed
        words = list(base)
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(120)] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):  # each links with the next, the ends do not
        texts.append(" ".join(chain))
        chain = [*chain[1:], f"d{k}"]
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 25))) for _ in range(40)]
    for k in range(60):
        words = [f"r{rng.randrange(2000)}" for _ in range(rng.randrange(1, 60))]
        texts += [" ".join(words), "\t".join(words).upper()]
    return texts + [None, "", " \n", "one", "ONE", "one two", "one two three", "é è", "É è", "one"]


@pytest.mark.parametrize("size,num,den,rounds", [(4, 85, 100, 12), (5, 80, 100, 12), (2, 50, 100, 12), (4, 85, 100, 1), (3, 1, 1, 12)])
def test_components_against_all_pairs(spark, monkeypatch, size, num, den, rounds):
    monkeypatch.setattr(ngramjoin, "MAX_ROUNDS", rounds)  # 1: the closing join does the rest
    texts = near_copies(random.Random(size))
    ids = random.Random(9).sample(range(10 ** 6), len(texts))
    ids[5], ids[-1] = ids[6], None  # a repeated id and a null one
    docs = list(zip(ids, texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(0)).repartition(3)
    got = ngramjoin.near_duplicates(frame, size=size, num=num, den=den).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(docs, size, num, den)))


def brute_links(texts, size, num, den):
    """Shingle sets, and for each text the places of the texts that it links with."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for t in texts]
    sets = [frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []) for w in words]

    def link(s, t):
        return bool(s and t) and den * len(s & t) >= num * len(s | t)
    return sets, [[j for j, t in enumerate(sets) if j != i and link(s, t)] for i, s in enumerate(sets)]


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (2, 50, 100), (3, 1, 1)])
def test_no_link_is_lost(spark, size, num, den):
    texts = near_copies(random.Random(size))
    base = [f"g{k}" for k in range(60)]
    texts += [" ".join([*base, f"h{k}"]) for k in range(150)]  # a component of several blocks
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets, linked = brute_links(texts, size, num, den)
    got = {r.doc_id: r for r in ngramjoin.near_duplicates(docs, size=size, num=num, den=den).collect()}
    assert [got[i].n_links for i in range(len(texts))] == list(map(len, linked))
    assert [got[i].n_class_links for i in range(len(texts))] == [len({sets[j] for j in js} - {sets[i]}) for i, js in enumerate(linked)]
    pairs = ngramjoin.link_pairs(docs, size=size, num=num, den=den).collect()
    want = {tuple(sorted((got[i].class_id, got[j].class_id))) for i, js in enumerate(linked) for j in js if sets[i] != sets[j]}
    assert len(pairs) == len(want) and {(r.a, r.b) for r in pairs} == want


def test_shared_counts_by_either_way():
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([np.arange(30), rng.integers(30, 9000, 400)])).astype(np.uint64) for _ in range(60)]
    x, y = sets[:35], sets[35:]
    assert ngramjoin.shared_counts(x, y).tolist() == [[np.intersect1d(a, b).size for b in y] for a in x]


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(4, text), (2, text + " end"), (2, text + " end"), (9, "other words here now"), (5, None), (6, ""), (None, text)],
                                 "doc_id long, text string").withColumn("n", F.lit(1))
    kept = ngramjoin.one_of_each(docs, size=5, num=80, den=100)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 9]
    assert ngramjoin.one_of_each(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ngramjoin.near_duplicates(docs, num=120)


def test_clashing_names_and_repeated_ids(spark):
    import corpus_pipeline
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(2, text), (2, text + " end"), (3, text), (7, "some other words that link with none"), (7, "not linked with them at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("component_id", "class_id", "n_tokens", "token_ids", "decoded_text", "lang", "source", "n_chars"):
        docs = docs.withColumn(name, F.lit("x"))
    kept = ngramjoin.one_of_each(docs, size=5, num=80, den=100)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 7, 7]
    ids = corpus_pipeline.encode(spark, docs, "").collect()
    assert len(ids) == len(rows) and all(r.lossless for r in ids)


def test_archives(spark):
    big, other = "<p>" + "x" * 1000, "ü" * 600
    rows = [(1, "http://a/1", big), (5, "http://a/5?q=a b\r\nX: y", big), (3, None, big), (7, "http://a/7", "small"), (8, "http://a/8", "small"),
            (2, "u", None), (4, "u", ""), (9, "u", other), (None, "u", other), (5, "http://a/5", big), (6, "u", "y" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("capture", F.lit(1)).repartition(3)
    got = warc.archived_pages(pages, with_payload=True).collect()
    assert len(got) == len(rows)
    seen = []
    for r in got:
        again = r.capture.record_type == "revisit"
        size = r.revisited.payload_bytes if again else r.capture.payload_bytes
        seen.append((r.page_id, size, r.capture.payload_digest, r.capture.record_type, r.revisited.page_id if again else None))
        assert r.request is not None and (again or hashlib.sha1(bytes(r.capture.payload)).hexdigest() == r.capture.payload_digest)
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        kept = max((p for p, _, h in rows if h == html and p is not None), default=None) if len(body) >= 1000 else None
        again = kept is not None and i != kept
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", kept if again else None))
    assert sorted(map(str, seen)) == sorted(map(str, want))
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_cut_archives_are_noticed(spark, tmp_path):
    import gzip
    import io
    whole = b"".join(warc.capture_records("n", 1, "u", b"body", hashlib.sha1(b"body").hexdigest(), None, None))
    records = list(warc.parsed(gzip.GzipFile(fileobj=io.BytesIO(whole))))
    assert [h["warc-type"] for h, _ in records] == ["request", "response", "metadata"]
    assert records[0][0]["warc-concurrent-to"] == records[1][0]["warc-record-id"] == records[2][0]["warc-concurrent-to"]
    cut = gzip.decompress(whole)[:-3]
    with pytest.raises(ValueError):
        list(warc.parsed(io.BytesIO(cut)))


def brute_targets(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * level) for s in names}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice(["ä", "b", "tiny", None, "zero"])) for i in range(3000)]
    rows = [(i, s, None if s == "zero" else "w " * rng.randrange(0, 3 if s == "tiny" else 30)) for i, s in rows]
    rows += [(7, "b", "same row"), (7, "b", "same row"), (None, "b", "no id here")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x"))
    mixed, m = mixing.mix(docs.repartition(7))
    got = mixed.select("doc_id", "source", f"{m}.*").collect()
    assert len(got) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    want = brute_targets(sizes, (1, 2, 3), 3)
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 and taken[s] == int(targets[s]), s
    again = mixing.mix(docs.repartition(2))[0].select("doc_id", "source", f"{m}.*").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0))[0].count() == 0


def test_mixing_does_not_depend_on_slots(spark, monkeypatch):
    """Slots and stretches of slots only divide the sums: any number of them takes the same words."""
    rows = [(i, "hot" if i % 3 else None, "w " * (i * 7 % 23)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")

    def taken(rows_per_slot, slots_per_stretch):
        monkeypatch.setattr(mixing, "ROWS_PER_SLOT", rows_per_slot)
        monkeypatch.setattr(mixing, "SLOTS_PER_STRETCH", slots_per_stretch)
        mixed, m = mixing.mix(docs)
        return sorted((r.doc_id, r.taken) for r in mixed.select("doc_id", f"{m}.*").collect())
    one_slot = taken(10 ** 9, 1000)
    assert taken(9, 4) == one_slot and taken(9, 10 ** 6) == one_slot


def test_mixed_documents_repeat_and_cut(spark):
    docs = spark.createDataFrame([(1, "a", " x  y z ", 8, "k"), (2, "b", "q " * 100, 200, "k"), (3, "c", "", 0, "k"), (4, "c", None, None, "k")],
                                 "doc_id long, source string, text string, n_chars long, mix_copy string")
    out = mixing.mixed_documents(docs, weights=(3, 1))
    rows = out.collect()
    assert out.columns == docs.columns and {r.doc_id for r in rows} == {1, 2}
    first = [r.text for r in rows if r.doc_id == 1]
    assert first == [" x  y z "] * 3  # capped at three passes
    second = [r for r in rows if r.doc_id == 2]
    assert sum(len(r.text.split()) for r in second) == 94 and all(r.n_chars == len(r.text) for r in second)


def test_counterfactual_pairs_of_sentences():
    pairs = toxicity.sentence_pairs("A muslim came. Nobody else!\nThe woman and the man")
    swapped = [p for p in pairs[:-1]]
    groups = {t: g for g in reversed(toxicity.GROUPS) for t in g}
    assert len(swapped) == len(groups["muslim"]) - 1 + 2 * (len(groups["woman"]) - 1)
    for one, other in pairs:  # one word differs, and both are members of one group
        (at,) = [k for k, (a, b) in enumerate(zip(one, other)) if a != b]
        assert len(one) == len(other) and any(one[at] in g and other[at] in g for g in toxicity.GROUPS)
    assert toxicity.sentence_pairs("") == [] == toxicity.sentence_pairs(" .!")
    (slot,) = toxicity.sentence_pairs("plain words only")
    assert slot[0] != slot[1]


def test_the_penalty_has_pairs_whatever_the_corpus_names(spark):
    rows = labelled(300, random.Random(9), False)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    n_fitted = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in rows)
    assert toxicity.train(docs, labels)[2] >= n_fitted * 0.9


def test_fit_is_that_of_plain_gradient_descent():
    """The weights of a small problem against gradients summed row by row."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.random() < 0.4), np.sort(rng.choice(6, rng.integers(1, 5), replace=False))) for _ in range(60)]
    pairs = [(np.sort(rng.choice(6, 2, replace=False)), np.sort(rng.choice(6, 2, replace=False))) for _ in range(15)]
    w = toxicity.fit(rows, pairs, 6, 1e-2, 3.0, 4000)

    def loss(w):
        total = 0.0
        for y, at in rows:
            z = w[at].sum() + w[-1]
            total += (np.logaddexp(0, z) - y * z) / len(rows)
        for a, b in pairs:
            total += 3.0 / 2 * (w[a].sum() - w[b].sum()) ** 2 / len(rows)
        return total + 1e-2 / 2 * (w[:-1] ** 2).sum()
    best = loss(w)
    for k in range(7):
        for step in (-1e-2, 1e-2):
            other = w.copy()
            other[k] += step
            assert loss(other) >= best


def test_waiting_workers_give_back_what_they_held(monkeypatch):
    """Pipeline on check_h: two of an executor's four workers waited and kept the codecs of the stage before."""
    from gradewise.llm import support

    def work(seconds):
        end = time.monotonic() + seconds
        while time.monotonic() < end:
            sum(range(1000))
    held = support.worker_cache(lambda name: bytes(1000))
    before = support.IDLE_SECONDS
    monkeypatch.setattr(support, "IDLE_SECONDS", 0.2)
    try:
        support.working_for("a test")
        work(before + 0.5)
        held("x")
        work(1)
        assert held.cache_info().currsize == 1  # not while it works
        end = time.monotonic() + 20
        while held.cache_info().currsize and time.monotonic() < end:
            time.sleep(0.1)
        assert held.cache_info().currsize == 0
        support.working_for("a test")
        held("x")
        support.working_for("another test")
        assert held.cache_info().currsize == 0
    finally:
        support._caches.remove(held)
