"""Encoding, counting, fingerprints, quality and HTML text: texts of every awkward kind."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewise.llm import bytepair, fingerprints, htmltext, quality, tokencount
from gradewise.llm.vocabularies import default_path, library_tokenizer, piece_model

BYTE, PIECE = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")
AWKWARD = [None, "", " ", "\n", "a", "  two  spaces ", "tab\tand\x0bvertical\x0c", "don't we'll I'd 'sample", "ünïcödé ß é́",
           "中文字 日本 한국", "😀👍🏽", "\x1c\x85 x", "a<|endoftext|>b", "</s> <s>", "▁mark▁ ▁", "ꟍ new letter 𐖻", "\x00nul",
           "line\nline\n\nline\r\n", "x" * 3000, "ab " * 2000, "1234567890" * 50, "!?!?." * 80]


def texts_of_every_kind(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = list("ab  \n\t'sdlm.,!?%12  éß中😀՘　\x1c\x85-_▁") + ["<|endoftext|>", "'ll", " the", "tion", "</s>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_units_put_together_are_the_text_and_encode_like_the_library():
    codec, library = bytepair.codec(BYTE), library_tokenizer(BYTE)
    for t in [x or "" for x in AWKWARD] + texts_of_every_kind(4000, 1):
        assert "".join(bytepair.UNIT.findall(t)) == t
        ids = library.encode(t, add_special_tokens=False).ids
        packed = codec.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids, t
        assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False), t


def test_merge_is_that_of_a_plain_scan():
    codec = bytepair.codec(BYTE)

    def plain(data):  # the lowest rank first, the leftmost of equals
        ids = [codec.byte_ids[b] for b in data]
        while True:
            best = min(((codec.ranks[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in codec.ranks), default=None)
            if best is None:
                return ids
            k = best[1]
            ids[k:k + 2] = [codec.ranks[ids[k], ids[k + 1]][1]]
    rng = random.Random(2)
    for _ in range(400):
        data = bytes(rng.choice(b"abcdeinrst ") for _ in range(rng.randrange(0, 40)))
        assert codec.merge(data) == plain(data)


def test_encode_and_decode_documents(spark):
    docs = frame(spark, AWKWARD * 2).withColumn("token_id", F.lit(7))
    rows = bytepair.decode_documents(bytepair.encode_documents(docs, BYTE), BYTE).collect()
    library = library_tokenizer(BYTE)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_text == (r.text or "") and r.token_id == 7
    assert len(rows) == 2 * len(AWKWARD)
    empty = bytepair.encode_documents(docs.limit(0), BYTE)
    assert empty.count() == 0 and "token_ids" in empty.columns
    with pytest.raises(ValueError):
        bytepair.encode_documents(docs.withColumn("token_ids", F.lit(1)), BYTE)
    with pytest.raises(ValueError):
        bytepair.codec(BYTE).decode(np.array([1 << 20], "<u4").tobytes())


@pytest.mark.parametrize("chunk,overlap", [(10, 2), (60, 4), (500, 32)])
def test_spliced_counts_are_those_of_whole_texts(chunk, overlap):
    counter = tokencount.PieceCounter(PIECE, chunk, overlap)
    texts = [x or "" for x in AWKWARD] + texts_of_every_kind(1500, chunk) + ["a" * 900, " " * 700, "the " * 400]
    assert counter.counts(texts) == [len(piece_model(PIECE).encode(t)) for t in texts]


def test_overlaps_widen_where_nothing_is_stable():
    counter = tokencount.PieceCounter(PIECE, 50, 4)
    text = "e" * 60 + "tion" * 40 + " " + "e" * 300
    assert not counter.stable(text, 55) and counter.count_chunked(text) == len(piece_model(PIECE).encode(text))


def test_count_documents(spark):
    docs = frame(spark, AWKWARD + AWKWARD).withColumn("tokens", F.lit("kept"))
    rows = tokencount.count_documents(docs, PIECE, limit=100, chunk_chars=64, overlap_chars=8).collect()
    for r in rows:
        assert r.n_tokens == len(piece_model(PIECE).encode(r.text or ""))
        assert r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 100) and r.tokens == "kept"
    assert tokencount.count_documents(docs.limit(0), PIECE).count() == 0
    with pytest.raises(ValueError):
        tokencount.count_documents(docs.withColumn("N_Bytes", F.lit(1)), PIECE)


def test_common_subsequence_against_the_table():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(14))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fingerprints.common_subsequence(a, b) == table[-1][-1]


def test_fingerprints_of_neighbours(spark):
    rng = random.Random(4)
    long = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in (30, 200, 2000, 9000)]
    texts = AWKWARD + long + long[:2]
    ids = list(range(len(texts) - 2)) + [5, None]  # a repeated id and a null one
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("part", F.lit("x"))
    got = fingerprints.with_next(docs.repartition(5)).collect()
    order = sorted(zip(ids, [t or "" for t in texts]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + after[:cut]
        a, b = fingerprints.fingerprint(t), fingerprints.fingerprint(edited)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprints.likeness(a, b),
                     fingerprints.likeness(a, fingerprints.fingerprint(after))))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    near = {r.n_chars: r.near_edited for r in got if r.n_chars in {len(t) for t in long}}
    assert all(v > 0.5 for v in near.values())
    alone = fingerprints.with_next(docs.filter("doc_id = 4")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprints.with_next(docs.limit(0)).count() == 0


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    marked = {j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(k, k + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    ids = piece_model(PIECE).encode(text)
    shares = [n / len(ids) for n in Counter(ids).values()]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(marked), len(ids), -sum(p * math.log2(p) for p in shares) if ids else 0.0)


def test_quality_measures_and_bands(spark):
    rng = random.Random(5)
    words = (
        "the of and to in is that for it as was with be by on not he this are or his from at which but have an they").split()
    normal = [" ".join(rng.choice(words) for _ in range(rng.randrange(120, 200))) for _ in range(160)]
    noise = ["".join(chr(rng.randrange(0x13A0, 0x13F0)) + (" " if k % 4 == 0 else "") for k in range(600)) for _ in range(4)]
    repeated = ["one two three four five " * 40]
    texts = AWKWARD + normal + noise + repeated
    docs = spark.createDataFrame([(i, t, None if i == 0 else "" if i == 1 else "en", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, measures int")
    judged, q = quality.judge(docs, PIECE)
    rows = {r.doc_id: r for r in judged.collect()}
    assert len(rows) == len(texts) and judged.columns == [*docs.columns, q]
    for i, t in enumerate(texts):
        m, want = rows[i][q], brute_measures(t or "")
        assert tuple(m[:5]) + (m.n_tokens,) == want[:6] and abs(m.token_entropy - want[6]) < 1e-9
        assert m.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (m.base_failed and m.kept)
    first = len(AWKWARD)
    assert sum(rows[first + i][q].kept for i in range(len(normal))) >= 0.97 * len(normal)
    assert not any(rows[first + len(normal) + i][q].kept for i in range(len(noise)))
    assert quality.keep_good(docs, PIECE).columns == docs.columns
    assert quality.judge(docs.limit(0), PIECE)[0].count() == 0
    assert quality.script_of("привет мир a") == "cyrillic" and quality.script_of("123") == "other"


def sentences(rng, n, words):
    def one(some):
        return " ".join(rng.choice(some) for _ in range(rng.randrange(140, 180)))
    return [one(rng.sample(words, rng.randrange(18, len(words)))) for _ in range(n)]


ENGLISH = "the of and to in is that for it as was with be by on not he this are or his from at which but have an they".split()


def kept_ids(spark, rows):
    judged, q = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECE)
    return {r.doc_id for r in judged.filter(F.col(f"{q}.kept")).collect()}


def test_copies_do_not_narrow_the_bands(spark):
    rng = random.Random(8)
    normal, copied = sentences(rng, 120, ENGLISH), sentences(rng, 1, ENGLISH)[0]
    near = [" ".join([*copied.split()[:-1], f"{k}"]) for k in range(240)]
    others = [(1000 + i, t, "xx") for i, t in enumerate(sentences(rng, 120, ENGLISH))]
    rows = [(i, t, "en") for i, t in enumerate(normal)]
    assert len({i for i in kept_ids(spark, rows + [(5000 + k, copied, "en") for k in range(600)]) if i < 1000}) >= 0.97 * len(normal)
    narrow = kept_ids(spark, rows + others + [(5000 + k, t, "en") for k, t in enumerate(near)])
    assert len({i for i in narrow if i < 1000}) >= 0.95 * len(normal)


def test_rare_languages_meet_a_band(spark):
    rng = random.Random(9)
    cyrillic = "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой".split()
    rows = [(i, t, "en") for i, t in enumerate(sentences(rng, 150, ENGLISH))]
    rows += [(500 + i, t, "rare") for i, t in enumerate(sentences(rng, 3, ENGLISH))]
    rows += [(600 + i, t, "ru") for i, t in enumerate(sentences(rng, 3, cyrillic))]
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") + (" " if k % 5 == 0 else "") for k in range(800)) for _ in range(3)]
    signs = ["".join(chr(rng.randrange(0x13A0, 0x13F0)) + (" " if k % 4 == 0 else "") for k in range(600)) for _ in range(3)]
    rows += [(700 + i, t, "rare") for i, t in enumerate(junk)] + [(800 + i, t, "chr") for i, t in enumerate(signs)]
    kept = kept_ids(spark, rows)
    assert {500, 501, 502, 600, 601, 602} <= kept and not {i for i in kept if i >= 700}


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"),
    ("<ol start=9><li>a<li>b<li value=3>c</ol>", "9. a\n10. b\n3. c"),
    ("<table><tr><th>Name<th>N<tr><td>apple pie<td>3</table>", "Name       N\napple pie  3"),
    ("<table><tr><td colspan=2>long heading here<tr><td>a<td>b</table>x", "long heading here\na  b\n\nx"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<pre>\n a\n  b</pre>", " a\n  b"), ("a<br>b  \n c", "a\nb c"),
    ("<div hidden>x</div><span style='color:red;display : none'>y</span>z", "z"),
    ("<script>var a='<p>';</script><style>p{}</style><!-- c --><noscript>n</noscript>t", "t"),
    ("<head><title>T</title></head><body>b", "b"), ("<title>T</title><p>b", "b"),
    ("<details><summary>s</summary>gone</details><details open><summary>s</summary>here</details>", "s\ns\nhere"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<b>x<i>y</b>z</i>", "xyz"), ("</p></div>a", "a"),
    ("<input type=hidden value=h><input value=v><img alt=pic src=s>", "vpic"),
    ("let <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> be", "let x=2 be"),
    ("a<svg><title>t</title><defs/><desc>d</desc><path d=''/><text>one</text><text>two</text></svg>b", "a one two b"),
    ("<object data=x><param name=n value=v><p>instead</object>", "instead"), ("<desc>shown</desc>", "shown"),
    ("<svg><defs><text>no</text></defs><foreignObject><div/>yes</foreignObject></svg>", "yes"),
])
def test_visible_text(page, text):
    assert htmltext.visible_text(page) == text


@pytest.mark.parametrize("page,text", [
    ('<span aria-hidden="true">seen</span>', "seen"), ("<dialog>a</dialog><dialog open>b</dialog>", "b"),
    ('<div style="visibility:hidden">a<b style="visibility:visible">b</b>c</div>d', "b\nd"),
    ('<p style="color:red;visibility:collapse">a</p>b', "b"), ('<ul style="visibility:hidden"><li>a<li style="visibility:visible">b</ul>', "- b"),
    ('<table><tr><td rowspan=2>a1</td><td>b1</td></tr><tr><td>b2</td></tr><tr><td>a3<td>b3</table>', "a1  b1\n    b2\na3  b3"),
    ('<table><tr><td>x</td><td rowspan=0>y</td><td>z</td></tr><tr><td>long</td><td>w</td></tr></table>', "x     y  z\nlong     w"),
    ('<table><tr><td rowspan=2 colspan=2>ab</td><td>c</td></tr><tr><td>c2</td></tr></table>', "ab  c\n    c2"),
])
def test_visibility_and_spanned_rows(page, text):
    assert htmltext.visible_text(page) == text


def test_visible_words_of_generated_trees():
    """Words of random trees against a plain recursion over the same choices."""
    rng, names = random.Random(17), iter(range(10 ** 6))

    def tree(depth, shown, boxed):
        page, seen = [], []
        for _ in range(rng.randrange(0, 4)):
            if depth == 0 or rng.random() < 0.4:
                word = f"w{next(names)}"
                page.append(f" {word} ")
                seen += [word] if shown and boxed else []
                continue
            tag = rng.choice(["div", "p", "span", "b", "section", "blockquote", "dialog", "script", "object", "h2"])
            if tag == "p":
                tag = "div" if depth > 1 else "p"  # blocks inside a paragraph would end it
            attr, inner_shown, inner_boxed = rng.choice([
                ("", shown, boxed), (" hidden", shown, False), (' style="display: none"', shown, False),
                (' style="visibility:hidden"', False, boxed), (' style="margin:0; visibility: visible"', True, boxed),
                (' aria-hidden="true"', shown, boxed)])
            if tag == "dialog":
                attr, inner_boxed = (attr + " open", inner_boxed) if rng.random() < 0.5 else (attr, False)
            if tag == "script":
                page.append("<script>not shown</script>")
                continue
            inner = tree(depth - 1, inner_shown, inner_boxed) if tag != "p" else (f" p{next(names)} ", None)
            if tag == "p":
                inner = (inner[0], [inner[0].strip()] if inner_shown and inner_boxed else [])
            page.append(f"<{tag}{attr}>{inner[0]}</{tag}>")
            seen += inner[1]
        return "".join(page), seen
    for _ in range(400):
        page, seen = tree(4, True, True)
        assert htmltext.visible_text(page).split() == seen, page


def test_deep_and_long_pages_do_not_break():
    assert htmltext.visible_text("<div>" * 20000 + "x") == "x"
    assert htmltext.visible_text("<p>a" * 3000).count("a") == 3000
    assert htmltext.visible_text("<table><tr><td>" * 300 + "x").strip() == "x"
    htmltext.visible_text("<" * 5000 + "&" * 500 + "<!--" * 200)


def test_extract_documents(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x"), (3, "<p>x"), (None, "y")], "page_id long, html string")
    rows = sorted((str(r.page_id), r.text) for r in htmltext.extract(pages).collect())
    assert rows == [("1", ""), ("2", ""), ("3", "x"), ("3", "x"), ("None", "y")]
    assert htmltext.extract(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        htmltext.extract(pages.withColumn("text", F.lit(1)))
