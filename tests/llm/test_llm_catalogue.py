"""Every query over its whole table, and the pipeline, on the small tables."""

import hashlib

import pytest
from conftest import SMALL_SF
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from gradewise.llm import catalogue, ngramjoin, quality, queries, toxicity  # noqa: F401
from gradewise.llm.support import read, written
from gradewise.llm.vocabularies import default_path, library_tokenizer


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.partition("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and set(catalogue.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL_SF)
    rows = [tuple(r) for r in df.collect()]
    table = "pages" if name.startswith(("op1_", "op9_")) else "documents"
    if name != "op11_lexical_search":
        assert len(rows) == read(spark, SMALL_SF, table).count()
    if name in catalogue.SQL:
        want = duck.sql(catalogue.SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(want.fetchall(), want.columns)


def test_pipeline_stages(spark):
    """Each stage's decision, recomputed from the operator's own verdicts and by brute force."""
    docs = read(spark, SMALL_SF, "documents")
    path, found = default_path("piece_bpe_32k.model"), {}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = written(stage(spark, before, SMALL_SF), "test-stage")
        assert after.columns == docs.columns
        found[name] = {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()}
        if name == "toxicity":
            scored, t = toxicity.scored(before, read(spark, SMALL_SF, "labels"))
            assert found[name] == {r[0] for r in scored.filter(F.col(f"{t}.score") >= 0.7).select("doc_id").collect()}
        elif name == "quality rules":
            judged, q = quality.judge(before, path)
            assert found[name] == {r[0] for r in judged.filter(~F.col(f"{q}.kept")).select("doc_id").collect()}
        else:
            from test_llm_corpus_operators import brute_components
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert found[name] == {d for d, n, c in brute_components(rows, 5, 80, 100) if n and d != c}
        before = after
    mixed = written(corpus_pipeline.mix_sources(spark, before, SMALL_SF), "test-stage")
    assert mixed.columns == docs.columns
    words = sum(len(r.text.split()) for r in before.collect())
    assert 0 <= words - sum(len(r.text.split()) for r in mixed.collect()) <= mixed.select("source").distinct().count()
    ids = corpus_pipeline.encode(spark, mixed, SMALL_SF).collect()
    assert len(ids) == mixed.count() and all(r.lossless for r in ids)
    library = library_tokenizer(default_path("byte_bpe_50k.json"))
    want = sorted(hashlib.sha1(b"".join(i.to_bytes(4, "little") for i in library.encode(r.text, add_special_tokens=False).ids)).hexdigest()
                  for r in mixed.collect())
    assert sorted(hashlib.sha1(bytes(r.token_ids)).hexdigest() for r in ids) == want
    assert corpus_pipeline.run(spark, SMALL_SF).count() == len(ids)
