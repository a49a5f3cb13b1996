"""From raw documents to a mixed, tokenised corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet in the folder that ``spark.checkpoint.dir`` names and gives the next stage what
it reads back, so a lost executor never costs more than the stage at hand.

1. toxicity: documents that the classifier rejects go.
2. quality: documents that the base rules or the vocabulary's bands reject go.
3. near duplicates: of documents linked by five-word shingles at a similarity of 0.8 or
   more one stays.
4. mixing: documents are repeated, kept or left out so that each source has its share of
   words; the document at a source's last word is cut there.
5. byte-pair encoding: one row per document of the mix with its ids, decoded again to check
   that nothing was lost.

All but the last keep the columns of ``documents``.

Whole texts go through Python and the writer together, so every stage limits the rows that its
session hands to Python at once (``limit_arrow_batches``); the setting stays on the session.

Cases: null and empty texts fail the base rules of stage 2; a stage that keeps nothing, and an
empty table, give empty results; repeated rows are treated alike until stage 3, where one of
them stays; null sources mix as a source of their own; the last stage leaves out columns other
than those of ``documents`` and takes nulls for missing ones of lang, source and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.llm import bytepair, mixing, ngramjoin, quality, toxicity
from gradewise.llm.support import limit_arrow_batches, read, written
from gradewise.llm.vocabularies import default_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_arrow_batches(spark)
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_arrow_batches(spark)
    return quality.keep_good(docs, default_path("piece_bpe_32k.model"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_arrow_batches(spark)
    return ngramjoin.one_of_each(docs, size=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_arrow_batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_arrow_batches(spark)
    path = default_path("byte_bpe_50k.json")
    has = {c.lower() for c in docs.columns}
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}  # other columns may clash with new names
    docs = docs.select("doc_id", *[F.col(c) if c in has else F.lit(None).cast(k).alias(c) for c, k in kinds.items()], "text")
    both = bytepair.decode_documents(bytepair.encode_documents(docs, path), path)
    return both.selectExpr("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids",
                           "decoded_text = coalesce(text, '') AS lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("bpe encoding and decoding", encode),
]

#: The classifier and the quantile sketches have no SQL twin; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
