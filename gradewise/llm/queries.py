"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bytepair, fingerprints, htmltext, lexical, licenses, mixing, ngramjoin, periodic, quality, tokencount,
               tokenfile, toxicity, warc)
from .catalogue import query
from .support import read
from .vocabularies import default_path


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path("byte_bpe_50k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    back = bytepair.decode_documents(bytepair.encode_documents(docs, path), path)
    return back.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                       F.sha2("decoded_text", 256).alias("decoded_sha256"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_documents(docs, default_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenfile.token_files(docs, default_path("byte_bpe_50k.json"))


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged, q = quality.judge(docs, default_path("piece_bpe_32k.model"), keep_text=False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"{q}.{n}").alias(n) for n in names])


@query("op9_warc", """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
  SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
), judged AS (
  SELECT p.*, kept, kept IS NOT NULL AND page_id IS DISTINCT FROM kept AS again
  FROM p LEFT JOIN kept USING (payload_digest)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN kept END AS refers_to
FROM judged
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archived_pages(read(spark, sf_dir, "pages"))
    return captures.select("page_id", F.coalesce("capture.payload_bytes", "revisited.payload_bytes").alias("payload_bytes"),
                           F.col("capture.payload_digest").alias("payload_digest"),
                           F.col("capture.record_type").alias("record_type"), F.col("revisited.page_id").alias("refers_to"))


@query("op10_mixing", r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), sources AS (
  SELECT *, [1.0, 2.0, 3.0][place % 3 + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM sums
), levels(step, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, (SELECT (sum(source_size)::DOUBLE - sum(CASE WHEN weight * level > cap THEN cap ELSE 0 END))
                           / sum(CASE WHEN weight * level > cap THEN 0 ELSE weight END) FROM sources)
  FROM levels WHERE step < 60
), targets AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM levels), cap) AS target FROM sources
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || size),
                     doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_before
  FROM sized
), budgets AS (
  SELECT p.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS passes
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(budget - passes * source_size - words_before, size)))::BIGINT AS taken
FROM budgets
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed, m = mixing.mix(docs, drop_text=True)
    return mixed.select("doc_id", f"{m}.size", f"{m}.source_size", f"{m}.target", f"{m}.taken")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found, t = toxicity.scored(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return found.select("doc_id", f"{t}.held_out", f"{t}.score", f"{t}.predicted")


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    return htmltext.extract(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query("op8_ngram_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngramjoin.near_duplicates(docs, size=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "class_id", "component_id", "n_links", "n_class_links")


@query("op11_lexical_search", r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), repeats AS (
  SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tfs, totals WHERE term IN (SELECT term FROM asked) GROUP BY term
), scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM repeats JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    return lexical.search(docs, items, k=10)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", periodic.repeated_tail_column(F.col("doc_id"), F.col("text")).alias("text"))
    found, p = periodic.with_runs(docs)
    lines = F.transform(f"{p}.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(lines) > 0, "\n").otherwise(""))
    return (found.withColumn("longest", periodic.longest_run(F.col(f"{p}.runs")))
            .select("doc_id", F.size(f"{p}.runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
                    "longest.exponent_milli", F.sha2(listed, 256).alias("runs_sha256"),
                    F.sha2(f"{p}.collapsed", 256).alias("collapsed_sha256")))


@query("op13_license_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, s = licenses.with_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    places, spans = F.col(f"{s}.places"), F.col(f"{s}.spans")
    words = F.transform(places, lambda x: x["word"])
    return found.select("doc_id", f"{s}.n_words", F.size(places).cast("long").alias("n_base"), F.array_min(words).alias("first_word"),
                        F.array_max(words).alias("last_word"), licenses.labels_of(places).alias("base_labels"),
                        licenses.labels_of(places, spans).alias("labels"), licenses.best_likeness(places, spans).alias("score"))
