"""Quality rules from tokeniser fertility.

A public piece vocabulary measures each document: characters per token, the share of
byte-fallback tokens, and the entropy of its token distribution.  Text of a kind that the
vocabulary handles like the rest of its language gives figures close to the language's
median; symbol noise, spam, encoding faults and boilerplate do not.

Bands are learned from the distinct texts that pass the base rules, each counted once in a
cell whatever its copies: per language (or per dominant script where a document has no
language) and per length class, since entropy and its spread depend on length.  A band is
median +- ``width`` robust deviations (a quartile distance / 1.349), which are not below the
floors, the median deviation of the group's length classes and that of all cells of the same
kind: near copies that fill a cell do not make it narrow.

Every document meets a band.  A cell of fewer than ``min_docs`` texts gives way to the next
of: language and length, language, script and length, script.  Where a whole script has
fewer, entropy is held against all documents (of that length, or of any), characters per
token and byte share against the few of the script, as they differ between scripts; texts
without letters are held against all documents.

Base rules: at least 50 words, at most half of them in 3-word windows that occur twice.

Cases: null and empty texts have no words and fail the base rules; null or empty language
falls back to the script; ties and repeated rows are measured and judged alike;
texts of any length are measured whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .support import strings, unused, working_for, written
from .tokencount import BATCH_CHARS
from .vocabularies import piece_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
BLANK = " \t\n\x0b\x0c\r"

#: First code points of script blocks and the script that starts there.
SCRIPT_STARTS = [
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"),
    (0x00C0, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0x4DC0, "other"), (0x4E00, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
STARTS = np.array([s for s, _ in SCRIPT_STARTS])
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
SCRIPT_AT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string")

#: measure -> (smallest deviation, whether low values are rejected, whether high ones are)
BANDED = {"chars_per_token": (0.02, True, True), "byte_share": (0.004, False, True),
          "token_entropy": (0.05, True, True)}
RELATIVE = {"chars_per_token"}  # its deviations are shares of the median


def script_of(text: str) -> str:
    """The script with most letters; ties by name; "other" without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(SCRIPT_AT[np.searchsorted(STARTS, points, side="right") - 1], minlength=len(SCRIPTS))
    counts[SCRIPTS.index("other")] = 0
    return SCRIPTS[int(counts.argmax())] if counts.any() else "other"


def repeated_window_words(words: list[str], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more, first ones included."""
    windows = list(zip(*(words[k:] for k in range(size))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # covered: words before this index are counted
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + size - max(at, covered)
            covered = at + size
    return total


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def encoded_in_batches(model, texts: list[str]):
    """Token ids of each text, a bounded amount of text at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
            size += len(texts[end])
            end += 1
        yield from model.encode(texts[at:end], num_threads=1)
        at = end


def measure_column(text: Column, path: str) -> Column:
    """Struct of MEASURES for each whole text."""
    @arrow_udf(MEASURES)
    def measures(column: pa.Array) -> pa.Array:
        working_for("quality")
        texts, model, out = strings(column), piece_model(path), []
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        for t, ids in zip(texts, encoded_in_batches(model, texts)):
            words = WORD.findall(t)
            ids = np.asarray(ids, np.int64)
            n = ids.size
            counts = np.bincount(ids) if n else np.zeros(0)
            share = counts[counts > 0] / max(n, 1)
            out.append({
                "n_words": len(words), "word_chars": sum(map(len, words)),
                "n_symbols": len(SYMBOLS.findall(t)), "n_dup_lines": repeated_lines(t),
                "n_repeat_words": repeated_window_words(words), "n_tokens": n,
                "chars_per_token": len(t) / n if n else 0.0,
                "byte_share": float(is_byte[ids].mean()) if n else 0.0,
                "token_entropy": float(-(share * np.log2(share)).sum()) if n else 0.0,
                "script": script_of(t)})
        kinds = [("long", pa.int64()), ("double", pa.float64()), ("string", pa.string())]
        fields = [(name, dict(kinds)[kind]) for name, kind in (f.split() for f in MEASURES.split(", "))]
        return pa.array(out, pa.struct(fields))
    return measures(text)


def base_failed(m: str) -> Column:
    words, repeats = F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def length_class(m: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(f"{m}.n_tokens"), F.lit(1)).cast("double"))).cast("int")


#: Kinds of cells, narrow ones first: (name, column of the group or none, whether by length class).
LEVELS = [("fine", "group", True), ("whole", "group", False), ("script_fine", "script", True),
          ("script", "script", False), ("all_fine", None, True), ("all", None, False)]


def cell_key(level: str, group: Column, script: Column, cls: Column) -> Column:
    _, by, fine = LEVELS[[name for name, _, _ in LEVELS].index(level)]
    return F.struct(F.lit(level).alias("level"), {"group": group, "script": script, None: F.lit("")}[by].alias("g"),
                    (cls if fine else F.lit(-1)).alias("c"))


def learn_bands(measured: DataFrame, m: str, group: str, cls: str, digest: str, width: float, min_docs: int) -> DataFrame:
    """One row per cell (level, g, c; c -1: all lengths) with its number of texts and the limits of
    each measure; cells of fewer than ``min_docs`` only for a whole script and for all documents."""
    keys = [cell_key(level, F.col(group), F.col(f"{m}.script"), F.col(cls)) for level, _, _ in LEVELS]
    rows = (measured.filter(~base_failed(m))
            .select(F.explode(F.array(*keys)).alias("k"), F.col(digest).alias("text_digest"), *[F.col(f"{m}.{x}").alias(x) for x in BANDED])
            .select("k.*", "text_digest", *BANDED).dropDuplicates(["level", "g", "c", "text_digest"]))
    # a partial aggregate per cell; a cell of any size is a few sketches
    quart = [F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(f"q_{x}") for x in BANDED]
    cells = (rows.groupBy("level", "g", "c").agg(F.count("*").alias("n"), *quart)
             .filter((F.col("n") >= min_docs) | F.col("level").isin("script", "all")))
    cells = written(cells.select("level", "g", "c", "n", *[F.col(f"q_{x}")[1].alias(f"mid_{x}") for x in BANDED],
                                 *[((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349 / unit(x)).alias(f"dev_{x}") for x in BANDED]),
                    "quality-cells")

    def usual(name, *by):  # the median deviation of cells that are alike, the larger one of two
        return (cells.filter(F.col("n") >= min_docs).groupBy(*by)
                .agg(*[F.percentile_approx(f"dev_{x}", 0.51, 2000).alias(f"{name}_{x}") for x in BANDED]))
    found = cells.join(usual("kind", "level"), "level", "left").join(usual("group", "level", "g"), ["level", "g"], "left")
    limits = []
    for x, (least, low, high) in BANDED.items():
        scale = F.col(f"mid_{x}") if x in RELATIVE else F.lit(1.0)
        reach = width * scale * F.greatest(F.col(f"dev_{x}"), F.col(f"kind_{x}"), F.col(f"group_{x}"), F.lit(least))
        limits += [((F.col(f"mid_{x}") - reach) if low else F.lit(-math.inf)).alias(f"low_{x}"),
                   ((F.col(f"mid_{x}") + reach) if high else F.lit(math.inf)).alias(f"high_{x}")]
    return found.select("level", "g", "c", "n", *limits)


def unit(x: str) -> Column:
    """What deviations of a measure are counted in."""
    return F.col(f"q_{x}")[1] if x in RELATIVE else F.lit(1.0)


def limits_of_cells(cells: DataFrame, bands: DataFrame, min_docs: int) -> DataFrame:
    """``cells`` (g, script_name, c) with the limits that hold there."""
    names = [f"{side}_{x}" for x in BANDED for side in ("low", "high")]
    for level, _, _ in LEVELS:
        key = cell_key(level, F.col("g"), F.col("script_name"), F.col("c"))
        side = bands.filter(F.col("level") == level).select(F.struct("level", "g", "c").alias("key_" + level), F.struct("n", *names).alias(level))
        cells = cells.join(side, key == F.col("key_" + level), "left").drop("key_" + level)
    enough = F.when(F.col("script.n") >= min_docs, F.col("script"))
    limits = []
    for name in names:
        alone = F.coalesce(F.col(f"all_fine.{name}"), F.col(f"all.{name}"))
        if not name.endswith("token_entropy"):
            alone = F.when(F.col("script_name") == "other", alone).otherwise(F.col(f"script.{name}"))
        limits.append(F.coalesce(F.col(f"fine.{name}"), F.col(f"whole.{name}"), F.col(f"script_fine.{name}"), enough[name], alone).alias(name))
    return cells.select("g", "script_name", "c", F.struct(*limits).alias("limits"))


def bounded(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Broadcast a written table of at most ``rows`` rows; leave a larger one to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def judge(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", keep_text: bool = True,
          width: float = 4.0, min_docs: int = 50) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of the measures, base_failed and kept; and its name.

    The measured table is written once in the shared folder, so the vocabulary runs once
    per document.  ``keep_text`` False leaves the text out of that table.
    """
    m, group, cls, digest, verdict = unused(docs, "measures", "band_group", "band_class", "text_digest", "quality")
    measured = docs.withColumn(m, measure_column(F.col(text), path)).withColumn(digest, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    known = F.trim(F.coalesce(F.col(lang), F.lit("")))
    measured = (measured
                .withColumn(group, F.when(known != "", F.concat(F.lit("language "), known))
                            .otherwise(F.concat(F.lit("script "), F.col(f"{m}.script"))))
                .withColumn(cls, length_class(m)))
    measured = written(measured if keep_text else measured.drop(text), "quality-measures")
    bands = written(learn_bands(measured, m, group, cls, digest, width, min_docs), "quality-bands")
    cells = measured.select(F.col(group).alias("g"), F.col(f"{m}.script").alias("script_name"), F.col(cls).alias("c")).distinct()
    limits = written(limits_of_cells(cells, bands, min_docs), "quality-limits").select(
        F.col("g").alias("__g"), F.col("script_name").alias("__script"), F.col("c").alias("__c"), F.col("limits").alias("__limits"))
    joined = measured.join(bounded(limits), (F.col(group) == F.col("__g")) & (F.col(f"{m}.script") == F.col("__script"))
                           & (F.col(cls) == F.col("__c")), "left")
    band = F.col("__limits")
    inside = F.lit(True)
    for x in BANDED:
        value = F.col(f"{m}.{x}")
        inside = inside & (value >= band[f"low_{x}"]) & (value <= band[f"high_{x}"])
    columns = [c for c in measured.columns if c not in (m, group, cls, digest)]
    out = joined.select(*columns, F.struct(
        *[F.col(f"{m}.{f.split()[0]}").alias(f.split()[0]) for f in MEASURES.split(", ")],
        F.col(group).alias("band_group"), base_failed(m).alias("base_failed"),
        (~base_failed(m) & F.coalesce(inside, F.lit(False))).alias("kept")).alias(verdict))
    return out, verdict


def keep_good(docs: DataFrame, path: str, **options) -> DataFrame:
    """The documents of ``docs`` that are kept, with their columns."""
    judged, verdict = judge(docs, path, **options)
    return judged.filter(F.col(f"{verdict}.kept")).select(*docs.columns)
