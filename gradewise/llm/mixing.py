"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source the documents are ordered by
key: the key space is cut into equal ranges ("slots") of about ROWS_PER_SLOT documents,
each slot is sorted alone, and a document's place among the words of its source is the sum
of the slots before it plus the running sum in its slot.  The slots before it are summed in two
levels, whole stretches of SLOTS_PER_STRETCH slots and the slots of its own stretch, so that the
longest run that one task orders is a millionth of the largest source.  A source's budget is taken from
that order: whole passes while it lasts, then a prefix cut at the exact word.

Targets: source k in code-point order (null last) weighs ``weights[k mod len]``; together
they take all words.  A target above ``max_epochs`` times the source's size is lowered to
it and the excess shared among the others by weight, until none is above.

Cases: null and empty texts have size 0 and are taken 0 times; a null source is a source
of its own; the hash covers doc_id and size, so repeated rows tie and share one slot and
equal rows are exchangeable; an empty table gives an empty result.  Reruns agree: nothing
depends on partitions.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from gradewise.operators.index import with_global_index

from .support import unused, written

ROWS_PER_SLOT = 1000
SLOTS_PER_STRETCH = 1000
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, src: str, size: str, weights, max_epochs: int) -> DataFrame:
    """One row per source: __src, __rows, __source_size, __target."""
    sums = written(sized.groupBy(F.col(src).alias("__src")).agg(
        F.count("*").alias("__rows"), F.sum(size).alias("__source_size")), "mix-sources")
    ranked = with_global_index(sums, [F.col("__src").asc_nulls_last()], name="__rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("__rank") % len(weights) + 1).cast("int"))
    table = written(ranked.withColumn("__weight", weight)
                    .withColumn("__cap", (max_epochs * F.col("__source_size")).cast("double")), "mix-weights")
    total = float(table.agg(F.sum("__source_size")).first()[0] or 0)
    level = 0.0  # words per weight; rises until no open source is above its cap
    while True:
        capped = F.col("__weight") * level > F.col("__cap")
        spent, open_weight = table.agg(F.sum(F.when(capped, F.col("__cap")).otherwise(0.0)),
                                       F.sum(F.when(capped, 0.0).otherwise(F.col("__weight")))).first()
        following = (total - spent) / open_weight if open_weight else level
        if following <= level:
            break
        level = following
    return table.select("__src", "__rows", "__source_size",
                        F.least(F.col("__weight") * level, F.col("__cap")).alias("__target"))


def _before(words: str, group: list[str], *order: str) -> Column:
    """Sum of ``words`` over the rows before in the group."""
    rows = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(words).over(rows), F.lit(0))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=(1, 2, 3), max_epochs: int = 3, seed: int = 0, drop_text: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (size, source_size, target, taken); and its name.

    Only the columns given are shuffled, once, by (source, slot): a source of any size is
    spread over as many slots as it needs.
    """
    out, size, key, slot, named, nameless = unused(
        docs, "mix", "mix_size", "mix_key", "mix_slot", "mix_source", "mix_no_source")
    key_of = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
                            F.lit("|"), F.col(size).cast("string")))
    sized = docs.withColumn(size, word_count(F.col(text)))
    if drop_text:
        sized = written(sized.drop(text), "mix-sized")
    targets = source_targets(sized, source, size, weights, max_epochs)
    largest = targets.agg(F.max("__rows")).first()[0] or 0
    # leading 28 bits of the key, cut into equal ranges; their number follows the largest source
    slots = max(1, math.ceil(largest / ROWS_PER_SLOT))
    lead = F.conv(F.substring(key, 1, 7), 16, 10).cast("long")
    # the null source as columns that compare with plain equality: window and join share one shuffle
    whose = {named: lambda c: F.coalesce(c, F.lit("")), nameless: lambda c: c.isNull()}
    keyed = (sized.withColumn(key, key_of).withColumn(slot, F.floor(lead * slots / F.lit(1 << 28)).cast("long"))
             .withColumns({c: f(F.col(source)) for c, f in whose.items()}))
    place = [named, nameless, slot]
    targets = targets.withColumns({c: f(F.col("__src")) for c, f in whose.items()}).drop("__src", "__rows")
    whole = [named, nameless, "__stretch"]
    sums = written(keyed.groupBy(*place).agg(F.sum(size).alias("__words"))
                   .withColumn("__stretch", F.floor(F.col(slot) / SLOTS_PER_STRETCH)), "mix-slots")
    stretches = sums.groupBy(*whole).agg(F.sum("__words").alias("__words"))
    stretches = stretches.select(*whole, _before("__words", [named, nameless], "__stretch").alias("__earlier"))
    offsets = (sums.withColumn("__offset", _before("__words", whole, slot)).join(stretches, whole)
               .withColumn("__offset", F.col("__offset") + F.col("__earlier"))
               .drop("__words", "__earlier", "__stretch").join(targets, [named, nameless]))
    offsets = written(offsets, "mix-offsets")
    joined = keyed.withColumn("__before", _before(size, place, key, doc_id, size)).join(offsets, place)
    budget = F.floor("__target").cast("long")
    passes = F.when(F.col("__source_size") > 0, F.floor(budget / F.col("__source_size"))).otherwise(0).cast("long")
    rest = budget - passes * F.col("__source_size") - F.col("__offset") - F.col("__before")
    taken = passes * F.col(size) + F.greatest(F.lit(0), F.least(rest, F.col(size)))
    kept = [c for c in docs.columns if not (drop_text and c == text)]
    return joined.select(*kept, F.struct(F.col(size).alias("size"), F.col("__source_size").alias("source_size"),
                                         F.col("__target").alias("target"), taken.alias("taken")).alias(out)), out


@arrow_udf(StringType())  # a type, not its name: no session is needed on import
def first_words(texts: pa.Array, counts: pa.Array) -> pa.Array:
    """The text up to the end of its word number ``counts``; null stays null."""
    out = []
    for t, n in zip(texts.to_pylist(), counts.to_pylist()):
        ends = None if t is None else [m.end() for m in re.finditer(WORDS, t)]
        out.append(None if t is None else t[:ends[n - 1]] if 0 < n <= len(ends) else t)
    return pa.array(out, pa.string())


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars",
                    **options) -> DataFrame:
    """The mix as documents: a row per pass over a document, with the columns of ``docs``;
    the document at which a budget ends has a last row cut after the budget's last word."""
    mixed, m = mix(docs, doc_id=doc_id, text=text, **options)
    size, taken = F.col(f"{m}.size"), F.col(f"{m}.taken")
    part, copy = unused(mixed, "mix_part", "mix_copy")
    mixed = mixed.filter(taken > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(taken / size).cast("int"))))
    mixed = mixed.withColumn(part, F.least(size, taken - (F.col(copy) - 1) * size))
    cut = first_words(F.when(F.col(part) < size, F.col(text)), F.col(part))  # few rows have one
    mixed = mixed.withColumn(text, F.when(F.col(part) < size, cut).otherwise(F.col(text)))
    if n_chars and n_chars in docs.columns:
        mixed = mixed.withColumn(n_chars, F.when(F.col(part) < size, F.length(text).cast(docs.schema[n_chars].dataType))
                                 .otherwise(F.col(n_chars)))
    return mixed.select(*docs.columns)
