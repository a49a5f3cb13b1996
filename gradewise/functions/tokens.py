"""Tokenisation stand-ins and sequence builders.

The reference tokenises with a model tokenizer.  Here a token is a
whitespace-separated word and its id is a stable function of the word:
``hash`` (default) maps it to ``pmod(xxhash64(word), vocab)``, ``codepoint``
to ``first code point * 64 + min(length, 63)`` (reproducible in SQL, used by
the oracle checks).  A model tokenizer can be plugged in as a pandas UDF that
returns ``array<int>``; the builders below only see id arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import array_sum, position_ids
from .common import as_col, let
from .text import py_strip


def words(text) -> Column:
    """``str.split()``: runs of whitespace separate words; blank text -> []."""
    return let(py_strip(as_col(text)), lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>"))
               .otherwise(F.split(t, r"(?U)\s+")))


def token_id(word, method: str = "hash", vocab_size: int = 32000) -> Column:
    w = as_col(word)
    if method == "hash":
        return F.pmod(F.xxhash64(w), F.lit(vocab_size)).cast("int")
    if method == "codepoint":
        return (F.ascii(w) * 64 + F.least(F.length(w), F.lit(63))).cast("int")
    raise ValueError(f"unknown token id method {method!r}")


def tokenize(text, method: str = "hash", vocab_size: int = 32000) -> Column:
    """Text -> array<int> of word ids."""
    return F.transform(words(text), lambda w: token_id(w, method, vocab_size))


def sft_sequence(prompt_ids, response_ids, eos_id: int, pad_id: int, max_length: int,
                 truncation: str = "error") -> Column:
    """Prompt + response + eos, right padded / truncated; attention mask,
    position ids and loss mask (prompt tokens except the last one masked, and
    the last response token masked)."""
    p, r = as_col(prompt_ids), F.concat(as_col(response_ids), F.array(F.lit(eos_id)))

    def build(ids, plen):
        n = F.size(ids)
        if truncation == "left":
            cut = F.when(n > max_length, F.slice(ids, n - max_length + 1, F.lit(max_length))).otherwise(ids)
        elif truncation == "right":
            cut = F.slice(ids, 1, max_length)
        elif truncation == "error":
            cut = F.when(n > max_length, F.raise_error(F.lit(f"sequence is longer than max_length={max_length}"))
                         .cast("array<int>")).otherwise(ids)
        else:
            raise ValueError(f"unknown truncation {truncation!r}")

        def out(c):
            k = F.size(c)
            input_ids = F.concat(c, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(max_length) - k, F.lit(0))))
            mask = F.concat(F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), F.greatest(F.lit(max_length) - k, F.lit(0))))
            last = F.least(n, F.lit(max_length)) - 1
            loss = F.transform(mask, lambda m, i: F.when(
                ((plen > 1) & (i < F.least(plen, F.lit(max_length)) - 1)) | (i == last), 0).otherwise(m))
            return F.struct(input_ids.alias("input_ids"), mask.alias("attention_mask"),
                            position_ids(mask).alias("position_ids"), loss.alias("loss_mask"))
        return let(cut, out)
    # bind the prompt and its length once: they are used inside per-token lambdas
    return let(p, lambda pv: let(F.concat(pv, r), lambda ids: let(F.size(pv), lambda plen: build(ids, plen))))


def rm_pair(prompt_ids, chosen_ids, rejected_ids, eos_id: int, max_length: int) -> Column:
    """Chosen and rejected sequences (prompt + response + eos), right
    padded with 0 or cut; each with its own mask (quirk Q6 fixed)."""
    p = as_col(prompt_ids)

    def one(resp):
        ids = F.concat(p, as_col(resp), F.array(F.lit(eos_id)))
        return let(ids, lambda x: F.struct(
            F.concat(F.slice(x, 1, max_length),
                     F.array_repeat(F.lit(0), F.greatest(F.lit(max_length) - F.size(x), F.lit(0)))).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), F.least(F.size(x), F.lit(max_length))),
                     F.array_repeat(F.lit(0), F.greatest(F.lit(max_length) - F.size(x), F.lit(0)))).alias("attention_mask")))
    return F.struct(one(chosen_ids).alias("chosen"), one(rejected_ids).alias("rejected"))


def duplicate_ngram_fraction(tokens, n: int = 3) -> Column:
    """T17 (re-aimed): share of word n-grams that repeat an earlier n-gram, told apart by
    64-bit hashes of the words and of the hashes of n neighbours."""
    def frac(h):
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - n + 1, F.lit(1))),
                            lambda i: F.xxhash64(*[F.try_element_at(h, i + k) for k in range(n)]))
        return let(grams, lambda g: F.when(F.size(h) < n, F.lit(0.0)).otherwise(
            1.0 - F.size(F.array_distinct(g)).cast("double") / F.size(g)))
    return let(F.transform(as_col(tokens), lambda w: F.xxhash64(w)), frac)


def is_repetitive(tokens, n: int = 3, threshold: float = 0.2) -> Column:
    return duplicate_ngram_fraction(tokens, n) > threshold


def mask_sum(mask) -> Column:
    return array_sum(mask, 0)
