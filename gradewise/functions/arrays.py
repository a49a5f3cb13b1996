"""Column -> Column functions over token arrays (one row = one sequence).

Arrays are kept unpadded where possible; padding is produced on request.
Everything here is a Catalyst expression (higher-order array functions),
so it runs in the JVM next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col, let, seeded_draw


def array_sum(arr, zero=0.0) -> Column:
    """Sum of an array (``zero`` fixes the accumulator type)."""
    return F.aggregate(as_col(arr), F.lit(zero), lambda acc, x: acc + x)


def masked_row_sum(values, mask) -> Column:
    """Per-row Σ values·mask (A1, row form)."""
    return array_sum(F.zip_with(as_col(values), as_col(mask), lambda v, m: v * m))


def masked_row_mean(values, mask) -> Column:
    """Per-row Σ values·mask / Σ mask; NULL when the mask is empty."""
    return F.try_divide(masked_row_sum(values, mask), array_sum(as_col(mask)))


# --- T2 / T3: pad and truncate ------------------------------------------------

def pad_to(arr, length, pad_value, left: bool = False) -> Column:
    """Pad ``arr`` with ``pad_value`` up to ``length`` (no truncation)."""
    length = as_col(length) if not isinstance(length, int) else F.lit(length)

    def build(a):
        padding = F.array_repeat(F.lit(pad_value).cast(_elem_type_hint(pad_value)),
                                 F.greatest(length - F.size(a), F.lit(0)))
        return F.concat(padding, a) if left else F.concat(a, padding)
    return let(arr, build)


def _elem_type_hint(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "double"
    return "string"


def truncate(arr, length: int, side: str = "right") -> Column:
    """Cut ``arr`` to ``length``: keep the head (right), the tail (left) or fail (error)."""
    arr = as_col(arr)
    if side == "right":
        return F.slice(arr, 1, length)
    if side == "left":
        return let(arr, lambda a: F.when(F.size(a) > length,
                                         F.slice(a, F.size(a) - length + 1, F.lit(length))).otherwise(a))
    if side == "error":
        return let(arr, lambda a: F.when(F.size(a) > length, F.raise_error(F.format_string(
            f"sequence length %d is larger than max length {length}", F.size(a)))).otherwise(a))
    raise ValueError(f"unknown truncation {side!r}")


def pad_and_truncate(arr, length: int, pad_value, left_pad: bool = True,
                     truncation: str = "error") -> tuple[Column, Column]:
    """Fixed-length ids and the matching attention mask."""
    both = let(truncate(arr, length, truncation), lambda cut: F.struct(
        pad_to(cut, length, pad_value, left=left_pad).alias("ids"),
        pad_to(F.array_repeat(F.lit(1), F.size(cut)), length, 0, left=left_pad).alias("mask")))
    return both["ids"], both["mask"]


# --- T4 / T5 / T6: masks and positions ---------------------------------------

def position_ids(mask) -> Column:
    """T4: ``max(cumsum(mask) - 1, 0)``.

    Closed form for masks with one run of ones (every mask built by padding,
    truncation or ``eos_mask``): before the run 0, inside it ``i - first``,
    after it ``count - 1``.
    """
    def build(mk):
        return let(F.array_position(mk, 1) - 1, lambda first: let(array_sum(mk, 0), lambda cnt: F.transform(
            mk, lambda m, i: F.when(first < 0, F.lit(0)).otherwise(
                F.least(F.greatest(i - first, F.lit(0)), F.greatest(cnt - 1, F.lit(0)))).cast("int"))))
    return let(mask, build)


def first_eos_position(ids, eos_ids) -> Column:
    """1-based position of the first token in ``eos_ids``; NULL if none."""
    ids = as_col(ids)
    eos_ids = [eos_ids] if isinstance(eos_ids, int) else list(eos_ids)
    found = F.array(*[F.array_position(ids, F.lit(e)) for e in eos_ids])
    return F.array_min(F.filter(found, lambda p: p > 0)).cast("int")


def eos_mask(ids, eos_ids=2) -> Column:
    """T5: 1 up to and including the first eos token, 0 after it."""
    return let(ids, lambda x: let(first_eos_position(x, eos_ids), lambda p: F.transform(
        x, lambda _t, i: F.when(p.isNull() | (i < p), 1).otherwise(0))))


def remove_left_padding(ids, mask) -> Column:
    """Keep the last ``sum(mask)`` ids (left-padded prompts)."""
    return let(ids, lambda x: let(array_sum(mask, 0), lambda n: F.when(n <= 0, F.slice(x, 1, 0)).otherwise(
        F.slice(x, F.size(x) - n + 1, n))))


def strip_pad_prefix(ids, pad_id: int) -> Column:
    """T6 (generator form): drop leading pad tokens."""
    def build(x):
        return let(F.array_position(F.transform(x, lambda t: t != F.lit(pad_id)), True).cast("int"),
                   lambda first: F.when(first == 0, F.slice(x, 1, 0)).otherwise(
                       F.slice(x, first, F.size(x) - first + 1)))
    return let(ids, build)


def valid_length(mask) -> Column:
    """Number of valid tokens (sum of the mask)."""
    return array_sum(mask, 0)


def clamp_arrays(x, lo, hi) -> Column:
    """``max(min(x, hi), lo)`` elementwise."""
    z = F.arrays_zip(as_col(x).alias("x"), as_col(lo).alias("lo"), as_col(hi).alias("hi"))
    return F.transform(z, lambda s: F.greatest(F.least(s["x"], s["hi"]), s["lo"]))


def score_at_last_token(score, mask) -> Column:
    """Scalar score on the last valid token, 0 elsewhere (right-padded)."""
    return let(mask, lambda mk: let(array_sum(mk, 0), lambda n: let(as_col(score).cast("double"), lambda sc: F.transform(
        mk, lambda m, i: F.when(i == n - 1, sc).otherwise(F.lit(0.0))))))


def joined_sequence(prompt_ids, prompt_mask, response_ids, eos_ids) -> dict[str, Column]:
    """prompt+response ids, joined attention mask, continued position ids."""
    prompt_ids, prompt_mask, response_ids = map(as_col, (prompt_ids, prompt_mask, response_ids))
    resp_mask = eos_mask(response_ids, eos_ids)

    def positions(pp):
        return let(F.coalesce(F.try_element_at(pp, F.lit(-1)), F.lit(-1)), lambda last: F.concat(
            pp, F.transform(response_ids, lambda x, i: (last + 1 + i).cast("int"))))
    return {
        "input_ids": F.concat(prompt_ids, response_ids),
        "attention_mask": F.concat(prompt_mask, resp_mask),
        "position_ids": let(position_ids(prompt_mask), positions),
        "response_mask": resp_mask,
    }


# --- T12 / T13 / T14: log-softmax arithmetic over logit arrays ---------------

def logsumexp(logits) -> Column:
    return let(logits, lambda lg: let(F.array_max(lg).cast("double"), lambda m: m + F.log(
        F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))))


def logprob_of_label(logits, label) -> Column:
    """``logits[label] - logsumexp(logits)`` (label 0-based)."""
    return let(logits, lambda lg: F.element_at(lg, as_col(label).cast("int") + 1).cast("double") - logsumexp(lg))


def entropy_from_logits(logits) -> Column:
    """``logsumexp - Σ softmax·x``."""
    return let(logits, lambda lg: let(logsumexp(lg), lambda lse: lse - F.aggregate(
        lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - lse) * x)))


def response_logprobs(step_logits, input_ids, response_length: int) -> Column:
    """Log-probs of the last ``response_length`` ids given per-step logits.

    ``step_logits[t]`` predicts ``input_ids[t+1]``, so the response uses logits
    ``[-L-1 : -1]`` and labels ``[-L :]``.
    """
    step_logits, input_ids = as_col(step_logits), as_col(input_ids)
    n = F.size(input_ids)
    labels = F.slice(input_ids, n - response_length + 1, F.lit(response_length))
    logits = F.slice(step_logits, n - response_length, F.lit(response_length))
    return F.zip_with(logits, labels, lambda lg, lb: logprob_of_label(lg, lb))


# --- T20: seeded random masks -------------------------------------------------

def random_mask(seq_len: int, key, seed: int, max_valid_ratio: float,
                max_left_pad_ratio: float, min_valid_ratio: float = 0.0) -> Column:
    """Left padding then a valid run, sizes drawn from a hash of ``key``."""
    max_valid = int(seq_len * max_valid_ratio)
    min_valid = max(1, int(seq_len * min_valid_ratio))
    max_left = int(seq_len * max_left_pad_ratio)
    if not (0 < max_valid and max_valid + max_left <= seq_len and min_valid <= max_valid):
        raise ValueError("invalid ratios for random_mask")
    key = as_col(key)
    left = F.pmod(seeded_draw(key, seed, F.lit("left")), F.lit(max_left + 1))
    valid = min_valid + F.pmod(seeded_draw(key, seed, F.lit("valid")), F.lit(max_valid - min_valid + 1))
    return let(left, lambda lf: let(valid, lambda vd: F.transform(
        F.sequence(F.lit(0), F.lit(seq_len - 1)), lambda i: F.when((i >= lf) & (i < lf + vd), 1).otherwise(0))))
