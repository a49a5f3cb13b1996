"""Rule-based scorers (R9-R31) and the scorer registry / reward manager.

A scorer is a function of Columns returning a struct ``(score DOUBLE, extra
MAP<STRING,DOUBLE>)``; everything is a Catalyst expression, so scoring a
billion responses is a map over partitions with no Python in the loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.common import as_col, let

Scorer = Callable[..., Column]


def _result(score: Column, extra: dict[str, Column] | None = None) -> Column:
    keys, vals = [], []
    for k, v in (extra or {}).items():
        keys.append(F.lit(k))
        vals.append(v.cast("double"))
    m = F.map_from_arrays(F.array(*keys), F.array(*vals)) if keys else \
        F.create_map().cast("map<string,double>")
    return F.struct(score.cast("double").alias("score"), m.alias("extra"))


def _puzzle_let(response, solution_text, body, with_marker: bool = True, with_prediction: bool = False) -> Column:
    """Evaluate the puzzle parse once per row and hand the pieces to ``body``
    (processed, answer, truth, names, parsed, match, has_answer, and the
    prediction where it is asked for)."""
    processed = T.assistant_part(response) if with_marker else as_col(response)

    def with_truth(p, a, t):
        def with_names(names):
            def with_pred(pred):
                parsed = pred.isNotNull() & (F.size(pred) > 0)
                match = parsed & T.identities_match(pred, t)
                has_answer = a.isNotNull() & (a != "")
                return body(p, a, t, names, parsed, match, has_answer, *([pred] if with_prediction else []))
            return let(T.predicted_identities(a, names), with_pred)
        return let(F.transform(t, lambda x: x["name"]), with_names)
    return let(processed, lambda p: let(T.last_answer_block(p), lambda a: let(
        T.truth_identities(solution_text), lambda t: with_truth(p, a, t))))


def with_puzzle_parse(df: DataFrame, response="response", solution_text="solution_text",
                      with_marker: bool = True) -> DataFrame:
    """Add the puzzle parse as columns ``_pz_processed``, ``_pz_answer``,
    ``_pz_truth``, ``_pz_names``, ``_pz_pred``, ``_pz_parsed``, ``_pz_match``
    and ``_pz_has_answer``.

    The parse is one ``let``-bound struct, so each expensive value is computed
    once per row even when the optimizer inlines the projection into a later
    filter (predicate pushdown substitutes column references by their
    expressions).
    """
    def body(processed, answer, truth, names, parsed, match, has_answer, pred):
        return F.struct(processed.alias("processed"), answer.alias("answer"), truth.alias("truth"),
                        names.alias("names"), pred.alias("pred"), parsed.alias("parsed"), match.alias("match"),
                        has_answer.alias("has_answer"))
    d = df.withColumn("_pz", _puzzle_let(response, solution_text, body, with_marker, True))
    for f in ("processed", "answer", "truth", "names", "pred", "parsed", "match", "has_answer"):
        d = d.withColumn(f"_pz_{f}", F.col("_pz")[f])
    return d.drop("_pz")


def drop_puzzle_parse(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_pz_")])


def puzzle_scores(df: DataFrame, variant: str = "pure", response="response",
                  solution_text="solution_text", valid_response_length=None,
                  max_response_length: int = 4096) -> DataFrame:
    """R9-R12 on a DataFrame: adds ``score`` and the variant's extra columns."""
    d = with_puzzle_parse(df, response, solution_text)
    proc, names = F.col("_pz_processed"), F.col("_pz_names")
    parsed, match, has_answer = F.col("_pz_parsed"), F.col("_pz_match"), F.col("_pz_has_answer")
    if variant == "pure":
        d = d.withColumn("score", F.when(has_answer & match, 1.0).otherwise(0.0))
        d = d.withColumn("outcome_score", F.col("score"))
    elif variant == "v1":
        d = d.withColumn("_fmt", T.tags_in_order(proc, T.THINK_ANSWER_TAGS))
        fmt = F.col("_fmt")
        ans = (F.when(fmt & has_answer & parsed & match, 2.0).when(fmt & has_answer & parsed, -1.5).otherwise(-2.0))
        d = (d.withColumn("score", F.when(fmt, 1.0).otherwise(-1.0) + ans)
              .withColumn("outcome_score", F.when(fmt & has_answer & match, 1.0).otherwise(0.0))
              .withColumn("format_score", F.when(fmt, 1.0).otherwise(0.0)).drop("_fmt"))
    elif variant in ("new", "verify"):
        vlen = F.col(valid_response_length) if isinstance(valid_response_length, str) else valid_response_length
        end_tag = "</think>" if variant == "new" else "</verify>"
        tokens = T.REFLECTION_TOKENS if variant == "new" else T.VERIFY_REFLECTION_TOKENS
        f = F.col("thinking_factor")
        judged = has_answer
        if variant == "verify":
            d = d.withColumn("format_score", F.when(T.verify_structure(proc), 0.0).otherwise(-1.0))
            judged = has_answer & (F.col("format_score") == 0.0) & (vlen > MIN_VERIFY_TOKENS)
        # read where it counts alone: it takes several searches of the thinking
        d = d.withColumn("thinking_factor", F.when(match & F.coalesce(judged, F.lit(True)),
                                                   T.thinking_factor(proc, names, end_tag, variant == "new", tokens)))
        ans = F.when(~judged, -2.0).when(~parsed, -1.0).when(match, 2.0 * f).otherwise(-0.5)
        if variant == "new":
            length = F.when((vlen <= 100) | (vlen >= max_response_length), -1.0).otherwise(0.0)
            d = d.withColumn("length_score", length).withColumn("score", ans + F.col("length_score"))
        else:
            length = F.when((vlen <= MIN_VERIFY_TOKENS) | (vlen >= max_response_length), -1.0).otherwise(0.0)
            d = (d.withColumn("language_mix_score", T.language_mix_reward(response)).withColumn("length_score", length)
                  .withColumn("score", ans + F.col("format_score") + F.col("language_mix_score") + F.col("length_score")))
        d = (d.withColumn("outcome_score", F.when(judged & match, 1.0).otherwise(0.0))
              .withColumn("thinking_factor", F.when(judged & match, f).otherwise(1.0)))
    else:
        raise ValueError(f"unknown puzzle scorer {variant!r}")
    return drop_puzzle_parse(d)


def puzzle_score_v1(response, solution_text) -> Column:
    """Format ±1 (tags once, in order) plus answer +2 / -1.5 / -2."""
    def body(processed, answer, truth, names, parsed, match, has_answer):
        return let(T.tags_in_order(processed, T.THINK_ANSWER_TAGS), lambda fmt_ok: _result(
            F.when(fmt_ok, 1.0).otherwise(-1.0)
            + F.when(fmt_ok & has_answer & parsed & match, 2.0).when(fmt_ok & has_answer & parsed, -1.5).otherwise(-2.0),
            {"outcome_score": F.when(fmt_ok & has_answer & match, 1).otherwise(0),
             "format_score": F.when(fmt_ok, 1).otherwise(0)}))
    return _puzzle_let(response, solution_text, body)


def puzzle_score_pure(response, solution_text) -> Column:
    """1 when every identity matches, else 0."""
    def body(processed, answer, truth, names, parsed, match, has_answer):
        ok = has_answer & match
        return _result(F.when(ok, 1.0).otherwise(0.0), {"outcome_score": F.when(ok, 1).otherwise(0)})
    return _puzzle_let(response, solution_text, body)


def puzzle_score_new(response, solution_text, valid_response_length, max_response_length: int) -> Column:
    """2·thinking factor on a full match, -0.5 wrong, -1 unparsed, -2 no
    answer; plus -1 for responses of <= 100 or >= max tokens."""
    vlen = as_col(valid_response_length)
    length = F.when((vlen <= 100) | (vlen >= max_response_length), -1.0).otherwise(0.0)

    def body(processed, answer, truth, names, parsed, match, has_answer):
        def scored(factor):
            ans = F.when(~has_answer, -2.0).when(~parsed, -1.0).when(match, 2.0 * factor).otherwise(-0.5)
            return _result(ans + length, {
                "outcome_score": F.when(has_answer & match, 1).otherwise(0),
                "thinking_factor": F.when(has_answer & match, factor).otherwise(1.0),
                "length_score": length})
        return let(T.thinking_factor(processed, names), scored)
    return _puzzle_let(response, solution_text, body)


MIN_VERIFY_TOKENS = 500


def puzzle_score_verify(response, solution_text, valid_response_length, max_response_length: int) -> Column:
    """Structure of the six tags (else -1), language rule (-5), a penalty for at most
    500 or at least the maximum of tokens (-1), and an answer that counts only in the right
    structure and above 500 tokens: 2 x thinking factor, -0.5 wrong, -1 unparsed, else -2.
    The thinking is read up to ``</verify>``, without a bonus for its length."""
    vlen = as_col(valid_response_length)
    length = F.when((vlen <= MIN_VERIFY_TOKENS) | (vlen >= max_response_length), -1.0).otherwise(0.0)
    lang = T.language_mix_reward(response)

    def body(processed, answer, truth, names, parsed, match, has_answer):
        def structured(ok):
            judged = ok & has_answer & (vlen > MIN_VERIFY_TOKENS)
            fmt = F.when(ok, 0.0).otherwise(-1.0)

            def scored(factor):
                ans = F.when(~judged, -2.0).when(~parsed, -1.0).when(match, 2.0 * factor).otherwise(-0.5)
                return _result(ans + fmt + lang + length, {
                    "outcome_score": F.when(judged & match, 1).otherwise(0),
                    "format_score": fmt, "language_mix_score": lang, "length_score": length,
                    "thinking_factor": F.when(judged & match, factor).otherwise(1.0)})
            return let(T.thinking_factor(processed, names, "</verify>", False, T.VERIFY_REFLECTION_TOKENS), scored)
        return let(T.verify_structure(processed), structured)
    return _puzzle_let(response, solution_text, body)


def number_answer_score(response, ground_truth, method: str = "strict", format_score: float = 0.0) -> Column:
    """R1-R3 combined (the math word-problem scorer)."""
    ans = T.strict_number(response) if method == "strict" else T.flexible_number(response)
    return _result(T.number_score(ans, ground_truth, format_score))


def boxed_score(response, ground_truth) -> Column:
    """R4."""
    return _result(T.boxed_equiv_score(response, ground_truth))


# Chat-role markers whose presence costs -5 in the open-math rule.
ROLE_MARKERS = r"(?i)(assistant:|user:|human:)"


def text_before_last(s, marker: str) -> Column:
    """Text before the last occurrence of ``marker``; NULL if absent."""
    s = as_col(s)
    return F.when(F.instr(s, marker) > 0, F.substring(s, F.lit(1), F.length(s) - F.length(F.substring_index(s, marker, -1)) - len(marker)))


def box_to_last_brace(s) -> Column:
    """From the first ``\\boxed{`` to the last closing brace of the text; NULL without both."""
    s = as_col(s)
    box = F.when(F.instr(s, "\\boxed{") > 0, F.substr(s, F.instr(s, "\\boxed{")))
    return let(box, lambda b: F.when(F.instr(b, "}") > 0, F.substring(b, F.lit(1), F.length(b) - F.length(F.substring_index(b, "}", -1)))))


def open_math_score(response, ground_truth) -> Column:
    """Last ``\\boxed{.*}`` (greedy) inside ``<answer>``, else anywhere;
    equal after normalisation 1, different -0.5, empty -1, none -2; -5 when a
    chat-role marker leaks into the response."""
    def on_processed(processed):
        # from the first box after the first <answer> to the last brace before the last </answer>
        in_tags = let(text_before_last(processed, "</answer>"), lambda head: let(
            F.when(F.instr(head, "<answer>") > 0, T.after_first(head, "<answer>")), box_to_last_brace))
        found = F.coalesce(in_tags, box_to_last_brace(processed))
        chat = F.when(processed.rlike(ROLE_MARKERS), -5.0).otherwise(0.0)

        def on_answer(answer):
            def on_pred(pred):
                truth = normalize_answer(let(as_col(ground_truth), lambda g: F.coalesce(
                    T.remove_boxed(T.last_boxed(g)), g)))
                ans = (F.when(answer.isNull() | (answer == ""), -2.0)
                        .when(pred.isNull() | (pred == ""), -1.0)
                        .when(stripped_equal(pred, truth), 1.0)
                        .otherwise(-0.5))
                return let(ans, lambda a: _result(a + chat, {"outcome_score": F.when(a == 1.0, 1).otherwise(0),
                                                             "chat_score": chat}))
            return let(normalize_answer(T.remove_boxed(T.last_boxed(answer))), on_pred)
        return let(T.py_strip(found), on_answer)
    return let(T.assistant_part(response), on_processed)


# Answer normalisation substitutions, removed words, and the patterns of
# ``normalize_answer`` (symbolic algebra is not reproduced).
ANSWER_SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""),
                        ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED_WORDS = ["square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units",
                 "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm",
                 "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples",
                 "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
                 r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots"]


def normalize_answer(s) -> Column:
    """Final-answer normalisation: apply the substitutions, drop unit words, unwrap ``\\text{}``/``\\boxed{}``, fix
    fractions and square roots, drop thousands commas in plain integers."""
    x = as_col(s)
    for a, b in ANSWER_SUBSTITUTIONS:
        x = F.replace(x, F.lit(a), F.lit(b))
    for w in REMOVED_WORDS:
        x = F.replace(x, F.lit(w), F.lit(""))
    x = F.regexp_replace(x, r"(.*?)(\$)(.*?)(\$)(.*)", "\\$$3\\$")
    x = F.regexp_replace(x, r"(\\text\{)(.*?)(\})", "$2")
    x = F.regexp_replace(x, r"(\\textbf\{)(.*?)(\})", "$2")
    x = F.regexp_replace(x, r"(\\overline\{)(.*?)(\})", "$2")
    x = F.regexp_replace(x, r"(\\boxed\{)(.*)(\})", "$2")
    x = F.regexp_replace(x, r"(frac)([^{])(.)", "frac{$2}{$3}")
    x = F.regexp_replace(x, r"(sqrt)([^{])", "sqrt{$2}")
    x = F.replace(x, F.lit("$"), F.lit(""))
    return F.when(x.rlike(r"^[0-9,]*[0-9][0-9,]*$"), F.replace(x, F.lit(","), F.lit(""))).otherwise(x)


# What a decimal number looks like.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(x: Column) -> Column:
    """The value of a decimal number, else NULL (no engine-specific spellings)."""
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def stripped_equal(a, b) -> Column:
    """After a second normalisation pass (commas out, LaTeX string rules): equal as
    numbers when both are, else as strings."""
    def stripped(x):
        return T.strip_latex(F.replace(as_col(x), F.lit(","), F.lit("")))

    def on(u, v):
        return let(number(u), lambda x: let(number(v), lambda y: F.when(
            x.isNotNull() & y.isNotNull(), x == y).otherwise(u == v)))
    return let(stripped(a), lambda u: let(stripped(b), lambda v: on(u, v)))


def answers_equal(a, b, rel_tol: float = 1e-4) -> Column:
    """Equal without regard to case, outer blanks or spaces; or numbers (thousands
    commas out) within a relative tolerance, also x100 and /100."""
    def close(u, v):
        return F.abs(u - v) <= rel_tol * F.greatest(F.abs(u), F.abs(v))

    def plain(x):  # a money sign before, a percent sign after
        x = F.when(x.rlike(r"^\$[0-9]+(\.[0-9]+)?"), F.substr(x, F.lit(2))).otherwise(x)
        return F.when(x.rlike(r"^[0-9]+(\.[0-9]+)?\\?%$"), F.regexp_replace(x, r"\\?%$", "")).otherwise(x)

    def digits(x):
        return number(F.replace(F.replace(x, F.lit("{,}"), F.lit("")), F.lit(","), F.lit("")))

    def on(u, v):
        same = (F.lower(T.py_strip(u)) == F.lower(T.py_strip(v))) | (
            F.replace(u, F.lit(" "), F.lit("")) == F.replace(v, F.lit(" "), F.lit("")))
        return let(digits(u), lambda x: let(digits(v), lambda y: same | F.coalesce(
            close(x, y) | close(x, y * 100) | close(x, y / 100), F.lit(False))))
    return let(plain(as_col(a)), lambda u: let(plain(as_col(b)), lambda v: on(u, v)))


# --- R17-R19: contest-math answer handling -------------------------------------------

# Markers of the final answer in contest solutions, in the order in which they
# are looked for: the text after the first kind, the text before the second, and, once a box
# and a closing sentence are dealt with, the text after the third.
AFTER_MARKERS = ["answer:", "answer is", "answers are"]
BEFORE_MARKERS = ["is answer", "is the answer", "are answers", "are the answers"]
LAST_MARKERS = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]


def contest_math_answer(response) -> Column:
    """The located answer; NULL when no marker or box was found or it has no digit."""
    def step(state, found, text):
        return let(state, lambda st: F.when(found(st["text"]), F.struct(
            text(st["text"]).alias("text"), F.lit(True).alias("matched"))).otherwise(st))

    def after(marker):
        pattern = "(?is)^.*" + _quoted(marker) + "(.*)$"
        return (lambda x: x.rlike(pattern)), (lambda x: T.py_strip(F.regexp_extract(x, pattern, 1)))

    def before(marker):
        pattern = "(?is)^(.*)" + _quoted(marker)
        return (lambda x: x.rlike(pattern)), (lambda x: T.py_strip(F.regexp_extract(x, pattern, 1)))

    def boxed(x):
        return T.py_strip(F.regexp_extract(F.coalesce(T.last_boxed(x), F.lit("")), r"(?s)^\\(?:boxed|fbox)[^{]*\{(.*)\}$", 1))
    state = F.struct(as_col(response).alias("text"), F.lit(False).alias("matched"))
    for m in AFTER_MARKERS:
        state = step(state, *after(m))
    for m in BEFORE_MARKERS:
        state = step(state, *before(m))
    state = step(state, lambda x: boxed(x) != "", boxed)
    # the part before the last full stop; not a sign of an answer by itself
    state = let(state, lambda st: F.struct(F.when(F.instr(st["text"], ". ") > 0, T.py_strip(
        F.regexp_extract(st["text"], r"(?s)^(.*)\. ", 1))).otherwise(st["text"]).alias("text"), st["matched"].alias("matched")))
    for m in LAST_MARKERS:
        state = step(state, *after(m))
    return let(state, lambda st: F.when(st["matched"] & st["text"].rlike(r"\p{Nd}"), st["text"]))


def _quoted(marker: str) -> str:
    return marker.replace("\n", "\\n")  # no marker holds a pattern character


def contest_math_format_ok(response) -> Column:
    """R17 format flag: has ``Step 2:`` and a box."""
    s = as_col(response)
    return (F.instr(s, "Step 2:") > 0) & (F.instr(s, "\\box") > 0)


# Replacements, scale words and units of the contest normalisation.
CONTEST_REPLACEMENTS = [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "),
                        ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month",
         "year", "foot", "feet", "inch", "yard", "liter"]
#: Plain forms of the LaTeX that answers use most; other commands stay as they are.
LATEX_WORDS = [("\\infty", "inf"), ("\\pi", "pi"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*")]


def contest_math_normalize(s) -> Column:
    """Unwrap ``\\text{}``, drop money, percent, unit and degree marks, write scale words
    as powers, " or " / " and " as commas, unwrap outer braces, integer-valued numbers as
    integers, ``7 3/4`` (also with ``\\frac``) as ``7+3/4``, lower case."""
    x = F.regexp_replace(as_col(s), r"^\\text\{(.+?)\}$", "$1")
    for a, b in CONTEST_REPLACEMENTS:
        x = F.replace(x, F.lit(a), F.lit(b))
    for unit in UNITS:
        x = F.regexp_replace(x, unit + r"(es)?(s)? *(\^[0-9]+)?", "")
    x = F.regexp_replace(x, r"\^ *\\circ", "")
    x = F.regexp_replace(x, r"(?s)^\{(.*)\}$", "$1")
    x = F.regexp_replace(x, r",\\! *", "")
    x = let(x, lambda v: let(number(v), lambda num: F.when(whole(num), F.round(num).cast("long").cast("string")).otherwise(v)))
    x = F.replace(F.replace(x, F.lit("\\tfrac"), F.lit("\\frac")), F.lit("\\dfrac"), F.lit("\\frac"))
    x = F.regexp_replace(x, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", " $1/$2")
    x = F.regexp_replace(x, r"\\sqrt\{([^{}]*)\}", "sqrt($1)")
    for a, b in LATEX_WORDS:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.regexp_replace(T.py_strip(x), "- *", "-"), "([0-9]) +([0-9])", "$1+$2")

    def integer(v):
        return let(number(without_thousands(v)), lambda num: F.when(whole(num), num.cast("long").cast("string")).otherwise(v))
    return let(F.lower(x), integer)


def whole(num: Column) -> Column:
    return num.isNotNull() & (F.abs(num - F.round(num)) <= 1e-7) & (F.abs(num) < 1e15)


def without_thousands(x) -> Column:
    """Commas between a digit and exactly three digits out; other commas separate items."""
    return F.regexp_replace(as_col(x), r"(?<=[0-9]),(?=[0-9]{3}($|[^0-9]))", "")


def tuple_parts(s) -> Column:
    """Items of ``(a, b)`` / ``[a, b)`` without inner brackets, trimmed; else the whole."""
    def on(x):
        return F.when(x.rlike(r"^[()\[\]][^()\[\]]+[()\[\]]$"), F.transform(
            F.split(F.substr(x, F.lit(2), F.length(x) - 2), ","), lambda p: T.py_strip(p))).otherwise(F.array(x))
    return let(without_thousands(s), on)


def _value(x: Column) -> Column:
    """Value of a number, a fraction a/b or a mixed number a+b/c, else NULL."""
    parts = F.regexp_extract_all(x, F.lit(r"^(?:(-?[0-9.]+)\+)?(-?[0-9.]+)/([0-9.]+)$"), 0)

    def fraction(pattern_group):
        return number(F.regexp_extract(x, r"^(?:(-?[0-9.]+)\+)?(-?[0-9.]+)/([0-9.]+)$", pattern_group))
    quotient = fraction(2) / F.when(fraction(3) != 0, fraction(3))
    return F.coalesce(number(x), F.when(F.size(parts) > 0, F.coalesce(fraction(1), F.lit(0.0)) + quotient))


def _item_equal(truth: Column, given: Column) -> Column:
    """Fractions must agree as written, whole numbers only with whole numbers; else by value."""
    is_fraction = r"^-?[0-9]+.?/0*[1-9][0-9]*.?$"
    whole_t, whole_g = (F.coalesce(whole(number(without_thousands(v))), F.lit(False)) for v in (truth, given))
    by_value = F.coalesce(F.abs(_value(truth) - _value(given)) <= 1e-9 * F.greatest(F.abs(_value(truth)), F.lit(1.0)), F.lit(False))
    return F.when(truth.rlike(is_fraction) & given.rlike(is_fraction), truth == given).when(
        whole_t != whole_g, False).otherwise((truth == given) | by_value)


def tuples_equal(given, truth) -> Column:
    """Equal after normalisation, or the same brackets (where there are several items),
    as many items, and each equal."""
    def on(g, t):
        def parts(gp, tp):
            brackets = (F.substring(g, 1, 1) == F.substring(t, 1, 1)) & (F.right(g, F.lit(1)) == F.right(t, F.lit(1)))
            return (g == t) | ((F.length(g) > 0) & (F.size(gp) == F.size(tp)) & ((F.size(tp) <= 1) | brackets) & F.forall(
                F.zip_with(tp, gp, lambda u, v: _item_equal(u, v)), lambda ok: ok))
        return let(tuple_parts(g), lambda gp: let(tuple_parts(t), lambda tp: parts(gp, tp)))
    return let(contest_math_normalize(given), lambda g: let(contest_math_normalize(truth), lambda t: on(g, t)))


def contest_math_score(response, ground_truth) -> Column:
    """R17-R20 combined: 1 when the located answer equals the truth as LaTeX, as a normalised
    answer or tuple, or as a number."""
    def on(ans):
        def pieces(x):
            return F.transform(F.split(F.regexp_replace(x, r"^[(\[]|[)\]]$", ""), ","), lambda p: T.py_strip(p))
        several = ans.rlike(r"^[(\[].+[)\]]$") & as_col(ground_truth).rlike(r"^[(\[].+[)\]]$")
        by_item = let(pieces(ans), lambda a: let(pieces(as_col(ground_truth)), lambda b: (F.size(a) == F.size(b)) & F.forall(
            F.zip_with(a, b, lambda u, v: answers_equal(u, v)), lambda ok: ok)))
        equal = (T.strip_latex(T.py_strip(ans)) == T.strip_latex(T.py_strip(ground_truth))) | tuples_equal(ans, ground_truth) | \
            answers_equal(ans, ground_truth) | (several & by_item)
        return F.coalesce(ans.isNotNull() & equal, F.lit(False))
    eq = let(contest_math_answer(response), on)
    return _result(F.when(eq, 1.0).otherwise(0.0),
                   {"format_ok": F.when(contest_math_format_ok(response), 1).otherwise(0)})


# --- R21 / R22: code tasks from recorded outcomes ---------------------------------

def code_task_scores(outcomes: DataFrame, task: str = "task", test_id: str = "test_id",
                     passed: str = "passed", first_n: int = 10, salts: int = 64) -> DataFrame:
    """All tests pass -> 1; otherwise the pass rate of the first ``first_n``
    tests (by id).  No code is run: outcomes are recorded rows.

    The first-n selection is two-level so a task with a huge number of tests
    is spread over ``salts`` partitions: top-n per (task, salt), then top-n of
    those candidates per task.
    """
    p = F.col(passed).cast("boolean")
    total = outcomes.groupBy(task).agg(F.bool_and(p).alias("all_passed"),
                                       F.count(F.lit(1)).alias("n_tests"))
    salted = outcomes.withColumn("_salt", F.pmod(F.xxhash64(F.col(test_id)), F.lit(salts)))
    w1 = Window.partitionBy(task, "_salt").orderBy(test_id)
    cand = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= first_n)
    w2 = Window.partitionBy(task).orderBy(test_id)
    firsts = cand.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= first_n)
    rate = firsts.groupBy(task).agg(F.avg(F.when(p, 1.0).otherwise(0.0)).alias("first_rate"))
    return (total.join(rate, task)
                 .withColumn("score", F.when(F.col("all_passed"), 1.0).otherwise(F.col("first_rate")))
                 .drop("first_rate"))


def recorded_outcomes_score(outcomes, first_n: int = 10) -> Column:
    """R21 for one row: outcomes as text, ``1`` passed and anything else failed, separated by
    commas, in test order."""
    passed = F.transform(F.split(as_col(outcomes), ","), lambda o: F.when(T.py_strip(o) == "1", 1.0).otherwise(0.0))

    def on(p):
        first = F.slice(p, 1, first_n)
        return F.when(F.forall(p, lambda x: x == 1.0), 1.0).otherwise(
            F.aggregate(first, F.lit(0.0), lambda acc, x: acc + x) / F.size(first))
    return _result(let(passed, on))


# --- R23-R26: registry and reward manager ----------------------------------------------

class ScorerRegistry:
    """Data-source predicate -> scorer.  ``score_column`` builds one CASE over
    all registered sources; an unknown source raises at execution time."""

    def __init__(self):
        self._entries: list[tuple[str, Callable[[Column], Column], Scorer]] = []

    def register(self, name: str, matches: Callable[[Column], Column], scorer: Scorer):
        self._entries.append((name, matches, scorer))
        return self

    def names(self) -> list[str]:
        return [n for n, _, _ in self._entries]

    def score_column(self, source, response, ground_truth, **kw) -> Column:
        source = as_col(source)
        expr = None
        for _name, matches, scorer in self._entries:
            res = scorer(response, ground_truth, **kw)
            expr = F.when(matches(source), res) if expr is None else expr.when(matches(source), res)
        unknown = F.raise_error(F.concat(F.lit("no scorer for data source "), source))
        return expr.otherwise(F.struct(unknown.cast("double").alias("score"),
                                       F.create_map().cast("map<string,double>").alias("extra")))


def default_registry(puzzle_variant: str = "pure") -> ScorerRegistry:
    """The reference's routing: exact names for math word problems and
    boxed math, substring ``kk`` for puzzles, ``orz`` for open math, contest
    math sources, and code sources, whose ``ground_truth`` holds the recorded outcomes."""
    puzzle = {"pure": lambda r, g, **kw: puzzle_score_pure(r, g),
              "v1": lambda r, g, **kw: puzzle_score_v1(r, g)}[puzzle_variant]
    reg = ScorerRegistry()
    reg.register("gsm8k", lambda s: s == "openai/gsm8k", lambda r, g, **kw: number_answer_score(r, g))
    reg.register("kk", lambda s: F.instr(s, "kk") > 0, puzzle)
    reg.register("orz", lambda s: F.instr(s, "orz") > 0, lambda r, g, **kw: open_math_score(r, g))
    reg.register("math", lambda s: s.isin("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval"),
                 lambda r, g, **kw: boxed_score(r, g))
    reg.register("contest_math", lambda s: s.isin("numina_aops_forum", "numina_synthetic_math", "numina_amc_aime",
                                                  "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"),
                 lambda r, g, **kw: contest_math_score(r, g))
    reg.register("code", lambda s: s.isin("codecontests", "apps", "codeforces", "taco"),
                 lambda r, g, **kw: recorded_outcomes_score(g))
    return reg


def reward_manager(df: DataFrame, registry: ScorerRegistry, source="data_source", response="response",
                   ground_truth="ground_truth", mask="response_mask", model_score: str | None = None,
                   extra_keys: list[str] | None = None) -> DataFrame:
    """Score every row (or take the model score when present), put the
    score on the last valid token (T16), and spread extra info into columns
    (missing keys -> 0).  A failed score (NULL) counts as 0."""
    from ..functions.arrays import score_at_last_token
    res = registry.score_column(source, response, ground_truth)
    out = df.withColumn("_res", res)
    score = F.coalesce(F.col("_res.score"), F.lit(0.0))
    if model_score:
        score = F.coalesce(F.col(model_score).cast("double"), score)
    out = out.withColumn("score", score).withColumn("token_level_scores", score_at_last_token("score", mask))
    for k in extra_keys or []:
        out = out.withColumn(k, F.coalesce(F.col("_res.extra")[k], F.lit(0.0)))
    return out.drop("_res")


def first_rows_per_key(df: DataFrame, key: str, order: str, n: int, salts: int = 64) -> DataFrame:
    """R26 (skew-safe form): first ``n`` rows per key by ``order``.

    Two levels: first ``n`` per (key, salt), then first ``n`` of those per
    key, so a hot key is ranked in ``salts`` tasks and the final ranking sees
    at most ``n * salts`` rows per key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(order)), F.lit(salts)))
    w1 = Window.partitionBy(key, "_salt").orderBy(order)
    cand = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n)
    w2 = Window.partitionBy(key).orderBy(order)
    return cand.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= n).drop("_r", "_salt")


# --- R27 / R28: evaluation-time puzzle parsers ---------------------------------------

# Patterns after which a legacy answer is cut, in order.
FINISH_PATTERNS = ["### Reason", "Let's think step by step again", "let's go back and check", "###"]


def legacy_gold_conditions(answer_text) -> Column:
    """Gold conditions: drop ' and ' and '.', split on ',', strip each."""
    gold = F.replace(F.replace(as_col(answer_text), F.lit(" and "), F.lit("")), F.lit("."), F.lit(""))
    return F.transform(F.split(gold, ","), lambda c: T.py_strip(c))


def legacy_parse(df: DataFrame, response: str, answer_text: str,
                 conclusion_pattern: str = "CONCLUSION:") -> DataFrame:
    """Cut at '### Question'; take the text after the conclusion pattern
    (if non-empty); cut at the finish patterns; then judge: a '(N+1)' item ->
    beyond_list, any 'if' -> contain_if, else every gold condition must be a
    substring (wrong_identity otherwise).  Adds is_correct, pred_answer,
    wrong_reason and correct_ratio.  (The unreachable fallback is skipped.)"""
    d = df.withColumn("_gold", legacy_gold_conditions(answer_text))
    pred = F.substring_index(F.col(response), "### Question", 1)
    after = F.substring_index(F.substring_index(pred, conclusion_pattern, 2), conclusion_pattern, -1)
    has = (F.instr(pred, conclusion_pattern) > 0) & (F.length(after) > 0)
    d = d.withColumn("pred_answer", F.when(has, after).otherwise(pred))
    judged = F.col("pred_answer")
    for fp in FINISH_PATTERNS:
        judged = F.substring_index(judged, fp, 1)
    d = d.withColumn("_j", judged)
    n = F.size("_gold")
    beyond = F.instr(F.col("_j"), F.concat(F.lit("("), (n + 1).cast("string"), F.lit(")"))) > 0
    found = F.size(F.filter("_gold", lambda g: F.instr(F.col("_j"), g) > 0))
    d = (d.withColumn("wrong_reason", F.when(beyond, "beyond_list").when(F.instr("_j", "if") > 0, "contain_if")
                      .when(found < n, "wrong_identity").otherwise("no_conclusion_matched"))
          .withColumn("is_correct", ~beyond & (F.instr("_j", "if") == 0) & (found == n))
          .withColumn("correct_ratio", F.when(beyond | (F.instr("_j", "if") > 0), 0.0)
                      .otherwise(found.cast("double") / n)))
    return d.drop("_gold", "_j")


def alt_puzzle_parse(df: DataFrame, response="response", solution_text="solution_text") -> DataFrame:
    """1/0 plus the parsed identities, without the assistant-marker split."""
    d = with_puzzle_parse(df, response, solution_text, with_marker=False)
    d = (d.withColumn("score", F.when(F.col("_pz_has_answer") & F.col("_pz_match"), 1).otherwise(0))
          .withColumn("predicted", F.when(F.col("_pz_has_answer") & F.col("_pz_parsed"), F.array_join(
              F.transform("_pz_pred", lambda p: F.concat(p["name"], F.lit(":"), p["role"])), ","))
              .otherwise(F.lit(" Parse failure"))))
    return drop_puzzle_parse(d)


# --- R29-R31, K12: digit-completion task ---------------------------------------------------

def digit_prompt_count(max_number: int, max_diff: int, max_completions: int) -> int:
    """Number of prompts that ``digit_prompt_at`` enumerates."""
    return (max_number + 1) * (max_diff + 1) * (max_completions + 1)


def digit_prompt_at(index, max_number: int, max_diff: int, max_completions: int) -> Column:
    """Prompt ``first,second:max,n`` number ``index`` of all: first numbers 0..max, then
    differences 0..max_diff (modulo max), then 0..max_completions numbers to complete."""
    def on(i):
        n = F.pmod(i, F.lit(max_completions + 1))
        diff = F.pmod(F.floor(i / (max_completions + 1)), F.lit(max_diff + 1))
        first = F.floor(i / ((max_completions + 1) * (max_diff + 1)))
        second = F.pmod(first + diff, F.lit(max_number))
        return F.concat(first.cast("string"), F.lit(","), second.cast("string"), F.lit(f":{max_number},"), n.cast("string"))
    return let(as_col(index).cast("long"), on)


def all_digit_prompts(spark, max_number: int, max_diff: int, max_completions: int) -> DataFrame:
    """(prompt_index, prompt) of every prompt, each once."""
    every = spark.range(digit_prompt_count(max_number, max_diff, max_completions)).withColumnRenamed("id", "prompt_index")
    return every.withColumn("prompt", digit_prompt_at("prompt_index", max_number, max_diff, max_completions))


def digit_ground_truth(prompt) -> Column:
    """Prompt ``a,b:max,n`` -> ``n`` numbers continuing the arithmetic
    sequence modulo ``max``: ``(b + d·(k+1)) mod max`` with ``d = (b-a) mod max``."""
    p = as_col(prompt)
    head, info = F.split(p, ":")[0], F.split(p, ":")[1]
    a, b = F.split(head, ",")[0].cast("long"), F.split(head, ",")[1].cast("long")
    m, n = F.split(info, ",")[0].cast("long"), F.split(info, ",")[1].cast("int")
    d = F.pmod(b - a, m)
    seq = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                      lambda k: F.pmod(b + d * k, m).cast("string"))
    return F.when(n > 0, F.array_join(seq, ",")).otherwise(F.lit(""))


def dense_prefix_reward(response, ground_truth, sequence_reward: float = 1.0) -> Column:
    """Each leading character matching the truth earns 1/(len(truth)+1)."""
    r, g = as_col(response), as_col(ground_truth)
    per = F.lit(sequence_reward) / (F.length(g) + 1)
    lcp = T.common_prefix_len(F.split(r, ""), F.split(g, ""))
    lcp = F.when((F.length(r) == 0) | (F.length(g) == 0), F.lit(0)).otherwise(lcp)
    return let(lcp, lambda n: F.when(F.length(r) == 0, F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.length(r) - 1), lambda i: F.when(i < n, per).otherwise(F.lit(0.0)))))


def pad_dense_reward(reward, ground_truth, response_mask) -> Column:
    """Extend with the last reward (empty: 1 if the truth is empty, else 0)
    to the mask length, then multiply by the mask."""
    r, mask = as_col(reward), as_col(response_mask)
    last = F.coalesce(F.try_element_at(r, F.lit(-1)),
                      F.when(F.length(as_col(ground_truth)) == 0, 1.0).otherwise(0.0))
    padded = F.transform(mask, lambda m, i: F.coalesce(F.try_element_at(r, i + 1), last) * m)
    return padded
