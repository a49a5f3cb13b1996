"""Answer extraction and text checks as native Column expressions.

Python ``re`` patterns of the reference are rewritten for Java regex: ``\\w``
and ``\\b`` get ``(?U)`` so they are Unicode-aware like Python's; ``(?s)``
stands for ``re.DOTALL``; ``(?i)`` for ``re.IGNORECASE``.  Literal substring
tests and counts use ``instr`` / ``replace`` arithmetic instead of regexes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import as_col, let


def count_substr(s, sub: str) -> Column:
    """Non-overlapping occurrences of a literal (Python ``str.count``)."""
    s = as_col(s)
    return ((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub.encode())).cast("int")


def py_find(s, sub: str) -> Column:
    """0-based index of the first occurrence, -1 if absent (``str.find``)."""
    return F.instr(as_col(s), sub) - 1


def after_first(s, marker: str) -> Column:
    """Text after the first occurrence of ``marker`` (``split(marker, 1)[1]``)."""
    s = as_col(s)
    return F.substr(s, F.instr(s, marker) + len(marker))


def py_strip(s) -> Column:
    """``str.strip()``: leading and trailing (Unicode) whitespace.  Text with none at either end is
    not searched: at every gap between words the pattern would look for the end."""
    def stripped(x):
        ends = F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
        return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)
    return let(s, stripped)


def py_slice(s, start: Column, stop: Column) -> Column:
    """``s[start:stop]`` with Python's rules for negative and out-of-range bounds."""
    s = as_col(s)

    def bound(n, at):  # the length and both positions take a search each
        return F.when(at < 0, F.greatest(n + at, F.lit(0))).otherwise(F.least(at, n))

    def cut(e):
        return let(bound(e["n"], e["start"]), lambda a: let(bound(e["n"], e["stop"]), lambda b: F.when(
            b > a, F.substring(s, a + 1, b - a)).otherwise(F.lit(""))))
    return let(F.struct(F.length(s).alias("n"), start.alias("start"), stop.alias("stop")), cut)


# --- R1-R3: numbers --------------------------------------------------------------

STRICT_NUMBER = r"#### (\-?[0-9\.\,]+)"
ANY_NUMBER = r"(\-?[0-9\.\,]+)"


def strict_number(s) -> Column:
    """First ``#### number``; commas and ``$`` removed; NULL if absent."""
    s = as_col(s)
    raw = F.regexp_extract(s, STRICT_NUMBER, 1)
    clean = F.replace(F.replace(raw, F.lit(","), F.lit("")), F.lit("$"), F.lit(""))
    return F.when(s.rlike(STRICT_NUMBER), clean)


def flexible_number(s) -> Column:
    """R2: last number-like match that is not '' or '.'; NULL if none."""
    found = F.regexp_extract_all(as_col(s), F.lit(ANY_NUMBER), 1)
    valid = F.filter(found, lambda x: ~x.isin("", "."))
    return F.when(F.size(found) > 0, F.coalesce(F.try_element_at(valid, F.lit(-1)), F.try_element_at(found, F.lit(1))))


def number_score(answer, ground_truth, format_score: float = 0.0, score: float = 1.0) -> Column:
    """No answer 0, exact string match ``score``, otherwise ``format_score``."""
    answer = as_col(answer)
    return (F.when(answer.isNull(), F.lit(0.0))
             .when(answer == as_col(ground_truth), F.lit(score))
             .otherwise(F.lit(format_score)))


# --- T7 / R4: boxed answers and LaTeX normalisation ---------------------------

def _first_balanced_end(s: Column) -> Column:
    """1-based position of the '}' closing the first brace group (0 if none)."""
    chars = F.split(s, "")
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("end"), F.lit(0).alias("i"))

    def step(acc, ch):
        i = acc["i"] + 1
        d = (acc["d"] + F.when(ch == "{", 1).otherwise(0) - F.when(ch == "}", 1).otherwise(0))
        hit = (acc["end"] == 0) & (ch == "}") & (d == 0)
        return F.struct(F.when(acc["end"] > 0, acc["d"]).otherwise(d).alias("d"),
                        F.when(hit, i).otherwise(acc["end"]).alias("end"), i.alias("i"))
    return F.aggregate(chars, init, step)["end"]


def last_boxed(s) -> Column:
    """The last ``\\boxed{...}`` (balanced), else ``\\fbox{...}``; the
    ``\\boxed `` form runs to the next ``$``.  NULL when there is none."""
    s = as_col(s)
    space_form = F.concat(F.lit("\\boxed "), F.substring_index(F.substring_index(s, "\\boxed ", -1), "$", 1))
    tail_boxed = F.concat(F.lit("\\boxed"), F.substring_index(s, "\\boxed", -1))
    tail_fbox = F.concat(F.lit("\\fbox"), F.substring_index(s, "\\fbox", -1))
    tail = F.when(F.instr(s, "\\boxed") > 0, tail_boxed).when(F.instr(s, "\\fbox") > 0, tail_fbox)
    braced = let(tail, lambda t: let(_first_balanced_end(t), lambda end: F.when(end > 0, F.substring(t, 1, end))))
    return F.when(F.instr(s, "\\boxed ") > 0, space_form).otherwise(braced)


def remove_boxed(b) -> Column:
    """Inside of a ``\\boxed`` string; NULL when it is not a ``\\boxed{..}`` form."""
    b = as_col(b)
    return (F.when(b.startswith("\\boxed "), F.substr(b, F.lit(8)))
             .when(b.startswith("\\boxed{") & b.endswith("}"),
                   F.substring(b, 8, F.length(b) - 8)))


def strip_latex(s) -> Column:
    """R4 normalisation of an answer string (string rules only).

    Fixed values: the replacement rules, in order: drop newlines and ``\\!``; ``\\\\`` to
    ``\\``; tfrac/dfrac to frac; drop ``\\left``, ``\\right``, degree marks,
    ``\\$``; cut a single trailing ``\\text{ `` unit; drop ``\\%``; add a 0
    before a bare decimal point; keep the right side of a short ``x=`` prefix;
    brace ``\\sqrt`` and ``\\frac`` arguments; drop spaces; 0.5 -> \\frac{1}{2};
    integer ``a/b`` -> ``\\frac{a}{b}``.
    """
    x = as_col(s)
    for a, b in [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"),
                 ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = let(x, lambda v: F.when(count_substr(v, "\\text{ ") == 1,
                                F.substring_index(v, "\\text{ ", 1)).otherwise(v))
    x = F.replace(x, F.lit("\\%"), F.lit(""))
    x = F.replace(F.replace(x, F.lit(" ."), F.lit(" 0.")), F.lit("{."), F.lit("{0."))
    x = F.regexp_replace(x, r"^\.", "0.")
    x = let(x, lambda v: F.when((count_substr(v, "=") == 1) & (F.length(F.substring_index(v, "=", 1)) <= 2),
                                F.substring_index(v, "=", -1)).otherwise(v))
    x = F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}")
    x = F.replace(x, F.lit(" "), F.lit(""))
    x = F.regexp_replace(x, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    x = F.regexp_replace(x, r"\\frac([^{])\{", r"\\frac{$1}{")
    x = F.regexp_replace(x, r"^0\.5$", r"\\frac{1}{2}")
    x = F.regexp_replace(x, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")
    return x


def boxed_equiv_score(response, ground_truth) -> Column:
    """1 when the last boxed answer equals the truth after normalisation."""
    ans = remove_boxed(last_boxed(response))
    return F.when(ans.isNotNull() & (strip_latex(ans) == strip_latex(ground_truth)), 1.0).otherwise(0.0)


# --- R5-R8: puzzle answers -----------------------------------------------------------

ROLE_LINE = r"(?i)\b([A-Za-z]+)\b.*?\b(knight|knave)\b"


def assistant_part(s) -> Column:
    """Text after the first assistant marker (``Assistant:`` or the chat marker)."""
    s = as_col(s)

    def after(marker, otherwise):  # a split looks for a fixed text faster than a search by position
        return let(F.split(s, marker, 2), lambda parts: F.when(F.size(parts) == 2, parts[1]).otherwise(otherwise))
    return after("Assistant:", after(r"<\|im_start\|>assistant", s))


def last_answer_block(s) -> Column:
    """Stripped text of the last ``<answer>...</answer>`` (NULL if none)."""
    blocks = F.regexp_extract_all(as_col(s), F.lit(r"(?s)<answer>(.*?)</answer>"), 1)
    return F.when(F.size(blocks) > 0, py_strip(F.element_at(blocks, -1)))


def truth_identities(solution_text) -> Column:
    """array<struct<name, role>> from lines ``.. Name .. knight|knave ..``;
    a repeated name keeps its last role (dict semantics)."""
    lines = F.transform(F.split(as_col(solution_text), "\n"), lambda l: py_strip(l))
    pairs = F.transform(lines, lambda l: F.struct(
        F.regexp_extract(l, ROLE_LINE, 1).alias("name"),
        F.lower(F.regexp_extract(l, ROLE_LINE, 2)).alias("role")))
    pairs = F.filter(pairs, lambda p: p["name"] != "")

    def dedupe(ps):
        # first-appearance order of names, each with the last role given to it
        firsts = F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, 1, i), lambda q: q["name"] == p["name"]))
        return F.transform(firsts, lambda p: F.struct(
            p["name"].alias("name"),
            F.element_at(F.filter(ps, lambda q: q["name"] == p["name"]), -1)["role"].alias("role")))
    return let(pairs, lambda ps: F.when(F.size(F.array_distinct(ps["name"])) == F.size(ps), ps).otherwise(dedupe(ps)))


def predicted_identities(answer, names) -> Column:
    """Roles the answer gives each expected name; NULL when the number of
    role words differs from the number of names or a name is not resolved.

    The answer is cut at all ``is a knight / knave`` claims in one pass; a name gets the role
    of the first claim whose words before it, back to the last claim, end with the name.
    """
    answer, names = as_col(answer), as_col(names)
    n_roles = let(F.lower(answer), lambda low: count_substr(low, "knight") + count_substr(low, "knave"))
    claims = F.split(answer, r"(?i)\b\s+is\s+a\s+\b(?:knight|knave)\b")  # and what comes after the last
    roles = F.regexp_extract_all(answer, F.lit(r"(?i)\b\s+is\s+a\s+\b(knight|knave)\b"), 1)

    def resolved(found):
        def role_of(name):
            low = F.lower(name)
            ends = F.filter(found, lambda c: F.endswith(c["words"], low) & (
                (F.length(c["words"]) == F.length(low))
                | ~F.substr(c["words"], F.length(c["words"]) - F.length(low), F.lit(1)).rlike(r"\w")))
            return F.coalesce(F.try_element_at(ends, F.lit(1))["role"], F.lit(""))
        pred = F.transform(names, lambda n: F.struct(n.alias("name"), role_of(n).alias("role")))
        return let(pred, lambda p: F.when(F.forall(p, lambda x: x["role"] != ""), p))
    found = F.zip_with(let(claims, lambda c: F.slice(c, 1, F.size(c) - 1)), roles, lambda c, r: F.struct(F.lower(c).alias("words"), F.lower(r).alias("role")))
    return F.when(answer.isNotNull() & (n_roles == F.size(names)), let(found, resolved))


def identities_match(pred, truth) -> Column:
    """Predicted and true identities agree for every name (dict equality)."""
    pred, truth = as_col(pred), as_col(truth)
    return (F.size(pred) == F.size(truth)) & F.forall(
        truth, lambda t: F.exists(pred, lambda p: (p["name"] == t["name"]) & (p["role"] == t["role"])))


THINK_ANSWER_TAGS = ["<think>", "</think>", "<answer>", "</answer>"]


def tags_in_order(s, tags: list[str]) -> Column:
    """Each tag exactly once and in the given order."""
    s = as_col(s)
    once = F.lit(True)
    for t in tags:
        once = once & (count_substr(s, t) == 1)
    ordered = F.lit(True)
    for a, b in zip(tags, tags[1:]):
        ordered = ordered & (F.instr(s, a) <= F.instr(s, b))
    return once & ordered


VERIFY_TAGS = ["<think>", "</think>", "<verify>", "</verify>", "<answer>", "</answer>"]


def verify_structure(s) -> Column:
    """Each of the six tags once; blocks open before they close, and ``<verify>`` and
    ``<answer>`` begin at most one character after the end of the block before them."""
    s = as_col(s)

    def kind(piece):
        number = F.when(F.startswith(piece, F.lit(VERIFY_TAGS[0][1:])), 0)
        for i, t in enumerate(VERIFY_TAGS[1:], 1):
            number = number.when(F.startswith(piece, F.lit(t[1:])), i)
        return number

    def ordered(found):
        at = {t: F.array_position(found, F.lit(i)) for i, t in enumerate(VERIFY_TAGS)}
        ok = F.array_sort(found) == F.array(*[F.lit(i) for i in range(len(VERIFY_TAGS))])
        for opened, closed in zip(VERIFY_TAGS[::2], VERIFY_TAGS[1::2]):
            ok = ok & (at[opened] <= at[closed])
        for closed, following in (("</think>", "<verify>"), ("</verify>", "<answer>")):
            ok = ok & ((at[following] < at[closed]) | s.rlike(f"(?s){closed}.?{following}"))
        return ok
    # the tags in the order they come in: what follows a "<", by one split
    behind = let(F.split(s, "<"), lambda pieces: F.slice(pieces, 2, F.size(pieces)))
    return let(F.filter(F.transform(behind, kind), lambda i: i.isNotNull()), ordered)


# --- T18 / T19 / R13 / R14 ------------------------------------------------------------

def word_count(s) -> Column:
    """Number of ``\\b\\w+\\b`` matches (Unicode word characters)."""
    return F.regexp_count(as_col(s), F.lit(r"(?U)\b\w+\b")).cast("int")


# Code-point ranges of the language rule (CJK, kana, CJK
# extensions A-E, CJK compatibility, Hangul syllables / jamo / compatibility,
# Cyrillic and its supplements and extensions A-B, Arabic and its supplement,
# Devanagari, Gujarati, Oriya, Bengali, Gurmukhi, Telugu, Kannada, Malayalam,
# Thai, Lao, Tibetan, Myanmar, Ethiopic, Khmer, Mongolian).
NON_LATIN_RANGES = [
    (0x4E00, 0x9FFF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF),
    (0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F), (0x0400, 0x04FF),
    (0x0500, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F), (0x0600, 0x06FF),
    (0x0750, 0x077F), (0x0900, 0x097F), (0x0A80, 0x0AFF), (0x0B00, 0x0B7F),
    (0x0980, 0x09FF), (0x0A00, 0x0A7F), (0x0C00, 0x0C7F), (0x0C80, 0x0CFF),
    (0x0D00, 0x0D7F), (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x0F00, 0x0FFF),
    (0x1000, 0x109F), (0x1200, 0x137F), (0x1780, 0x17FF), (0x1800, 0x18AF),
]
NON_LATIN_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in NON_LATIN_RANGES) + "]"
# the same characters; one comparison tells that a character below or above all ranges is none of them
NON_LATIN_SEARCH = f"[\\x{{{min(NON_LATIN_RANGES)[0]:X}}}-\\x{{{max(b for _, b in NON_LATIN_RANGES):X}}}&&{NON_LATIN_CLASS}]"


def has_non_latin(s) -> Column:
    """Any character from the non-Latin ranges (one Java regex class); ASCII text, a byte a
    character, is not searched."""
    s = as_col(s)
    return (F.length(s) < F.octet_length(s)) & s.rlike(NON_LATIN_SEARCH)


def language_mix_reward(s) -> Column:
    """-5 when a non-Latin character occurs, else 0."""
    return F.when(has_non_latin(s), -5.0).otherwise(0.0)


# Logic symbols rewarded by the logic rule; each symbol also in
# its escaped spelling, which the reference lists as literal text.
LOGIC_SYMBOLS = ["∨", "\\u2228", "∧", "\\u2227", "¬", "\\u00AC"]
# Reflection words and symbols of the thinking rule; the rule for
# responses with a verify block does not count its own word.
REFLECTION_TOKENS = ["wait", "verify", "yet", "re-evaluate", "review",
                     "∨", "\\u2228", "∧", "\\u2227", "¬", "\\u00AC"]
VERIFY_REFLECTION_TOKENS = [t for t in REFLECTION_TOKENS if t != "verify"]


def logic_symbol_reward(s) -> Column:
    """+0.5 when any logic symbol occurs, else -0.1."""
    s = as_col(s)
    hit = F.lit(False)
    for sym in LOGIC_SYMBOLS:
        hit = hit | (F.instr(s, sym) > 0)
    return F.when(hit, 0.5).otherwise(-0.1)


def think_content(s, end_tag: str = "</think>") -> Column:
    """``s[find('<think>') + 7 : find(end_tag)]`` with Python slice rules."""
    s = as_col(s)
    return py_slice(s, py_find(s, "<think>") + 7, py_find(s, end_tag))


def thinking_factor(processed, names, end_tag: str = "</think>", word_bonus: bool = True,
                    tokens: list[str] = REFLECTION_TOKENS) -> Column:
    """1 + 1e-5·floor(words/100); halved per expected name missing from
    the thinking; if still >= 1, +1e-5 per reflection token present."""
    def factor(think):
        f = F.lit(1.0)
        if word_bonus:
            f = f + F.floor(word_count(think) / 100.0) * 1e-5
        missing = F.size(F.filter(as_col(names), lambda n: ~F.contains(think, n)))
        f = f * F.pow(F.lit(0.5), missing)

        def with_bonus(low):
            bonus = F.lit(0.0)
            for tok in tokens:
                bonus = bonus + F.when(F.contains(low, F.lit(tok)), 1e-5).otherwise(0.0)
            return bonus
        return let(f, lambda fv: F.when(fv >= 1.0, fv + let(F.lower(think), with_bonus)).otherwise(fv))
    return let(think_content(processed, end_tag), factor)


# --- R22 / R29 / R30 / R32 ---------------------------------------------------------------

def outputs_equal(out, expected) -> Column:
    """Equal as whole strings, or line by line after stripping each line."""
    def norm(x):
        return F.array_join(F.transform(F.split(py_strip(x), "\n"), lambda l: py_strip(l)), "\n")
    out, expected = as_col(out), as_col(expected)
    return (out == expected) | (norm(out) == norm(expected))


def common_prefix_len(a, b) -> Column:
    """Length of the common prefix of two arrays."""
    a, b = as_col(a), as_col(b)
    eq = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_diff = F.array_position(eq, False)
    return F.when(first_diff == 0, F.least(F.size(a), F.size(b))).otherwise(first_diff - 1).cast("int")


#: What ``(?U)\s`` matches; the first six are all that ``\s`` matches.
WHITE_SPACE = [chr(c) for c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def approx_tokens(s) -> Column:
    """Rough token count, whitespace-separated words: ``split(strip(s), r"\\s+")``, whose search
    takes three times as long as to cut at each of the characters and to count the spaces."""
    def words(piece):
        def spaced(p):
            return F.contains(p, F.lit("  ")) | F.startswith(p, F.lit(" ")) | F.endswith(p, F.lit(" "))
        return (F.when(piece == "", 0).when(spaced(piece), F.size(F.array_remove(F.split(piece, " "), "")))
                 .otherwise(count_substr(piece, " ") + 1))

    def cut(pieces, c):
        return F.flatten(F.transform(pieces, lambda p: F.split(p, c)))

    def count(x):
        pieces = F.array(x)
        for c in WHITE_SPACE[1:6]:
            pieces = cut(pieces, c)
        total = F.aggregate(F.transform(pieces, words), F.lit(0), lambda acc, n: acc + n)
        return let(total, lambda n: F.when(n == 0, 1).otherwise(n))

    def stripped(x):
        ends = F.lit(False)
        for c in WHITE_SPACE:
            ends = ends | F.startswith(x, F.lit(c)) | F.endswith(x, F.lit(c))
        return F.when(ends, py_strip(x)).otherwise(x)
    return let(s, lambda x: let(stripped(x), count)).cast("int")
