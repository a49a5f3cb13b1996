"""R16, R19, R20 beyond strings and numbers: answers that are expressions, tuples, intervals, matrices.

``nested_items`` reads an answer's lists with a depth-tracking fold, so that items keep their inner
brackets; ``plain_lists`` writes intervals and matrices as lists first.  ``items_equal`` compares
items as expressions: both sides are evaluated at seeded points, exactly modulo two primes
where that is possible (sums, products, quotients, whole powers), else as doubles (roots,
functions, pi).  Two expressions that agree at a point by chance would have to do so at all
POINTS points; a false match has a chance of about degree / 2**61 for each of them.

An item that does not read as an expression, has over two variables or over MAX_LENGTH
characters is compared as text without blanks.  Null items make the result null.
"""

from __future__ import annotations

import math
import re
import zlib
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import text as T
from ..functions.common import as_col, let

PRIMES = ((1 << 61) - 1, (1 << 61) - 31)
POINTS = 3
MAX_LENGTH, MAX_POWER, MAX_VARIABLES = 400, 1000, 2

FUNCTIONS = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "ln": math.log, "log": math.log,
             "exp": math.exp, "abs": abs, "arcsin": math.asin, "arccos": math.acos, "arctan": math.atan}
TOKEN = re.compile(r"\d+\.?\d*|\.\d+|\\?(?:" + "|".join(sorted(FUNCTIONS, key=len, reverse=True)) + r")(?![a-z])|\\?pi(?![a-z])"
                   r"|\\[dt]?frac|\*\*|[-+*/^(){}\[\]!]|[a-zA-Z]|\S")
#: LaTeX and text signs, as this reader has them.
SIGNS = [("\\left", ""), ("\\right", ""), ("\\!", ""), ("\\,", ""), ("\\;", ""), ("\\ ", ""), ("$", ""), ("\\cdot", "*"), ("\\times", "*"),
         ("\\div", "/"), ("−", "-"), ("·", "*"), ("×", "*"), ("÷", "/"), ("√", "sqrt"), ("π", "pi")]


class Unreadable(ValueError):
    """Text that is no expression of this grammar."""


def parse(text: str):
    """Nested tuples: ("num", Fraction), ("var", name), ("pi",), (operator, a, b), ("call", name, a)."""
    for a, b in SIGNS:
        text = text.replace(a, b)
    tokens, at = TOKEN.findall(text), 0

    def peek():
        return tokens[at] if at < len(tokens) else ""

    def take(expected=None):
        nonlocal at
        t = peek()
        if not t or (expected and t != expected):
            raise Unreadable(text)
        at += 1
        return t

    def total():
        value = product()
        while peek() in ("+", "-") and peek():
            value = (take(), value, product())
        return value

    def product():
        value = signed()
        while (t := peek()) and t not in "+-)}]^!":
            if t in ("*", "/"):
                value = (take(), value, signed())
            else:  # written side by side
                value = ("*", value, power())
        return value

    def signed():
        if peek() == "-":
            take()
            return ("-", ("num", Fraction(0)), signed())
        if peek() == "+":
            take()
            return signed()
        return power()

    def power():
        value = atom()
        if peek() in ("^", "**") and peek():
            take()
            return ("^", value, signed())
        return value

    def group(close):
        take()
        value = total()
        take(close)
        return value

    def atom():
        t = peek()
        if t == "(":
            return group(")")
        if t == "{":
            return group("}")
        t = take()
        name = t.lstrip("\\")
        if t[0].isdigit() or t[0] == ".":
            return ("num", Fraction(t if t[-1] != "." else t[:-1]))
        if name == "pi":
            return ("pi",)
        if name in ("frac", "dfrac", "tfrac"):
            return ("/", digit_or_group(), digit_or_group())
        if name in FUNCTIONS:
            if name == "sqrt" and peek() == "[":
                degree = group("]")
                return ("^", digit_or_group(), ("/", ("num", Fraction(1)), degree))
            return ("call", name, digit_or_group() if peek() in ("{", "(") else power())
        if len(t) == 1 and t.isalpha():
            return ("var", t)
        raise Unreadable(text)

    def digit_or_group():
        nonlocal at
        t = peek()
        if t[:1].isdigit() and len(t) > 1 and "." not in t:  # \frac12 is a half
            tokens[at:at + 1] = list(t)
        return atom()

    value = total()
    if at < len(tokens):
        raise Unreadable(text)
    return value


def variables(tree) -> set[str]:
    if tree[0] == "var":
        return {tree[1]}
    return set().union(*(variables(x) for x in tree[1:] if isinstance(x, tuple)), set())


def modular(tree, point: dict[str, int], p: int) -> int:
    """Value modulo ``p``; ArithmeticError where the expression has none."""
    kind = tree[0]
    if kind == "num":
        return tree[1].numerator * pow(tree[1].denominator, -1, p) % p
    if kind == "var":
        return point[tree[1]] % p
    if kind in ("pi", "call"):
        raise ArithmeticError("not rational")
    a = modular(tree[1], point, p)
    if kind == "^":
        n = constant(tree[2])
        if n.denominator != 1 or abs(n) > MAX_POWER or (n < 0 and a == 0):
            raise ArithmeticError("no whole power")
        return pow(a, int(n), p)
    b = modular(tree[2], point, p)
    if kind == "/":
        if b == 0:
            raise ArithmeticError("division by zero")
        return a * pow(b, -1, p) % p
    return (a + b if kind == "+" else a - b if kind == "-" else a * b) % p


def constant(tree) -> Fraction:
    """Exact value of a rational expression without variables."""
    kind = tree[0]
    if kind == "num":
        return tree[1]
    if kind not in "+-*/":
        raise ArithmeticError("not rational")
    a, b = constant(tree[1]), constant(tree[2])
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b


def decimal(tree, point: dict[str, float]) -> float:
    kind = tree[0]
    if kind == "num":
        return float(tree[1])
    if kind == "var":
        return point[tree[1]]
    if kind == "pi":
        return math.pi
    if kind == "call":
        return FUNCTIONS[tree[1]](decimal(tree[2], point))
    a, b = decimal(tree[1], point), decimal(tree[2], point)
    if kind == "^":
        value = a ** b
        if isinstance(value, complex):
            raise ArithmeticError("no real power")
        return value
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b


def place(name: str, k: int) -> int:
    """Seeded whole number that stands for a variable at the k-th point."""
    return zlib.crc32(f"{name}/{k}".encode()) * 0x9E3779B1 + 12345


def same_expression(a: str, b: str, tolerance: float) -> bool:
    plain = ["".join(x.split()) for x in (a, b)]
    if plain[0] == plain[1]:
        return True
    if max(map(len, plain)) > MAX_LENGTH:
        return False
    try:
        trees = [parse(x) for x in (a, b)]
    except (Unreadable, RecursionError, IndexError):
        return False
    names = variables(trees[0]) | variables(trees[1])
    if len(names) > MAX_VARIABLES:
        return False
    try:
        if all(modular(trees[0], at, p) == modular(trees[1], at, p)
               for p in PRIMES for at in ({n: place(n, k) for n in names} for k in range(POINTS))):
            return True
        exact = True
    except ArithmeticError:
        exact = False
    if exact and names:
        return False  # rational expressions that differ at a point are different
    close = tolerance if not names else 1e-9
    for k in range(POINTS):
        try:
            u, v = (decimal(t, {n: 0.5 + place(n, k) % 1000 / 512 for n in names}) for t in trees)
        except (ArithmeticError, ValueError):
            return False
        if not math.isclose(u, v, rel_tol=close, abs_tol=1e-12):
            return False
    return True


def items_equal(given, truth, tolerance: float = 1e-4) -> Column:
    """Whether two arrays of items are as long and each item equals its partner as an expression;
    numbers without variables within the relative tolerance."""
    @arrow_udf("boolean")
    def equal(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(x.to_pylist(), y.to_pylist()):
            missing = a is None or b is None or None in a or None in b
            out.append(None if missing else len(a) == len(b) and all(same_expression(u, v, tolerance) for u, v in zip(a, b)))
        return pa.array(out, pa.bool_())
    return equal(as_col(given), as_col(truth))


def expressions_equal(a, b, tolerance: float = 1e-4) -> Column:
    """Two answers as expressions."""
    return items_equal(F.array(as_col(a)), F.array(as_col(b)), tolerance)


# How interval objects are printed, and the brackets that they stand for.
INTERVAL_FORMS = [("Interval.open", "(", ")"), ("Interval.Lopen", "(", "]"), ("Interval.Ropen", "[", ")"), ("Interval", "[", "]")]
MATRIX = r"(?s)^\\begin\{[pbv]?matrix\}(.*)\\end\{[pbv]?matrix\}$"


def plain_lists(s) -> Column:
    """``Interval.open(a, b)`` and its kind as ``(a, b)``, a LaTeX matrix and ``Matrix([..])`` as
    a list of rows, ``Point(..)`` as a tuple; other text as it is, without outer blanks."""
    x = T.py_strip(F.replace(F.replace(as_col(s), F.lit("\\left"), F.lit("")), F.lit("\\right"), F.lit("")))
    for name, opened, closed in INTERVAL_FORMS:
        x = F.regexp_replace(x, r"(?s)^" + name.replace(".", r"\.") + r"\((.*)\)$", rf"\{opened}$1\{closed}")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)^Matrix\((\[.*\])\)$", "$1"), r"(?s)^Point(?:2D|3D)?(\(.*\))$", "$1")

    def rows(v):
        inner = F.regexp_replace(T.py_strip(F.regexp_extract(v, MATRIX, 1)), r"\\\\\s*$", "")
        row = F.transform(F.split(inner, r"\\\\"), lambda r: F.concat(F.lit("["), F.replace(r, F.lit("&"), F.lit(",")), F.lit("]")))
        return F.when(v.rlike(MATRIX), F.concat(F.lit("["), F.array_join(row, ","), F.lit("]"))).otherwise(v)
    return let(x, rows)


def nested_items(s) -> Column:
    """Struct of ``marks`` and ``items`` of an answer's lists, in order.

    A bracket at the begin of an item opens a list; every comma and every bracket that closes
    one ends an item, and its mark is the list brackets open there and that sign.  Brackets
    inside an item belong to it.  Text whose lists do not close, or go on after they closed,
    is one item without marks.
    """
    def step(st, c):
        opens, closes = c.isin("(", "[", "{"), c.isin(")", "]", "}")
        blank = F.trim(st["item"]) == ""
        inner = st["inner"]
        lists = (inner == 0) & blank & ~st["closed"] & c.isin("(", "[")
        ends = (inner == 0) & ((c == ",") | (c.isin(")", "]") & (F.length(st["open"]) > 0)))
        more = ~lists & ~ends
        return F.struct(
            F.when(lists, F.concat(st["open"], c)).when(ends & (c != ","), F.substring(st["open"], F.lit(1), F.length(st["open"]) - 1))
             .otherwise(st["open"]).alias("open"),
            F.when(more & opens, inner + 1).when(more & closes, inner - 1).otherwise(inner).alias("inner"),
            F.when(more, F.concat(st["item"], c)).otherwise(F.lit("")).alias("item"),
            F.when(ends, c != ",").when(c == " ", st["closed"]).otherwise(F.lit(False)).alias("closed"),
            (st["ok"] & ~(st["closed"] & ~ends & (c != " ")) & ~(more & closes & (inner == 0))).alias("ok"),
            F.when(ends, F.concat(st["marks"], F.array(F.concat(st["open"], c)))).otherwise(st["marks"]).alias("marks"),
            F.when(ends, F.concat(st["items"], F.array(F.trim(st["item"])))).otherwise(st["items"]).alias("items"))

    def on(x):
        none = F.array().cast("array<string>")
        start = F.struct(F.lit("").alias("open"), F.lit(0).alias("inner"), F.lit("").alias("item"), F.lit(False).alias("closed"),
                         F.lit(True).alias("ok"), none.alias("marks"), none.alias("items"))

        def finish(st):
            whole = st["ok"] & (F.length(st["open"]) == 0) & (st["inner"] == 0)
            rest = F.trim(st["item"])
            return F.struct(F.when(whole, st["marks"]).otherwise(none).alias("marks"),
                            F.when(~whole, F.array(x)).when(rest == "", st["items"])
                             .otherwise(F.concat(st["items"], F.array(rest))).alias("items"))
        return F.when(x.isNotNull(), F.aggregate(F.split(x, ""), start, step, finish))
    return let(T.py_strip(as_col(s)), on)


def with_forms_equal(df: DataFrame, given, truth, name: str, tolerance: float = 1e-4) -> DataFrame:
    """``df`` with a boolean: the same lists (brackets, nesting and lengths), and each item equal
    as an expression.  Intervals and matrices count as lists."""
    if any(c.lower() in (name.lower(), "_given_items", "_truth_items") for c in df.columns):
        raise ValueError(f"column {name} exists; name another")
    # columns of their own: Python gets the items that were read, not the expressions that read them
    read = (df.withColumn("_given_items", nested_items(plain_lists(given)))
            .withColumn("_truth_items", nested_items(plain_lists(truth))))
    g, t = F.col("_given_items"), F.col("_truth_items")
    read = read.withColumn(name, items_equal(g["items"], t["items"], tolerance))
    return read.withColumn(name, (g["marks"] == t["marks"]) & F.col(name)).drop("_given_items", "_truth_items")
