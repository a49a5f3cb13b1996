"""Knights-and-knaves puzzle corpus as table jobs.

A puzzle is one row: ``k`` (its seed key), ``n`` people and ``statements``,
``array<struct<op, args array<struct<lie, who>>>>`` with ``op`` in
leaf/not/and/or/->/<=> (depth 2, width 2 covers every statement the
generator makes).  All randomness comes from ``draw`` (an md5 of seed, key and
salt), so a puzzle is a pure function of its key and any engine can reproduce
it.  Solving works inside the row: the 2^n assignments are 64-bit words (one
up to 6 people, 2^(n-6) beyond) and each statement is a handful of bit
operations over them (``solution_words``); no join, no UDF.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.common import as_col, let, seeded_digits, seeded_draw
from ..session import ensure_checkpoint_dir
from . import puzzle_text as PT
from .perturbations import first_changes

OPS = ["leaf", "not", "and", "or", "->", "<=>"]


def draw(key, salt, seed: int = 0) -> Column:
    """Deterministic integer in [0, 2^60) for (key, salt)."""
    return seeded_draw(key, seed, salt)


def _leaf(j: Column, n: Column, p: Column) -> Column:
    """Valid leaf option j in [0, 2n-2]: j < n -> telling-truth j; else lying
    about someone other than the speaker (no trivially false self-accusation)."""
    w = j - n
    return F.struct((j >= n).alias("lie"),
                    F.when(j < n, j).otherwise(w + F.when(w >= p, 1).otherwise(0)).cast("int").alias("who"))


def sample_statement(k, n, p, salt_base, seed: int = 0, leaf_only: bool = False) -> Column:
    """One statement for speaker ``p``: op by a six-sided draw, leaves distinct."""
    k, n, p, base = as_col(k), as_col(n), as_col(p), as_col(salt_base)
    opts = 2 * n - 1

    def build(j1, j2, d):
        if leaf_only:
            return F.struct(F.lit("leaf").alias("op"), F.array(_leaf(j1, n, p)).alias("args"))
        op = F.element_at(F.array(*[F.lit(o) for o in OPS]), d + 1)
        args = F.when(d <= 1, F.array(_leaf(j1, n, p))).otherwise(F.array(_leaf(j1, n, p), _leaf(j2, n, p)))
        return F.struct(op.alias("op"), args.alias("args"))
    return let(F.pmod(draw(k, base + 1, seed), opts), lambda j1: let(
        F.pmod(j1 + 1 + F.pmod(draw(k, base + 2, seed), opts - 1), opts), lambda j2: let(
            F.pmod(draw(k, base, seed), F.lit(6)).cast("int"), lambda d: build(j1, j2, d))))


def sample_puzzles(keys: DataFrame, key: str = "k", n_people=None, seed: int = 0) -> DataFrame:
    """K2 (sampling part): one candidate puzzle per key.  ``n_people`` is an
    int or a column; by default 2 + key % 7 (sizes 2..8)."""
    return numbered_people(keys, key, n_people).withColumn("statements", sampled_statements("k", "n", seed))


def numbered_people(keys: DataFrame, key: str = "k", n_people=None) -> DataFrame:
    """Key ``k`` and number of people ``n`` of each candidate."""
    n = F.lit(n_people) if isinstance(n_people, int) else (
        as_col(n_people) if n_people is not None else (F.pmod(F.col(key), F.lit(7)) + 2))
    return keys.select(F.col(key).alias("k"), n.cast("int").alias("n"))


def sampled_statements(k, n, seed: int = 0) -> Column:
    """The statements of the candidate puzzle of key ``k`` with ``n`` people."""
    k, n = as_col(k), as_col(n)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda p: sample_statement(k, n, p, p * 16, seed))


def knight(a: Column, i: Column) -> Column:
    return F.call_function("shiftright", a, i).bitwiseAND(F.lit(1)) == 1


def statement_value(s: Column, a: Column) -> Column:
    """Truth of one flat statement under assignment bitmask ``a``."""
    v1 = knight(a, s["args"][0]["who"]) != s["args"][0]["lie"]
    second = F.try_element_at(s["args"], F.lit(2))
    v2 = knight(a, second["who"]) != second["lie"]
    op = s["op"]
    return (F.when(op == "leaf", v1).when(op == "not", ~v1).when(op == "and", v1 & v2)
             .when(op == "or", v1 | v2).when(op == "->", ~v1 | v2).otherwise(v1 == v2))


def consistent(statements: Column, a: Column) -> Column:
    """Every speaker is a knight exactly when their statement is true."""
    return F.forall(F.transform(statements, lambda s, p: statement_value(s, a) == knight(a, p)), lambda x: x)


def solutions(statements, n) -> Column:
    """K1: array of assignment bitmasks consistent with all statements."""
    statements, n = as_col(statements), as_col(n)
    space = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), n) - 1)
    return let(statements, lambda st: F.filter(space, lambda a: consistent(st, a)))


def bits_to_roles(bits, n) -> Column:
    """Bitmask -> array<boolean> (True = knight) in person order."""
    return F.transform(F.sequence(F.lit(0), as_col(n) - 1), lambda i: knight(as_col(bits), i))


# --- bit-parallel solving ------------------------------------------------------------
# The 2^n assignments are words of 64 bits: bit j of word w stands for
# assignment a = 64w + j, and the number of words follows from n.  "Person i is a knight" is a fixed bit
# pattern, so a statement's truth over all assignments is a few word
# operations, and the consistent assignments are the AND over speakers.

def _signed(x: int) -> int:
    return x - (1 << 64) if x >= (1 << 63) else x


# bit patterns of "bit i of a is set" inside one 64-assignment word, i = 0..5
_LOW_PATTERNS = [_signed(sum(1 << j for j in range(64) if (j >> i) & 1)) for i in range(6)]


def _knight_word(i: Column, w: Column) -> Column:
    low = F.element_at(F.array(*[F.lit(x) for x in _LOW_PATTERNS]), i + 1)
    high_bit_set = F.call_function("shiftright", w, i - 6).bitwiseAND(F.lit(1)) == 1
    return F.when(i < 6, low).otherwise(F.when(high_bit_set, F.lit(-1)).otherwise(F.lit(0))).cast("long")


def _leaf_word(arg: Column, w: Column) -> Column:
    k = _knight_word(arg["who"], w)
    return F.when(arg["lie"], F.bitwise_not(k)).otherwise(k)


_BY_OP = {"leaf": lambda a, b: a, "not": lambda a, b: F.bitwise_not(a),
          "and": lambda a, b: a.bitwiseAND(b), "or": lambda a, b: a.bitwiseOR(b),
          "->": lambda a, b: F.bitwise_not(a).bitwiseOR(b), "<=>": lambda a, b: F.bitwise_not(a.bitwiseXOR(b))}


def _combined_word(op: Column, a: Column, b: Column) -> Column:
    """Truth word of a statement from the words of its arguments (an only one given twice)."""
    word = F.when(op == OPS[0], _BY_OP[OPS[0]](a, b))
    for name in OPS[1:-1]:
        word = word.when(op == name, _BY_OP[name](a, b))
    return word.otherwise(_BY_OP[OPS[-1]](a, b))


def _statement_word(s: Column, w: Column) -> Column:
    second = F.coalesce(F.try_element_at(s["args"], F.lit(2)), s["args"][0])
    return let(_leaf_word(s["args"][0], w), lambda v1: let(_leaf_word(second, w), lambda v2: _combined_word(s["op"], v1, v2)))


def _valid_word(n: Column, w: Column) -> Column:
    size = F.call_function("shiftleft", F.lit(1), n)      # 2^n assignments
    low = size - w * 64
    low_bits = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), low))   # no overflow
    return F.when(low >= 64, F.lit(-1)).when(low <= 0, F.lit(0)).otherwise(low_bits).cast("long")


def word_indexes(n: Column) -> Column:
    """0 .. number of 64-assignment words of n people - 1."""
    return F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.greatest(n - 6, F.lit(0))) - 1)


def solution_words(statements, n) -> Column:
    """Words whose set bits are the assignments consistent with every statement."""
    statements, n = as_col(statements), as_col(n)

    def word(w):
        ok = F.transform(statements, lambda s, p: F.bitwise_not(_statement_word(s, w).bitwiseXOR(_knight_word(p, w))))
        return F.aggregate(ok, F.lit(-1).cast("long"), lambda acc, x: acc.bitwiseAND(x)).bitwiseAND(_valid_word(n, w))
    return F.transform(word_indexes(n), word)


def _single_bit_index(x: Column) -> Column:
    """Index of the only set bit of ``x`` (a unique solution sets one bit)."""
    return F.when(x < 0, F.lit(63)).otherwise(F.round(F.log2(x)).cast("int"))


def solution_summary(statements, n) -> Column:
    """struct(n_solutions, solution_bits): count of consistent assignments and,
    when it is exactly one, that assignment (else -1)."""
    return words_summary(solution_words(statements, n))


def words_summary(words: Column) -> Column:
    """``solution_summary`` of the words of ``solution_words``."""
    def summarize(words):
        count = F.aggregate(words, F.lit(0), lambda acc, x: acc + F.bit_count(x))
        first = F.filter(F.transform(words, lambda x, w: F.struct(w.alias("w"), x.alias("x"))), lambda e: e["x"] != 0)
        bits = let(F.try_element_at(first, F.lit(1)), lambda e: e["w"] * 64 + _single_bit_index(e["x"]))
        return F.struct(count.cast("int").alias("n_solutions"),
                        F.when(count == 1, bits).otherwise(F.lit(-1)).cast("int").alias("solution_bits"))
    return let(words, summarize)


def solve(puzzles: DataFrame) -> DataFrame:
    """K1: add ``n_solutions``, ``solution_bits`` (-1 unless unique) and ``solution``."""
    d = puzzles.withColumn("_sum", solution_summary("statements", "n"))
    d = (d.withColumn("n_solutions", F.col("_sum.n_solutions"))
          .withColumn("solution_bits", F.col("_sum.solution_bits")).drop("_sum"))
    return d.withColumn("solution", F.when(F.col("solution_bits") >= 0, bits_to_roles("solution_bits", "n")))


def _leaf_repr(arg: Column) -> Column:
    return F.concat(F.lit("('"), F.when(arg["lie"], "lying").otherwise("telling-truth"), F.lit("', "),
                    arg["who"].cast("string"), F.lit(")"))


def statement_repr(s: Column) -> Column:
    """Python tuple text of one statement, e.g. ``('and', ('lying', 0), ('telling-truth', 2))``."""
    a1 = _leaf_repr(s["args"][0])
    a2 = _leaf_repr(F.try_element_at(s["args"], F.lit(2)))
    return (F.when(s["op"] == "leaf", a1)
             .when(s["op"] == "not", F.concat(F.lit("('not', "), a1, F.lit(")")))
             .otherwise(F.concat(F.lit("('"), s["op"], F.lit("', "), a1, F.lit(", "), a2, F.lit(")"))))


def statements_repr(statements) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(as_col(statements), statement_repr), ", "), F.lit(")"))


# --- statements as numbers -------------------------------------------------------------
# Until puzzles with several solutions and copies are gone, a statement is one number: the place
# of its operator in OPS, then a byte for each leaf (128 for "lying", plus who; an only one twice).

def _leaf_code(j: Column, n: Column, p: Column) -> Column:
    """Leaf option j of ``_leaf`` as a byte."""
    return F.when(j < n, j).otherwise(j - n + F.when(j - n >= p, 129).otherwise(128))


def sampled_codes(k, n, seed: int = 0) -> Column:
    """The statements of ``sampled_statements`` as numbers, array<int>; the draws share the text they begin with."""
    k, n = as_col(k), as_col(n)

    def of_speaker(start, p):
        def drawn(place):
            return F.conv(F.substring(F.md5(F.concat(start, (p * 16 + place).cast("string"))), 1, 15), 16, 10).cast("long")
        opts = 2 * n - 1

        def second(j1):
            return F.pmod(j1 + 1 + F.pmod(drawn(2), opts - 1), opts)

        def code(d, j1):
            return let(_leaf_code(j1, n, p), lambda a: d * 65536 + a * 256 + F.when(d <= 1, a).otherwise(
                let(second(j1), lambda j2: _leaf_code(j2, n, p))))
        return let(F.pmod(drawn(1), opts), lambda j1: let(F.pmod(drawn(0), F.lit(len(OPS))), lambda d: code(d, j1))).cast("int")
    start = F.concat(F.concat_ws(":", F.lit(str(seed)), k.cast("string")), F.lit(":"))
    return let(start, lambda start: F.transform(F.sequence(F.lit(0), n - 1), lambda p: of_speaker(start, p)))


def _code_byte(c: Column, place: int) -> Column:
    return F.call_function("shiftright", c, F.lit(8 - 8 * place)).bitwiseAND(F.lit(255))


def coded_statement(c: Column) -> Column:
    """The statement of a number."""
    def leaf(place):
        return let(_code_byte(c, place), lambda x: F.struct((x >= 128).alias("lie"), x.bitwiseAND(F.lit(127)).alias("who")))
    op = F.call_function("shiftright", c, F.lit(16))
    return F.struct(F.element_at(F.array(*[F.lit(o) for o in OPS]), op + 1).alias("op"),
                    F.when(op <= 1, F.array(leaf(0))).otherwise(F.array(leaf(0), leaf(1))).alias("args"))


def coded_solution_words(codes: Column, n: Column) -> Column:
    """``solution_words`` of statements given as numbers."""
    low = F.array(*[F.lit(x) for x in _LOW_PATTERNS])

    def word(w):
        def agreeing(c, p, knights):
            def leaf(place):
                return let(_code_byte(c, place), lambda x: let(knights[x.bitwiseAND(F.lit(127))], lambda k: F.when(
                    x >= 128, F.bitwise_not(k)).otherwise(k)))

            def truth(a, b):
                found = F.when(c < 1 << 16, a)
                for at, name in enumerate(OPS[1:-1], 2):
                    found = found.when(c < at << 16, _BY_OP[name](a, b))
                return found.otherwise(_BY_OP[OPS[-1]](a, b))
            stated = let(leaf(0), lambda a: F.when(c < 1 << 16, a).when(c < 2 << 16, F.bitwise_not(a)).otherwise(
                let(leaf(1), lambda b: truth(a, b))))
            return F.bitwise_not(stated.bitwiseXOR(knights[p]))
        knights = F.when(n <= 6, low).otherwise(F.concat(low, F.transform(F.sequence(F.lit(6), F.greatest(n - 1, F.lit(6))), lambda i: _knight_word(i, w))))
        ok = let(knights, lambda knights: F.transform(codes, lambda c, p: agreeing(c, p, knights)))
        return F.aggregate(ok, F.lit(-1).cast("long"), lambda acc, x: acc.bitwiseAND(x)).bitwiseAND(_valid_word(n, w))
    return F.transform(word_indexes(n), word)


CODED_TYPE = "array<struct<codes:array<int>,solution_bits:int>>"


def unique_puzzles(keys: DataFrame, key: str = "k", n_people=None, seed: int = 0) -> DataFrame:
    """The puzzles of ``generate`` as narrow rows: ``k``, ``n``, ``solution_bits`` and ``codes``, the
    statements as numbers.

    Candidates without a unique solution go first, inside the row.  The de-duplication is a hash
    aggregate over the numbers with the smallest key as its only buffer (a struct in the buffer would
    sort whole rows), partial before the shuffle, so a very common puzzle does not make a hot task."""
    def row(codes, found):
        one = F.struct(codes.alias("codes"), found["solution_bits"].alias("solution_bits"))
        return F.when(found["n_solutions"] == 1, F.array(one)).otherwise(F.array().cast(CODED_TYPE))
    tried = let(sampled_codes("k", "n", seed), lambda codes: let(
        words_summary(coded_solution_words(codes, F.col("n"))), lambda found: row(codes, found)))
    # a generator keeps its argument: a filter on the result would sample and solve twice
    valid = numbered_people(keys, key, n_people).select("k", "n", F.inline(tried))
    return valid.groupBy("codes", "n", "solution_bits").agg(F.min("k").alias("k"))


def restored(puzzles: DataFrame) -> DataFrame:
    """Puzzles of ``unique_puzzles`` with what follows from numbers and solution: ``statements``,
    ``statements_repr``, ``n_solutions`` and ``solution``."""
    return (puzzles.withColumn("statements", F.transform("codes", coded_statement)).drop("codes")
            .withColumn("statements_repr", statements_repr("statements")).withColumn("n_solutions", F.lit(1))
            .withColumn("solution", bits_to_roles("solution_bits", "n")))


def generate(keys: DataFrame, key: str = "k", n_people=None, seed: int = 0, tasks: int | None = None) -> DataFrame:
    """K2: candidates -> solve -> keep unique-solution puzzles -> drop duplicate statement sets
    (the smallest key wins).  Statements go through the shuffle as numbers.  The rows are dealt to
    ``tasks`` partitions (as many as the keys came in): work on puzzles takes far longer than the
    bytes of these rows tell.  A hash of the key, which the aggregate leaves once, deals them
    without the sort that dealing in turn would put into the aggregate's tasks."""
    dealt = unique_puzzles(keys, key, n_people, seed).repartition(tasks or keys.rdd.getNumPartitions(), "k")
    return restored(dealt).select("k", "n", "statements", "n_solutions", "solution_bits", "solution", "statements_repr")


def generate_exactly(spark: SparkSession, count: int, n_people: int | None = None, seed: int = 0) -> DataFrame:
    """K2 for a number of puzzles: keys 0, 1, 2, ... are tried, twice as many each time, until
    enough distinct puzzles with one solution are found; the first ``count`` by key are
    returned.  Raises when twice the keys bring no new puzzle (small sizes have few)."""
    ensure_checkpoint_dir(spark)
    tried, before = max(64, 8 * count), -1
    while True:
        keys = spark.range(tried).withColumnRenamed("id", "k")
        found = generate(keys, n_people=n_people, seed=seed).checkpoint(eager=True)
        n = found.count()
        if n >= count:
            return found.orderBy("k").limit(count)
        if n == before:
            raise ValueError(f"only {n} distinct puzzles of this kind were found")
        tried, before = 2 * tried, n


# --- K6: rendering -------------------------------------------------------------

def _role_words(pair_index: Column | None, flip: bool):
    pairs = PT.KNIGHT_KNAVE_PAIRS
    if pair_index is None:
        a_knight, a_knave = F.lit("a knight"), F.lit("a knave")
    else:
        a_knight = F.element_at(F.array(*[F.lit(p[0]) for p in pairs]), pair_index + 1)
        a_knave = F.element_at(F.array(*[F.lit(p[1]) for p in pairs]), pair_index + 1)
    if flip:
        a_knight, a_knave = a_knave, a_knight
    knight_w = F.element_at(F.split(a_knight, " "), 2)
    knave_w = F.element_at(F.split(a_knave, " "), 2)
    return a_knight, a_knave, knight_w, knave_w


def _capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def render(puzzles: DataFrame, seed: int = 0, uncommon_names: bool = False, random_pairs: bool = False,
           flip_roles: bool = False, reorder: bool = False) -> DataFrame:
    """K6 (and K5 surface variants): names, quiz text, solution text.

    Names are the first ``n`` of the name list in a seeded order; each
    statement takes a seeded sentence template.  Variants: uncommon names,
    a random role-word pair, swapped roles, statements in a different order.
    """
    name_pool = PT.UNCOMMON_NAMES if uncommon_names else PT.COMMON_NAMES
    # the draws share the text they begin with; 15 digits and the name in one text sort as the two do
    pool = F.array(*[F.struct(F.lit(f":{5000 + i}").alias("end"), F.lit(nm).alias("name")) for i, nm in enumerate(name_pool)])
    ranked = let(F.concat_ws(":", F.lit(str(seed)), F.col("k").cast("string")), lambda start: F.transform(
        pool, lambda e: F.concat(F.substring(F.md5(F.concat(start, e["end"])), 1, 15), e["name"])))
    names = F.transform(F.slice(F.sort_array(ranked), 1, F.col("n")), lambda e: F.substr(e, F.lit(16)))
    d = puzzles.withColumn("names", names)
    pair_index = F.pmod(draw(F.col("k"), 9000, seed), F.lit(len(PT.KNIGHT_KNAVE_PAIRS))).cast("int") if random_pairs else None
    a_knight, a_knave, knight_w, knave_w = _role_words(pair_index, flip_roles)
    d = d.withColumn("_kk", F.struct(a_knight.alias("a_knight"), a_knave.alias("a_knave"),
                                     knight_w.alias("knight"), knave_w.alias("knave")))
    kk = F.col("_kk")

    def leaf_text(arg, neg=False):
        role = F.when(arg["lie"], kk["a_knave"]).otherwise(kk["a_knight"])
        return F.concat(F.element_at(F.col("names"), arg["who"] + 1), F.lit(" is not " if neg else " is "), role)

    def content(s):
        a1, a2 = s["args"][0], F.try_element_at(s["args"], F.lit(2))
        return (F.when(s["op"] == "leaf", leaf_text(a1))
                 .when(s["op"] == "not", leaf_text(a1, True))
                 .when(s["op"].isin("and", "or"), F.concat(leaf_text(a1), F.lit(" "), s["op"], F.lit(" "), leaf_text(a2)))
                 .when(s["op"] == "->", F.concat(F.lit("If "), leaf_text(a1), F.lit(" then "), leaf_text(a2)))
                 .otherwise(F.concat(leaf_text(a1), F.lit(" if and only if "), leaf_text(a2))))
    tmpls = F.array(*[F.lit(t) for t in PT.TEMPLATES])
    stm_text = F.transform("statements", lambda s, p: F.concat(F.lit(" "), F.replace(F.replace(
        F.element_at(tmpls, (F.pmod(draw(F.col("k"), 6000 + p, seed), F.lit(len(PT.TEMPLATES))) + 1).cast("int")),
        F.lit("{name}"), F.element_at(F.col("names"), p + 1)), F.lit("{content}"), content(s))))
    d = d.withColumn("_stm", stm_text)
    if reorder:
        order = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                            lambda p: F.struct(seeded_digits(F.col("k"), seed, 7000 + p).alias("h"), p.alias("p")))
        perm = F.transform(F.sort_array(order), lambda e: e["p"])
        ident = F.sequence(F.lit(0), F.col("n") - 1)
        rotated = F.transform(ident, lambda p: F.pmod(p + 1, F.col("n")))
        d = d.withColumn("_perm", F.when(perm == ident, rotated).otherwise(perm))
        d = d.withColumn("_stm", F.transform("_perm", lambda p: F.element_at(F.col("_stm"), p + 1)))
    def fill(template):
        out = F.lit(template)
        for key, value in (("{Knight}", _capitalize(kk["knight"])), ("{Knave}", _capitalize(kk["knave"])),
                           ("{knight}", kk["knight"]), ("{knave}", kk["knave"]),
                           ("{a_knight}", kk["a_knight"]), ("{a_knave}", kk["a_knave"])):
            out = F.replace(out, F.lit(key), value)
        return out
    prefix = fill(PT.PREFIX)
    meet = F.concat(F.lit("You meet "), F.col("n").cast("string"), F.lit(" inhabitants: "),
                    F.array_join(F.slice("names", 1, F.col("n") - 1), ", "), F.lit(", and "),
                    F.element_at("names", -1), F.lit("."))
    post = F.concat(F.lit(" "), fill(PT.POSTFIX))
    d = d.withColumn("quiz", F.concat(prefix, meet, F.array_join("_stm", ""), post))
    sol = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(
        F.element_at(F.col("names"), i + 1), F.lit(" is "),
        F.when(F.element_at(F.col("solution"), i + 1), kk["a_knight"]).otherwise(kk["a_knave"])))
    d = d.withColumn("solution_text", F.when(F.col("solution").isNull(), F.lit("No valid solution exists.")).otherwise(
        F.concat(F.array_join(F.slice(sol, 1, F.col("n") - 1), ", "), F.lit(", and "), F.element_at(sol, -1), F.lit("."))))
    d = d.withColumn("solution_text_format", format_solution_text("solution_text"))
    d = d.withColumn("knight_knave", F.create_map(
        F.lit("knight"), kk["knight"], F.lit("knave"), kk["knave"], F.lit("a_knight"), kk["a_knight"],
        F.lit("a_knave"), kk["a_knave"], F.lit("Knight"), _capitalize(kk["knight"]), F.lit("Knave"), _capitalize(kk["knave"])))
    return d.drop("_kk", "_stm", "_perm")


def format_solution_text(solution_text) -> Column:
    """P12: 'A is x, B is y, and C is z.' -> '(1) A is x\\n(2) B is y\\n(3) C is z'."""
    gold = F.replace(F.replace(as_col(solution_text), F.lit(" and "), F.lit("")), F.lit("."), F.lit(""))
    parts = F.transform(F.split(gold, ","), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.transform(parts, lambda c, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), c)), "\n")


# --- K3 / K4: perturbations --------------------------------------------------------
# Every candidate is tried, inside the row.  With m = 2n - 1 leaf options per speaker, the
# statements of a speaker are numbered: m leaves, m negations, then for each of the four
# two-leaf operators m * (m - 1) ordered pairs of different leaves; candidate = speaker *
# (statements per speaker) + statement.  Leaf changes are numbered (speaker * 2 + place) * m + leaf.

def _views(agrees: Column, n: Column, p: Column) -> Column:
    """The words in which the other speakers leave assignments to speaker ``p``: index ``w``,
    what is left ``o``, "p is a knight" ``kp`` and the truth ``v`` of each leaf option of p."""
    def left(w):
        return F.aggregate(F.filter(agrees, lambda a, q: q != p), _valid_word(n, w), lambda acc, a: acc.bitwiseAND(a[w]))

    def view(e):
        leaves = F.transform(F.sequence(F.lit(0), 2 * n - 2), lambda j: let(_leaf(j, n, p), lambda a: _leaf_word(a, e["w"])))
        return F.struct(e["w"].alias("w"), e["o"].alias("o"), _knight_word(p, e["w"]).alias("kp"), leaves.alias("v"))
    words = F.transform(word_indexes(n), lambda w: F.struct(w.alias("w"), left(w).alias("o")))
    return F.transform(F.filter(words, lambda e: e["o"] != 0), view)


def _left(e: Column, word: Column) -> Column:
    """Assignments of view ``e`` that remain when the speaker's statement is true in ``word``."""
    return e["o"].bitwiseAND(F.bitwise_not(word.bitwiseXOR(e["kp"])))


def _valid(views: Column, choices: Column, truth, *numbers) -> Column:
    """struct(i, bit) for each of ``numbers`` of the choices whose statement ``truth(view, choice)``
    leaves one assignment, ``bit``.  Counting comes first: few choices pass, only they are looked
    at again."""
    def position(c):
        words = F.transform(views, lambda e: F.struct(e["w"].alias("w"), _left(e, truth(e, c)).alias("x")))
        return let(F.filter(words, lambda f: f["x"] != 0)[0], lambda f: (f["w"] * 64 + _single_bit_index(f["x"])).cast("int"))
    passing = F.filter(choices, lambda c: F.aggregate(
        views, F.lit(0), lambda acc, e: acc + F.bit_count(_left(e, truth(e, c)))) == 1)
    return F.flatten(F.transform(passing, lambda c: let(position(c), lambda bit: F.array(*[
        F.struct(number(c).cast("int").alias("i"), bit.alias("bit")) for number in numbers]))))


def _statement_changes(views: Column, m: Column) -> Column:
    """All statements of one speaker that leave one assignment: array<struct<i, bit>>."""
    options = F.sequence(F.lit(0), m - 1)

    def pairs(at, op):
        def with_first(j1):
            seen = F.transform(views, lambda e: F.struct(*[e[c].alias(c) for c in ("w", "o", "kp", "v")], e["v"][j1].alias("first")))
            both_ways = op != "->"       # the other operators say the same with leaves swapped
            others = F.filter(options, lambda j2: j2 > j1 if both_ways else j2 != j1)

            def number(a, b):
                return 2 * m + at * m * (m - 1) + a * (m - 1) + F.pmod(b - a - 1, m)
            numbers = [lambda j2: number(j1, j2)] + ([lambda j2: number(j2, j1)] if both_ways else [])
            return let(seen, lambda seen: _valid(seen, others, lambda e, j2: _BY_OP[op](e["first"], e["v"][j2]), *numbers))
        return F.flatten(F.transform(options, with_first))
    return F.concat(_valid(views, options, lambda e, j: e["v"][j], lambda j: j),
                    _valid(views, options, lambda e, j: F.bitwise_not(e["v"][j]), lambda j: m + j),
                    *[pairs(at, op) for at, op in enumerate(OPS[2:])])


#: Survivors that fit in one word of ``_few_changes``.
FEW = 62


def _survivors(views: Column) -> Column:
    """The assignments the other speakers leave, in the words of ``_views``."""
    def of_half(e):
        def pop(acc, _):
            x = acc["x"]
            at = e["first"] + F.bit_count(x.bitwiseAND(-x) - 1)
            return F.struct(x.bitwiseAND(x - 1).alias("x"), F.concat(acc["found"], F.array(at.cast("int"))).alias("found"))
        start = F.struct(e["o"].alias("x"), F.array().cast("array<int>").alias("found"))
        return F.aggregate(F.sequence(F.lit(1), F.bit_count(e["o"])), start, pop)["found"]
    halves = F.flatten(F.transform(views, lambda e: F.array(  # without the sign bit
        F.struct((e["w"] * 64).alias("first"), e["o"].bitwiseAND(F.lit((1 << 32) - 1)).alias("o")),
        F.struct((e["w"] * 64 + 32).alias("first"), F.call_function("shiftrightunsigned", e["o"], F.lit(32)).alias("o")))))
    return F.flatten(F.transform(F.filter(halves, lambda e: e["o"] != 0), of_half))


def _few_changes(found: Column, n: Column, p: Column, solution: Column) -> Column:
    """All statements of speaker ``p`` that leave one assignment other than the solution, where the
    others leave those of ``found``: array<struct<bit, numbers>>.

    Bit t of a word stands for ``found[t]``.  A statement leaves ``found[t]`` alone exactly when
    its word is the opposite of "p is a knight" everywhere but at t, so there is one word to meet
    per assignment, and a conjunction, say, can only meet it with leaves that hold wherever it does."""
    def word(i):
        return F.aggregate(F.transform(found, lambda a, t: F.call_function(
            "shiftleft", F.call_function("shiftright", a, i).bitwiseAND(F.lit(1)).cast("long"), t)),
            F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))

    def of_people(people, mask):
        leaves = F.transform(F.sequence(F.lit(0), 2 * n - 2), lambda j: let(_leaf(j, n, p), lambda a: F.struct(
            j.alias("j"), F.when(a["lie"], people[a["who"]].bitwiseXOR(mask)).otherwise(people[a["who"]]).alias("v"))))
        wrong = people[p].bitwiseXOR(mask)
        targets = F.filter(F.transform(found, lambda a, t: F.struct(
            a.alias("bit"), wrong.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t)).alias("r"))),
            lambda e: e["bit"] != solution)
        return let(leaves, lambda v: F.transform(targets, lambda e: F.struct(e["bit"].alias("bit"), let(
            e["r"].bitwiseXOR(mask), lambda q: meeting(v, e["r"], q)).alias("numbers"))))

    def meeting(v, r, q):
        m = 2 * n - 1

        def number(at, a, b):
            return (2 * m + at * m * (m - 1) + a * (m - 1) + F.pmod(b - a - 1, m)).cast("int")

        def pairs(at, firsts, seconds, fits, both_ways):
            def with_first(f, seconds):
                ok = F.filter(seconds, lambda g: (g["j"] > f["j"] if both_ways else g["j"] != f["j"]) & fits(f["v"], g["v"]))
                return F.flatten(F.transform(ok, lambda g: F.array(number(at, f["j"], g["j"]), number(at, g["j"], f["j"])))) \
                    if both_ways else F.transform(ok, lambda g: number(at, f["j"], g["j"]))
            return let(seconds, lambda kept: F.flatten(F.transform(kept if firsts is None else firsts, lambda f: with_first(f, kept))))
        holds = F.filter(v, lambda e: e["v"].bitwiseAND(r) == r)
        within = F.filter(v, lambda e: e["v"].bitwiseAND(q) == 0)
        covers = F.filter(v, lambda e: e["v"].bitwiseAND(q) == q)
        return F.concat(
            F.transform(F.filter(v, lambda e: e["v"] == r), lambda e: e["j"].cast("int")),
            F.transform(F.filter(v, lambda e: e["v"] == q), lambda e: (m + e["j"]).cast("int")),
            pairs(0, None, holds, lambda a, b: a.bitwiseAND(b) == r, True),
            pairs(1, None, within, lambda a, b: a.bitwiseOR(b) == r, True),
            pairs(2, covers, within, lambda a, b: a.bitwiseAND(F.bitwise_not(b)) == q, False),
            pairs(3, None, v, lambda a, b: a.bitwiseXOR(b) == q, True))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.size(found)) - 1
    return let(F.transform(F.sequence(F.lit(0), n - 1), word), lambda people: let(mask, lambda x: of_people(people, x)))


def _leaf_changes(views: Column, m: Column, statement: Column) -> Column:
    """The statement of one speaker with each of its leaves replaced, as ``_statement_changes``."""
    def changed(place, a):
        def truth(e, j):
            kept = let(a, lambda x: _leaf_word(x, e["w"]))
            return let(e["v"][j], lambda new: F.when(F.size(statement["args"]) == 1, _combined_word(statement["op"], new, new))
                       .when(place == 0, _combined_word(statement["op"], new, kept))
                       .otherwise(_combined_word(statement["op"], kept, new)))
        return _valid(views, F.sequence(F.lit(0), m - 1), truth, lambda j: place * m + j)
    # beside each leaf stands the one that stays: the other of two
    return F.flatten(F.transform(F.reverse(statement["args"]), lambda a, place: changed(place, a)))


def _new_statement(n: Column, p: Column, i: Column) -> Column:
    """Statement number ``i`` of speaker ``p``."""
    def build(m, pair):
        single = i < 2 * m
        op = F.when(single, F.floor(i / m)).otherwise(F.floor((i - 2 * m) / (m * (m - 1))) + 2).cast("int")
        j1 = F.when(single, F.pmod(i, m)).otherwise(F.floor(pair / (m - 1))).cast("int")
        first = let(j1, lambda j: _leaf(j, n, p))
        second = let(F.pmod(j1 + 1 + F.pmod(pair, m - 1), m), lambda j: _leaf(j, n, p))
        return F.struct(F.element_at(F.array(*[F.lit(o) for o in OPS]), op + 1).alias("op"),
                        F.when(single, F.array(first)).otherwise(F.array(first, second)).alias("args"))
    return let(2 * n - 1, lambda m: let(F.pmod(i - 2 * m, m * (m - 1)), lambda pair: build(m, pair)))


def _with_new_leaf(statement: Column, n: Column, p: Column, i: Column) -> Column:
    """``statement`` with change number ``i`` of one leaf."""
    m = 2 * n - 1
    args = F.transform(statement["args"], lambda a, place: F.when(
        place == F.floor(i / m), let(F.pmod(i, m), lambda j: _leaf(j, n, p))).otherwise(a))
    return F.struct(statement["op"].alias("op"), args.alias("args"))


def _statement_code(s: Column) -> Column:
    """A statement as a number; who is 127, nobody, where it is null."""
    def leaf(arg):
        return F.when(arg["lie"], 128).otherwise(0) + F.coalesce(arg["who"], F.lit(127))
    op = F.when(s["op"] == OPS[0], 0)
    for at, name in enumerate(OPS[1:-1], 1):
        op = op.when(s["op"] == name, at)
    second = F.coalesce(F.try_element_at(s["args"], F.lit(2)), s["args"][0])
    return op.otherwise(len(OPS) - 1) * 65536 + leaf(s["args"][0]) * 256 + leaf(second)


def _perturb_batches(puzzles: DataFrame, seed: int) -> DataFrame:
    """The rows of ``perturb`` for whole statements from Arrow batches."""
    k, n = F.col("k"), F.col("n")
    few = FEW

    @arrow_udf("array<struct<cand:int,bit:int>>")
    def first_change(starts: pa.Array, n: pa.Array, codes: pa.Array, solution: pa.Array) -> pa.Array:
        return first_changes(starts, n, codes, solution, few)
    start = F.concat(F.lit(f"{seed}:"), k.cast("string"), F.lit(":"))
    found = first_change(start, n, F.transform("statements", _statement_code), F.col("solution_bits").cast("int"))
    # a generator keeps its argument: a filter on the result would evaluate it twice
    changes = puzzles.select("k", "n", "statements", F.inline(found))
    m = 2 * n - 1
    each = 2 * m + 4 * m * (m - 1)
    p, i = F.floor(F.col("cand") / each).cast("int"), F.pmod(F.col("cand"), each)
    new = let(p, lambda p: let(i, lambda i: F.transform("statements", lambda s, q: F.when(q == p, _new_statement(n, q, i)).otherwise(s))))
    return changes.select("k", "cand", "n", new.alias("statements"), F.col("bit").alias("solution_bits"))


def perturb(puzzles: DataFrame, leaf: bool = False, seed: int = 1, batches: bool = False) -> DataFrame:
    """K3 (whole statement) / K4 (one leaf): of all changes whose statements differ and whose
    solution is unique and differs from the original, the one first in a seeded order.
    Puzzles without any such change, and those with nulls, get no row.

    With ``batches`` whole statements are tried in Arrow batches (perturbations.py), all puzzles of a
    size together, in Python workers: much faster.  Otherwise columns alone do it:

    One row in, one row out: the other speakers' words are ANDed once.  They mostly leave a handful
    of assignments, which give the words a new statement has to meet (``_few_changes``); only where
    they leave more than ``FEW`` is every statement tried on the words that have any left.  No
    shuffle; candidates with a valid solution alone get a draw."""
    if batches:
        if leaf:
            raise ValueError("changes of one leaf are tried in columns")
        return _with_roles(_perturb_batches(puzzles, seed))
    k, n, solution = F.col("k"), F.col("n"), F.col("solution_bits")

    prefix = F.concat(F.lit(f"{seed}:"), k.cast("string"), F.lit(":"))

    def valid(st, agrees, prefix):
        def of_speaker(statement, p):
            m = 2 * n - 1
            first = (p * (2 * m if leaf else 2 * m + 4 * m * (m - 1))).cast("int")

            def drawn(c):
                return let(first + c["i"], lambda cand: F.struct(F.substring(F.md5(F.concat(prefix, cand.cast("string"))), 1, 15).alias("d"),
                                                                 cand.alias("cand"), p.alias("p"), c["i"].alias("i"), c["bit"].alias("bit")))

            def tried(changes):
                return F.transform(F.filter(changes, lambda c: c["bit"] != solution), drawn)

            def first_of(e):  # a draw and a number each; what else there is to say follows for the first alone
                draws = F.transform(e["numbers"], lambda i: F.struct(
                    F.substring(F.md5(F.concat(prefix, (first + i).cast("string"))), 1, 15).alias("d"), i.alias("i")))
                return let(F.array_min(draws), lambda b: F.struct(b["d"].alias("d"), (first + b["i"]).alias("cand"), p.alias("p"),
                                                                  b["i"].alias("i"), e["bit"].alias("bit")))

            def few(found):
                return F.transform(F.filter(_few_changes(found, n, p, solution), lambda e: F.size(e["numbers"]) > 0), first_of)
            if leaf:
                return let(_views(agrees, n, p), lambda views: tried(_leaf_changes(views, m, statement)))
            left = F.aggregate(agrees_left(p), F.lit(0), lambda acc, o: acc + F.bit_count(o))
            views = F.transform(agrees_left(p), lambda o, w: F.struct(w.alias("w"), o.alias("o")))
            return let(left, lambda size: F.when(size <= FEW, let(_survivors(F.filter(views, lambda e: e["o"] != 0)), few)).otherwise(
                let(_views(agrees, n, p), lambda views: tried(_statement_changes(views, m)))))

        def agrees_left(p):
            return F.transform(word_indexes(n), lambda w: F.aggregate(
                F.filter(agrees, lambda a, q: q != p), _valid_word(n, w), lambda acc, a: acc.bitwiseAND(a[w])))
        return F.flatten(F.transform(st, of_speaker))

    def changed(st, best):
        def statement(s, q):
            return F.when(q == best["p"], _with_new_leaf(s, n, q, best["i"]) if leaf else _new_statement(n, q, best["i"])).otherwise(s)
        return F.struct(best["cand"].alias("cand"), n.alias("n"), F.transform(st, statement).alias("statements"),
                        best["bit"].alias("solution_bits"))

    def row(st):
        agreeing = F.transform(st, lambda s, q: F.transform(word_indexes(n), lambda w: F.bitwise_not(
            _statement_word(s, w).bitwiseXOR(_knight_word(q, w)))))
        best = F.array_min(let(agreeing, lambda agrees: let(prefix, lambda start: valid(st, agrees, start))))
        return F.transform(F.filter(F.array(best), lambda b: b.isNotNull()), lambda b: changed(st, b))

    # a generator keeps its argument: a filter on the result would evaluate it twice
    return _with_roles(puzzles.select("k", F.inline(let("statements", row))))


def _with_roles(changes: DataFrame) -> DataFrame:
    return changes.withColumn("solution", bits_to_roles("solution_bits", "n")).withColumn("n_solutions", F.lit(1))


# --- K9 / K10: wrong solutions and shuffled steps ------------------------------------

def flipped_solution(k, n, solution, seed: int = 2) -> Column:
    """K9: flip 1..n-1 entries chosen by a seeded order."""
    k, n, sol = as_col(k), as_col(n), as_col(solution)
    m = F.pmod(draw(k, 8000, seed), F.greatest(n - 1, F.lit(1))) + 1
    order = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct(draw(k, 8100 + p, seed).alias("h"), p.alias("p")))
    chosen = F.transform(F.slice(F.array_sort(order), 1, m.cast("int")), lambda e: e["p"])
    return F.transform(sol, lambda v, i: F.when(F.array_contains(chosen, i), ~v).otherwise(v))


def shuffled(arr, k, seed: int = 3) -> Column:
    """Seeded permutation of an array's items."""
    keyed = F.transform(as_col(arr), lambda x, i: F.struct(draw(as_col(k), 9100 + i, seed).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda e: e["x"])


# --- K7 / K8: reasoning steps ---------------------------------------------------------

def _role_mask(person: Column, value: Column, w: Column) -> Column:
    k = _knight_word(person, w)
    return F.when(value, k).otherwise(F.bitwise_not(k))


STEP_TYPE = ("array<struct<person:int,assignment:boolean,outcome:string,"
             "conflict_person:int,conflict_assignment:boolean>>")


def reasoning_steps(puzzles: DataFrame, dynamic_order: bool = True) -> DataFrame:
    """K7: steps that reach the (unique) solution.

    People are decided one at a time with the true roles of the people already
    decided fixed.  The order starts as 0..n-1; with ``dynamic_order`` the
    people mentioned in the claim of the person just decided move to the front
    of the remaining ones (as the reference's search does).  Knight is tried
    first: when the truth is knave, the knight assumption is reported as a
    conflict if some decided speaker's claim (true for a knight, false for a
    knave) has no extension of the partial assignment, naming the speaker with
    the smallest index; then the true role is assumed.  A wrong assumption
    without an immediate conflict is not shown (the reference backtracks to it
    later; this job does not replay the search), so traces equal the
    reference's whenever no backtracking is needed.
    Adds ``steps``: array<struct<person, assignment, outcome, conflict_person,
    conflict_assignment>>.
    """
    st, n, sol = F.col("statements"), F.col("n"), F.col("solution")

    def word_list(f):
        return F.transform(word_indexes(n), f)

    def steps_for(claims, p, before):
        """Steps for person ``p`` given the people ``before`` (already decided)."""
        truth = F.element_at(sol, p + 1)
        decided = F.sort_array(F.concat(before, F.array(p)))      # index order for the conflict search

        def conflict():
            """The first decided speaker whose claim has no extension when ``p`` is taken for a knight."""
            def ext_word(w):
                return F.aggregate(before, _knight_word(p, w).bitwiseAND(_valid_word(n, w)), lambda acc, q: acc.bitwiseAND(
                    _role_mask(q, F.element_at(sol, q + 1), w)))

            def broken(ext):
                def of_speaker(q):
                    val = (q == p) | F.element_at(sol, q + 1)
                    claim = F.element_at(claims, q + 1)
                    return ~F.exists(F.zip_with(claim, ext, lambda s, e: F.when(val, s).otherwise(F.bitwise_not(s)).bitwiseAND(e)),
                                     lambda x: x != 0)
                return F.try_element_at(F.filter(decided, of_speaker), F.lit(1))
            return let(word_list(ext_word), broken)

        def step(assignment, outcome, cq, cv):
            return F.struct(p.cast("int").alias("person"), assignment.alias("assignment"), F.lit(outcome).alias("outcome"),
                            cq.cast("int").alias("conflict_person"), cv.alias("conflict_assignment"))
        ok = step(truth, "ok", F.lit(None), F.lit(None).cast("boolean"))
        return let(F.when(~truth, conflict()), lambda q: F.when(q.isNotNull(), F.array(
            step(F.lit(True), "conflict", q, (q == p) | F.element_at(sol, q + 1)), ok)).otherwise(F.array(ok)))

    def advance(acc, j):
        order = acc["order"]
        p = F.element_at(order, j + 1)
        before = F.slice(order, 1, j)
        rest = F.slice(order, j + 2, n)
        if dynamic_order:
            mentioned = F.array_distinct(F.transform(F.element_at(st, p + 1)["args"], lambda x: x["who"]))
            front = F.filter(mentioned, lambda x: F.array_contains(rest, x))
            rest = F.concat(front, F.filter(rest, lambda x: ~F.array_contains(mentioned, x)))
        new_order = F.concat(F.slice(order, 1, j + 1), rest)
        return F.struct(new_order.alias("order"), F.concat(acc["steps"], steps_for(acc["claims"], p, before)).alias("steps"), acc["claims"].alias("claims"))
    claims = F.transform(st, lambda s: word_list(lambda w: _statement_word(s, w)))
    init = F.struct(F.sequence(F.lit(0), n - 1).alias("order"), F.array().cast(STEP_TYPE).alias("steps"), claims.alias("claims"))
    steps = F.aggregate(F.sequence(F.lit(0), n - 1), init, advance)["steps"]
    return puzzles.withColumn("steps", steps)


def render_steps(puzzles: DataFrame) -> DataFrame:
    """K8: ``cot_head``, ``cot_repeat_steps`` (one sentence per step, the claim
    repeated for assumptions) and ``cot_foot`` from rendered puzzles with steps."""
    names, kk = F.col("names"), F.col("knight_knave")

    def name(i):
        return F.element_at(names, i + 1)

    def role(v):
        return F.when(v, kk["a_knight"]).otherwise(kk["a_knave"])

    def leaf_text(arg, neg=False):
        return F.concat(name(arg["who"]), F.lit(" is not " if neg else " is "), role(~arg["lie"]))

    def claim(s):
        a1, a2 = s["args"][0], F.coalesce(F.try_element_at(s["args"], F.lit(2)), s["args"][0])
        return (F.when(s["op"] == "leaf", leaf_text(a1)).when(s["op"] == "not", leaf_text(a1, True))
                 .when(s["op"].isin("and", "or"), F.concat(leaf_text(a1), F.lit(" "), s["op"], F.lit(" "), leaf_text(a2)))
                 .when(s["op"] == "->", F.concat(F.lit("If "), leaf_text(a1), F.lit(" then "), leaf_text(a2)))
                 .otherwise(F.concat(leaf_text(a1), F.lit(" if and only if "), leaf_text(a2))))

    def sentence(t):
        own = F.element_at(F.col("statements"), t["person"] + 1)
        ok = F.concat(F.lit("Assume "), name(t["person"]), F.lit(" is "), role(t["assignment"]),
                      F.lit(". No contradiction is found in their "), F.when(t["assignment"], "").otherwise("false "),
                      F.lit("claim that "), claim(own), F.lit("."))
        whose = F.when(t["conflict_person"] == t["person"], F.lit("their own")).otherwise(name(t["conflict_person"]))
        bad = F.concat(name(t["person"]), F.lit(" cannot be "), role(t["assignment"]),
                       F.lit(", because this would contradict the "),
                       F.when(t["conflict_assignment"], "").otherwise("false "), F.lit("claim of "), whose, F.lit("."))
        return F.when(t["outcome"] == "ok", ok).otherwise(bad)
    return (puzzles.withColumn("cot_head", F.lit(PT.COT_HEAD))
                   .withColumn("cot_repeat_steps", F.transform("steps", sentence))
                   .withColumn("cot_foot", F.lit(PT.STEP_FOOTER_SUCCESS)))


def replace_one_step(puzzles: DataFrame, seed: int = 5, widest: int = 64) -> DataFrame:
    """Replace one step with a step of another puzzle, the partner's names mapped to ours by
    position; the first partner step (from a seeded start) that differs from ours is used.

    Partners are the next puzzles in a seeded order.  Round after round the puzzles that no
    partner so far could serve try further ones (1, 2, 4, ... up to ``widest`` a round), until
    every puzzle has a step or has tried all others.  Adds ``replaced_steps`` and
    ``replaced_at``; a puzzle that no other one can serve has no row.
    """
    from .index import sized, with_global_index
    base = puzzles.select("k", "n", "names", "cot_repeat_steps")
    ranked = with_global_index(base.withColumn("_h", seeded_draw("k", seed)), ["_h", "k"], "_i").drop("_h")
    total = ranked.count()
    at = F.pmod(draw(F.col("k"), 9300, seed), F.size("cot_repeat_steps")).cast("int")
    partner = ranked.select(F.col("_i").alias("_p"), F.col("names").alias("p_names"), F.col("cot_repeat_steps").alias("p_steps"))

    def mapped(text):
        # partner names -> placeholders -> our names (so swapped names do not collide)
        pairs = F.arrays_zip(F.col("p_names").alias("a"), F.col("names").alias("b"))
        holes = F.aggregate(F.transform(pairs, lambda e, i: F.struct(e["a"].alias("a"), i.alias("i"))), text,
                            lambda acc, e: F.when(e["a"].isNull(), acc).otherwise(F.regexp_replace(
                                acc, F.concat(F.lit("\\b"), e["a"], F.lit("\\b")),
                                F.concat(F.lit("\u0001"), e["i"].cast("string"), F.lit("\u0002")))))
        return F.aggregate(F.transform(pairs, lambda e, i: F.struct(e["b"].alias("b"), i.alias("i"))), holes,
                           lambda acc, e: F.replace(acc, F.concat(F.lit("\u0001"), e["i"].cast("string"), F.lit("\u0002")),
                                                    F.coalesce(e["b"], F.lit("someone"))))
    start = F.pmod(draw(F.col("k"), 9400, seed), F.size("p_steps")).cast("int")
    cands = F.transform(F.sequence(F.lit(0), F.size("p_steps") - 1), lambda o: mapped(
        F.element_at(F.col("p_steps"), F.pmod(start + o, F.size("p_steps")) + 1)))
    differing = F.try_element_at(F.filter(cands, lambda c: c != F.element_at(F.col("cot_repeat_steps"), F.col("_at") + 1)), F.lit(1))

    rounds, open_, first, width = [], ranked.withColumn("_at", at), 1, 1
    while first < total:
        last = min(first + width, total) - 1
        tried = (open_.withColumn("_o", F.explode(F.sequence(F.lit(first), F.lit(last))))
                 .withColumn("_p", F.pmod(F.col("_i") + F.col("_o"), F.lit(total))).join(partner, "_p"))
        found = tried.withColumn("_new", F.when(F.size("p_steps") > 0, differing)).filter(F.col("_new").isNotNull())
        if last > first:  # the nearest partner that serves
            found = found.groupBy("k").agg(F.min_by("_new", "_o").alias("_new"))
        found, _ = sized(found.select("k", "_new"))
        rounds.append(found)
        open_, _ = sized(open_.join(found.select("k"), "k", "left_anti"))
        if open_.isEmpty():
            break
        first, width = last + 1, min(2 * width, widest)
    if not rounds:
        return ranked.limit(0).select("k", at.alias("replaced_at"), F.col("cot_repeat_steps").alias("replaced_steps"))
    served = rounds[0]
    for found in rounds[1:]:
        served = served.unionByName(found)
    out = ranked.withColumn("replaced_at", at).join(served, "k").withColumn("replaced_steps", F.transform(
        "cot_repeat_steps", lambda s, i: F.when(i == F.col("replaced_at"), F.col("_new")).otherwise(s)))
    return out.select("k", "replaced_at", "replaced_steps")
