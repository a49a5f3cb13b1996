"""Dataset-preparation queries (P1-P25, J4, J5) over lineitem, part, conversations,
documents and the generated puzzle corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import tokenize
from ..operators import prep as P
from ..operators import puzzle_text as PT
from ..operators import puzzles as K
from ..operators.index import with_global_index
from ..session import table
from .puzzles import _RENDER_SQL, _draw, corpus, generated, rendered, restored, unique
from .registry import register
from .scoring import _BOXED_SQL, _PUZZLE_SQL, boxed_responses
from .tokens import ids_sql


def q(v: str) -> str:
    """SQL string literal (DuckDB keeps backslashes and newlines as written)."""
    return "'" + v.replace("'", "''") + "'"


# --- P1 / P2 / P18 / P21: math word problems from lineitem --------------------------------

def math_questions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    x = F.floor("l_extendedprice")
    q_ = F.floor("l_quantity").cast("string")
    question = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" line "),
                        F.col("l_linenumber").cast("string"), F.lit(" ships "), q_, F.lit(" units. What do they cost?"))
    answer = F.concat(F.lit("Multiply the units by the price. #### "), F.format_number(x, 0))
    return li.select("l_orderkey", "l_linenumber", question.alias("question"), answer.alias("answer"))


def math_records(spark, sf):
    # (l_orderkey, l_linenumber) repeats in this table: order by every column the record uses
    m = with_global_index(math_questions(spark, sf), ["l_orderkey", "l_linenumber", "question", "answer"], "_idx")
    return P.math_qa_records(m, "question", "answer", F.lit("train"), F.col("_idx")).drop("_idx")


_MATH_Q_SQL = """
WITH m AS (
  SELECT l_orderkey, l_linenumber,
         'Order ' || l_orderkey || ' line ' || l_linenumber || ' ships ' || CAST(floor(l_quantity) AS BIGINT) || ' units. What do they cost?' AS question,
         'Multiply the units by the price. #### ' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) AS answer,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, question, answer) - 1 AS idx
  FROM lineitem)
"""


@register("P1", _MATH_Q_SQL + f"""
SELECT l_orderkey, l_linenumber, 'openai/gsm8k' AS data_source, 'user' AS role,
       question || ' ' || {q(PT.GSM8K_INSTRUCTION)} AS content, 'math' AS ability, 'rule' AS style,
       replace(split_part(answer, '#### ', 2), ',', '') AS ground_truth, 'train' AS split, idx AS index
FROM m""")
def p1_canonical_record(spark, sf):
    r = math_records(spark, sf)
    return r.select("l_orderkey", "l_linenumber", "data_source", F.col("prompt")[0]["role"].alias("role"),
                    F.col("prompt")[0]["content"].alias("content"), "ability", "reward_model.style",
                    "reward_model.ground_truth", "extra_info.split", "extra_info.index")


@register("P2", _MATH_Q_SQL + """
SELECT l_orderkey, l_linenumber, replace(split_part(answer, '#### ', 2), ',', '') AS ground_truth FROM m""")
def p2_math_prep(spark, sf):
    r = math_records(spark, sf)
    return r.select("l_orderkey", "l_linenumber", "reward_model.ground_truth")


@register("P18", _MATH_Q_SQL + "SELECT l_orderkey, l_linenumber, question, answer, question || ' ' || "
          + q(PT.GSM8K_INSTRUCTION) + " AS first_content FROM m")
def p18_nested_keys(spark, sf):
    r = math_records(spark, sf)
    return r.select("l_orderkey", "l_linenumber", F.col("extra_info").getField("question").alias("question"),
                    F.col("extra_info").getField("answer").alias("answer"),
                    F.col("prompt").getItem(0).getField("content").alias("first_content"))


@register("P21", _MATH_Q_SQL + "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 ELSE idx END AS index FROM m")
def p21_index_default(spark, sf):
    """Rows whose extra_info is missing (here: first lines) get index 0."""
    r = math_records(spark, sf)
    r = r.withColumn("extra_info", F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("extra_info")))
    return r.select("l_orderkey", "l_linenumber", F.coalesce(F.col("extra_info.index"), F.lit(0)).cast("long").alias("index"))


# --- P3: boxed-answer problems from part -----------------------------------------------------

@register("P3", _BOXED_SQL + f"""
SELECT p_partkey, 'Simplify item ' || p_partkey || '. ' || {q(PT.MATH_INSTRUCTION)} AS content,
       CASE WHEN starts_with(boxed, '\\boxed ') THEN substr(boxed, 8)
            WHEN starts_with(boxed, '\\boxed{{') AND ends_with(boxed, '}}') THEN substr(boxed, 8, length(boxed) - 8) END AS ground_truth
FROM b""")
def p3_boxed_prep(spark, sf):
    b = boxed_responses(spark, sf).select(
        "p_partkey", F.concat(F.lit("Simplify item "), F.col("p_partkey").cast("string"), F.lit(".")).alias("problem"),
        F.col("response").alias("solution"))
    r = P.boxed_records(b, "problem", "solution", F.lit("train"), F.col("p_partkey"))
    return r.select("p_partkey", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth")


# --- P4 / P11 / P13 / P15 / P16 / P20 / P25 on the puzzle corpus --------------------------------

def _split_corpus(spark, sf):
    """Puzzles are numbered and split before their texts are rendered."""
    c = P.positional_split(unique(spark, sf), "k", [("train", lambda n: (n * 0.9).cast("long")),
                                                       ("test", lambda n: n - (n * 0.9).cast("long"))])
    return rendered(restored(c))


_P4_SQL = "WITH " + _RENDER_SQL + """,
sp AS (SELECT fin.*, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS total FROM fin)
"""


@register("P4", _P4_SQL + f"""
SELECT k, CASE WHEN idx < CAST(floor(total * 0.9) AS BIGINT) THEN 'train' ELSE 'test' END AS split, idx AS index,
       '<|im_start|>system' || chr(10) || {q(PT.INSTRUCT_PROMPT)} || '<|im_end|>' || chr(10)
       || '<|im_start|>user' || chr(10) || quiz || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt_text,
       solution_text_format AS ground_truth
FROM sp""")
def p4_puzzle_prep(spark, sf):
    r = P.puzzle_records(_split_corpus(spark, sf))
    return r.select("k", "extra_info.split", "extra_info.index", P.render_chat("prompt").alias("prompt_text"),
                    F.col("ground_truth.solution_text_format").alias("ground_truth"))


@register("P4_base", _P4_SQL + f"""
SELECT k, replace({q(PT.BASE_PROMPT)}, '{{quiz}}', quiz) AS prompt_text FROM sp""")
def p4_puzzle_prep_base(spark, sf):
    r = P.puzzle_records(_split_corpus(spark, sf), chat_template=False)
    return r.select("k", "prompt_text")


@register("P11", _P4_SQL + """
SELECT k, CASE WHEN idx < total // 10 THEN 'test' WHEN idx < total // 10 + (total * 8) // 10 THEN 'train' ELSE 'val' END AS split
FROM sp""")
def p11_range_split(spark, sf):
    c = unique(spark, sf).select("k")
    out = P.positional_split(c, "k", [("test", lambda n: (n / 10).cast("long")),
                                      ("train", lambda n: (n * 8 / 10).cast("long")),
                                      ("val", lambda n: n - (n / 10).cast("long") - (n * 8 / 10).cast("long"))])
    return out.select("k", "split")


@register("P13", _P4_SQL + f"""
SELECT k, {q(PT.SYSTEM_INSTRUCTION_NO_REASON + chr(10) + chr(10) + "### Question: ")} || quiz
          || {q(chr(10) + "### Answer:" + chr(10) + "CONCLUSION:" + chr(10))} || solution_text_format || '</s>' AS text
FROM sp""")
def p13_finetune_direct(spark, sf):
    c = corpus(spark, sf)
    return c.select("k", P.finetune_text_direct("quiz", "solution_text_format", "</s>").alias("text"))


def _eval_sql(cot: bool, one_shot: bool, no_lb: bool = False) -> str:
    head = PT.SYSTEM_INSTRUCTION if cot else PT.SYSTEM_INSTRUCTION_NO_REASON
    if one_shot:
        head += "\n\n" + (PT.DEMONSTRATION_2CHAR if cot else PT.DEMONSTRATION_2CHAR_NO_REASON)
    cue = "### Answer: Let's think step by step" if cot else ("### Answer:" if no_lb else "### Answer:\n")
    return f"{q(head + chr(10) + chr(10) + '### Question: ')} || quiz || {q(chr(10) + cue)}"


@register("P15", _P4_SQL + f"""
SELECT k, 'cot_1shot' AS variant, {_eval_sql(True, True)} AS prompt FROM sp
UNION ALL SELECT k, 'direct_0shot', {_eval_sql(False, False)} FROM sp
UNION ALL SELECT k, 'direct_nolb', {_eval_sql(False, False, True)} FROM sp""")
def p15_eval_prompts(spark, sf):
    c = corpus(spark, sf).select("k", "quiz")
    a = c.select("k", F.lit("cot_1shot").alias("variant"), P.eval_prompt("quiz", True, True).alias("prompt"))
    b = c.select("k", F.lit("direct_0shot").alias("variant"), P.eval_prompt("quiz", False, False).alias("prompt"))
    d = c.select("k", F.lit("direct_nolb").alias("variant"), P.eval_prompt("quiz", False, False, True).alias("prompt"))
    return a.unionByName(b).unionByName(d)


@register("P16", _P4_SQL + f"""
SELECT k, 'normal' AS mode, replace({q(PT.NORMAL_TEMPLATE)}, '{{prompt}}', {_eval_sql(True, False)}) AS prompt FROM sp
UNION ALL SELECT k, 'zero', replace({q(PT.ZERO_TEMPLATE)}, '{{prompt}}', quiz) FROM sp
UNION ALL SELECT k, 'zero-auto-template', replace({q(PT.NORMAL_TEMPLATE)}, '{{prompt}}', quiz) FROM sp""")
def p16_prompt_modes(spark, sf):
    c = corpus(spark, sf).select("k", "quiz").withColumn("p", P.eval_prompt("quiz", True, False))
    parts = [c.select("k", F.lit(m).alias("mode"), P.prompt_for_mode(m, "quiz", "p").alias("prompt"))
             for m in ("normal", "zero", "zero-auto-template")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("P20", _P4_SQL + f"""
SELECT k FROM sp WHERE len({ids_sql("quiz")}) <= 120""")
def p20_length_filter(spark, sf):
    c = corpus(spark, sf)
    # a generator keeps its argument: a filter would render the puzzle again for every use of its parts
    return c.select(F.explode(F.filter(F.array("k"), lambda k: F.size(tokenize("quiz", "codepoint")) <= 120)).alias("k"))


@register("P25", _P4_SQL + f""",
pz AS (SELECT k, quiz, names, res.solution_bits, res.n FROM sp JOIN res USING (k)),
ch AS (SELECT *, list_transform(list_sort(list_transform(range(n), lambda p: {{'h': {_draw('k', '9500 + p', 4)}, 'p': p}})),
                              lambda e: e.p)[1:2] AS chosen FROM pz),
ex AS (SELECT k, quiz, names, solution_bits, unnest(chosen) AS p FROM ch)
SELECT k, names[p + 1] AS name,
       quiz || ' ' || names[p + 1] || ' is ' || CASE WHEN ((solution_bits >> p) & 1) = 1 THEN 'knight' ELSE 'knave' END || '.' AS statement_correct,
       quiz || ' ' || names[p + 1] || ' is ' || CASE WHEN ((solution_bits >> p) & 1) = 1 THEN 'knave' ELSE 'knight' END || '.' AS statement_wrong
FROM ex""")
def p25_probes(spark, sf):
    return P.probe_statements(corpus(spark, sf))


# --- P5 / P6 / P7 / P8 / P17 / P19 / P24 on conversations ----------------------------------------

_PAIRS = """
up AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS response
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
pref AS (
  SELECT x.conv_id, x.turn, x.prompt, x.response AS chosen, y.response AS rejected
  FROM up x JOIN up y ON y.conv_id = x.conv_id AND y.turn = x.turn + 2)
"""


def _pairs(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("response"))
    return u.join(a, ["conv_id", "turn"])


def _preferences(spark, sf):
    """Preference rows: a user turn, its reply (chosen) and the reply two turns later (rejected)."""
    x = _pairs(spark, sf)
    y = x.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("response").alias("rejected"))
    return x.withColumnRenamed("response", "chosen").join(y, ["conv_id", "turn"])


@register("P5", "WITH " + _PAIRS + f""",
d AS (SELECT conv_id, turn, prompt, response, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM up)
SELECT conv_id, turn, CASE WHEN idx < 500 THEN 'train' ELSE 'test' END AS split,
       replace({q(PT.ORZ_BASE_PROMPT.replace('{{}}', '{}'))}, '{{prompt}}', prompt) AS prompt_text, response AS ground_truth
FROM d""")
def p5_open_math(spark, sf):
    d = with_global_index(_pairs(spark, sf), ["conv_id", "turn"], "idx")
    text = F.replace(F.lit(PT.ORZ_BASE_PROMPT.replace("{{}}", "{}")), F.lit("{prompt}"), F.col("prompt"))
    r = d.select("conv_id", "turn", *P.record(F.lit("orz"), None, text, F.lit("logic"), F.col("response"), "rule",
                                              F.when(F.col("idx") < 500, "train").otherwise("test"), F.col("idx")))
    return r.select("conv_id", "turn", "extra_info.split", "prompt_text", F.col("reward_model.ground_truth").alias("ground_truth"))


@register("P6", "WITH " + _PAIRS + """
SELECT conv_id, turn, 0 AS kind, prompt, chosen AS response FROM pref
UNION ALL SELECT conv_id, turn, 1, prompt, rejected FROM pref""")
def p6_preference_to_sft(spark, sf):
    return P.preference_to_sft(_preferences(spark, sf), "prompt", "chosen", "rejected")


@register("P7", "WITH " + _PAIRS + """,
r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx, count(*) OVER () AS n FROM pref)
SELECT conv_id, turn, CASE WHEN idx < round(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM r""")
def p7_rm_split(spark, sf):
    r = P.fraction_split(_preferences(spark, sf), ["conv_id", "turn"], 0.75)
    return r.select("conv_id", "turn", "split")


@register("P8", "WITH " + _PAIRS + """,
r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM pref)
SELECT conv_id, turn, 'Dahoas/full-hh-rlhf' AS data_source, prompt AS content, 'alignment' AS ability, 'model' AS style,
       chosen AS ground_truth, idx AS index FROM r""")
def p8_rl_prompts(spark, sf):
    d = with_global_index(_preferences(spark, sf), ["conv_id", "turn"], "idx")
    r = d.select("conv_id", "turn", *P.record(F.lit("Dahoas/full-hh-rlhf"), P.chat(("user", F.col("prompt"))), None,
                                              F.lit("alignment"), F.col("chosen"), "model", F.lit("train"), F.col("idx")))
    return r.select("conv_id", "turn", "data_source", F.col("prompt")[0]["content"].alias("content"), "ability",
                    "reward_model.style", "reward_model.ground_truth", "extra_info.index")


_CHAT_SQL = """
WITH c AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS body
           FROM conversations GROUP BY conv_id)
"""


#: Turns of a chat; more fit no context.
MAX_TURNS = 10_000


def conversation_chats(spark, sf):
    """One chat per conversation (turns in order).  A chat is bounded by the model's context
    length; turns are counted before any is collected, and a longer one raises."""
    c = table(spark, sf, "conversations")
    longest = c.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    if longest > MAX_TURNS:
        raise ValueError(f"a conversation has {longest} turns, a chat at most {MAX_TURNS}")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return g.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


@register("P17", _CHAT_SQL + "SELECT conv_id, body || '<|im_start|>assistant' || chr(10) AS text FROM c")
def p17_render_chat(spark, sf):
    return conversation_chats(spark, sf).select("conv_id", P.render_chat("messages").alias("text"))


@register("P19", "SELECT doc_id, '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS text FROM documents")
def p19_string_to_chat(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", P.render_chat(P.text_to_chat(F.col("text"))).alias("text"))


@register("P24", "WITH " + _PAIRS + """
SELECT conv_id, turn, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10)
       || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' || chr(10) AS text
FROM up""")
def p24_switch_template(spark, sf):
    """Decoded responses carry an eos text ('<|endoftext|>', this fixture's choice) that is dropped."""
    p = _pairs(spark, sf)
    decoded = F.concat(F.col("response"), F.lit("<|endoftext|>"))
    return p.select("conv_id", "turn", P.switch_chat_template(P.chat(("user", F.col("prompt"))), decoded, "<|endoftext|>").alias("text"))


# --- P9 / P10 on documents -----------------------------------------------------------------------

def _mc_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    lines = F.split(F.col("text"), "\n")
    return d.select("doc_id", F.col("source").alias("activity_label"),
                    F.try_element_at(lines, F.lit(1)).alias("ctx_a"),
                    F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")).alias("ctx_b"),
                    F.slice(lines, F.lit(3), F.size(lines)).alias("endings"),
                    F.when(F.size(lines) < 2, F.lit("")).otherwise((F.size(lines) % 4).cast("string")).alias("label"))


def _clean_sql(x: str) -> str:
    s = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    s = f"replace({s}, ' [title]', '. ')"
    s = f"regexp_replace({s}, '\\[.*?\\]', '', 'g')"
    return f"replace({s}, '  ', ' ')"


@register("P9", f"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
r AS (SELECT doc_id, source, lines[1] AS ctx_a, coalesce(lines[2], '') AS ctx_b, lines[3:] AS endings,
             CASE WHEN len(lines) < 2 THEN '' ELSE CAST(len(lines) % 4 AS VARCHAR) END AS label FROM d)
SELECT doc_id, {_clean_sql("source || ': ' || ctx_a || ' ' || upper(substr(ctx_b, 1, 1)) || lower(substr(ctx_b, 2))")} AS query,
       array_to_string(list_transform(endings, lambda e: {_clean_sql('e')}), '|') AS choices, CAST(label AS INT) AS gold
FROM r WHERE length(label) > 0""")
def p9_multiple_choice(spark, sf):
    r = P.multiple_choice_records(_mc_rows(spark, sf), "label", "activity_label", "ctx_a", "ctx_b", "endings", None, None)
    return r.select("doc_id", "query", F.array_join("choices", "|").alias("choices"), "gold")


@register("P10", """
WITH f AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents)
SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS index FROM f WHERE rk <= 10""")
def p10_combine_files(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id")
    return P.first_n_per_group_concat(d, "source", "doc_id", 10).select("source", "doc_id", "index")


# --- P22 / P23 on scored puzzle responses ---------------------------------------------------------

def _scored_responses(spark, sf):
    from ..operators import scoring as S
    from .scoring import puzzle_responses
    r = S.puzzle_scores(puzzle_responses(spark, sf), "pure")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return r.join(o, "o_orderkey").select("o_custkey", "o_orderkey", "response", "score")


_SCORED_SQL = _PUZZLE_SQL + """,
sc AS (SELECT a7.o_orderkey, o.o_custkey, a7.response, CASE WHEN has_answer AND match THEN 1.0 ELSE 0.0 END AS score
       FROM a7 JOIN orders o USING (o_orderkey))
"""


@register("P22", _SCORED_SQL + """,
d AS (SELECT o_custkey, response, min(o_orderkey) AS o_orderkey FROM sc WHERE score >= 1 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rk FROM d)
SELECT o_custkey, o_orderkey FROM r WHERE rk <= 2""")
def p22_rejection_sampling(spark, sf):
    """Correct, distinct responses, first two per customer (prompt)."""
    r = P.rejection_sample(_scored_responses(spark, sf), "o_custkey", "response", "score", "o_orderkey")
    return r.select("o_custkey", "o_orderkey")


@register("P23", _SCORED_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS rb,
             row_number() OVER (PARTITION BY o_custkey ORDER BY score ASC, o_orderkey) AS rw FROM sc)
SELECT o_custkey, max(CASE WHEN rb = 1 THEN o_orderkey END) AS chosen, max(CASE WHEN rw = 1 THEN o_orderkey END) AS rejected,
       CAST(max(score) AS DOUBLE) AS chosen_score, CAST(min(score) AS DOUBLE) AS rejected_score
FROM r GROUP BY o_custkey HAVING max(score) > min(score)""")
def p23_preference_pairs(spark, sf):
    """Best vs worst response per customer, ties dropped."""
    r = _scored_responses(spark, sf)
    return P.preference_pairs(r, "o_custkey", "o_orderkey", "score")


# --- J4 / J5: anti-join with finished work, clean <-> perturbed join --------------------------------

@register("J4", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j4_anti_join(spark, sf):
    """Work left to do: documents without a stored result (labels act as finished results)."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@register("J5")
def j5_clean_perturbed(spark, sf):
    """Clean puzzle joined with its perturbed version by key; missing perturbations dropped
    (oracle in perturb_checks)."""
    g = generated(spark, sf)
    p = K.perturb(g, batches=True).select("k", F.col("solution_bits").alias("perturbed_bits"))
    return g.select("k", "n", "solution_bits").join(p, "k")
