"""Dataset preparation (P1-P25): raw rows -> canonical nested records.

Canonical record columns: data_source, prompt (array<struct<role, content>>),
prompt_text (base-model prompts), ability, reward_model (struct), extra_info
(struct).  Everything is a projection, a filter, an ``explode`` or a grouped
aggregate; positional splits go through ``with_global_index``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.common import as_col, seeded_digits
from . import puzzle_text as PT
from .index import row_count, with_global_index
from .scoring import first_rows_per_key

MESSAGE = "struct<role:string,content:string>"


def chat(*messages: tuple[str, object]) -> Column:
    """array<struct<role, content>> from (role, content) pairs."""
    return F.array(*[F.struct(F.lit(r).alias("role"), as_col(c).cast("string").alias("content")) for r, c in messages])


def record(data_source, prompt=None, prompt_text=None, ability=None, ground_truth=None, style: str = "rule",
           split=None, index=None, extra: dict | None = None) -> list[Column]:
    """Canonical record columns (superset struct; absent fields are NULL)."""
    extra_fields = [as_col(split).cast("string").alias("split") if split is not None else F.lit(None).cast("string").alias("split"),
                    as_col(index).cast("long").alias("index") if index is not None else F.lit(None).cast("long").alias("index")]
    for k, v in (extra or {}).items():
        extra_fields.append(as_col(v).alias(k))
    return [
        as_col(data_source).cast("string").alias("data_source"),
        (prompt if prompt is not None else F.lit(None).cast(f"array<{MESSAGE}>")).alias("prompt"),
        (as_col(prompt_text) if prompt_text is not None else F.lit(None).cast("string")).alias("prompt_text"),
        as_col(ability).cast("string").alias("ability"),
        F.struct(F.lit(style).alias("style"), as_col(ground_truth).cast("string").alias("ground_truth")).alias("reward_model"),
        F.struct(*extra_fields).alias("extra_info"),
    ]


def math_qa_records(df: DataFrame, question: str, answer: str, split, index,
                    data_source: str = "openai/gsm8k") -> DataFrame:
    """Question + instruction as a user message; ground truth = the number
    after '####' without commas; a missing answer fails the job."""
    gt = T.strict_number(F.col(answer))
    gt = F.when(gt.isNull(), F.raise_error(F.lit("answer has no '#### number'"))).otherwise(
        F.replace(F.regexp_extract(F.col(answer), r"#### (\-?[0-9\.\,]+)", 1), F.lit(","), F.lit("")))
    content = F.concat(F.col(question), F.lit(" " + PT.GSM8K_INSTRUCTION))
    return df.select(*[c for c in df.columns if c not in (question, answer)],
                     *record(F.lit(data_source), chat(("user", content)), None, F.lit("math"), gt, "rule", split, index,
                             {"answer": F.col(answer), "question": F.col(question)}))


def boxed_records(df: DataFrame, problem: str, solution: str, split, index,
                  data_source: str = "lighteval/MATH") -> DataFrame:
    """Ground truth = inside of the last boxed answer of the solution."""
    gt = T.remove_boxed(T.last_boxed(F.col(solution)))
    content = F.concat(F.col(problem), F.lit(" " + PT.MATH_INSTRUCTION))
    return df.select(*[c for c in df.columns if c not in (problem, solution)],
                     *record(F.lit(data_source), chat(("user", content)), None, F.lit("math"), gt, "rule", split, index))


def positional_split(df: DataFrame, order_cols, sizes: list[tuple[str, object]], idx: str = "index",
                     require: bool = True) -> DataFrame:
    """Consecutive index ranges get the named splits in order; rows
    past the last range are dropped; too few rows fail when ``require``.

    A size is an int, a Column, or a function of the row count ``n`` (counted
    on the indexed, checkpointed frame, so the input is not computed again)."""
    ranked = with_global_index(df, order_cols, idx)
    n = row_count(ranked)
    start = F.lit(0)
    split = F.lit(None).cast("string")
    bounds = []
    for name, size in sizes:
        size = size(n) if callable(size) else size
        end = start + as_col(size)
        bounds.append((name, start, end))
        start = end
    for name, a, b in reversed(bounds):
        split = F.when((F.col(idx) >= a) & (F.col(idx) < b), F.lit(name)).otherwise(split)
    out = ranked.withColumn("split", split)
    if require:
        out = out.filter(F.assert_true(n >= start, F.lit("not enough rows for the requested splits")).isNull())
    return out.filter(F.col("split").isNotNull())


def puzzle_records(puzzles: DataFrame, split: str = "split", index: str = "index",
                   chat_template: bool = True) -> DataFrame:
    """System + user chat (or the base-model text prompt) with the puzzle
    truth (numbered solution text and statements) as ground truth."""
    base_text = F.replace(F.lit(PT.BASE_PROMPT), F.lit("{quiz}"), F.col("quiz"))
    prompt = chat(("system", F.lit(PT.INSTRUCT_PROMPT)), ("user", F.col("quiz"))) if chat_template else None
    out = puzzles.select(
        "k", *record(F.lit("kk_logic"), prompt, None if chat_template else base_text, F.lit("logic"),
                     F.col("solution_text_format"), "rule", F.col(split), F.col(index),
                     {"apply_chat_template": F.lit(chat_template)}),
        F.struct(F.col("solution_text_format"), F.col("statements_repr").alias("statements")).alias("ground_truth"))
    return out


def render_chat(messages, add_generation_prompt: bool = True) -> Column:
    """Chat list -> text with role markers (the common chat format)."""
    body = F.array_join(F.transform(as_col(messages), lambda m: F.concat(
        F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(body, F.lit("<|im_start|>assistant\n")) if add_generation_prompt else body


def text_to_chat(prompt) -> Column:
    """A plain string prompt -> a one-message user chat."""
    return chat(("user", prompt))


def preference_to_sft(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """One preference row -> two SFT rows (chosen, then rejected)."""
    ex = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col(chosen).alias("response")),
                           F.struct(F.lit(1).alias("kind"), F.col(rejected).alias("response"))))
    return df.select(*[c for c in df.columns if c not in (chosen, rejected)], ex.alias("_x")).select(
        "*", "_x.kind", "_x.response").drop("_x")


def fraction_split(df: DataFrame, order_cols, fraction: float, first: str = "train", rest: str = "test",
                   idx: str = "index") -> DataFrame:
    """The first round(fraction * n) rows by position, then the rest (one cut)."""
    ranked = with_global_index(df, order_cols, idx)
    cut = F.round(row_count(ranked) * fraction)
    return ranked.withColumn("split", F.when(F.col(idx) < cut, first).otherwise(rest))


def choice_text_clean(text) -> Column:
    """P9 text rule: strip, ' [title]' -> '. ', drop [..] spans, '  ' -> ' '."""
    x = T.py_strip(as_col(text))
    x = F.replace(x, F.lit(" [title]"), F.lit(". "))
    x = F.regexp_replace(x, r"\[.*?\]", "")
    return F.replace(x, F.lit("  "), F.lit(" "))


def py_capitalize(s) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower (Q21)."""
    s = as_col(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def multiple_choice_records(df: DataFrame, label: str, activity: str, ctx_a: str, ctx_b: str, endings: str,
                            split, index) -> DataFrame:
    """Query from activity + contexts, cleaned choices, integer gold; rows
    without a label are dropped."""
    kept = df.filter(F.length(F.col(label)) > 0)
    ctx = F.concat(F.col(ctx_a), F.lit(" "), py_capitalize(F.col(ctx_b)))
    query = choice_text_clean(F.concat(F.col(activity), F.lit(": "), ctx))
    choices = F.transform(F.col(endings), choice_text_clean)
    return kept.select("*", query.alias("query"), choices.alias("choices"),
                       F.col(label).cast("int").alias("gold"))


def first_n_per_group_concat(df: DataFrame, group: str, order: str, n: int, group_order: str | None = None) -> DataFrame:
    """P10: the first ``n`` rows of each group (file), concatenated in group order
    with a continuing position (skew-safe two-level top-n)."""
    firsts = first_rows_per_key(df, group, order, n)
    return with_global_index(firsts, [group_order or group, order], "index")


def rejection_sample(df: DataFrame, prompt: str, response: str, score: str, order: str,
                     threshold: float = 1.0, k: int = 2) -> DataFrame:
    """P22 (our rule): keep responses scoring >= threshold, distinct per prompt,
    the first ``k`` per prompt by ``order`` (skew-safe top-k)."""
    good = df.filter(F.col(score) >= threshold)
    distinct = good.groupBy(prompt, response).agg(F.min(order).alias(order))
    return first_rows_per_key(distinct, prompt, order, k)


def preference_pairs(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """Per group the best (highest score, then smallest id) and the worst
    (lowest score, then smallest id) item; groups where they tie are dropped.
    One partial aggregate per group, so a hot group costs nothing extra."""
    best = F.max_by(F.col(item), F.struct(F.col(score), -F.col(item)))
    worst = F.min_by(F.col(item), F.struct(F.col(score), F.col(item)))
    agg = df.groupBy(group).agg(best.alias("chosen"), worst.alias("rejected"),
                                F.max(score).alias("chosen_score"), F.min(score).alias("rejected_score"))
    return agg.filter(F.col("chosen_score") > F.col("rejected_score"))


def switch_chat_template(messages, response_text, eos_text: str) -> Column:
    """Drop the eos text from a decoded response, append it as the
    assistant message and render the whole chat again (no generation cue)."""
    clean = F.replace(as_col(response_text), F.lit(eos_text), F.lit(""))
    full = F.concat(as_col(messages), F.array(F.struct(F.lit("assistant").alias("role"), clean.alias("content"))))
    return render_chat(full, add_generation_prompt=False)


def eval_prompt(quiz, cot: bool, one_shot: bool, no_linebreak: bool = False) -> Column:
    """Instruction (+ 1-shot demonstration) + question + answer cue."""
    head = PT.SYSTEM_INSTRUCTION if cot else PT.SYSTEM_INSTRUCTION_NO_REASON
    if one_shot:
        head += "\n\n" + (PT.DEMONSTRATION_2CHAR if cot else PT.DEMONSTRATION_2CHAR_NO_REASON)
    cue = "### Answer: Let's think step by step" if cot else ("### Answer:" if no_linebreak else "### Answer:\n")
    return F.concat(F.lit(head + "\n\n### Question: "), as_col(quiz), F.lit("\n" + cue))


def prompt_for_mode(mode: str, quiz, prompt) -> Column:
    """Normal -> chat template around the full prompt; zero -> the
    hard-coded system template around the quiz; zero-auto-template -> chat
    template around the quiz."""
    def fill(tmpl, x):
        return F.replace(F.lit(tmpl), F.lit("{prompt}"), as_col(x))
    if mode.startswith("normal"):
        return fill(PT.NORMAL_TEMPLATE, prompt)
    if mode.startswith("zero-auto-template"):
        return fill(PT.NORMAL_TEMPLATE, quiz)
    if mode.startswith("zero"):
        return fill(PT.ZERO_TEMPLATE, quiz)
    raise NotImplementedError(mode)


def finetune_text_direct(quiz, solution_text_format, eos: str = "") -> Column:
    """Instruction + question + conclusion, no reasoning."""
    return F.concat(F.lit(PT.SYSTEM_INSTRUCTION_NO_REASON + "\n\n### Question: "), as_col(quiz),
                    F.lit("\n### Answer:\nCONCLUSION:\n"), as_col(solution_text_format), F.lit(eos))


def finetune_text_cot(quiz, steps, foot, solution_text_format, eos: str = "") -> Column:
    """Instruction + question + reasoning steps joined by spaces + conclusion."""
    return F.concat(F.lit(PT.SYSTEM_INSTRUCTION + "\n\n### Question: "), as_col(quiz),
                    F.lit("\n### Answer: " + PT.COT_HEAD + " "), F.array_join(as_col(steps), " "), F.lit(" "),
                    as_col(foot), F.lit("\nCONCLUSION:\n"), as_col(solution_text_format), F.lit(eos))


def probe_statements(puzzles: DataFrame, seed: int = 4) -> DataFrame:
    """P25: two seeded people per puzzle; for each a correct and a wrong claim."""
    order = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                        lambda p: F.struct(seeded_digits(F.col("k"), seed, 9500 + p).alias("h"), p.alias("p")))
    chosen = F.transform(F.slice(F.sort_array(order), 1, 2), lambda e: e["p"])
    ex = puzzles.select("k", "quiz", "names", "solution", F.explode(chosen).alias("p"))
    name = F.element_at(F.col("names"), F.col("p") + 1)
    is_knight = F.element_at(F.col("solution"), F.col("p") + 1)
    role = F.when(is_knight, "knight").otherwise("knave")
    wrong = F.when(is_knight, "knave").otherwise("knight")
    return ex.select("k", name.alias("name"),
                     F.concat(F.col("quiz"), F.lit(" "), name, F.lit(" is "), role, F.lit(".")).alias("statement_correct"),
                     F.concat(F.col("quiz"), F.lit(" "), name, F.lit(" is "), wrong, F.lit(".")).alias("statement_wrong"))
