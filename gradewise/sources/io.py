"""Sources and sinks.

Everything is ``spark.read`` / ``df.write``.  Output locations default to a
fresh folder under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/gradewise-out/{name}-{uuid.uuid4().hex}"


# --- S1-S5 ---------------------------------------------------------------------------------

def read_parquet_files(spark: SparkSession, paths: list[str], order_col: str = "file_order") -> DataFrame:
    """Read many parquet files as one table; ``file_order`` is the position
    of the row's file in ``paths`` (concatenation order)."""
    # one scan per path: the path itself says which rows are its own
    parts = [spark.read.parquet(p).withColumn(order_col, F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


DIALOGUE = "array<struct<from:string,value:string,ground_truth:struct<value:string>>>"


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """S3: one JSON array of turns per line -> (prompt = item[0].value,
    answer = item[1].ground_truth.value)."""
    t = spark.read.text(path).select(F.from_json("value", DIALOGUE).alias("d"))
    return t.select(F.col("d")[0]["value"].alias("prompt"), F.try_element_at("d", F.lit(2))["ground_truth"]["value"].alias("answer"))


def write_parquet_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One parquet folder per split value."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines."""
    df.write.mode(mode).json(path)


# --- S7 / S8: resumable work ------------------------------------------------------------------

def resumable_write(df: DataFrame, path: str, idx_col: str, batch_size: int) -> DataFrame:
    """batch_id = idx div batch_size; batches finished under ``path`` are
    skipped, the rest is appended.  Returns the rows written by this call.

    ``path/rows`` holds the rows with their batch and run, in files of any size,
    and ``path/finished`` one small row per finished batch and run, written after
    the rows: a run that dies before that leaves rows which no reader counts.
    """
    spark = df.sparkSession
    todo = df.withColumn("batch_id", F.floor(F.col(idx_col) / batch_size).cast("long"))
    if _exists(spark, f"{path}/finished"):
        todo = todo.join(spark.read.parquet(f"{path}/finished").select("batch_id").distinct(), "batch_id", "left_anti")
    run = uuid.uuid4().hex
    todo.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("run") == run)
    rows.select("run", "batch_id").distinct().write.mode("append").parquet(f"{path}/finished")
    return rows.drop("run")


def read_resumable(spark: SparkSession, path: str) -> DataFrame:
    """The rows of finished batches."""
    finished = spark.read.parquet(f"{path}/finished")
    return spark.read.parquet(f"{path}/rows").join(finished, ["run", "batch_id"], "left_semi").drop("run")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, by the file system of its path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def resume_results(existing: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Keep stored results, evaluate only rows without one, and union."""
    todo = candidates.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(todo, allowMissingColumns=True)


# --- S9-S13 -------------------------------------------------------------------------------------

def append_log(df: DataFrame, path: str, partition_col: str | None = None, fmt: str = "json") -> None:
    """Append rows to a log.  Steps stay a column: a folder per step would grow with
    the data; ``partition_col`` is for columns of few values, such as a day."""
    writer = df.write.mode("append").format(fmt)
    (writer.partitionBy(partition_col) if partition_col else writer).save(path)


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested struct fields -> top-level columns named ``a/b/c``."""
    cols: list[Column] = []

    def walk(dtype, prefix, ref):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f.dataType, prefix + [f.name], ref[f.name] if ref is not None else F.col(f.name))
        else:
            cols.append(ref.alias(sep.join(prefix)))
    for f in df.schema.fields:
        walk(f.dataType, [f.name], F.col(f.name))
    return df.select(*cols)


def metric_lines(long_metrics: DataFrame, step: str = "step", metric: str = "metric", value: str = "value") -> DataFrame:
    """Render (step, metric, value) rows as log lines ``step:N - k:v - ...``."""
    kv = F.concat(F.col(metric), F.lit(":"), F.col(value).cast("string"))
    g = long_metrics.groupBy(step).agg(F.array_join(F.array_sort(F.collect_list(kv)), " - ").alias("_kv"))
    return g.select(F.concat(F.lit("step:"), F.col(step).cast("string"), F.lit(" - "), F.col("_kv")).alias("value"))


def parse_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines back into (step, metric, value)."""
    t = spark.read.text(path)
    parts = F.split(F.col("value"), " - ")
    step = F.element_at(F.split(F.element_at(parts, 1), ":"), 2).try_cast("long")
    kv = F.explode(F.slice(parts, F.lit(2), F.size(parts)))
    x = t.select(step.alias("step"), kv.alias("kv"))
    return x.select("step", F.substring_index("kv", ":", 1).alias("metric"),
                    F.substring_index("kv", ":", -1).try_cast("double").alias("value"))


def best_value_check(parsed: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Best value of a metric over steps and whether it passes a threshold."""
    best = parsed.filter(F.col("metric") == metric).agg(F.max("value").alias("best"))
    return best.withColumn("passed", F.col("best") > threshold)


def save_batch(df: DataFrame, path: str) -> None:
    """Persist a batch (parquet, not pickle)."""
    df.write.mode("overwrite").parquet(path)


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
