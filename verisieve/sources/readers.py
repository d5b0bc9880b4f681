"""Readers of samples, scores and generations as typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verisieve.functions import arrays as A
from verisieve.functions import text as X
from verisieve.operators import generations as gen
from verisieve.operators import relational as rel

SAMPLE = "id string, question string, ground_truth string, greedy_prediction string, candidate_list array<string>, candidate_pool array<string>, gt_aliases array<string>, open_text_label boolean, category string, c_metric double"
RECORD = "id string, candidate string, sum_logprob double, n_answer_tokens int, s_ext double, is_gt boolean, is_greedy boolean"


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def read_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """A headed CSV whose fields may hold quotes; all columns are text. Fields with line breaks make a
    file one task; without them (``line_breaks`` false) large files are split."""
    return spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)


def in_file_order(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows that are read from text files with columns that rise with their place in these: the
    file, the start of the split, and the row's number, which rises inside a split."""
    at = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")).withColumn("_n", F.monotonically_increasing_id())
    return at, ["_f", "_b", "_n"]


def in_row_order(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows that are read from Parquet files with columns that tell their place: the file, the row's
    number in it. However files are split and whichever task reads them, these stay the same."""
    return rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_n")), ["_f", "_n"]


def parse_samples(raw: DataFrame, id: str = "id", question: str = "question", truth: str = "ground_truth", answer: str = "low_t_generation", candidates: str = "candidates", verdict: str = "LLM_verdict") -> DataFrame:
    """Rows of text fields as samples; candidates that repeat the truth or each other (normalised) leave the pool."""
    require_columns(raw, [id, question, truth, answer, candidates, verdict])
    optional = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    said = F.transform(F.coalesce(X.list_literal(F.col(candidates)), F.array().cast("array<string>")), lambda c: X.norm_quotes(F.regexp_replace(c, r"^\s+|\s+$", "")))
    gt = X.norm_quotes(X.first_of_list(F.col(truth)))
    rows = raw.select("*", said.alias("_c"), gt.alias("_gt"))
    pool = F.aggregate(F.col("_c"), F.array("_gt"), lambda seen, c: F.when(F.exists(seen, lambda s: X.norm(s) == X.norm(c)), seen).otherwise(F.concat(seen, F.array(c))))
    number = X.repaired_number(optional("C_metric"))
    return rows.select(
        F.col(id).cast("string").alias("id"), F.regexp_replace(question, r"^\s+|\s+$", "").alias("question"), F.col("_gt").alias("ground_truth"),
        X.norm_quotes(F.regexp_replace(answer, r"^\s+|\s+$", "")).alias("greedy_prediction"), F.col("_c").alias("candidate_list"), pool.alias("candidate_pool"),
        F.transform(X.aliases(F.col(truth)), X.norm_quotes).alias("gt_aliases"), X.verdict(F.col(verdict), optional("accuracy").try_cast("double")).alias("open_text_label"),
        F.nullif(optional("category"), F.lit("")).alias("category"), number.alias("c_metric"),
    )


def read_samples_csv(spark: SparkSession, path: str, line_breaks: bool = True, **names: str) -> DataFrame:
    return parse_samples(read_csv(spark, path, line_breaks), **names)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = SAMPLE) -> DataFrame:
    """Typed JSON lines; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """JSON lines keyed by (id, candidate): of repeated keys the last line of the last file stays."""
    rows = read_jsonl(spark, path, schema)
    if not exists(spark, path):
        return rows
    at, order = in_file_order(rows)
    return rel.first_by(at, ["id", "candidate"], *map(F.desc, order)).drop(*order)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a JSON array file, with their source split and number."""
    text = spark.read.text(path, wholetext=True)
    ids = text.select(F.explode(F.from_json("value", "array<string>")).alias("id"))
    parts = F.split("id", "::")
    return ids.select("id", parts[0].alias("source_split"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("number"))


def read_scores(spark: SparkSession, path: str, key: str, value: str, order: str | None = None) -> DataFrame:
    """(key, value) of a score CSV: wrapped numbers repaired, NaN left out, of repeated keys the last row."""
    raw = require_columns(read_csv(spark, path, line_breaks=False), [key, value])
    at, last = in_file_order(raw) if order is None else (raw, [order])
    rows = at.select(key, X.repaired_number(F.col(value)).alias(value), *last)
    return rel.first_by(rows.where(F.col(value).isNotNull()), [key], *map(F.desc, last)).select(key, value)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """(id, answers) of JSON lines of maps by example."""
    lines = spark.read.text(path)
    return lines.select(F.inline(gen.answers_of_map(F.col("value"))))


def read_layers(spark: SparkSession, path: str, least: int | None = None) -> DataFrame:
    """A table partitioned by layer; ``least`` prunes the partitions."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("layer") >= least) if least is not None else rows


def layers_present(spark: SparkSession, path: str, least: int = 22) -> DataFrame:
    return read_layers(spark, path, least).select("layer").distinct()


def lookup(keys: DataFrame, records: DataFrame, key: list[str], order: str | list[str], strict: bool = False) -> DataFrame:
    """First record of each key by ``order``, which should leave no ties open (``in_row_order``); an
    absent key is an error if ``strict``."""
    first = rel.first_by(records, key, *map(F.asc, [order] if isinstance(order, str) else order)).withColumn("_hit", F.lit(True))
    got = keys.join(first, key, "left")
    if strict:
        got = got.where(F.coalesce("_hit", F.raise_error(F.concat_ws(" ", F.lit("no record for"), *[F.col(k).cast("string") for k in key])).cast("boolean")))
    return got.drop("_hit")


def read_candidate_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, candidate) of a JSON sidecar: lines of objects that have both; of repeated ids the last."""
    rows = read_jsonl(spark, path, "id string, candidate string")
    at, order = in_file_order(rows) if exists(spark, path) else (rows, ["candidate"])
    return rel.first_by(at.where("id IS NOT NULL AND candidate IS NOT NULL"), ["id"], *map(F.desc, order)).select("id", "candidate")


def read_bundle(spark: SparkSession, path: str, half: list[str] | None = None, least: int | None = None) -> DataFrame:
    """``read_layers`` with the columns ``half``, of 16-bit patterns, as floats."""
    return read_layers(spark, path, least).withColumns({c: A.widened(F.col(c)) for c in half or []})
