"""Readers and writers of the record files that pipelines exchange: rollouts, problems, reasoning records, evaluations, pairs.

All readers take explicit schemas, so nothing is inferred and JSON is pruned to the wanted
fields; land them as Parquet once and work from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import fixed, text

TRACE = T.StructType([T.StructField("solution", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("is_correct", T.BooleanType()), T.StructField("num_tokens", T.IntegerType())])
ROLLOUT = T.StructType([T.StructField("problem_id", T.StringType()), T.StructField("problem_text", T.StringType()), T.StructField("ground_truth", T.StringType()), T.StructField("traces", T.ArrayType(TRACE))])
TURN = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
CONVERSATION = T.StructType([T.StructField("conversations", T.ArrayType(TURN)), T.StructField("system", T.StringType())])
STEP = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("inputs", T.ArrayType(T.IntegerType())),
        T.StructField("outputs", T.ArrayType(T.IntegerType())),
        T.StructField("deterministic", T.BooleanType()),
        T.StructField("original_tokens", T.IntegerType()),
        T.StructField("paragraphs", T.ArrayType(T.IntegerType())),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("problem_id", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("original_answer", T.StringType()),
        T.StructField("original_reasoning", T.StringType()),
        T.StructField("original_token_count", T.IntegerType()),
        T.StructField("steps", T.ArrayType(STEP)),
        T.StructField("paragraph_texts", T.MapType(T.StringType(), T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("benchmark", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("predicted", T.StringType()),
        T.StructField("is_correct", T.BooleanType()),
        T.StructField("solution", T.StringType()),
        T.StructField("num_tokens", T.IntegerType()),
        T.StructField("dsr", T.DoubleType()),
        T.StructField("num_steps", T.IntegerType()),
        T.StructField("num_dead", T.IntegerType()),
    ]
)
EVALUATION = T.StructType([T.StructField("model", T.StringType()), T.StructField("results", T.ArrayType(RESULT))])
PAIR = T.StructType([T.StructField("conversations", T.ArrayType(TURN)), T.StructField("chosen", TURN), T.StructField("rejected", TURN)])


def read_rollouts(spark: SparkSession, *paths: str) -> DataFrame:
    """Rollout files (JSON arrays), several or with globs, as one table."""
    return spark.read.schema(ROLLOUT).option("multiLine", True).json(list(paths))


def merge_shards(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(all rollouts in order of problem_id as text, problem_ids that came more than once); repeated ids are told, not dropped."""
    r = read_rollouts(spark, *paths)
    return r.orderBy("problem_id"), r.groupBy("problem_id").count().filter("count > 1")


def in_file_order(df: DataFrame, name: str = "__number") -> DataFrame:
    """Rows numbered from 0 in the order of their files: numbers inside each part of a file, and how many rows the parts before hold. No task gathers rows."""
    rows = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__before")


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """Problems of a conversation file: entries of two turns or more, named prob_0, prob_1, ... in file order, with the boxed answer of the second turn."""
    c = spark.read.schema(CONVERSATION).option("multiLine", True).json(path)
    rows = in_file_order(c.filter(F.size("conversations") >= 2))
    return rows.select(F.concat(F.lit("prob_"), F.col("__number").cast("string")).alias("problem_id"), F.element_at("conversations", 1)["value"].alias("problem_text"), text.boxed_answer(F.element_at("conversations", 2)["value"]).alias("ground_truth"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Reasoning records of a folder, one JSON file each; summaries are left out, and a record without problem_id has its file's name."""
    r = spark.read.schema(RECORD).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).select("*", "_metadata.file_name")
    stem = F.regexp_replace("file_name", r"\.json$", "")
    return r.filter(~F.endswith("file_name", F.lit("_summary.json"))).select(F.coalesce("problem_id", stem).alias("problem_id"), *[f.name for f in RECORD.fields if f.name != "problem_id"], "file_name")


def read_results(spark: SparkSession, path: str, benchmark: str | None = None) -> DataFrame:
    """One row per result of an evaluation file."""
    r = spark.read.schema(EVALUATION).option("multiLine", True).json(path).select("model", F.explode("results").alias("r")).select("model", "r.*")
    return r.filter(F.col("benchmark") == benchmark) if benchmark else r


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).option("multiLine", True).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole text as ``solution``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "solution")


def write_pairs(pairs: DataFrame, problems: DataFrame, path: str) -> None:
    """Pairs (problem_id, chosen_solution, rejected_solution) as conversation records; pairs whose problem text is empty or missing are left out."""
    from tracemill.operators.pairs import sharegpt

    j = pairs.join(problems.filter("problem_text <> ''").select("problem_id", "problem_text"), "problem_id")
    j.select(sharegpt(F.col("problem_text"), F.col("chosen_solution"), F.col("rejected_solution")).alias("r")).select("r.*").write.mode("overwrite").json(path)


def write_variants(variants: DataFrame, path: str) -> None:
    """Cleaned training texts, a folder per variant."""
    variants.write.mode("overwrite").partitionBy("variant").json(path)


def choices(question, options):
    """Choices of a multiple-choice question in an order that only depends on their texts, empty ones dropped, as lettered lines."""
    ordered = F.array_sort(F.transform(F.filter(options, lambda x: F.trim(x) != ""), lambda x: F.struct(F.md5(F.concat(question, x)).alias("k"), x.alias("v"))))
    letters = F.array(*[F.lit(c) for c in "ABCDEFGH"])
    return F.array_join(F.transform(ordered, lambda s, i: F.concat(F.lit("("), F.element_at(letters, i + 1), F.lit(") "), s["v"])), "\n")


def choice_letter(question, options, right):
    """The letter of the right choice in that order; A where it is not among them."""
    ordered = F.transform(F.array_sort(F.transform(F.filter(options, lambda x: F.trim(x) != ""), lambda x: F.struct(F.md5(F.concat(question, x)).alias("k"), x.alias("v")))), lambda s: s["v"])
    at = F.array_position(ordered, right).cast("int")
    return F.when(at > 0, F.substring(F.lit("ABCDEFGH"), F.greatest(at, F.lit(1)), F.lit(1))).otherwise("A")


# Records with results, raw items, lookups.

RAW = "id bigint, question string, solution string, answer string"
ELIMINATION = "limo_id bigint, dead_ids array<int>, live_ids array<int>"
SCORES = "struct<dsr: double, quality_reward: double, num_steps: int>"
ANNOTATION = "problem_id string, rollout_id bigint, trace_id int, is_correct boolean, num_steps bigint, dsr double, typed_dsr map<string,double>, verification_density double, live_verification_rate double, trace_length bigint"


def _file_number() -> Column:
    return F.expr("try_cast(nullif(regexp_extract(file_name, '_([0-9]+)', 1), '') as bigint)")


def structured(records: DataFrame) -> DataFrame:
    """Records that have steps, in the form that ``rir.features`` and the cleaned variants take: correctness by the last box or line, paragraphs in order of their numbers."""
    r = records.filter(F.size("steps") > 0)
    right = text.numeric_equal(text.record_answer(F.col("original_answer")), F.col("ground_truth"))
    numbers = F.array_sort(F.transform(F.map_entries(F.coalesce("paragraph_texts", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].alias("v"))))
    return r.select("problem_id", F.xxhash64("file_name").alias("rollout_id"), F.lit(0).alias("trace_id"), right.alias("is_correct"), F.col("original_answer").alias("answer"), "ground_truth", F.col("original_reasoning").alias("solution"), F.col("steps").alias("rsteps"), F.transform(numbers, lambda e: e["v"]).alias("paragraph_texts"))


def read_three_way(spark: SparkSession, raw: str, records: str, results: str, min_parsed: int = 1) -> DataFrame:
    """(limo_id, question, solution, steps, paragraph_texts, dead_ids) of the items that all three sources have; fewer than ``min_parsed`` is an error.

    A record's id is ``metadata.limo_id``, a result's ``limo_id``, else the number in the file's name.
    """
    items = spark.read.schema(RAW).option("multiLine", True).json(raw).select(F.col("id").alias("limo_id"), "question", "solution")
    parsed = read_records(spark, records).select(F.coalesce(F.col("metadata")["limo_id"].try_cast("bigint"), _file_number()).alias("limo_id"), "steps", "paragraph_texts")
    found = spark.read.schema(ELIMINATION).option("multiLine", True).option("pathGlobFilter", "*.json").json(results).select("limo_id", "dead_ids", "_metadata.file_name")
    both = parsed.join(found.select(F.coalesce("limo_id", _file_number()).alias("limo_id"), "dead_ids"), "limo_id")
    out = items.join(both, "limo_id")
    if (n := both.count()) < min_parsed:
        raise ValueError(f"{n} parsed items, {min_parsed} are needed")
    return out


def items(df: DataFrame, benchmark: str = "math500") -> DataFrame:
    """Test items in the form of problems: id, problem, answer, subject ('' where absent), level (0 where absent), benchmark."""
    return df.select(F.col("unique_id").alias("id"), "problem", "answer", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("level", F.lit(0)).alias("level"), F.lit(benchmark).alias("benchmark"))


def choice_items(df: DataFrame, benchmark: str = "gpqa") -> DataFrame:
    """Multiple-choice items (question, correct, incorrect_1 to 3, subdomain) as problems: lettered choices in an order that depends on the texts alone, and the letter as answer."""
    options = F.array("correct", "incorrect_1", "incorrect_2", "incorrect_3")
    kept = F.filter(options, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    prompt = F.concat(F.col("question"), F.lit("\n\nChoices:\n"), choices(F.col("question"), kept), F.lit("\n\n" + fixed.CHOICE_PROMPT))
    numbered = in_file_order(df.filter("question is not null"))
    return numbered.select(F.concat(F.lit(f"{benchmark}_"), F.col("__number").cast("string")).alias("id"), prompt.alias("problem"), choice_letter(F.col("question"), kept, F.col("correct")).alias("answer"), F.coalesce("subdomain", F.lit("")).alias("subject"), F.lit(0).alias("level"), F.lit(benchmark).alias("benchmark"))


def first_that_reads(spark: SparkSession, *paths: str) -> DataFrame | None:
    """The first of several Parquet sources that is there; None for none."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.read.parquet(path)
    return None


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(problem_id, trace_id, dsr, quality_reward, num_steps) of files that nest scores by problem and trace; one file is one value, so keep them of moderate size."""
    nested = F.from_json("value", f"map<string,map<string,{SCORES}>>")
    by_problem = spark.read.text(path, wholetext=True).select(F.explode(nested).alias("problem_id", "traces"))
    return by_problem.select("problem_id", F.explode("traces").alias("trace", "s")).select("problem_id", F.expr("try_cast(trace as int)").alias("trace_id"), "s.*")


def read_paired(spark: SparkSession, base: str, new: str) -> DataFrame:
    """(place, base, new): results of two files that are aligned by place."""
    side = lambda path, name: in_file_order(spark.read.schema(RESULT).option("multiLine", True).json(path), "place").select("place", F.struct(*[f.name for f in RESULT.fields]).alias(name))
    return side(base, "base").join(side(new, "new"), "place")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION).json(path)


def read_problem_map(spark: SparkSession, path: str) -> DataFrame:
    """(problem_id, problem_text) of a file that maps one to the other."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("problem_id", "problem_text"))
