"""Readers: JSON lines strict, lenient and optional, whole documents, CSV, id lists, trees whose paths carry keys, bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

BAD = "_corrupt_record"


def kind_of(schema: str | StructType) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: str | StructType, mode: str = "strict", missing_ok: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines are none.

    strict: a line that isn't an object of the schema is an error when it is read, which names file and text. lenient:
    such lines go. A missing path is an error, or no rows with `missing_ok`.
    """
    kind = kind_of(schema)
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], kind)
    if mode == "lenient":
        lines = spark.read.text(path).filter(F.trim("value").startswith("{"))
        full = StructType([*kind.fields, StructField(BAD, StringType())])
        parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
        return parsed.filter(F.col(BAD).isNull()).drop(BAD)
    lines = spark.read.text(path).withColumn("__at", F.col("_metadata.file_path")).filter(F.trim("value") != "")
    full = StructType([*kind.fields, StructField(BAD, StringType())])
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    wrong = F.col(f"r.{BAD}").isNotNull() | ~F.trim("value").startswith("{") | F.col("r").isNull()
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("not a JSON object: "), "__at", F.lit(": "), F.substring("value", 1, 200))).cast(full)).otherwise(F.col("r"))
    return parsed.select(checked.alias("r")).select(*[F.col("r")[f.name].alias(f.name) for f in kind.fields])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line from 1, value): files read whole, so that a line's number needs no order across tasks."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return whole.withColumn("line", F.col("line") + 1).filter(F.trim("value") != "")


def documents(spark: SparkSession, path: str, schema: str | StructType, empty_ok: bool = False) -> DataFrame:
    """One row for each JSON file, with `file`. A file that holds no object is an error when read, or an empty object."""
    kind = kind_of(schema)
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    parsed = F.when(F.trim("value").startswith("{"), F.from_json("value", kind))
    other = F.from_json(F.lit("{}"), kind) if empty_ok else F.raise_error(F.concat(F.lit("no JSON object: "), "file")).cast(kind)
    return whole.select("file", F.coalesce(parsed, other).alias("r")).select("file", "r.*")


def path_keys(df: DataFrame, names: list[str], column: str = "file") -> DataFrame:
    """The last folders of a file's path, and its name without suffix, as columns."""
    parts = F.split(column, "/")
    keys = {n: F.element_at(parts, i - len(names)) for i, n in enumerate(names)}
    keys[names[-1]] = F.regexp_replace(keys[names[-1]], r"\.[^.]*$", "")
    return df.withColumns(keys)


def task_tree(spark: SparkSession, root: str, schema: str | StructType, file: str = "metadata.json", key: str = "task_id") -> DataFrame:
    """A document for each task folder. A folder whose document names another task is an error; so is an empty tree."""
    if not exists(spark, f"{root}/*/{file}"):
        raise ValueError(f"no tasks in {root}")
    rows = path_keys(documents(spark, f"{root}/*/{file}", schema), ["__folder", "__name"])
    wrong = F.raise_error(F.concat(F.lit("folder and id differ: "), "file")).cast("string")
    return rows.withColumn(key, F.when(F.col(key) == F.col("__folder"), F.col(key)).otherwise(wrong)).drop("__folder", "__name")


def csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """CSV with a header; a byte order mark is no part of its first name."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def task_ids(spark: SparkSession, path: str, prefix: str = "task_", width: int = 4) -> DataFrame:
    """(task_id, position): a list's ids without comments, bare numbers padded, the first of equal ones; others are an error."""
    rows = numbered_lines(spark, path).withColumn("x", F.trim(F.regexp_replace("value", "#.*$", ""))).filter("x <> ''")
    name = F.when(F.col("x").rlike("^[0-9]+$"), F.concat(F.lit(prefix), F.lpad(F.col("x").cast("bigint").cast("string"), width, "0"))).otherwise(F.col("x"))
    bad = F.raise_error(F.concat(F.lit("no task id: "), "x")).cast("string")
    name = F.when(name.rlike(f"^{prefix}[0-9]{{{width},}}$"), name).otherwise(bad)
    return rows.select(name.alias("task_id"), "line").groupBy("task_id").agg(F.min("line").alias("position"))


def ids_with_fallback(spark: SparkSession, root: str, limit: int | None = None, total: int = 500) -> DataFrame:
    """(task_id, position) from a list file, else from folders, else made from a prefix; the first `limit` of them."""
    if exists(spark, f"{root}/tasks.txt"):
        out = task_ids(spark, f"{root}/tasks.txt")
    elif exists(spark, f"{root}/task_*"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/task_*")
        names = sorted(s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) if s.isDirectory())
        out = spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "task_id string, position int")
    else:
        out = spark.range(1, total + 1).select(F.concat(F.lit("task_"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("task_id"), F.col("id").cast("int").alias("position"))
    return out.orderBy("position").limit(limit) if limit else out


def binary(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)


def signature(content: Column, magic: bytes = b"%PDF-") -> Column:
    return F.substring(content, 1, len(magic)) == F.lit(magic)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(image, text) of a list of pairs; relative paths count from the list's folder."""
    rows = documents_list(spark, path)
    folder = F.regexp_replace("file", "/[^/]*$", "/")
    return rows.select(F.when(F.col("image").rlike("^(/|[a-z]+:)"), F.col("image")).otherwise(F.concat(folder, "image")).alias("image"), "text")


def documents_list(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return whole.select("file", F.explode(F.from_json("value", "array<struct<image:string,text:string>>")).alias("r")).select("file", "r.*")


def settings(text: str, defaults: dict) -> dict:
    """A TOML text's values over typed defaults; keys without a default go, other types are an error."""
    import tomllib

    given = tomllib.loads(text)
    out = dict(defaults)
    for k, v in given.items():
        if k in defaults:
            if not isinstance(v, type(defaults[k])) and not (isinstance(defaults[k], float) and type(v) is int):
                raise TypeError(f"{k}: {type(defaults[k]).__name__} expected")
            out[k] = v
    return out
