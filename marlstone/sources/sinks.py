"""Writers: JSON lines, CSV, a file for each key, atomic replacement, append logs, public projections, reports."""

from __future__ import annotations

import html
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from marlstone.functions.text import escaped


def write_jsonl(df: DataFrame, path: str, one_file: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines with sorted fields; `one_file` for small tables."""
    out = df.select(*sorted(df.columns))
    (out.coalesce(1) if one_file else out).write.mode(mode).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, mode="append")


def write_csv(df: DataFrame, path: str, fields: list[str], bom: bool = False) -> None:
    """The fields in their order, what is missing or null as ''; with a byte order mark before the header on request."""
    given = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]
    out = df.select(*given)
    if not bom:
        out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
        return
    named = out.withColumnRenamed(fields[0], "\ufeff" + fields[0])
    named.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_per_key(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON files in a folder for each key; only the folders of keys in `df` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def replace(df: DataFrame, path: str, form: str = "parquet") -> None:
    """`df` takes the place of `path` at once: written beside it, then renamed; if that fails, the old data comes back."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    beside, old, at = (jvm.Path(f"{path}.{k}-{uuid.uuid4().hex}") for k in ("new", "old", "x"))
    at = jvm.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.format(form).save(beside.toString())
        had = fs.exists(at)
        if had and not fs.rename(at, old):
            raise OSError(f"can't move {path}")
        if not fs.rename(beside, at):
            if had:
                fs.rename(old, at)
            raise OSError(f"can't replace {path}")
        if had:
            fs.delete(old, True)
    finally:
        fs.delete(beside, True)


def public(df: DataFrame, private: set[str]) -> DataFrame:
    """The table without private fields, at any depth of structs and arrays of structs."""

    def kept(kind, c):
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[kept(f.dataType, c[f.name]).alias(f.name) for f in kind.fields if f.name not in private]))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            return F.transform(c, lambda x: kept(kind.elementType, x))
        return c

    return df.select(*[kept(f.dataType, F.col(f.name)).alias(f.name) for f in df.schema.fields if f.name not in private])


def write_results(root: str, cases: DataFrame, scores: DataFrame, board: DataFrame, summary: DataFrame, private: set[str] = frozenset()) -> None:
    """Four result tables: cases as JSON lines without private fields, the others as CSV."""
    write_jsonl(public(cases, private), f"{root}/cases", mode="overwrite")
    for name, df in (("scores", scores), ("leaderboard", board), ("issue_summary", summary)):
        write_csv(df, f"{root}/{name}", df.columns)


def gallery(df: DataFrame, title: str, columns: list[str]) -> DataFrame:
    """An HTML table row for each row, made on executors; `page` wraps a bounded number of them."""
    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row"))


def page(rows: list[str], title: str, columns: list[str]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><table><tr>{head}</tr>{''.join(rows)}</table>"


def markdown(spark: SparkSession, df: DataFrame, title: str, most: int = 1000) -> str:
    """A report of a table that has at most `most` rows; a larger one is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]) + "\n"
