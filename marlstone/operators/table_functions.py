"""Functions for SQL texts: scalar and table functions in SQL, and a partitioned table function that stops early."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import SkipRestOfInputTableException, udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class UntilSums:
    """`until_sums(TABLE(...) PARTITION BY (k) ORDER BY (o), 'a, b', 'ta, tb')`: a partition's rows until every sum has reached its target.

    The row that completes the last sum is the partition's last; the rest is skipped. Columns `sum_a`, `sum_b` say how far
    the sums are. Nulls count 0. Columns are whole numbers, decimals or doubles; sums are exact but for doubles.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, columns: AnalyzeArgument, targets: AnalyzeArgument) -> AnalyzeResult:
        names, goals = (x.value.split(",") for x in (columns, targets))
        fields = {f.name: f.dataType for f in table.dataType.fields}
        missing = [n.strip() for n in names if n.strip() not in fields]
        if missing or len(names) != len(goals):
            raise ValueError(f"no column {', '.join(missing)}" if missing else "columns and targets differ in number")
        out = T.StructType(list(table.dataType.fields))
        for n in names:
            kind = fields[n.strip()]
            sums = T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.DoubleType() if isinstance(kind, (T.FloatType, T.DoubleType)) else T.LongType()
            out.add(f"sum_{n.strip()}", sums)
        return AnalyzeResult(schema=out)

    def __init__(self, result: AnalyzeResult) -> None:
        self.kinds, self.sums = [f.dataType for f in result.schema.fields], None

    def eval(self, row: Row, columns: str, targets: str) -> Iterator[tuple]:
        if self.sums is None:
            self.names, self.goals = [n.strip() for n in columns.split(",")], [float(g) for g in targets.split(",")]
            zero = {T.DecimalType: Decimal(0), T.DoubleType: 0.0}  # of the column's type: another one would be read as null
            self.sums = [zero.get(type(k), 0) for k in self.kinds[-len(self.names) :]]
        for i, n in enumerate(self.names):
            self.sums[i] += row[n] or 0
        yield (*row, *self.sums)
        if all(s >= g for s, g in zip(self.sums, self.goals)):
            raise SkipRestOfInputTableException


#: Bodies of scalar functions: name, parameters, result, expression.
SCALARS = (
    ("canonical_id", "x STRING", "STRING", r"regexp_replace(substring_index(x, '/abs/', -1), 'v[0-9]+$', '')"),
    ("safe_id", "x STRING", "STRING", "translate(x, '/.', '_-')"),
    ("caption_of", "x STRING", "STRING", r"trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}_]+', ' '))"),
    ("license_url", "x STRING", "STRING", r"regexp_replace(regexp_replace(lower(trim(x)), '^https:', 'http:'), '/+$', '')"),
    ("stair", "ratio DOUBLE", "DOUBLE", "CASE WHEN ratio <= 0.02 THEN 1.0D WHEN ratio <= 0.1 THEN 1.25D WHEN ratio <= 0.25 THEN 1.5D WHEN ratio <= 0.5 THEN 2.0D ELSE 2.5D END"),
    ("points_lost", "base DOUBLE, ratio DOUBLE", "DOUBLE", "bround(base * stair(ratio), 2)"),
    ("hamming", "a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
)
#: Table functions over views: name, parameters, result, query.
TABLES = (
    ("orders_of", "customer BIGINT", "o_orderkey BIGINT, o_totalprice DOUBLE, place BIGINT", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) FROM orders WHERE o_custkey = customer"),
    ("top_orders", "most INT", "o_custkey BIGINT, o_orderkey BIGINT, place INT", "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= most"),
    ("usage_by", "kind STRING", "user_id BIGINT, n BIGINT, units BIGINT", "SELECT user_id, count(*), sum(CAST(round(value * 100) AS BIGINT)) FROM events WHERE event_type = kind GROUP BY user_id"),
)


def register(spark: SparkSession, tables: bool = True) -> None:
    """Registers all of them for this session; table functions need views `orders` and `events`."""
    for name, takes, gives, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    for name, takes, gives, body in TABLES if tables else ():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {body}")
    spark.udtf.register("until_sums", udtf(UntilSums))
