"""License queries over absent, empty and oddly written texts, as in their SQL."""

from __future__ import annotations

import duckdb

from marlstone.plans import registry

TEXTS = [None, "", " ", "MIT License", "the MİT LİCENSE", "APACHE LİCENSE", "Apache Lİcense, BY-SA", "GENERAL PUBLİC LICENSE", "mi̇t license", "CC BY-NC", "by-nc-nd", "a by-\0sa", "none"]


def both(spark, path, name, ids):
    """The query's rows and its SQL's, as sets of the same columns, over each text twice."""
    rows = [(k, t, "en", f"s{i % 3}", len(t or "")) for i, (k, t) in enumerate(zip(ids, TEXTS * 2))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.sql(registry.ORACLE[name])
    got = registry.QUERIES[name](spark, str(path)).select(*want.columns).collect()
    return tuple(sorted(map(tuple, x), key=repr) for x in (got, want.fetchall()))


def test_classify_equals_sql(spark, tmp_path):
    got, want = both(spark, tmp_path, "license_classify", range(2 * len(TEXTS)))
    assert got == want and {f for _, f, _ in got} == {"unknown", "mit", "apache", "gpl", "cc-by-sa", "cc-by-nc", "cc-by-nc-nd"}


def test_ids_equal_sql_with_absent_ids_last(spark, tmp_path):
    """Positions count on behind ids that are there, none for rows without a text."""
    got, want = both(spark, tmp_path, "license_ids", [None if i % 4 == 1 else 90 - i for i in range(2 * len(TEXTS))])
    assert got == want and any(k is None and position > 1 for _, _, k, position in got)


def test_summary_equals_sql(spark, tmp_path):
    got, want = both(spark, tmp_path, "license_summary", range(2 * len(TEXTS)))
    assert got == want and len(want) == 6
