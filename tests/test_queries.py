"""Every registered query with SQL gives the SQL's rows over the small tables."""

import duckdb
import pandas as pd
import pytest

from memoria.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        x, pair = df[c], (df[c], other[c])
        if all(pd.api.types.is_numeric_dtype(z) and not pd.api.types.is_bool_dtype(z) for z in pair):
            x = x.astype("float64")
        elif any(pd.api.types.is_datetime64_any_dtype(z) for z in pair):
            x = pd.to_datetime(x).astype("datetime64[us]")
        out[c] = x.astype(object).where(x.notna(), "~").astype(str)
    return pd.DataFrame(out).sort_values(sorted(out)).reset_index(drop=True)


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, small, db, name):
    got = catalog.queries()[name](spark, small).toPandas()
    want = db.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got, want), normal(want, got))


#: Queries that SQL can't express: held against brute force in test_beyond_sql.py.
WITHOUT_SQL = {"communities", "vector_index_topk", "sketched_drift"}


def test_every_query_has_sql_or_is_known():
    assert set(catalog.queries()) - WITHOUT_SQL == set(catalog.oracle_sql())


def test_no_leak_under_any_ceiling(spark, small):
    assert catalog.queries()["scope_leaks_by_profile"](spark, small).filter("leaks > 0").count() == 0
    assert catalog.queries()["scope_leaks_without_ceiling"](spark, small).filter("leaks > 0").count() > 0


def test_restricted_rows_never_take_a_place(spark, small):
    """The ceiling holds before ranking: every query has its full number of permitted neighbours."""
    from memoria.model import admits, derived_scope
    from pyspark.sql import functions as F

    found = catalog.queries()["gate_decision"](spark, small)
    assert found.filter("profile = 'public'").count() > 0
    hits = catalog.queries()["dense_topk_scoped"](spark, small)
    assert hits.filter(~admits(derived_scope(F.col("id")), F.lit("professional"))).count() == 0


def test_flagship_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["query_id", "id", "score", "place"]
    assert rows.count() > 0
