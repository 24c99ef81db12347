"""Every query with a SQL counterpart against DuckDB on the smallest tables; the others for their shape."""

import duckdb
import pytest

from trawler.plans.oracle import ORACLE_SQL
from trawler.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    got, want = (f[cols].sort_values(cols).reset_index(drop=True) for f in (got, want))
    assert [str(t) for t in got.dtypes] == [str(t) for t in want.dtypes]
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize("name", ["analyze_docs_stemmed", "tokenize_treebank", "stem_terms", "random_negatives", "feature_columns", "train_val_split", "cv_folds"])
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
