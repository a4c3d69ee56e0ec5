"""Every query of the driver contract against its SQL, on the smallest driver tables."""

import importlib.util
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
DATA = os.environ.get("SHELFLINE_TESTDATA", "/root/testdata/sf0.001")

from compare import connect, duck_rows, spark_rows  # noqa: E402

spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables not there")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["product", "n_pages", "n_by_rules", "n_unavailable", "n_live"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
    cols, got = spark_rows(df)
    want_cols, want = duck_rows(con, entry.oracle_sql()[name])
    assert cols == want_cols
    assert got == want
