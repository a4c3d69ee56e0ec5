import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shelfline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(
        "shelfline-tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate one expression over a list of inputs, in order."""

    def run(expr, inputs, ddl="x STRING"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i INT, {ddl}")
        return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]

    return run
