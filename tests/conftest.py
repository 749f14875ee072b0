import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return c


def same_rows(df, relation):
    """Rows of a DataFrame and of a DuckDB relation, whatever their order and that of the columns."""

    def norm(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        text = lambda x: repr(round(x, 9)) if isinstance(x, float) else str(x)
        return sorted(tuple(text(r[i]) for i in order) for r in rows)

    assert sorted(df.columns) == sorted(relation.columns)
    assert norm(df.collect(), df.columns) == norm(relation.fetchall(), relation.columns)
