import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/root"


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


def same(spark_df, duck_rows, names):
    """Rows as a multiset, columns by name."""
    order = sorted(spark_df.columns)
    assert order == sorted(names)
    plain = lambda v: round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else bytes(v) if isinstance(v, bytearray) else v
    a = sorted((repr([plain(r[c]) for c in order]) for r in spark_df.collect()))
    at = {n: i for i, n in enumerate(names)}
    b = sorted((repr([plain(r[at[c]]) for c in order]) for r in duck_rows))
    assert a == b
