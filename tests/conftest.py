import glob
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH")]))
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(folder / "checkpoints")).config("spark.sql.warehouse.dir", str(folder / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    """Values of either engine in one form."""
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Asserts that a query and its SQL return the same columns and rows."""

    def check(query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == sorted(str([plain(r[i]) for i in order]) for r in found.fetchall())

    return check
