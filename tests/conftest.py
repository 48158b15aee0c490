import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def oracle(sf_dir):
    """Rows of a SQL text over the same tables, compared with a DataFrame's: columns by name, floats to nine digits."""
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")

    def plain(value):
        if isinstance(value, float):
            return float(f"{value:.9g}")
        return tuple(map(plain, value)) if isinstance(value, list | tuple) else value

    def compare(df, sql):
        names = sorted(df.columns)
        result = con.execute(sql)
        theirs = [d[0] for d in result.description]
        assert sorted(theirs) == names
        want = sorted((tuple(plain(row[theirs.index(n)]) for n in names) for row in result.fetchall()), key=repr)
        assert sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=repr) == want

    return compare
