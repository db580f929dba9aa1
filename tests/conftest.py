import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def oracle_rows(sf_dir, sql):
    """Column names, sorted, and rows as DuckDB sees them."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def settled(names, rows):
    """Rows with columns by name, floats rounded, in a fixed order."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v

    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
