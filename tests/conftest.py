import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{own}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{own}/warehouse")
        .config("spark.local.dir", own)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(columns, found):
    """Rows as comparable text, columns in the order of their names."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    said = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)
    return sorted(columns), sorted(tuple(said(r[i]) for i in at) for r in found)
