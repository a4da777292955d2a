import glob
import math
import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Values of expressions over a single text."""

    def run(text, **exprs):
        df = spark.createDataFrame([(text,)], "c string")
        return df.select(*[e.alias(n) for n, e in exprs.items()]).first().asDict()

    return run


DATA = os.environ.get("LAKEMASON_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def db(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="session")
def bare(spark, data, tmp_path_factory):
    """The tables without rows, and with ids only."""
    root = tmp_path_factory.mktemp("bare")
    for path in glob.glob(f"{data}/*.parquet"):
        df, name = spark.read.parquet(path), os.path.basename(path)
        df.limit(0).write.parquet(f"{root}/empty/{name}")
        ids = {"listing_id", "coord_id", "doc_id", "item_id"}
        df.limit(20).select(*[F.col(c) if c in ids else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]).write.parquet(f"{root}/nulls/{name}")
    return root


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return "" if v is None else str(v)


@pytest.fixture
def same_as_sql(spark, data, db):
    """Does a query give the rows of its SQL?"""

    def check(query, sql):
        df = query(spark, data)
        result = db.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted(tuple(_plain(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
        assert sorted(tuple(_plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want

    return check
