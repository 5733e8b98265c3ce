import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH", "")]))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def compare(spark_df, duck_rel):
    """Rows of both as sorted lists of tuples in column-name order."""
    import math

    names = sorted(spark_df.columns)
    found = spark_df.select(*names).collect()
    wanted = duck_rel.select(", ".join(f'"{n}"' for n in names)).fetchall()
    assert names == sorted(duck_rel.columns)
    plain = lambda v: ("nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v)
    rows = lambda x: sorted((tuple(plain(v) for v in r) for r in x), key=repr)
    assert rows(found) == rows(wanted)
