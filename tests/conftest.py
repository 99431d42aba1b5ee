import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def compare(spark, small):
    """Run a registered query and its SQL on the same tables and compare rows."""
    import glob
    import math

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")

    def norm(v):
        return (None if math.isnan(v) else v + 0.0) if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, small)
        cols = sorted(df.columns)
        rel = con.sql(sql)
        names = list(rel.columns)
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        ours = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=lambda r: [str(x) for x in r])
        theirs = sorted(([norm(r[i]) for i in at] for r in rel.fetchall()), key=lambda r: [str(x) for x in r])
        assert ours == theirs

    return check
