import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))
DATA = Path(os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip(f"{DATA} is not here")
    return str(DATA)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(float(value)) if type(value).__name__ == "Decimal" else str(value)


@pytest.fixture(scope="session")
def same(spark, data, oracle):
    """Whether a query returns what its SQL does."""
    from collections import Counter

    def check(query, sql):
        df = query(spark, data)
        names = sorted(df.columns)
        rows = Counter(tuple(map(normal, r)) for r in df.select([f"`{c}`" for c in names]).collect())
        found = oracle.sql(sql)
        order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
        assert [found.columns[i] for i in order] == names
        want = Counter(tuple(normal(r[i]) for i in order) for r in found.fetchall())
        assert rows == want, (list((rows - want).items())[:3], list((want - rows).items())[:3])

    return check
