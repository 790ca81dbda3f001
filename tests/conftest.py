import os
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
# Python workers import the package and the fakes of the test modules.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")]
)

from pagewright.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "pagewright-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a column function to literal rows and return the results in order."""
    from pyspark.sql import functions as F

    def run(function, values, schema="string"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        kinds = [s.strip() for s in schema.split(";")]
        names = [f"c{i}" for i in range(len(kinds))]
        ddl = "i int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
        df = spark.createDataFrame(rows, ddl)
        out = df.select("i", function(*[F.col(n) for n in names]).alias("out")).orderBy("i").collect()
        return [r["out"] for r in out]

    return run
