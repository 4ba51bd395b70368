import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from formsift.session import build_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a column function on rows of text arguments."""
    from pyspark.sql import functions as F

    def run(fn, rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = [f"a{i}" for i in range(len(rows[0]))]
        schema = "n int, " + ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        out = df.select("n", fn(*[F.col(n) for n in names]).alias("v")).orderBy("n").collect()
        return [r.v for r in out]

    return run
