import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetmeter import session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session.build(
        master="local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def frame(spark):
    """Build a DataFrame from rows and a DDL schema; text is cast where the schema says timestamp or date."""
    from pyspark.sql import functions as F

    def build(rows, ddl):
        names = [c.split()[0] for c in ddl.split(", ")]
        kinds = [c.split()[1] for c in ddl.split(", ")]
        plain = ", ".join(
            f"{n} {'STRING' if k.upper().startswith(('TIMESTAMP', 'DATE')) else k}" for n, k in zip(names, kinds)
        )
        df = spark.createDataFrame(rows, plain)
        return df.select([F.col(n).cast(k).alias(n) for n, k in zip(names, kinds)])

    return build
