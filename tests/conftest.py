import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TINY = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tidewatch-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def canonical(rows, digits=6):
    """Rows as comparable tuples, columns by name, doubles rounded."""
    out = []
    for r in rows:
        d = r.asDict()
        out.append(tuple((k, round(d[k], digits) + 0.0 if isinstance(d[k], float) else d[k]) for k in sorted(d)))
    return sorted(out, key=str)


def same(a, b, digits=6):
    left, right = canonical(a.collect(), digits), canonical(b.collect(), digits)
    assert len(left) == len(right)
    assert left == right
