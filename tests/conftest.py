import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from quire.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("warehouse")
    return local_session(4, "quire-tests", spark__sql__warehouse__dir=str(folder), spark__sql__shuffle__partitions="4")


@pytest.fixture
def one(spark):
    """Value of an expression over one text."""
    from pyspark.sql import functions as F

    def run(build, *texts):
        df = spark.createDataFrame([(t,) for t in texts], "c string")
        got = [r[0] for r in df.select(build(F.col("c"))).collect()]
        return got if len(texts) > 1 else got[0]

    return run
