import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberwatch import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="emberwatch-test-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def events(spark):
    """Build unified events from sparse dicts."""
    import json

    from pyspark.sql import functions as F

    from emberwatch.schema import conform

    def make(*docs):
        rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
        return conform(spark.createDataFrame(rows, "seq long, value string")).withColumn("case_id", F.lit("c"))

    return make
