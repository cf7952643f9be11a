import pytest
from pyspark.sql import SparkSession

from opsweave.operators import timeline


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("opsweave-tests")
               .config("spark.sql.shuffle.partitions", "2")
               .config("spark.default.parallelism", "2")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def narrow_buckets(monkeypatch):
    """A handful of rows per bucket, so that carries pass through many."""
    monkeypatch.setattr(timeline, "BUCKET_SECONDS", 7)
    monkeypatch.setattr(timeline, "BUCKET_STEPS", 3)
