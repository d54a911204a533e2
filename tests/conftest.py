import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "scripts"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from barloom.session import local_session, tune
    from pyspark.sql import SparkSession
    # The cluster names this folder; tests name one before the session starts.
    SparkSession.builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return tune(local_session(8, 4, "4g"))
