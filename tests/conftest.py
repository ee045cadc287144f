import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))
sys.path.insert(0, str(ROOT / "tests" / "llm"))


@pytest.fixture(scope="session", autouse=True)
def small_models():
    """Fewer trees and rounds than the production sizes: the tests are about what surrounds the models."""
    from visitgrid.operators import models
    models.TREES, models.TREE_DEPTH, models.ROUNDS = 15, 6, 8


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "6g")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="visitgrid-tests-")).config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
