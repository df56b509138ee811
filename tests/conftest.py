import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def engine(tmp_path_factory):
    from millrace import Engine

    made = (
        Engine.builder().master("local[4]").app_name("tests")
        .config("spark.sql.shuffle.partitions", 4).config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
        .get_or_create()
    )
    made.spark.sparkContext.setLogLevel("OFF")
    yield made
    made.spark.stop()


@pytest.fixture(scope="session")
def spark(engine):
    return engine.spark


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)
