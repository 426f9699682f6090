import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from emberline.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests", "8g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(autouse=True)
def default_limit(spark):
    yield
    spark.conf.unset("emberline.group.limit")
