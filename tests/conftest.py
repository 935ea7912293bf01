import os
import sys

import pytest
from hypothesis import settings

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])


settings.register_profile("steady", deadline=None)
settings.load_profile("steady")


@pytest.fixture(scope="session")
def spark():
    from sedimenta.session import local_session

    s = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def data():
    at = os.environ.get("SEDIMENTA_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(at):
        pytest.skip("no test tables")
    return at
