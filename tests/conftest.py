import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from confluo.session import build_session
    ck = tempfile.mkdtemp(prefix="confluo-test-ckpt-")
    s = build_session("local[4]", 4, extra={"spark.checkpoint.dir": ck,
                                             "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_csv():
    return tempfile.mkdtemp(prefix="confluo-test-csv-")


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path
