import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
REFERENCE_FIXTURES = os.path.join(ROOT, "tests", "fixtures")


@pytest.fixture(scope="session")
def spark():
    from fleetframe.session import build_session
    ck = tempfile.mkdtemp(prefix="fleetframe-test-ck-")
    s = build_session("local[4]", app_name="fleetframe-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ck})
    yield s
    s.stop()


@pytest.fixture()
def tmp_out():
    return tempfile.mkdtemp(prefix="fleetframe-test-out-")
