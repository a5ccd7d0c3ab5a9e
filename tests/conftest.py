import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cellcube.session import get_spark

    s = get_spark("local[4]", 8, app_name="cellcube-tests")
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
