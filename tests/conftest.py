import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from oracle import make_spark

    session = make_spark()
    # plans name whole paths, however long the folder of the tests is
    session.conf.set("spark.sql.maxMetadataStringLength", "1000")
    return session
