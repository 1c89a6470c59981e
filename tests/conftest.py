import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from borehole.session import local_session

    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def sql():
    from compare import oracle

    return oracle(SF)


@pytest.fixture
def small_groups(spark):
    """Groups above 40 rows count as too large for one task."""
    spark.conf.set("spark.borehole.maxGroupRows", "40")
    yield 40
    spark.conf.unset("spark.borehole.maxGroupRows")
