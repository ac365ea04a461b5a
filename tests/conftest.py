import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import local_session, release

    session = local_session(8, "plumbline-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    from plumbline.plans.compare import oracle_connection

    return oracle_connection(SF)


def rows(df):
    return [tuple(r) for r in df.collect()]
