import os
import sys


import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tracehound.session import local_session

    return local_session(cpus=8, shuffle_partitions=8)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
