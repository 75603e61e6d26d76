import pytest

from skolion.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__adaptive__advisoryPartitionSizeInBytes="1m")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
