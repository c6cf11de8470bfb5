import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import pytest

from tracemill import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
