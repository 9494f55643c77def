import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from perilscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tests are many small queries: compiling code for each costs more than running it.
    session = local_session(4, app="tests", spark__sql__codegen__wholeStage="false")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
