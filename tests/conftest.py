import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from graphmill.session import local_session

    # Compiling code costs more than running it on a few rows.
    quick = {"spark__sql__codegen__wholeStage": "false", "spark__sql__shuffle__partitions": "3"}
    return local_session(4, "tests", spark__driver__memory="4g", **quick)
