import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from casebook.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("tallyhouse-tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
