import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from churnlens.config import ChurnConfig  # noqa: E402
from churnlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="churnlens-tests")
    yield s


@pytest.fixture(scope="session")
def cfg():
    return ChurnConfig(close_date=dt.date(2024, 12, 31), cut_date=dt.date(2024, 6, 30), materialize=False)


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)
