from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marlstone.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark("4", shuffle_partitions=4, memory="4g")
