import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 4)


@pytest.fixture
def lake(spark, tmp_path):
    from terrace.sources.lake import Lake

    return Lake(spark, str(tmp_path / "lake"))


SF = "/root/testdata/sf0.001"
