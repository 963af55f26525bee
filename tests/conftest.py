import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from seriesforge.sources.session import local_session
    from seriesforge.sources.shipping import ship_package

    return ship_package(local_session(4, "3g"))


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
