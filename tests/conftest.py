import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rolloutlab.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 4, app_name="rolloutlab-tests")
    yield s


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
