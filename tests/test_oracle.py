"""Every registered query against its DuckDB oracle (order-insensitive), and
every rows-only query at least runs. Uses the smallest driver tables."""

import pytest

from rolloutlab.plans.catalog import ORACLES, QUERIES
from rolloutlab.plans.compare import compare, duck

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_SMALL)
    assert res["status"] in ("match", "rows-only"), res


def test_every_survey_group_is_covered():
    from rolloutlab.plans.registry import OPERATOR_IDS
    ids = {i for v in OPERATOR_IDS.values() for i in v}
    expected = ({f"S{i}" for i in range(1, 7)} | {f"P{i}" for i in range(1, 10)} | {"F1", "F2", "F3"}
                | {f"J{i}" for i in range(1, 8)} | {f"A{i}" for i in range(1, 9)} | {f"W{i}" for i in range(1, 6)}
                | {"D1", "D2", "D3", "G1"} | {f"X{i}" for i in range(1, 14)} | {f"K{i}" for i in range(1, 5)}
                | {f"R{i}" for i in range(1, 6)} | {f"V{i}" for i in range(1, 25)} | {f"N{i}" for i in range(1, 8)}
                | {"M1", "M2", "M3"} | {"ST1", "ST2", "ST3"} | {"U1", "U2"})
    assert expected - ids == set()
