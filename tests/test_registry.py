"""The registry's contract with the driver: same column names and types on
both sides, and the double-rounding list in sync with the Spark schemas."""

import pytest
from pyspark.sql import types as T

from conftest import SF_SMALL
from rolloutlab.plans.catalog import ORACLES, QUERIES, RAW_QUERIES
from rolloutlab.plans.compare import duck
from rolloutlab.plans.float_columns import FLOAT_COLUMNS

DUCK_NAME = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
             T.BooleanType: "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_schema_contract(spark, con, name):
    schema = RAW_QUERIES[name](spark, SF_SMALL).schema
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    assert doubles == FLOAT_COLUMNS.get(name, [])
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        spark_types = {f.name: DUCK_NAME.get(type(f.dataType), f.dataType.simpleString()) for f in schema.fields}
        duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        assert spark_types == duck_types


def test_entry_module():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "prepare_prompts" in e.oracle_sql()
