"""Every registered query of the light-curve library with SQL agrees with it; the others run and give rows."""

import pytest

from fluxloom import plans
from tests.oracle import rows_of, sql_rows

WITH_SQL = sorted(plans.oracle_sql())
MAY_BE_EMPTY = {"augment_ddf"}


@pytest.mark.parametrize("name", WITH_SQL)
def test_agrees_with_sql(spark, small, name):
    assert rows_of(plans.queries()[name](spark, small)) == sql_rows(plans.oracle_sql()[name], small)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(WITH_SQL)))
def test_runs(spark, small, name):
    assert plans.queries()[name](spark, small).count() > 0 or name in MAY_BE_EMPTY


def test_flagship(spark, small):
    assert plans.flagship(spark, small).count() == 15
