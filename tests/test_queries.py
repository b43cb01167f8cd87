"""Every query against its SQL; those without SQL give rows. EMPTY lists the ones that find nothing in these tables."""

import pytest
from conftest import SF
from oracle import check

from quillon.plans.registry import ORACLES, QUERIES

EMPTY: set[str] = {"j05_containment", "u02_difference", "k14_page_range", "j13_prefix_fallback", "l01_visible_limit"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    n = check(df, ORACLES[name], duck) if name in ORACLES else df.count()
    assert n > 0 or name in EMPTY
