"""Every registered query of the subpackage, against its SQL where there is one."""

import pytest

from gridquill.llm.oracles import ORACLES
from gridquill.llm.queries import QUERIES
from support import DATA, duck, rows, sql_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        assert rows(df) == sql_rows(duck(), ORACLES[name], sorted(df.columns))
    else:
        assert df.count() > 0
