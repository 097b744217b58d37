"""Every registered query agrees with its DuckDB oracle (sf0.001), and the
smoke entry runs."""

import os

import pytest

from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_all_queries_match_oracles(spark):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    con = duck(SF)
    bad = []
    for k in qs:
        if k in orc:
            ok, msg = compare(spark, con, k, qs[k], orc[k], SF)
            if not ok:
                bad.append(msg)
        else:
            qs[k](spark, SF).count()
    assert not bad, "\n".join(bad)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "document" in df.columns
