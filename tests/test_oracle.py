import os

import pytest

from chandas.plans import nested, reference

from . import oracle

QUERIES, SQL = {**nested.QUERIES, **reference.QUERIES}, {**nested.SQL, **reference.SQL}


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(SQL) - {"verse_documents_read"}))  # slow to build: the session's tests read documents back
def test_same_rows(spark, name):
    # some fields of the alignment only occur in the larger tables
    oracle.same_rows(spark, QUERIES[name], SQL[name], oracle.SF.replace("0.001", "0.01") if name == "p5_alignment" else None)


def test_entry_has_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
