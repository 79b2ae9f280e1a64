"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from check import as_rows, connect
from tallyframe.catalog import COVERAGE, ORACLES, QUERIES

# Inventory entries without a query of their own: an error raised by the reader
# (S8), a path text built on the driver (B5), and per-row loops, which are
# column expressions in every other query (UD4).
WITHOUT_QUERY = {"S8", "B5", "UD4"}
INVENTORY = (
    [f"S{i}" for i in range(1, 9)] + [f"C{i}" for i in range(1, 9)] + [f"P{i}" for i in range(1, 7)]
    + [f"F{i}" for i in range(1, 6)] + [f"I{i}" for i in range(1, 5)] + ["U1", "U2"] + [f"J{i}" for i in range(1, 7)]
    + [f"A{i}" for i in range(1, 17)] + [f"G{i}" for i in range(1, 16)] + [f"W{i}" for i in range(1, 7)]
    + [f"O{i}" for i in range(1, 6)] + ["X1", "X2", "X3", "N1", "N2", "N3", "D1", "D2", "D3", "D4"]
    + ["B1", "B2", "B3", "B4", "B5", "R1", "M1", "M2", "M3"] + [f"V{i}" for i in range(1, 7)]
    + [f"E{i}" for i in range(1, 9)] + [f"Z{i}" for i in range(6)] + ["K0", "K1", "K2", "K3a", "K3b", "K3c"]
    + ["H1", "H2", "H3"] + [f"L{i}" for i in range(1, 11)] + [f"Q{i}" for i in range(1, 11)]
    + [f"Y{i}" for i in range(1, 11)] + ["UD1", "UD2", "UD3", "UD4"]
)


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, con, small_dir):
    df = QUERIES[name](spark, small_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    columns, rows = as_rows(df.columns, df.collect())
    assert rows or name in ORACLES
    if name in ORACLES:
        cursor = con.execute(ORACLES[name])
        want_columns, want = as_rows([d[0] for d in cursor.description], cursor.fetchall())
        assert columns == want_columns
        assert rows == want


def test_every_inventory_entry_has_a_query():
    assert set(INVENTORY) - set(COVERAGE) == WITHOUT_QUERY
    assert set(COVERAGE) <= set(INVENTORY)
