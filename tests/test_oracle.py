"""Every registered query with a SQL twin gives the same rows at the smallest scale."""

import pytest

from check_oracle import compare, connect
from depotlens.plans import QUERIES
from depotlens.plans.registry import STEPS
from depotlens.sources.views import Domain
from depotlens.sources.views_sql import VIEWS, with_views

CHECKED = [n for n, q in QUERIES.items() if q.sql]


def no_all_pairs_join_and_no_row_udf(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan, bad


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, folder, name):
    verdict = compare(spark, con, QUERIES[name], folder, no_all_pairs_join_and_no_row_udf)
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("view", ["depots", "operations", "services", "absences", "health", "daily", "service_daily", "holidays",
                                  "lunar", "weather", "gold", "ledger", "sheet"])
def test_view_matches_sql(spark, con, folder, view):
    """The two statements of the domain mapping agree row for row."""
    df = getattr(Domain(spark, folder), view)
    cols = sorted(df.columns)
    got = sorted(str([r[c] for c in cols]) for r in df.collect())
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted(str(list(r)) for r in con.execute(with_views(f"SELECT {names} FROM {view}")).fetchall())
    assert got == want


def test_names_carry_their_id():
    assert all(n.split("_")[0][0].isupper() for n in QUERIES)
    assert not set(STEPS) & set(VIEWS)
