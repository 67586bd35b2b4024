"""Rows of tables move to the files they make, and are rendered there."""

from srcloom.sources import rendered
from srcloom.sources.corpora import code_files


def test_rows_move_instead_of_lines(spark, folder):
    plan = code_files(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan[plan.index("RepartitionByExpression") :]
    assert "makePart" in plan[: plan.index("RepartitionByExpression")] and "makePart" not in moved


def test_template_columns_are_bound_outside_quotes():
    assert rendered._bound("'k ''p'' k' || CAST(k % 7 AS STRING) || p", "l") == "'k ''p'' k' || CAST(l.k % 7 AS STRING) || l.p"
    assert rendered._bound("lang = 0 AND p % 3 = 0 AND 'lang' <> brand", "p") == "p.lang = 0 AND p.p % 3 = 0 AND 'lang' <> p.brand"
