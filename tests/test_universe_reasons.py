"""Universe rules on rows that carry score and flags: the same reasons as by the join, from one pass over the bars."""

from tickloom.checks import QUERIES
from tickloom.operators.portfolio import filter_universe, universe_reasons


def test_audit_reads_the_bars_once(spark, root):
    plan = QUERIES["universe_filter_audit"](spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # order lines and suppliers; before, the order lines twice


def test_reasons_match_the_joined_form(spark):
    rows = [(s, d, (s * 37 + d * 11) % 7 / 10.0, 100.0 * s, s % 4 == 0, s % 5 == 0, s % 6 == 0, s % 2 == 0) for s in range(1, 31) for d in range(3)]
    df = spark.createDataFrame(rows, "symbol long, trade_date int, score double, amount double, is_suspended boolean, is_limit_up boolean, high_chase boolean, is_st boolean")
    joined = filter_universe(df.select("symbol", "trade_date", "score"), df.drop("score"), "score", 500.0)
    pick = lambda x: sorted(map(tuple, x.select("symbol", "trade_date", "reason", "universe_pass").collect()))
    assert pick(universe_reasons(df, "score", 500.0)) == pick(joined)
