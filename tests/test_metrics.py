from datetime import date

from pyspark.sql import functions as F

from folioscope.functions import periods
from folioscope.plans import metrics

SCHEMA = ("company_id long, canonical_metric string, fiscal_year int, fiscal_period string, value double, period_start date, "
          "period_end date, filing_date date, fact_id string")


def row(metric, year, period, value, start, end, filed=date(2026, 3, 1), fact="a", company=1):
    return (company, metric, year, period, value, start, end, filed, fact)


def cells(spark, rows):
    df = metrics.discrete(metrics.fiscal_spread(metrics.metric_slots(spark.createDataFrame(rows, SCHEMA))))
    return {(r.canonical_metric, r.fiscal_year, r.period): (r.value, r.derived) for r in df.collect()}


def test_quarters_come_from_year_to_date(spark):
    y = 2025
    got = cells(spark, [
        row("operating_cash_flow", y, "Q1", 10.0, date(y, 1, 1), date(y, 3, 31)), row("operating_cash_flow", y, "H1", 25.0, date(y, 1, 1), date(y, 6, 30)),
        row("operating_cash_flow", y, "9M", 45.0, date(y, 1, 1), date(y, 9, 30)), row("operating_cash_flow", y, "FY", 70.0, date(y, 1, 1), date(y, 12, 31)),
        row("eps_diluted", y, "Q1", 1.0, date(y, 1, 1), date(y, 3, 31)), row("eps_diluted", y, "H1", 2.5, date(y, 1, 1), date(y, 6, 30)),
        row("cash", y, "FY", 99.0, None, date(y, 12, 31))])
    assert got[("operating_cash_flow", y, "Q2")] == (15.0, True)
    assert got[("operating_cash_flow", y, "Q3")] == (20.0, True)
    assert got[("operating_cash_flow", y, "Q4")] == (25.0, True)
    assert got[("operating_cash_flow", y, "H2")] == (45.0, True)
    assert ("eps_diluted", y, "Q2") not in got
    assert got[("cash", y, "Q4")] == (99.0, False)


def test_restated_value_of_the_latest_filing_wins(spark):
    span = (date(2024, 1, 1), date(2024, 12, 31))
    got = cells(spark, [row("revenue", 2024, "FY", 100.0, *span, filed=date(2025, 2, 1)),
                        row("revenue", 2024, "FY", 90.0, *span, filed=date(2026, 2, 1), fact="b")])
    assert got[("revenue", 2024, "FY")] == (90.0, False)


def test_table_ratios_and_growth(spark):
    rows = []
    for y, revenue, capex in ((2023, 80.0, -5.0), (2025, 120.0, 6.0)):
        span = (date(y, 1, 1), date(y, 12, 31))
        rows += [row("revenue", y, "FY", revenue, *span), row("operating_cash_flow", y, "FY", 30.0, *span), row("capex", y, "FY", capex, *span),
                 row("cost_of_revenue", y, "FY", 60.0, *span), row("net_income", y, "FY", -4.0, *span)]
    table = metrics.financial_table(metrics.column_table(spark.createDataFrame(rows, SCHEMA)))
    got = {(r.fiscal_year, r.row_key): r.value for r in table.collect()}
    assert got[(2023, "free_cash_flow")] == 25.0          # cash spent is deducted whatever its sign
    assert got[(2025, "gross_margin")] == 0.5
    assert (2025, "revenue_growth") not in got             # 2024 is missing: growth is never taken across a gap
    assert (2025, "cash_conversion") not in got            # a loss makes the ratio meaningless
    assert got[(2025, "net_margin")] == -4.0 / 120.0


def test_period_months_and_fiscal_labels(spark):
    df = spark.createDataFrame([
        (date(2025, 1, 27), date(2025, 4, 27), date(2025, 1, 27)), (date(2025, 1, 27), date(2026, 1, 25), date(2025, 1, 27)),
        (None, date(2025, 7, 27), date(2025, 1, 27)), (date(2025, 1, 27), date(2025, 7, 27), date(2025, 1, 27)),
        (date(2024, 1, 29), date(2025, 1, 26), date(2025, 1, 27))], "s date, e date, fy date")
    got = [tuple(r) for r in df.select(
        periods.period_months("s", "e"), periods.fiscal_period("fy", "s", "e"), periods.fiscal_year("fy", F.lit(2026), "e")).collect()]
    assert got == [(3, "Q1", 2026), (12, "FY", 2026), (None, "Q2", 2026), (6, "H1", 2026), (12, "FY", 2025)]


def test_year_end_text(spark):
    df = spark.createDataFrame([("--01-31",), ("1/31",), ("December 31",), ("soon",)], "t string")
    assert [r[0] for r in df.select(periods.year_end_mmdd("t")).collect()] == ["01-31", "01-31", "12-31", None]
