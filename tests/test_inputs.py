"""Budgets of the extraction input and the ids of a digest on small tables."""

from datetime import date

from folioscope.operators import insights as ins

A = "The first risk is that demand for our products may fall."
B = "The second risk, which is much longer than the others, is that a supplier of parts may fail us."
C = "The third risk is that a court may rule against us."


def test_budgets_stop_or_pass_over(spark):
    df = spark.createDataFrame([("\n".join([A, B, C, A]),), ("",), (None,)], "text string")
    room = len(A) + 3 + len(C)
    got = df.select(ins.prose("text", room).alias("p"), ins.risk_outline("text", room).alias("o")).collect()
    assert got[0].p == A                            # the second line ends the text
    assert got[0].o == f"- {A}\n- {C}"              # the second title is passed over, the first stands once
    assert got[1].p == "" and got[1].o == ""


def test_input_of_filings(spark):
    companies = spark.createDataFrame([(1, "Acme", "ACM", None)], "company_id long, name string, ticker string, reporting_currency string")
    filings = spark.createDataFrame(
        [(10, 1, "10-K", 2023, "FY", date(2023, 12, 31), True), (11, 1, "10-K", 2024, "FY", date(2024, 12, 31), True), (12, 1, "10-Q", 2025, "Q1", date(2025, 3, 31), False)],
        "filing_id long, company_id long, form_type string, fiscal_year int, fiscal_period string, period_end date, is_annual boolean")
    sections = spark.createDataFrame(
        [(10, "risk_factors", 1, A), (11, "risk_factors", 2, C), (11, "risk_factors", 1, A), (11, "business", 1, "We make parts."), (11, "other", 1, "Nothing.")],
        "filing_id long, category string, ordinal int, text string")
    bases = spark.createDataFrame([(11, 10), (10, 9)], "filing_id long, base_filing_id long")
    got = {r.filing_id: r.text for r in ins.extraction_inputs(companies, filings, sections, bases).collect()}
    assert got[11] == (
        "COMPANY: Acme (ACM). FILING: 10-K for FY2024, period ended 2024-12-31. Reporting currency: unknown.\n\n=== BUSINESS DESCRIPTION ===\nWe make parts.\n\n"
        f"=== RISK FACTORS: OUTLINE ===\n- {A}\n- {C}\n\n=== NEW OR CHANGED RISK FACTORS (since the 10-K for FY2023) ===\n[new] {C}")
    assert got[10].endswith(f"=== RISK FACTORS: OUTLINE ===\n- {A}")
    assert got[12].endswith("Reporting currency: unknown.")
