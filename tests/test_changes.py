from datetime import date

from pyspark.sql import functions as F

from folioscope.functions.score import with_score
from folioscope.operators import numeric_changes as nc
from folioscope.operators import renames

FACT = ("company_id long, filing_id long, filing_date date, fact_id string, canonical_metric string, fact_key string, category string, "
        "label string, xbrl_concept string, value double, normalized_unit string, currency string, period_type string, period_start date, "
        "period_end date, fiscal_year int, fiscal_period string, period_months int, is_comparative boolean, triggers array<string>")
FILING = "company_id long, filing_id long, form_type string, filing_date date, period_end date, fiscal_year int, fiscal_period string, is_annual boolean"
FILINGS = [(1, 1, "10-Q", date(2025, 11, 20), date(2025, 10, 26), 2026, "Q3", False), (1, 2, "10-K", date(2026, 2, 20), date(2026, 1, 25), 2026, "FY", True),
           (1, 3, "10-Q", date(2026, 5, 20), date(2026, 4, 26), 2027, "Q1", False), (1, 4, "10-Q", date(2026, 8, 20), date(2026, 7, 26), 2027, "Q2", False)]


def fact(filing, key, value, end, category="commitment", start=None, months=None, comparative=False, unit="currency", concept="us-gaap:OtherCommitment"):
    f = FILINGS[filing - 1]
    return (1, filing, f[3], f"{filing}-{key}-{end}-{start}", None, key, category, key, concept, float(value), unit, "USD",
            "instant" if start is None else "duration", start, end, f[5], f[6], months, comparative, [])


def changes(spark, facts, filings=FILINGS):
    out = nc.numeric_changes(spark.createDataFrame(facts, FACT), spark.createDataFrame(filings, FILING))
    return {r.fact_key: r for r in out.collect()}


def test_balance_against_previous_report_and_annual(spark):
    ends = [f[4] for f in FILINGS]
    got = changes(spark, [fact(2, "commitment.a.supply", 95.2, ends[1]), fact(3, "commitment.a.supply", 119, ends[2]), fact(4, "commitment.a.supply", 279, ends[3]),
                          fact(3, "commitment.a.cloud", 27, ends[2]), fact(4, "commitment.a.cloud", 26.5, ends[3]),
                          fact(4, "guarantee.a.lease", 105, ends[3], category="guarantee")])
    supply = got["commitment.a.supply"]
    assert (supply.base_value, supply.annual_value, supply.comparison, supply.change_type) == (119.0, 95.2, "sequential", "changed")
    assert abs(supply.change - 160 / 119) < 1e-12
    assert got["commitment.a.cloud"].change_type == "repeated"
    assert got["guarantee.a.lease"].change_type == "new"


def test_flow_prefers_the_quarter_with_a_year_earlier_match(spark):
    facts = [fact(4, "investment.g", 30, date(2026, 7, 26), "investment", date(2026, 4, 27), 3), fact(4, "investment.g", 42.4, date(2026, 7, 26), "investment", date(2026, 1, 26), 6),
             fact(4, "investment.g", 1, date(2025, 7, 27), "investment", date(2025, 4, 28), 3, True), fact(4, "investment.g", 0, date(2025, 7, 27), "investment", date(2025, 1, 27), 6, True),
             fact(4, "investment.z", 4, date(2026, 7, 26), "investment", date(2026, 4, 27), 3), fact(4, "investment.z", 0, date(2025, 7, 27), "investment", date(2025, 4, 28), 3, True)]
    got = changes(spark, facts)
    assert (got["investment.g"].value, got["investment.g"].base_value) == (30.0, 1.0)
    assert (got["investment.z"].change_type, got["investment.z"].change) == ("changed", None)


def test_a_line_missing_after_an_annual_base_is_not_removed(spark):
    line = fact(2, "debt.a.notes", 5, date(2026, 1, 25), "debt")
    assert "debt.a.notes" not in changes(spark, [line], FILINGS[:3])
    interim = fact(3, "debt.a.notes", 5, date(2026, 4, 26), "debt")
    assert changes(spark, [interim])["debt.a.notes"].change_type == "removed"


def test_anonymous_customers_are_compared_as_a_set(spark):
    def share(filing, letter, value):
        return fact(filing, f"customer_concentration.concentration_risk_percentage.revenue.customer_{letter}", value, FILINGS[filing - 1][4],
                    "customer_concentration", unit="ratio")
    rows = [share(3, c, v) for c, v in zip("abc", (.30, .18, .16))] + [share(4, c, v) for c, v in zip("abcd", (.22, .14, .13, .11))]
    from folioscope.operators.filings import report_bases
    got = nc.share_sets(spark.createDataFrame(rows, FACT), report_bases(spark.createDataFrame(FILINGS, FILING))).collect()
    assert len(got) == 1 and (got[0]["count"], got[0].base_count, got[0].change_type) == (4, 3, "changed")
    assert abs(got[0].change + 0.08) < 1e-12


def score(spark, **values):
    base = {"category": "commitment", "change_type": "changed", "unit": "currency", "amount": None, "base_amount": None, "change": None, "currency": "USD",
            "by_delta": False, "balance": True, "trigger_weight": 0.0, "anchor_currency": "USD", "anchor_revenue": 100e9,
            "anchor_operating_income": 40e9, "anchor_total_assets": 200e9, "anchor_bank": False, **values}
    types = ("category string, change_type string, unit string, amount double, base_amount double, change double, currency string, by_delta boolean, "
             "balance boolean, trigger_weight double, anchor_currency string, anchor_revenue double, anchor_operating_income double, "
             "anchor_total_assets double, anchor_bank boolean")
    df = spark.createDataFrame([tuple(base.values())], types)
    df = df.withColumn("trigger_phrases", F.array().cast("array<string>")).withColumn("flags", F.array().cast("array<string>"))
    return with_score(df).collect()[0]


def test_a_large_new_guarantee_is_top(spark):
    r = score(spark, category="guarantee", change_type="new", amount=105e9)
    assert (r.score, r.tier) == (1.0, "top") and "new in this filing" in r.reasons


def test_concentration_is_in_points(spark):
    r = score(spark, category="customer_concentration", unit="ratio", amount=.22, base_amount=.30, change=-.08)
    assert "-8.0 pts" in r.reasons


def test_a_large_percentage_of_a_small_amount_is_damped(spark):
    r = score(spark, amount=2e6, base_amount=1e6, change=1.0)
    assert abs(r.components.change - 0.3) < 1e-9


def test_renames_one_to_one_and_chains(spark):
    old = [(1, 3, date(2026, 5, 1), None, "commitment.c.supply", "commitment", 119.0, "USD", None, date(2026, 4, 26), False)]
    new = [(1, 4, date(2026, 8, 1), None, "commitment.c.supply_and_capacity", "commitment", 119.0, "USD", None, date(2026, 4, 26), True),
           (1, 4, date(2026, 8, 1), None, "commitment.c.supply_and_capacity", "commitment", 279.0, "USD", None, date(2026, 7, 26), False)]
    schema = ("company_id long, filing_id long, filing_date date, canonical_metric string, fact_key string, category string, value double, currency string, "
              "period_start date, period_end date, is_comparative boolean")
    got = renames.bridged_by_value(spark.createDataFrame(old + new, schema)).collect()
    assert [(r.old_key, r.new_key) for r in got] == [("commitment.c.supply", "commitment.c.supply_and_capacity")]
    links = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "x", "y"), (1, "y", "x")], "company_id long, old_key string, new_key string")
    assert {r.old_key: r.newest_key for r in renames.newest_keys(links).collect()} == {"a": "c", "b": "c", "x": "y", "y": "x"}


def test_long_chains_and_cycles(spark):
    import random
    rng = random.Random(2)
    chain = [(1, f"k{i}", f"k{i + 1}") for i in range(1000)]
    ring = [(2, f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(2, f"t{i}", f"t{i + 1}" if i < 20 else "r3") for i in range(21)] + [(2, "own", "own")]
    wild = [(3, str(i), str(rng.randrange(60))) for i in range(50)]
    links = chain + ring + wild
    got = {(r.company_id, r.old_key): r.newest_key for r in renames.newest_keys(
        spark.createDataFrame(links, "company_id long, old_key string, new_key string")).collect()}
    step = {(c, a): b for c, a, b in links}
    want = {}
    for c, a, _ in links:
        seen = [a]
        while (c, seen[-1]) in step and step[c, seen[-1]] not in seen:
            seen.append(step[c, seen[-1]])
        want[c, a] = seen[-1]
    assert got == want
    assert renames.newest_keys(spark.createDataFrame([], "company_id long, old_key string, new_key string")).count() == 0
