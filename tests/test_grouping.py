import random

from folioscope.functions import fixed_values as fv
from folioscope.operators import grouping


def brute(rows, floor):
    """Groups one change after the other: {change: lead}."""
    leads, homes = [], {}
    for r in sorted(rows, key=lambda r: (r["kind"] == "narrative", -r["score"], r["change_id"])):
        text, money = r["kind"] == "narrative", r["unit"] == "currency" and r["kind"] == "numeric"
        amount = r["value"] if (text or money) and r["value"] and abs(r["value"]) >= floor else None

        def fits(lead):
            if lead["currency"] != r["currency"]:
                return False
            if r["first_itemized"]:
                return r["first_itemized"] == lead["first_itemized"]
            own = [v for v in (lead["value"], lead["base_value"]) if v] if lead["unit"] == "currency" and lead["kind"] == "numeric" else []
            about = bool(words(lead["label"]) & words(r["text"])) if text else (lead["category"], lead["change_type"]) == (r["category"], r["change_type"])
            return amount is not None and about and any(abs(amount - v) <= fv.GROUP_TOLERANCE * max(abs(amount), abs(v)) for v in own)

        home = next((lead["change_id"] for lead in leads if fits(lead)), None)
        if home is None:
            home = r["change_id"]
            if not text:
                leads.append(r)
        homes[r["change_id"]] = home
    return homes


def words(text):
    return {w[:6] for w in (text or "").lower().split() if len(w) >= 5}


def changes_of(rng, n):
    """Changes in chains of amounts, each within the tolerance of the next but not of the one behind."""
    base = [1e9 * 1.004 ** i for i in range(12)] + [-1e9, 5e9, 1.0, None, 0.0]
    return [{
        "change_id": f"c{i:03}", "kind": rng.choice(["numeric", "numeric", "numeric", "derived", "narrative"]), "category": rng.choice(["debt", "guarantee"]),
        "change_type": rng.choice(["new", "changed"]), "label": rng.choice(["guarantee line", "borrowings", "xx"]), "text": rng.choice(["Guarantee given", "borrow", None]),
        "value": rng.choice(base), "base_value": rng.choice(base), "unit": rng.choice(["currency", "currency", "ratio"]), "currency": rng.choice(["USD", "USD", "EUR"]),
        "score": rng.choice([0.9, 0.7, 0.7, 0.2]), "tier": "background", "reasons": [f"r{i % 3}", "same"],
        "first_itemized": rng.choice([None, None, None, "bonds", "notes"])} for i in range(n)]


def test_rounds_come_to_the_same_as_one_change_after_the_other(spark):
    rng = random.Random(11)
    companies = {c: changes_of(rng, rng.choice([1, 5, 40, 90])) for c in range(12)}
    for rows in companies.values():
        for r in rows:
            if r["kind"] == "narrative":
                r["first_itemized"] = None
    schema = ("company_id long, change_id string, kind string, category string, change_type string, label string, text string, value double, base_value double, "
              "unit string, currency string, score double, tier string, reasons array<string>, first_itemized string")
    names = [f.split()[0] for f in schema.split(", ")[1:]]
    changes = spark.createDataFrame([(c, *[r[n] for n in names]) for c, rows in companies.items() for r in rows], schema)
    revenue = spark.createDataFrame([(c, 1e8) for c in companies if c], "company_id long, revenue double")
    got = grouping.grouped(changes, revenue).collect()
    for c, rows in companies.items():
        want = brute(rows, 1e8 * fv.GROUP_FLOOR_SHARE if c else 0.0)
        assert {r.change_id: r.group_id for r in got if r.company_id == c} == want
        by_id = {r["change_id"]: r for r in rows}
        for r in got:
            if r.company_id == c:
                members = [by_id[i] for i, g in want.items() if g == r.group_id]
                assert r.members == len(members) and r.group_score == max(m["score"] for m in members)
                assert r.group_reasons[0] == by_id[r.group_id]["reasons"][0] and len(set(r.group_reasons)) == len(r.group_reasons)


def test_background_groups_are_trimmed_and_counted(spark):
    rows = [(1, f"c{i}", f"c{i}" if i % 2 else "c1", "new", 0.1, "background", ["x"], 1, i) for i in range(100)] + [(1, "t", "t", "changed", 0.9, "top", ["x"], 1, 0)]
    groups = spark.createDataFrame(rows, "company_id long, change_id string, group_id string, group_type string, group_score double, group_tier string, "
                                         "group_reasons array<string>, members int, group_place int")
    assert sorted(r.group_place for r in grouping.shown_groups(groups).collect()) == [0, *range(1, 80, 2)]
    counts = grouping.group_counts(groups).first()
    assert (counts.top, counts.background, counts.new, counts.changed, counts.hidden) == (1, 50, 50, 1, 10)
