"""Materiality of a change: weighted components, bonuses, tier and reasons."""

from functools import reduce

from pyspark.sql import functions as F

from . import fixed_values as fv
from .arith import col, lookup, ratio


def curve(r):
    """0 at nothing, 0.7 at the threshold, 1.0 at twice the threshold."""
    return F.when(r <= 1, r * 0.7).otherwise(F.least(F.lit(1.0), (r - 1) * 0.3 + 0.7))


def anchor_shares(basis, balance):
    """[(anchor name, share of the amount, share over its threshold)], NULL where the anchor does not apply."""
    amount = F.abs(basis)
    bank_balance = F.col("anchor_bank") & balance
    revenue = F.when(~bank_balance, F.col("anchor_revenue"))
    operating = F.when(~bank_balance & F.coalesce(F.col("anchor_revenue") != 0, F.lit(False)), F.greatest(
        F.abs(F.col("anchor_operating_income")), F.abs(F.col("anchor_revenue")) * 0.02))
    operating = F.when(F.col("anchor_operating_income").isNotNull(), operating)
    shares = {"revenue": ratio(amount, F.abs(revenue)), "operating_income": ratio(amount, operating),
              "total_assets": ratio(amount, F.abs(F.col("anchor_total_assets")))}
    return [(name, share, share / F.lit(fv.SHARE_THRESHOLDS[name])) for name, share in shares.items()]


def percent_text(value):
    return F.when(F.abs(value) >= 0.01, F.format_string("%.0f%%", value * 100)).otherwise(
        F.format_string("%.1f%%", value * 100))


def with_score(df):
    """Adds ``score``, ``tier``, ``components`` and ``reasons`` to candidate rows.

    Candidates carry category, change_type, unit, amount, base_amount, change,
    currency, trigger_phrases / trigger_weight, flags, by_delta, balance, and the
    company's anchors (anchor_currency, anchor_revenue, anchor_operating_income,
    anchor_total_assets, anchor_bank).
    """
    amount, base, change = F.col("amount"), F.col("base_amount"), F.col("change")
    unit, kind, usd = F.col("unit"), F.col("change_type"), F.coalesce(F.col("currency") == "USD", F.lit(False))
    money = (unit == "currency") & amount.isNotNull()
    by_delta = (F.col("by_delta") | (F.col("anchor_bank") & F.col("balance"))) & base.isNotNull()
    basis = F.when(by_delta, amount - base).otherwise(amount)
    same_currency = F.col("anchor_currency").eqNullSafe(F.col("currency"))
    shares = [(n, F.when(same_currency, s), F.when(same_currency, t)) for n, s, t in anchor_shares(basis, F.col("balance"))]
    largest = F.greatest(*[t for _, _, t in shares])
    points = unit.isin("points", "days")
    step = F.when(unit == "days", F.lit(float(fv.DAYS_THRESHOLD))).otherwise(F.lit(fv.POINTS_THRESHOLD))
    magnitude = (
        F.when(money, F.coalesce(curve(largest), F.lit(0.0)))
        .when((unit == "ratio") & amount.isNotNull(), curve(F.abs(amount) / F.lit(fv.CONCENTRATION_THRESHOLD)))
        .when(points & change.isNotNull(), curve(F.abs(change) / step))
        .otherwise(0.0))

    delta = F.abs(amount - F.coalesce(base, F.lit(0.0)))
    big = (same_currency & F.coalesce(F.col("anchor_revenue") != 0, F.lit(False))
           & (delta >= F.abs(F.col("anchor_revenue")) * fv.CHANGE_FLOOR_SHARE)) | (usd & (delta >= fv.CHANGE_FLOOR_USD))
    damp = F.when(money & ~F.coalesce(big, F.lit(False)), 0.3).otherwise(1.0)
    from_zero = change.isNull() & F.coalesce(base == 0, F.lit(False))
    moved = (
        F.when(kind == "new", 1.0).when(kind == "removed", 0.6)
        .when((kind == "changed") & change.isNotNull() & unit.isin("points", "days", "ratio"), curve(F.abs(change) / step))
        .when((kind == "changed") & from_zero, damp)
        .when((kind == "changed") & change.isNotNull(), curve(F.abs(change) / F.lit(0.5)) * damp)
        .when(kind == "changed", 0.5).otherwise(0.0))
    strategic = lookup(fv.STRATEGIC, "category", 0.5)
    language = F.coalesce(F.col("trigger_weight"), F.lit(0.0))
    novelty = lookup(fv.NOVELTY, "change_type", 0.0)

    phrases = F.coalesce(F.col("trigger_phrases"), F.array().cast("array<string>"))
    flags = F.coalesce(F.col("flags"), F.array().cast("array<string>"))
    raised = {
        "subsequent_event": F.array_contains(flags, "subsequent_event"),
        "new_guarantee": ((kind == "new") & (F.col("category") == "guarantee")) | F.array_contains(flags, "new_guarantee"),
        "new_financing": F.array_contains(flags, "new_financing"),
        "hypothetical_to_realized": F.array_contains(flags, "hypothetical_to_realized"),
        "material_weakness": F.array_contains(phrases, "material weakness") | F.array_contains(flags, "material_weakness"),
        "critical_audit_matter": F.array_contains(phrases, "critical audit matter") | F.array_contains(flags, "critical_audit_matter"),
        "over_10b": money & usd & (F.abs(basis) >= fv.OVER_10B),
    }
    bonus = reduce(lambda a, b: a + b, [F.when(F.coalesce(on, F.lit(False)), fv.FLAG_BONUS[f]).otherwise(0.0) for f, on in raised.items()])

    parts = {"magnitude": magnitude, "change_part": moved, "strategic": strategic, "language": language, "novelty": novelty}
    weights = dict(zip(parts, fv.SCORE_WEIGHTS.values()))
    out = df.withColumns({**{f"_{k}": v for k, v in parts.items()}, "_bonus": bonus, "_basis": basis})
    total = reduce(lambda a, b: a + b, [F.col(f"_{k}") * weights[k] for k in parts]) + F.col("_bonus")
    out = out.withColumn("score", F.round(F.least(F.lit(1.0), total), 3))
    out = out.withColumn("tier", F.when(F.col("score") >= fv.TIER_TOP, "top").when(F.col("score") >= fv.TIER_NOTABLE, "notable")
                         .otherwise("background"))
    of_anchor = F.lit(None).cast("string")
    for name, share, over in reversed(shares):
        what = F.when(by_delta, "a change of ").otherwise("")
        of_anchor = F.when(over == largest, F.when(over >= 0.5, F.concat(
            what, percent_text(share), F.lit(f" of {name.replace('_', ' ')}")))).otherwise(of_anchor)
    change_reason = (
        F.when(kind == "new", "new in this filing").when(kind == "removed", "no longer disclosed")
        .when((kind == "changed") & (unit == "days"), F.format_string("%+.0f days", change))
        .when((kind == "changed") & unit.isin("points", "ratio"), F.format_string("%+.1f pts", change * 100))
        .when((kind == "changed") & from_zero, "from zero")
        .when((kind == "changed") & (F.abs(change) >= 0.1), F.format_string("%+.0f%%", change * 100)))
    quoted = F.transform(F.slice(phrases, 1, 2), lambda p: F.concat(F.lit("“"), p, F.lit("”")))
    reasons = F.array_compact(F.array(
        F.when(money, of_anchor), change_reason,
        F.when(F.size(phrases) > 0, F.concat(F.lit("mentions "), F.array_join(quoted, ", "))),
        F.when(F.array_contains(flags, "subsequent_event"), "subsequent event"),
        F.when(F.array_contains(flags, "hypothetical_to_realized"), "was hypothetical, now described as having happened")))
    components = F.struct(F.col("_magnitude").alias("magnitude"), F.col("_change_part").alias("change"),
                          F.col("_strategic").alias("strategic"), F.col("_language").alias("language"),
                          F.col("_novelty").alias("novelty"), F.col("_bonus").alias("bonus"))
    return out.withColumns({"components": components, "reasons": reasons}).drop(*[f"_{k}" for k in parts], "_bonus", "_basis")


def stable_id(kind, category, key_or_label, text):
    """A change's identity across rebuilds."""
    basis = F.concat_ws("|", col(kind), col(category), col(key_or_label), F.coalesce(col(text), F.lit("")))
    return F.substring(F.sha1(basis), 1, 16)
