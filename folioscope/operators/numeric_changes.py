"""What changed in the numbers: disclosed lines, ratios, removed lines, share sets, and their scored ranking.

Facts are first reduced to one row per (line, span) with partial aggregates.  What
is left of a line is bounded by the calendar, so its spans are gathered into one
array and compared inside the row: no self-joins over history.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.arith import ratio
from ..functions.periods import fiscal_label
from ..functions.score import with_score
from ..plans import metrics as tables
from .filings import report_bases
from .latest import latest_filed, pick

LINE = ["company_id", "line_key", "currency", "normalized_unit", "period_type"]
ROW = ["value", "label", "filing_id", "fact_id", "fiscal_year", "fiscal_period", "triggers", "xbrl_concept"]
ANONYMOUS = r"(?:^|_)(?:customer|client)_(?:[a-z]|\d+|one|two|three|four|five|six|seven|eight|nine|ten)$"


def with_bases(df, bases):
    """The company's report bases beside each row, flattened to what comparisons need."""
    flat = bases.select(
        "company_id", F.col("latest.filing_id").alias("latest_filing"), F.col("latest.is_annual").alias("latest_annual"),
        F.col("latest.period_end").alias("latest_end"), F.col("previous.filing_id").alias("previous_filing"),
        F.col("previous.period_end").alias("previous_end"), F.col("previous.is_annual").alias("previous_annual"),
        F.col("annual.filing_id").alias("annual_filing"), F.col("annual.period_end").alias("annual_end"))
    return df.join(flat, "company_id")


def followed(facts, aliases=None):
    """Rows worth comparing, under their newest key: headline metrics and disclosure families."""
    metric = F.col("canonical_metric")
    rows = facts.where(
        (metric.isin(fv.CHANGE_METRICS) | (metric.isNull() & F.col("category").isin(fv.FAMILY_KEYS)))
        & F.col("normalized_unit").isin("currency", "ratio"))
    if aliases is None:
        return rows.withColumn("line_key", F.col("fact_key"))
    names = aliases.select("company_id", F.col("old_key").alias("fact_key"), F.col("newest_key"))
    return rows.join(names, ["company_id", "fact_key"], "left").withColumn("line_key", F.coalesce("newest_key", "fact_key")).drop("newest_key")


def anonymous_basis():
    """'accounts receivable', 'revenue', ... for an anonymized customer's share, else NULL."""
    parts = F.slice(F.split("fact_key", r"\."), 3, 100)
    rest = F.array_join(F.filter(parts, lambda p: ~p.rlike(ANONYMOUS)), " ")
    return F.when(
        (F.col("category") == "customer_concentration") & (F.col("normalized_unit") == "ratio")
        & F.exists(parts, lambda p: p.rlike(ANONYMOUS)),
        F.when(rest.contains("receivable"), "accounts receivable").when(rest.rlike("revenue|sales"), "revenue")
        .when(rest.rlike("purchase|cost"), "purchases").otherwise("other"))


def line_spans(rows):
    """One row per (line, span): the latest filed value, the latest report's own, and what else exists."""
    packed = F.struct(*ROW)
    order = F.struct("filing_date", "fact_id")
    current = (F.col("filing_id") == F.col("latest_filing")) & ~F.col("is_comparative")
    removed_base = F.when(F.col("latest_annual"), F.col("annual_filing")).otherwise(
        F.when(~F.col("previous_annual"), F.col("previous_filing")))
    own_base = F.coalesce((F.col("filing_id") == removed_base) & ~F.col("is_comparative"), F.lit(False))
    company = ["latest_filing", "latest_annual", "latest_end", "previous_filing", "previous_end", "previous_annual",
               "annual_filing", "annual_end"]
    return rows.groupBy(*LINE, "period_start", "period_end").agg(
        F.max_by(packed, order).alias("row"),
        F.when(F.max(current.cast("int")) == 1, F.max_by(packed, F.when(current, order))).alias("current"),
        F.when(F.max(own_base.cast("int")) == 1, F.max_by(packed, F.when(own_base, order))).alias("own_base"),
        F.max((~current).cast("int")).alias("has_prior"),
        F.max((F.col("filing_id") == F.col("latest_filing")).cast("int")).alias("in_latest"),
        F.max("canonical_metric").alias("metric"),
        F.max("period_months").alias("months"), F.max("category").alias("category"),
        *[F.first(c).alias(c) for c in company])


def compare_lines(spans):
    """New, changed, repeated and removed lines of the latest report."""
    company = ["latest_filing", "latest_annual", "latest_end", "previous_filing", "previous_end", "previous_annual",
               "annual_filing", "annual_end"]
    span = F.struct("period_end", "period_start", "months", "row", "current", "own_base", "has_prior", "in_latest")
    lines = spans.groupBy(*LINE).agg(
        F.sort_array(F.collect_list(span)).alias("spans"), F.max("metric").alias("metric"),
        F.max("category").alias("family"), *[F.first(c).alias(c) for c in company])
    instant = F.col("period_type") == "instant"
    spans_ = F.col("spans")
    own = F.filter(spans_, lambda s: s.current.isNotNull())
    lines = lines.withColumn("own", own).withColumn("end", F.array_max(F.transform("own", lambda s: s.period_end)))

    # flows: the quarter first, then the longest span, the first that has a year-earlier match
    def year_earlier(s):
        match = F.filter(spans_, lambda b: b.months.eqNullSafe(s.months)
                         & (F.abs(F.datediff(s.period_end, b.period_end) - 365) <= 10))
        nearest = F.sort_array(F.transform(match, lambda b: F.struct(
            F.abs(F.datediff(s.period_end, b.period_end) - 365).alias("gap"), b.period_end.alias("period_end"), b.row.alias("row"))))
        return F.try_element_at(nearest, F.lit(1))

    at_end = F.filter("own", lambda s: s.period_end == F.col("end"))
    with_base = F.transform(at_end, lambda s: F.struct(
        s.current.alias("row"), s.months.alias("months"), s.period_end.alias("period_end"), year_earlier(s).alias("base")))
    flows = F.sort_array(F.transform(with_base, lambda s: F.struct(
        s.base.isNull().cast("int").alias("missing"),
        F.when(s.base.isNull(), 0).otherwise((~s.months.eqNullSafe(F.lit(3))).cast("int")).alias("longer"),
        (-F.coalesce(s.months, F.lit(0))).alias("length"),
        s.row.alias("row"), s.months.alias("months"), s.base.alias("base"))))
    lines = lines.withColumn("flow", F.when(~instant, F.try_element_at(flows, F.lit(1))))

    # balances: the value at the base report's date, else the latest earlier one
    base_end = F.when(F.col("latest_annual"), F.col("annual_end")).otherwise(F.col("previous_end"))
    at_base = F.try_element_at(F.filter(spans_, lambda s: s.period_end == base_end), F.lit(1))
    before = F.try_element_at(F.filter(spans_, lambda s: (s.has_prior == 1) & (s.period_end < F.col("end"))), F.lit(-1))
    lines = lines.withColumn("at_base", F.when(instant, at_base)).withColumn("before", F.when(instant, before))
    current = F.when(instant, F.try_element_at("own", F.lit(-1)).current).otherwise(F.col("flow.row"))
    base = F.when(instant, F.coalesce("at_base.row", "before.row")).otherwise(F.col("flow.base.row"))
    annual_row = F.try_element_at(F.filter(spans_, lambda s: s.period_end == F.col("annual_end")), F.lit(1)).row
    annual = F.when(instant & ~F.col("latest_annual") & base.isNotNull() & current.isNotNull(), annual_row)
    base_annual = F.when(F.col("latest_annual"), F.lit(True)).otherwise(F.col("previous_annual"))
    compared = F.when(current.isNull(), F.when(F.col("latest_annual"), "annual_vs_annual").otherwise("sequential")).when(
        ~instant, "year_over_year").when(
        F.col("at_base").isNotNull() & F.coalesce(base_annual, F.lit(False)),
        F.when(F.col("latest_annual"), "annual_vs_annual").otherwise("vs_annual")).otherwise("sequential")
    series = F.when(instant, spans_).otherwise(F.filter(spans_, lambda s: s.months.eqNullSafe(F.col("flow.months"))))
    points = F.transform(F.slice(series, F.greatest(F.lit(1), F.size(series) - 5), 6), lambda s: F.struct(
        s.period_end.alias("period_end"), s.row.value.alias("value")))
    lines = lines.withColumns({"cur": current, "base": base, "annual_row": annual, "comparison": compared, "series": F.when(current.isNotNull(), points)})

    now, then = F.col("cur.value"), F.col("base.value")
    has_prior = F.exists(spans_, lambda s: s.has_prior == 1)
    ratio_unit = F.col("normalized_unit") == "ratio"
    change = F.when(ratio_unit, now - then).otherwise(ratio(now - then, F.abs(then)))
    kind = (
        F.when(then.isNull(), F.when(~has_prior & F.col("previous_filing").isNotNull(), "new"))
        .when(ratio_unit, F.when(F.abs(change) >= fv.POINTS_NOISE, "changed").otherwise("repeated"))
        .when(then == 0, F.when(now != 0, "changed").otherwise("repeated"))
        .when(F.abs(change) >= fv.CHANGE_THRESHOLD, "changed").otherwise("repeated"))
    gone_from = F.try_element_at(F.filter(spans_, lambda s: s.own_base.isNotNull()), F.lit(-1)).own_base
    gone = (F.col("cur").isNull() & F.col("metric").isNull() & ~F.exists(spans_, lambda s: s.in_latest == 1))
    category = F.when(F.col("metric").isNotNull(), "financial_metric").otherwise(F.col("family"))
    lines = lines.withColumn("gone_from", F.when(gone, gone_from)).withColumn("category", category).withColumn(
        "change_type", F.when(F.col("cur").isNotNull(), kind).when(F.col("gone_from").isNotNull(), "removed")).where(
        F.col("change_type").isNotNull())
    removed = F.col("change_type") == "removed"
    flags = F.array_compact(F.array(
        F.when(F.array_contains("cur.triggers", "subsequent_event"), "subsequent_event"),
        F.when((F.col("category") == "debt") & (F.col("change_type") == "new"), "new_financing")))
    return lines.select(
        "company_id", F.lit("numeric").alias("kind"), "change_type", "category", F.coalesce("cur.label", "gone_from.label").alias("label"),
        "comparison", F.col("latest_filing").alias("filing_id"),
        F.when(removed, F.col("gone_from.filing_id")).otherwise(F.col("base.filing_id")).alias("base_filing_id"),
        F.col("line_key").alias("fact_key"), F.col("cur.fact_id").alias("fact_id"),
        F.coalesce("gone_from.fact_id", "base.fact_id").alias("base_fact_id"),
        F.coalesce("cur.xbrl_concept", "gone_from.xbrl_concept").alias("xbrl_concept"),
        now.alias("value"), F.coalesce("gone_from.value", "base.value").alias("base_value"),
        F.col("annual_row.value").alias("annual_value"),
        F.when(F.col("change_type").isin("changed", "repeated"), change).alias("change"),
        F.col("normalized_unit").alias("unit"), "currency", "period_type", "metric",
        F.when(~removed, fiscal_label(F.col("cur.fiscal_year"), F.col("cur.fiscal_period"))).alias("period_label"),
        F.when(removed, fiscal_label(F.col("gone_from.fiscal_year"), F.col("gone_from.fiscal_period")))
        .otherwise(fiscal_label(F.col("base.fiscal_year"), F.col("base.fiscal_period"))).alias("base_period_label"),
        flags.alias("flags"), "series")


def numeric_changes(facts, filings, aliases=None, bases=None):
    """Every numeric change of each company's latest report against its bases."""
    rows = with_bases(followed(facts, aliases), bases if bases is not None else report_bases(filings))
    return compare_lines(line_spans(rows.where(anonymous_basis().isNull())))


def first_itemized(changes, facts, bases):
    """Marks new lines under a concept the company never tagged before, three or more at once."""
    earlier = with_bases(facts.select("company_id", "xbrl_concept", "filing_id"), bases).where(
        F.col("filing_id") != F.col("latest_filing")).select("company_id", "xbrl_concept", F.lit(True).alias("_tagged")).distinct()
    keys = ["company_id", "category", "xbrl_concept", "currency"]
    # counted where the changes stand: joining their counts to them would compare all lines a second time
    rows = changes.join(earlier, ["company_id", "xbrl_concept"], "left")
    fresh = (F.col("change_type") == "new") & F.col("_tagged").isNull() & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counted = F.sum(F.when(fresh, 1)).over(Window.partitionBy(*keys))
    marked = F.when(fresh & (F.col("_n") >= fv.FIRST_ITEMIZED_MIN), F.col("_n"))
    rows = rows.withColumn("_n", counted).withColumn("itemized", marked).drop("_n", "_tagged")
    return rows.withColumn("first_itemized", F.when(F.col("itemized").isNotNull(), F.concat_ws(":", "category", "xbrl_concept")))


def stems(text):
    """Distinctive six-letter word stems."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{5,}"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(fv.GROUP_GENERIC_WORDS))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, 6)))


def possible_replacements(changes, limit=4):
    """For each removed line, up to four added ones of its category with the same concept or two shared stems.

    Matching goes through shared tokens (concept, stems), so only lines that have
    something in common ever meet.
    """
    token = F.explode(F.array_union(F.array(F.concat(F.lit("concept:"), F.col("xbrl_concept"))), stems(F.col("label"))))
    cols = ["company_id", "category"]
    lost = changes.where(F.col("change_type") == "removed").select(*cols, F.col("fact_key").alias("removed_key"), token.alias("token"))
    added = changes.where(F.col("change_type") == "new").select(
        *cols, F.col("fact_key").alias("added_key"), F.col("label").alias("added_label"), token.alias("token"))
    shared = lost.join(added, [*cols, "token"]).groupBy(*cols, "removed_key", "added_key", "added_label").agg(
        F.max(F.col("token").startswith("concept:").cast("int")).alias("same_concept"),
        F.sum((~F.col("token").startswith("concept:")).cast("int")).alias("shared_stems"))
    similar = shared.where((F.col("same_concept") == 1) | (F.col("shared_stems") >= 2))
    w = Window.partitionBy(*cols, "removed_key").orderBy("added_key")
    return similar.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def share_sets(facts, bases):
    """Anonymized customers' shares compared as a set: count, sorted list, top share, change."""
    rows = with_bases(facts.withColumn("basis", anonymous_basis()).where(F.col("basis").isNotNull()), bases)
    own = rows.where(~F.col("is_comparative"))
    keys = ["company_id", "basis", "filing_id"]
    months = F.coalesce("period_months", F.lit(0))
    at = own.groupBy(*keys).agg(F.max(F.struct("period_end", months.alias("months"))).alias("at"))
    kept = own.join(at, keys).where((F.col("period_end") == F.col("at.period_end")) & (months == F.col("at.months")))
    best = latest_filed(kept, [*keys, "fact_key"], columns=[
        *keys, "fact_key", "value", "filing_date", "fact_id", "period_end", "latest_filing", "latest_annual",
        "previous_filing", "annual_filing", "previous_annual"])
    sets = best.groupBy(*keys).agg(
        F.max("period_end").alias("period_end"), F.count(F.lit(1)).alias("n"), F.max("value").alias("top"),
        F.sum("value").alias("total"),
        *[F.first(c).alias(c) for c in ["latest_filing", "latest_annual", "previous_filing", "annual_filing", "previous_annual"]])
    primary = F.when(F.col("latest_annual"), F.col("annual_filing")).otherwise(F.col("previous_filing"))
    is_latest = F.col("filing_id") == F.col("latest_filing")
    order = F.struct((F.col("filing_id").eqNullSafe(primary)).cast("int"), "period_end", "filing_id")
    packed = F.struct("filing_id", "n", "top", "total", "period_end")
    out = sets.groupBy("company_id", "basis").agg(
        F.max_by(packed, F.when(is_latest, order)).alias("cur"), F.max(is_latest.cast("int")).alias("_cur"),
        F.max_by(packed, F.when(~is_latest, order)).alias("base"), F.max((~is_latest).cast("int")).alias("_base"))
    out = out.where(F.col("_cur") == 1).withColumn("base", F.when(F.col("_base") == 1, F.col("base")))
    change = F.col("cur.top") - F.col("base.top")
    kind = F.when(F.col("base").isNull(), "new").when(
        (F.abs(change) >= fv.POINTS_NOISE) | (F.col("cur.n") != F.col("base.n")), "changed").otherwise("repeated")
    return out.select(
        "company_id", "basis", F.col("cur.filing_id").alias("filing_id"), F.col("base.filing_id").alias("base_filing_id"),
        kind.alias("change_type"), F.col("cur.top").alias("value"), F.col("base.top").alias("base_value"), change.alias("change"),
        F.col("cur.n").alias("count"), F.col("base.n").alias("base_count"))


def derived_changes(rows, bases):
    """Ratios and day counts of the latest period against the year before.

    ``rows`` are the wide rows of ``plans.metrics.column_table``.
    """
    annual = bases.select("company_id", F.col("latest.is_annual").alias("latest_annual"), F.col("latest.filing_id").alias("filing_id"))
    kinds = rows.join(annual, "company_id")
    interim = F.when(F.col("interim_kind") == "half_yearly", F.col("period").startswith("H")).otherwise(F.col("period").startswith("Q"))
    eligible = tables.is_anchor_period() & F.when(F.col("latest_annual"), F.col("period") == "FY").otherwise(interim)
    current = pick(kinds.where(eligible), ["company_id"], ["fiscal_year", "period"])
    days = F.when(F.col("latest_annual"), F.lit(365.0)).otherwise(F.lit(91.25))

    def prior(m):
        return F.col(f"prior.{m}")

    def none(m):
        return F.lit(None).cast("double")

    out = current.withColumn("days", days)
    now = tables.general_values(days=F.col("days"))
    then = tables.general_values(at=prior, before=none, days=F.col("days"))
    bank_now = tables.bank_values()
    bank_then = tables.bank_values(at=prior, before=none, opening=F.lit(None).cast("double"))

    def cells(layout, a, b, bank):
        return [F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.lit(unit).alias("unit"),
                         F.when(F.col("is_bank") == bank, a[k]).alias("value"), b[k].alias("base_value"))
                for k, label, unit in layout if k != "roe"]

    def bridge_share(at):
        operating, pretax, net = at("operating_income"), at("pretax_income"), at("net_income")
        share = ratio(F.coalesce(at("nonoperating_income"), pretax - operating), pretax)
        return F.when(operating.isNotNull() & net.isNotNull() & (pretax > 0) & (F.abs(share) <= 1), share)

    revenue_growth = now["revenue_growth"]

    def outpaced(metric):
        pace = ratio(F.col(metric) - prior(metric), F.abs(prior(metric)))
        return F.when(pace - revenue_growth >= fv.WORKING_CAPITAL_SPREAD, pace)

    extra = [
        F.struct(F.lit("non_operating_share").alias("key"), F.lit("Non-operating income as % of pretax income").alias("label"),
                 F.lit("points").alias("unit"), F.when(~F.col("is_bank"), bridge_share(lambda m: F.col(m))).alias("value"),
                 bridge_share(prior).alias("base_value")),
        *[F.struct(F.lit(f"{m}_vs_revenue").alias("key"), F.lit(f"{name} growing faster than revenue").alias("label"),
                   F.lit("points").alias("unit"), F.when(~F.col("is_bank"), outpaced(m)).alias("value"),
                   revenue_growth.alias("base_value"))
          for m, name in (("accounts_receivable", "Receivables"), ("inventory", "Inventory"))]]
    general = cells(fv.DERIVED_RATIOS, now, then, False)
    bank = cells(fv.BANK_DERIVED_RATIOS, bank_now, bank_then, True)
    prior_opening = out  # return on equity needs the opening balance of both years
    long = prior_opening.select("company_id", "filing_id", "fiscal_year", "period", F.inline(F.array(*general, *bank, *extra)))
    delta = F.col("value") - F.col("base_value")
    noise = F.when(F.col("unit") == "days", F.lit(float(fv.DAYS_NOISE))).otherwise(F.lit(fv.POINTS_NOISE))
    return long.where(F.abs(delta) >= noise).select(
        "company_id", F.lit("derived").alias("kind"), F.lit("changed").alias("change_type"), F.lit("derived_metric").alias("category"),
        "label", F.lit("year_over_year").alias("comparison"), "filing_id",
        F.concat(F.lit("derived."), F.col("key")).alias("fact_key"), "value", "base_value", delta.alias("change"), "unit",
        fiscal_label(F.col("fiscal_year"), F.col("period")).alias("period_label"),
        fiscal_label(F.col("fiscal_year") - 1, F.col("period")).alias("base_period_label"))


def anchors(rows, facts, currency="USD"):
    """The company's own scale: latest fiscal year revenue and operating income, latest total assets."""
    profile = tables.company_profile(rows)
    assets = facts.where((F.col("canonical_metric") == "total_assets") & (F.col("currency") == currency)).groupBy("company_id").agg(
        F.max_by("value", F.struct("period_end", "filing_date", "fact_id")).alias("anchor_total_assets"))
    return profile.join(assets, "company_id", "left").select(
        "company_id", F.lit(currency).alias("anchor_currency"), "anchor_revenue", "anchor_operating_income",
        "anchor_total_assets", F.col("is_bank").alias("anchor_bank"))


def score_numeric(changes, anchors_):
    """Scores numeric and derived changes; statement lines and flows by how much they moved, balances by size."""
    ready = changes
    for name, kind in (("first_itemized", "string"), ("flags", "array<string>"), ("period_type", "string"), ("currency", "string")):
        if name not in ready.columns:
            ready = ready.withColumn(name, F.lit(None).cast(kind))
    scored_type = F.when(F.col("first_itemized").isNotNull(), "changed").otherwise(F.col("change_type"))
    ready = ready.withColumns({
        "_type": F.col("change_type"), "change_type": scored_type, "amount": F.coalesce("value", "base_value"),
        "base_amount": F.col("base_value"), "trigger_phrases": F.array().cast("array<string>"),
        "trigger_weight": F.lit(0.0),
        "by_delta": (F.col("category") == "financial_metric") | F.coalesce(F.col("period_type") == "duration", F.lit(False)),
        "balance": F.coalesce(F.col("period_type") == "instant", F.lit(False))})
    scored = with_score(ready.join(anchors_, "company_id"))
    return scored.withColumn("change_type", F.col("_type")).drop(
        "_type", "amount", "base_amount", "trigger_phrases", "trigger_weight", "by_delta", "balance")


def without_bank_routine(changes):
    """A bank's cash flows and funding lines are not news (F8)."""
    routine = (F.col("category") == "financial_metric") & F.element_at(F.split("fact_key", r"\."), -1).isin(fv.BANK_ROUTINE_METRICS)
    return changes.where(~(F.col("anchor_bank") & routine))


def without_reported_ratios(derived, numeric):
    """A ratio the company reports itself replaces the computed one of the same label."""
    reported = numeric.where(F.col("unit") == "ratio").select("company_id", F.lower("label").alias("_l")).distinct()
    return derived.withColumn("_l", F.lower("label")).join(reported, ["company_id", "_l"], "left_anti").drop("_l")


def ranked(changes, keep_background=fv.MAX_BACKGROUND):
    """Non-repeated changes by score; the lowest tier is trimmed per company (T4)."""
    rows = changes.where(F.col("change_type") != "repeated")
    w = Window.partitionBy("company_id", "tier").orderBy(F.desc("score"), "fact_key", "label")
    return rows.withColumn("tier_position", F.row_number().over(w)).where(
        (F.col("tier") != "background") | (F.col("tier_position") <= keep_background))


def hidden_changes(changes, keep_background=fv.MAX_BACKGROUND):
    """How many changes of the lowest tier ``ranked`` leaves out, per company (T4)."""
    rows = changes.where((F.col("change_type") != "repeated") & (F.col("tier") == "background"))
    counts = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("company_id", F.greatest(F.col("n") - keep_background, F.lit(0)).alias("hidden"))


def change_counts(changes):
    """How many changes per tier and type each company has."""
    rows = changes.where(F.col("change_type") != "repeated")
    return rows.groupBy("company_id").agg(
        *[F.sum((F.col("tier") == t).cast("long")).alias(t) for t in ("top", "notable", "background")],
        *[F.sum((F.col("change_type") == t).cast("long")).alias(t) for t in ("new", "changed", "removed")])
