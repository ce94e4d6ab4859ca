"""Tagged numbers as canonical metrics and disclosed lines of a filing.

Everything about a filing is decided inside the filing: the merged facts are
partitioned by filing once, and filing-level answers (standard, currency, fiscal
calendar) are windows over it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import labels, periods
from ..functions.arith import gather, literal_map, once
from ..session import stored
from .latest import pick

# FIXED VALUES: confidence of a reading; concepts that tell the reporting currency.
STANDARD, FALLBACK, EXTENSION, CONFLICT, FAMILY, FAMILY_EXTENSION = 0.95, 0.9, 0.6, 0.25, 0.9, 0.7
CURRENCY_ANCHORS = ["Revenues", "Revenue", "Assets", "NetIncomeLoss", "ProfitLoss", "RevenueFromContractWithCustomerExcludingAssessedTax"]
NEUTRAL = ["ConsolidationItemsAxis=OperatingSegmentsMember", "SegmentConsolidationItemsAxis=OperatingSegmentsMember"]
SUBSEQUENT_AXIS = "SubsequentEventTypeAxis"


def dictionary(spark):
    """(concept, metric, us_rank, ifrs_rank, period_type, unit): a constant of about 200 rows, small enough to broadcast."""
    rows = {}
    for metric, _, period, unit, us, ifrs in fv.METRIC_TABLE:
        gaap, other = [f"us-gaap:{t}" for t in us], [f"ifrs-full:{t}" for t in ifrs]
        for rank, concept in enumerate(gaap + other):
            rows.setdefault((concept, metric), [None, None, period, unit])[0] = rank
        for rank, concept in enumerate(other + gaap):
            rows[(concept, metric)][1] = rank
    return spark.createDataFrame([(c, m, *v) for (c, m), v in rows.items()],
                                 "concept string, metric string, us_rank int, ifrs_rank int, metric_period string, metric_unit string")


def with_filing_profile(facts, covers):
    """Standard, reporting currency and fiscal calendar beside each fact.

    ``covers``: filing_id, cover_start, cover_end, focus_year, form_type.
    """
    filing = Window.partitionBy("filing_id")
    prefix, name = F.substring_index("concept", ":", 1), labels.local_name("concept")
    currency = periods.currency_of_unit("unit")
    plain = F.size(F.map_keys("dimensions")) == 0
    rows = facts.join(covers, "filing_id")
    rows = rows.withColumn("_ifrs", F.sum((prefix == "ifrs-full").cast("int")).over(filing)).withColumn(
        "_us", F.sum((prefix == "us-gaap").cast("int")).over(filing))
    rows = rows.withColumn("standard", F.when(F.col("_ifrs") > F.col("_us"), "ifrs").when(F.col("_us") > 0, "us-gaap").otherwise("other"))
    rows = rows.withColumn("currency", currency)
    by_currency = Window.partitionBy("filing_id", "currency")
    anchored = plain & name.isin(CURRENCY_ANCHORS) & currency.isNotNull()
    monetary = currency.isNotNull() & ~F.col("unit").contains("/")
    rows = rows.withColumn("_anchors", F.sum(anchored.cast("int")).over(by_currency)).withColumn(
        "_monetary", F.sum(monetary.cast("int")).over(by_currency))
    # ties go to the alphabetically first currency
    rank = F.struct((F.col("_anchors") > 0).cast("int").alias("a"), "_anchors", "_monetary")
    top = F.max(F.when(currency.isNotNull() & (F.col("_monetary") + F.col("_anchors") > 0), rank)).over(filing)
    rows = rows.withColumn("reporting_currency", F.min(F.when(rank == top, F.col("currency"))).over(filing))
    days = F.datediff("period_end", "period_start")
    span = plain & F.col("period_start").isNotNull() & (F.abs(F.datediff("period_end", "cover_end")) <= 3) & (days <= 380)
    rows = rows.withColumn("fy_start", F.least(F.min(F.when(span, F.col("period_start"))).over(filing), F.col("cover_start")))
    return rows.drop("_ifrs", "_us", "_anchors", "_monetary").withColumn("is_plain", plain)


def metric_facts(profiled, spark):
    """One consolidated value per filing, metric and period.

    Standard tags in preference order; a company-specific tag only when exactly one
    fits a metric that no standard tag reports.
    """
    plain = profiled.where(F.col("is_plain") & F.col("value").isNotNull())
    known = F.broadcast(dictionary(spark))
    instant = F.col("period_start").isNull()
    period_fits = instant == (F.col("metric_period") == "instant")
    same = F.col("currency").eqNullSafe(F.col("reporting_currency")) & F.col("unit").isNotNull()
    unit_fits = (F.when(F.col("metric_unit") == "shares", F.col("unit") == "xbrli:shares")
                 .when(F.col("metric_unit") == "currency_per_share", F.col("unit").endswith("/xbrli:shares") & same)
                 .otherwise(~F.col("unit").contains("/") & same))
    fits = period_fits & F.coalesce(unit_fits, F.lit(False))
    rank = F.when(F.col("standard") == "ifrs", F.col("ifrs_rank")).otherwise(F.col("us_rank"))
    standard = plain.join(known, "concept").where(fits).withColumn("rank", rank).withColumn(
        "confidence", F.when(rank == 0, STANDARD).otherwise(FALLBACK))
    own = plain.where(~F.substring_index("concept", ":", 1).isin("us-gaap", "ifrs-full", "dei", "srt", "ecd"))
    found = _extensions(own, standard, fits)
    slot = ["filing_id", "metric", "period_start", "period_end"]
    columns = [*slot, "concept", "value", "unit", "currency", "reporting_currency", "standard", "decimals", "conflicting", "sources", "fy_start",
               "focus_year", "cover_end", "rank", "confidence", "metric_period", "metric_unit", "order"]
    chosen = pick(standard.select(*columns).unionByName(found.select(*columns)), slot, ["rank", "order"], largest=False)
    outflow = F.col("metric").isin(fv.OUTFLOW_METRICS)
    return chosen.select(
        "filing_id", F.col("metric").alias("canonical_metric"), F.concat(F.lit("metric."), F.col("metric")).alias("fact_key"),
        F.col("concept").alias("xbrl_concept"), F.when(outflow, F.abs("value")).otherwise(F.col("value")).alias("value"),
        F.col("metric_unit").alias("normalized_unit"), "currency", "standard", F.col("metric_period").alias("period_type"), "period_start", "period_end",
        periods.fiscal_year("fy_start", "focus_year", "period_end").alias("fiscal_year"),
        periods.fiscal_period("fy_start", "period_start", "period_end").alias("fiscal_period"),
        periods.period_months("period_start", "period_end").alias("period_months"),
        F.coalesce(F.col("period_end") < F.col("cover_end"), F.lit(False)).alias("is_comparative"),
        F.round(F.col("confidence") - F.when(F.col("conflicting"), CONFLICT).otherwise(0.0), 3).alias("confidence"), "sources")


def _extensions(own, standard, fits):
    """Company-specific tags that extend a metric's standard name, or whose row reads exactly like the metric."""
    from ..functions.text import statement_label_key

    name = F.lower(labels.local_name("concept"))
    tests, worded = [], literal_map(fv.LABEL_METRICS)
    for metric, _, period, unit, us, ifrs in fv.METRIC_TABLE:
        stems = "|".join(sorted({t.lower() for t in us + ifrs}, key=lambda t: (-len(t), t)))
        hit = name.rlike(f"^(?:{stems})(?:$|[^a-z])")
        if metric in fv.METRIC_EXTENSIONS:
            hit = hit | labels.local_name("concept").rlike(fv.METRIC_EXTENSIONS[metric])
        tests.append(F.when(hit, F.struct(F.lit(metric).alias("metric"), F.lit(0).alias("way"))))
    info = literal_map({m[0]: m[2] for m in fv.METRIC_TABLE}), literal_map({m[0]: m[3] for m in fv.METRIC_TABLE})
    by_label = F.transform(F.filter(F.transform("sources", lambda s: F.try_element_at(worded, statement_label_key(s.row_label))), lambda m: m.isNotNull()),
                           lambda m: F.struct(m.alias("metric"), F.lit(1).alias("way")))
    rows = own.withColumn("c", F.explode(F.array_distinct(F.concat(F.array_compact(F.array(*tests)), by_label))))
    rows = rows.select("*", "c.metric", "c.way").drop("c")
    taken = standard.select("filing_id", "metric").distinct()
    rows = rows.join(taken, ["filing_id", "metric"], "left_anti")
    # names come before row wording, and only a single candidate is used
    w = Window.partitionBy("filing_id", "metric")
    rows = rows.withColumn("_way", F.min("way").over(w)).where(F.col("way") == F.col("_way"))
    rows = rows.withColumn("_n", F.size(F.collect_set("concept").over(w))).where(F.col("_n") == 1)
    rows = rows.withColumn("metric_period", F.try_element_at(info[0], F.col("metric"))).withColumn("metric_unit", F.try_element_at(info[1], F.col("metric")))
    return rows.where(fits).withColumn("rank", F.lit(0)).withColumn("confidence", F.lit(EXTENSION))


def breakdown_concepts():
    """concept -> (metric, rank) of the metrics broken out by segment, geography and product."""
    out = {}
    for metric, _, _, _, us, ifrs in fv.METRIC_TABLE:
        if metric in ("revenue", "operating_income"):
            for rank, tag in enumerate(us + ifrs):
                for prefix in ("us-gaap", "ifrs-full"):
                    out.setdefault(f"{prefix}:{tag}", (metric, rank))
    return out


def family_facts(profiled, metric_values):
    """The lines behind the statements: commitments, guarantees, debt, one-offs, concentrations, segments."""
    dims = F.map_entries("dimensions")
    subsequent = F.exists(dims, lambda d: labels.local_name(d.key) == SUBSEQUENT_AXIS)
    kept = F.array_sort(F.filter(dims, lambda d: (labels.local_name(d.key) != SUBSEQUENT_AXIS) & ~F.concat_ws(
        "=", labels.local_name(d.key), labels.local_name(d.value)).isin(NEUTRAL)))
    # what metrics have taken is looked up among the filing's own rows, so these are moved once, by filing, for all that follows
    taken = metric_values.select("filing_id", F.col("xbrl_concept").alias("concept"), "period_start", "period_end", F.lit(True).alias("_taken")).where(
        "filing_id IS NOT NULL AND concept IS NOT NULL AND period_end IS NOT NULL")
    rows = profiled.where(F.col("value").isNotNull()).withColumn("_taken", F.lit(False)).unionByName(taken, allowMissingColumns=True)
    rows = gather(rows.withColumn("_s", F.coalesce("period_start", F.lit("0001-01-01").cast("date"))), "filing_id")
    found = F.max("_taken").over(Window.partitionBy("filing_id", "concept", "_s", "period_end"))
    rows = once(rows.withColumn("_found", found).where(~F.col("_taken")), key_dims=kept, subsequent=subsequent)
    rows = rows.where(~F.col("_found") | (F.size("key_dims") > 0)).drop("_s", "_taken", "_found")
    rows = once(rows, axes=F.transform("key_dims", lambda d: labels.local_name(d.key)))
    broken = breakdown_concepts()
    metric = F.try_element_at(literal_map({c: m for c, (m, _) in broken.items()}), F.col("concept"))
    rank = F.try_element_at(literal_map({c: r for c, (_, r) in broken.items()}), F.col("concept"))
    axis = F.try_element_at("axes", F.lit(1))
    view = F.when(F.size("key_dims") == 1, F.when(axis.isin(fv.SEGMENT_AXES), "segment").when(
        axis.isin(fv.GEOGRAPHY_AXES) & (metric == "revenue"), "geography").when(axis.isin(fv.PRODUCT_AXES) & (metric == "revenue"), "product"))
    breakdown = F.when(metric.isNotNull(), view)
    # rules run once per distinct (concept, axes): a few thousand whatever the number of facts.  Most rows are of a few
    # of these; stored, the kinds are of known size, and no row is moved to the task of its kind where they are small
    kinds = once(profiled.where(F.col("value").isNotNull()).select("concept", "dimensions"), key_dims=kept)
    kinds = kinds.select("concept", F.transform("key_dims", lambda d: labels.local_name(d.key)).alias("axes")).distinct()
    kinds = stored(once(kinds, family=labels.family_of("concept", "axes")))
    rows = rows.join(kinds, ["concept", "axes"], "left").withColumn("breakdown", breakdown).where(
        F.col("breakdown").isNotNull() | F.col("family").isNotNull())
    member = F.try_element_at("key_dims", F.lit(1))
    name = labels.local_name("concept")
    members = F.array_join(F.transform("key_dims", lambda d: labels.member_label(d.key, d.value)), ", ")
    key = F.when(F.col("breakdown").isNotNull(), F.concat_ws(".", "breakdown", metric, labels.slug(member.value))).otherwise(F.concat_ws(
        ".", F.col("family"), labels.slug("concept"), F.array_join(F.transform("key_dims", lambda d: labels.slug(d.value)), ".")))
    key = F.regexp_replace(key, r"\.$", "")
    label = (
        F.when(F.col("breakdown").isNotNull(), F.concat(labels.member_label(member.key, member.value), F.when(
            metric != "revenue", F.concat(F.lit(" ("), F.replace(metric, F.lit("_"), F.lit(" ")), F.lit(")"))).otherwise("")))
        .when(F.col("family") == "customer_concentration", labels.concentration_label(F.map_from_entries("key_dims")))
        .when((members != "") & name.isin(labels.MEMBER_NAMES_VALUE), members)
        .otherwise(F.concat(labels.concept_label("concept"), F.when(members != "", F.concat(F.lit(": "), members)).otherwise(""))))
    confidence = F.when(F.substring_index("concept", ":", 1).isin(labels.STANDARD_PREFIXES), FAMILY).otherwise(FAMILY_EXTENSION)
    rows = once(rows, fact_key=key, label=label, dims_hash=F.sha1(F.to_json(F.array_sort(F.map_entries("dimensions")))),
                category=F.coalesce("breakdown", "family"), rank=F.when(F.col("breakdown").isNotNull(), rank).otherwise(0))
    slot = ["filing_id", "fact_key", "period_start", "period_end", "dims_hash"]
    rows = rows.withColumn("_foreign", (~F.col("currency").eqNullSafe(F.col("reporting_currency"))).cast("int"))
    chosen = pick(rows, slot, ["_foreign", "rank", "order"], largest=False)
    out = chosen.select(
        "filing_id", "category", "fact_key", "label", F.col("concept").alias("xbrl_concept"), "dimensions", "value",
        periods.normalized_unit("unit").alias("normalized_unit"), "currency",
        F.when(F.col("period_start").isNull(), "instant").otherwise("duration").alias("period_type"), "period_start", "period_end",
        periods.fiscal_year("fy_start", "focus_year", "period_end").alias("fiscal_year"),
        periods.fiscal_period("fy_start", "period_start", "period_end").alias("fiscal_period"),
        periods.period_months("period_start", "period_end").alias("period_months"),
        F.coalesce(F.col("period_end") < F.col("cover_end"), F.lit(False)).alias("is_comparative"),
        F.round(confidence - F.when(F.col("conflicting"), CONFLICT).otherwise(0.0), 3).alias("confidence"),
        F.when(F.col("subsequent"), F.array(F.lit("subsequent_event"))).otherwise(F.array().cast("array<string>")).alias("triggers"), "sources", "axes", "order")
    return _merge_repeated(out)


def _merge_repeated(rows):
    """One amount tagged under several members of an axis from one sentence is one line, its labels joined."""
    text = F.try_element_at("sources", F.lit(1)).row_text
    alone = F.when((F.size("axes") == 1) & text.isNotNull(), F.lit("")).otherwise(F.to_json(F.struct("fact_key", "dimensions", "order")))
    keys = ["filing_id", "category", "xbrl_concept", "period_start", "period_end", "value", "currency", "axes", "_text", "_alone"]
    ready = rows.withColumn("_text", text).withColumn("_alone", alone)
    rest = [c for c in rows.columns if c not in keys]
    merged = ready.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), "order").alias("f"), F.sort_array(F.collect_list(F.struct("order", "label"))).alias("_labels"))
    joined = F.array_join(F.transform("_labels", lambda x: x.label), " / ")
    return merged.select(*[k for k in keys if not k.startswith("_")], "f.*", joined.alias("_joined")).withColumn("label", F.col("_joined")).drop("_joined", "axes", "order")
