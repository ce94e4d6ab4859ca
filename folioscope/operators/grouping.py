"""Folding changes that report the same amount about the same thing.

Changes are taken in order: numbers before wording, the highest score first.
One joins the first group whose lead is about the same thing with the same
amount, else it leads a group of its own.  Which changes could lead which is a
join on bands of the amount (two amounts within a tolerance lie in the same or
in neighbouring bands of their logarithm).  Who leads follows in rounds: a
change whose earlier candidates are all followers leads, one with a leading
candidate follows.  Each round settles the first open change of every company
at least, mostly all of them.  Wording never leads numbers, so it is joined to
the leads at the end.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import checkpointed
from .numeric_changes import stems

#: Width of a band of logarithms: amounts within the tolerance differ by less.
BAND = -math.log(1 - fv.GROUP_TOLERANCE) * 1.000001


def ordered(changes, revenue):
    """Changes with their place in the company's order, the amount they are matched by, and those that they are matched with as a lead."""
    text = F.col("kind") == "narrative"
    money = (F.col("unit") == "currency") & (F.col("kind") == "numeric")
    floor = F.coalesce(F.abs("revenue") * fv.GROUP_FLOOR_SHARE, F.lit(0.0))
    matched = (F.col("value") != 0) & (F.abs("value") >= floor) & (text | money)
    rows = changes.join(revenue.select("company_id", "revenue"), "company_id", "left").select(
        "company_id", "change_id", text.alias("is_text"), "category", "change_type", F.coalesce("currency", F.lit("")).alias("currency"), "score",
        F.when(~text, F.col("first_itemized")).alias("itemized"), F.when(matched, F.col("value")).alias("amount"),
        F.when(money, F.array_compact(F.array(F.nullif("value", F.lit(0.0)), F.nullif("base_value", F.lit(0.0))))).alias("lead_amounts"),
        stems(F.coalesce(F.when(text, F.col("text")).otherwise(F.col("label")), F.lit(""))).alias("stems"))
    w = Window.partitionBy("company_id").orderBy("is_text", F.desc("score"), "change_id")
    first = F.min("place").over(Window.partitionBy("company_id", "currency", "itemized"))
    return rows.withColumn("place", F.row_number().over(w)).withColumn("itemized_home", F.when(F.col("itemized").isNotNull(), first))


def _band(amount):
    return F.floor(F.log(F.abs(amount)) / F.lit(BAND))


def _same(a, b):
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(fv.GROUP_TOLERANCE)


def _by_band(followers, leads, keys):
    """Pairs of a change and one with nearly its amount, on equal ``keys``: the follower's columns and ``lead``, the place of the other."""
    bands = F.explode(F.sequence(_band(F.col("lead_amount")) - 1, _band(F.col("lead_amount")) + 1))
    offered = leads.select(*keys, F.col("place").alias("lead"), F.col("stems").alias("lead_stems"), F.explode("lead_amounts").alias("lead_amount"))
    offered = offered.withColumn("band", bands)
    asked = followers.withColumn("band", _band(F.col("amount")))
    return asked.join(offered, [*keys, "band"]).where(_same(F.col("amount"), F.col("lead_amount")))


def _leading(candidates):
    """Which of the changes with candidates lead: company_id, place, leads.  ``candidates``: company_id, place, lead (an earlier place)."""
    open_, settled = checkpointed(candidates), None
    places = open_.select("company_id", "place").distinct()
    certain = open_.select("company_id", F.col("lead").alias("place")).distinct().join(places, ["company_id", "place"], "left_anti")
    known = checkpointed(certain.withColumn("leads", F.lit(True)))
    while not open_.isEmpty():
        state = known.select("company_id", F.col("place").alias("lead"), "leads")
        seen = open_.join(state, ["company_id", "lead"], "left").groupBy("company_id", "place").agg(
            F.max(F.coalesce("leads", F.lit(False))).alias("_follows"), F.min(F.col("leads").isNotNull()).alias("_all"))
        new = checkpointed(seen.where("_follows OR _all").select("company_id", "place", (~F.col("_follows")).alias("leads")))
        settled = new if settled is None else settled.unionByName(new)
        known = known.unionByName(new)
        open_ = checkpointed(open_.join(new.select("company_id", "place"), ["company_id", "place"], "left_anti"))
    return known if settled is None else checkpointed(known)


def homes(changes, revenue):
    """The change that leads each change's group: company_id, change_id, place, home (a place)."""
    rows = checkpointed(ordered(changes, revenue))
    numbers = rows.where(~F.col("is_text"))
    able = numbers.where("itemized IS NULL OR itemized_home = place")
    keys = ["company_id", "currency", "category", "change_type"]
    plain = numbers.where("itemized IS NULL AND amount IS NOT NULL").select(*keys, "place", "amount")
    pairs = _by_band(plain, able, keys).where("lead < place").select("company_id", "place", "lead").distinct()
    pairs = checkpointed(pairs)
    leading = _leading(pairs)
    followed = pairs.join(leading.where("leads").select("company_id", F.col("place").alias("lead")), ["company_id", "lead"])
    # a lead is followed by others, but a change that leads has none among its own candidates
    home = followed.groupBy("company_id", "place").agg(F.min("lead").alias("_home"))
    numbers = rows.where(~F.col("is_text")).join(home, ["company_id", "place"], "left")
    numbers = numbers.withColumn("home", F.coalesce("itemized_home", "_home", "place")).drop("_home")
    leads = numbers.where("home = place")
    said = rows.where("is_text AND amount IS NOT NULL").select("company_id", "currency", "place", "amount", "stems")
    told = _by_band(said, leads, ["company_id", "currency"]).where(F.arrays_overlap("stems", "lead_stems")).groupBy("company_id", "place").agg(
        F.min("lead").alias("_home"))
    wording = rows.where("is_text").join(told, ["company_id", "place"], "left").withColumn("home", F.coalesce("_home", "place"))
    columns = ["company_id", "change_id", "place", "home"]
    return numbers.select(*columns).unionByName(wording.select(*columns))


def grouped(changes, revenue):
    """Group of every change, led by the first that reports the amount; ranked by the highest score in it, with that change's tier.

    ``changes``: company_id, change_id, kind, category, change_type, label, text,
    value, base_value, unit, currency, score, tier, reasons, first_itemized.
    Reasons are the lead's, then those of the change with the highest score.
    """
    found = homes(changes, revenue)
    rows = found.join(changes.select("company_id", "change_id", "score", "tier", "reasons", "change_type"), ["company_id", "change_id"])
    groups = rows.groupBy("company_id", "home").agg(
        F.max_by(F.struct("score", "tier", "reasons"), F.struct("score", -F.col("place"))).alias("top"),
        F.min_by(F.struct("change_id", "reasons", "change_type"), "place").alias("lead"), F.count(F.lit(1)).alias("members"))
    reasons = F.array_distinct(F.concat(F.coalesce("lead.reasons", F.array().cast("array<string>")), F.coalesce("top.reasons", F.array().cast("array<string>"))))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("top.score"), "home"))
    groups = groups.select("company_id", "home", F.col("lead.change_id").alias("group_id"), F.col("lead.change_type").alias("group_type"),
                           F.col("top.score").alias("group_score"), F.col("top.tier").alias("group_tier"), reasons.alias("group_reasons"), "members",
                           place.alias("group_place"))
    return found.join(groups, ["company_id", "home"]).select(
        "company_id", "change_id", "group_id", "group_type", "group_score", "group_tier", "group_reasons", "members", "group_place")


def shown_groups(groups, keep_background=fv.MAX_BACKGROUND):
    """The leads of the groups that a page shows: the lowest tier is trimmed (T4, C11)."""
    leads = groups.where("change_id = group_id")
    nth = F.row_number().over(Window.partitionBy("company_id", "group_tier").orderBy("group_place"))
    return leads.withColumn("_nth", nth).where((F.col("group_tier") != "background") | (F.col("_nth") <= keep_background)).drop("_nth")


def group_counts(groups, keep_background=fv.MAX_BACKGROUND):
    """Groups of each tier, and of each kind of change, and how many of the lowest tier are hidden."""
    leads = groups.where("change_id = group_id")
    out = leads.groupBy("company_id").agg(
        *[F.sum((F.col("group_tier") == t).cast("long")).alias(t) for t in ("top", "notable", "background")],
        *[F.sum((F.col("group_type") == t).cast("long")).alias(t) for t in ("new", "changed", "removed")])
    return out.withColumn("hidden", F.greatest(F.col("background") - keep_background, F.lit(0)))
