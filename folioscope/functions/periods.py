"""Period lengths, fiscal calendar and form names as Column expressions."""

from pyspark.sql import functions as F

from .arith import col
from .fixed_values import MONTH_BUCKETS

MONTH_DAYS = 365.25 / 12


def days_between(start, end):
    return F.datediff(col(end), col(start))


def between_days(start, end, window):
    return days_between(start, end).between(*window)


def period_months(start, end):
    """Whole months of a span; NULL for a balance at a date."""
    days = days_between(start, end)
    out = F
    for low, high, months in MONTH_BUCKETS:
        out = out.when(days.between(low, high), months)
    estimate = F.bround(days / F.lit(MONTH_DAYS), 0).cast("int")
    return F.when(col(start).isNotNull(), out.otherwise(F.greatest(F.lit(1), estimate)))


def fiscal_offset(fy_start, end):
    """Years between the fiscal year beginning at ``fy_start`` and the one ``end`` falls in."""
    position = days_between(fy_start, end) + 1
    return (F.ceil(position / F.lit(365.25) - 0.03) - 1).cast("int")


def months_into_year(fy_start, end):
    position = days_between(fy_start, end) + 1
    return F.bround((position - fiscal_offset(fy_start, end) * 365.25) / F.lit(MONTH_DAYS), 0).cast("int")


def fiscal_year(fy_start, focus_year, end):
    return col(focus_year) + fiscal_offset(fy_start, end)


def fiscal_period(fy_start, start, end):
    """FY, Q1..Q4, H1, H2, 9M, or NULL when the span is no fiscal period."""
    into, months = months_into_year(fy_start, end), period_months(start, end)
    instant = (F.when(into == 3, "Q1").when(into == 6, "Q2").when(into == 9, "Q3").when(into == 12, "FY"))
    flow = (
        F.when(months == 12, "FY")
        .when((months == 3) & into.isin(3, 6, 9, 12), F.concat(F.lit("Q"), (into / 3).cast("int").cast("string")))
        .when((months == 6) & (into == 6), "H1").when((months == 6) & (into == 12), "H2")
        .when((months == 9) & (into == 9), "9M")
    )
    return F.when(col(fy_start).isNotNull(), F.when(col(start).isNull(), instant).otherwise(flow))


MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
               "november", "december"]


def year_end_mmdd(text):
    """'--01-31', '1/31' or 'December 31' -> 'MM-DD'."""
    t = F.trim(col(text))
    pattern = r"^-*(\d{1,2})[-/](\d{1,2})$"
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    out = F.when(t.rlike(pattern), F.concat(two(F.regexp_extract(t, pattern, 1)), F.lit("-"), two(F.regexp_extract(t, pattern, 2))))
    for number, name in enumerate(MONTH_NAMES, start=1):
        named = rf"(?i){name}\s+(\d{{1,2}})"
        out = out.when(t.rlike(named), F.concat(F.lit(f"{number:02d}-"), two(F.regexp_extract(t, named, 1))))
    return out


def base_form(form):
    return F.regexp_replace(col(form), "/A$", "")


def is_amendment(form):
    return col(form).endswith("/A")


def is_annual_form(form, period=None):
    annual = base_form(form).isin("10-K", "10-KT", "20-F", "40-F")
    return annual if period is None else annual | F.coalesce(col(period) == "FY", F.lit(False))


def fiscal_label(year, period):
    """'Q2 FY2027', 'FY2026'; NULL when either part is missing."""
    year_text = F.concat(F.lit("FY"), col(year).cast("string"))
    return F.when(col(period) == "FY", year_text).otherwise(F.concat(col(period), F.lit(" "), year_text))


def currency_of_unit(unit):
    return F.nullif(F.regexp_extract(col(unit), r"^iso4217:([^/]+)", 1), F.lit(""))


def normalized_unit(unit):
    u = col(unit)
    return (
        F.when(u == "xbrli:pure", "ratio").when(u == "xbrli:shares", "shares")
        .when(u.startswith("iso4217:") & u.endswith("/xbrli:shares"), "currency_per_share")
        .when(u.startswith("iso4217:") & ~u.contains("/"), "currency")
        .otherwise("other")
    )
