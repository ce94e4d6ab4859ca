"""Amounts and percentages in text: claims with their rounding tolerance, and the figures a source states."""

import re

import pandas as pd
from pyspark.sql import functions as F

from . import fixed_values as fv
from .arith import col

# FIXED VALUES: figure patterns.
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
SCALE_TAIL = r"(?:\s*((?i:trillion|billion|million|thousand))\b|({})\b)?"
DOLLAR_CLAIM = rf"\$\s?({NUMBER})" + SCALE_TAIL.format("tn|bn|mm|[TBMK]")
PERCENT_CLAIM = rf"(?<![\w.])({NUMBER})\s*(%|(?i:percentage\s+points?|percent|basis\s+points?|bps|pts?)\b)"
SOURCE_AMOUNT = rf"(?<![\w.])(\$)?\s?({NUMBER})" + SCALE_TAIL.format("tn|bn|[TBM]")
TABLE_UNITS = r"\b(?:in|amounts\s+in)\s+(thousands|millions|billions)\b"
CLAIM = "array<struct<kind:string,value:double,tolerance:double,text:string>>"


def _scale(text):
    """The scale a claim's unit stands for; 1 without one."""
    word = F.lower(F.regexp_extract(text, r"(?i)(trillion|billion|million|thousand)$", 1))
    short = F.regexp_extract(text, r"(tn|bn|mm|[TBMK])$", 1)
    out = F.lit(1.0)
    for name, value in fv.SCALE_SHORT.items():
        out = F.when(short == name, F.lit(value)).otherwise(out)
    for name, value in fv.SCALES.items():
        out = F.when(word == name, F.lit(value)).otherwise(out)
    return out


def claims(text):
    """Dollar amounts and percentages of a text with the tolerance their precision implies."""
    t = col(text)

    def parts(hit):
        digits = F.regexp_extract(hit, rf"({NUMBER})", 1)
        decimals = F.length(F.regexp_extract(digits, r"\.(\d+)$", 1))
        return F.replace(digits, F.lit(","), F.lit("")).cast("double"), F.lit(0.5) * F.pow(F.lit(10.0), -decimals)

    def amount(hit):
        value, half = parts(hit)
        scale = _scale(hit)
        return F.struct(F.lit("amount").alias("kind"), (value * scale).alias("value"), (half * scale * (1 + 1e-9)).alias("tolerance"),
                        hit.alias("text"))

    def percent(hit):
        value, half = parts(hit)
        divisor = F.when(F.lower(hit).rlike(r"(basis\s+points?|bps)$"), 100.0).otherwise(1.0)
        return F.struct(F.lit("percent").alias("kind"), (value / divisor).alias("value"), (half / divisor + 1e-9).alias("tolerance"),
                        hit.alias("text"))

    dollars = F.regexp_extract_all(t, F.lit(f"({DOLLAR_CLAIM})"), F.lit(1))
    percents = F.regexp_extract_all(t, F.lit(f"({PERCENT_CLAIM})"), F.lit(1))
    return F.when(t.rlike(r"\d"), F.concat(F.transform(dollars, amount), F.transform(percents, percent))).otherwise(F.array().cast(CLAIM))


FIGURES = "array<struct<kind:string,value:double>>"


def _reader():
    """The function that reads one batch of texts; it carries its patterns along and imports nothing of this package."""
    percent, amount, header = re.compile(PERCENT_CLAIM), re.compile(SOURCE_AMOUNT), re.compile(TABLE_UNITS, re.IGNORECASE)
    scales, short, window = fv.SCALES, fv.SCALE_SHORT, fv.TABLE_WINDOW

    def stated(text):
        out, taken = [], set()
        for m in percent.finditer(text):
            taken.add(m.start(1))
            out.append(("percent", float(m[1].replace(",", "")) / (100 if m[2].lower().startswith(("basis", "bps")) else 1)))
        headers = [(m.end(), scales[m[1].lower()[:-1]]) for m in header.finditer(text)]
        at = 0
        for m in amount.finditer(text):
            begin = m.start(2)
            if begin in taken:
                continue
            while at < len(headers) and headers[at][0] <= begin:
                at += 1
            scale = scales.get((m[3] or "").lower()) or short.get(m[4] or "")
            if not scale and at and begin - headers[at - 1][0] <= window:
                scale = headers[at - 1][1]
            if scale or m[1]:
                out.append(("amount", float(m[2].replace(",", "")) * (scale or 1.0)))
        return out

    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: stated(t) if t else [])

    return read


def source_figures(text):
    """The figures a source text states: dollar and scaled amounts, table amounts under a stated scale, percents.

    Positions matter (table headers count for 240 characters), which the SQL
    regex functions do not give; texts without a digit never leave the JVM.
    """
    t = col(text)
    read = F.pandas_udf(_reader(), FIGURES)
    return F.when(t.rlike(r"\d"), read(F.when(t.rlike(r"\d"), t))).otherwise(F.array().cast(FIGURES))


def traced(claim, figures):
    """Whether some source figure of the claim's kind lies within its tolerance."""
    return F.exists(figures, lambda f: (f.kind == claim.kind) & (f.value >= F.abs(claim.value) - claim.tolerance)
                    & (f.value <= F.abs(claim.value) + claim.tolerance))
