"""Ranking all changes together, and the text digests and merges built on them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import figures as fig
from ..functions import fixed_values as fv
from ..functions import labels
from ..functions import text as T
from ..functions.arith import col, folded, gather, lookup, once
from ..functions.periods import fiscal_label
from ..functions.score import stable_id, with_score
from .latest import pick, top_n
from .search import take_within
from .wording import section_diff, sentence_rows

# FIXED VALUES: note categories that score like a disclosure family; currencies as texts cite them; section budgets.
STRATEGIC_KEY = {"commitments": "commitment", "guarantees": "guarantee"}
CURRENCIES = {
    "USD": r"US\$|U\.S\.\s?dollars?|\bUSD(?![A-Za-z])|(?<![A-Za-z$])\$", "TWD": r"(?i)NT\$|New Taiwan dollars?|\bNT dollars?|\bTWD(?![A-Za-z])",
    "CAD": r"(?i)C\$|Canadian dollars?|\bCAD(?![A-Za-z])", "EUR": r"(?i)€|\bEUR(?![A-Za-z])|\beuros?\b",
    "GBP": r"(?i)£|\bGBP(?![A-Za-z])|pounds? sterling", "JPY": r"(?i)¥|\bJPY(?![A-Za-z])|\byen\b",
    "CNY": r"(?i)\bRMB(?![A-Za-z])|\bCNY(?![A-Za-z])|\bRenminbi\b", "HKD": r"(?i)HK\$|\bHKD(?![A-Za-z])|Hong Kong dollars?",
    "CHF": r"(?i)\bCHF(?![A-Za-z])|Swiss francs?", "INR": r"(?i)₹|\bINR(?![A-Za-z])|\bRs\.|Indian rupees?", "KRW": r"(?i)₩|\bKRW(?![A-Za-z])|Korean won",
    "BRL": r"(?i)R\$|\bBRL(?![A-Za-z])|Brazilian reais|\breais\b", "AUD": r"(?i)A\$|\bAUD(?![A-Za-z])|Australian dollars?",
    "DKK": r"(?i)\bDKK(?![A-Za-z])|Danish kroner"}
MIN_MENTIONS = 5
MAX_DIGEST_CHANGES, QUOTED_CHARS = 25, 400
ID_PREFIX = {"segments": "s", "strategy": "g", "drivers": "d", "outlook": "o", "upside": "u", "downside": "w", "risks": "r", "non_operating": "n"}
LATEST_LISTS = ("drivers", "upside", "downside")
MERGED_LISTS = {"segments": 6, "strategy": 6, "outlook": 6, "non_operating": 6, "risks": 16}
INPUT_CHARS = {"business": 30_000, "discussion_annual": 45_000, "discussion_interim": 35_000, "risk_outline": 12_000, "risk_changes": 15_000,
               "risk_updates": 20_000}
PREDECESSOR = (r"([A-Z][A-Za-z0-9.&' -]{1,80}?),\s+an?\s+[A-Za-z ]{2,40}?(?:[Cc]orporation|[Cc]ompany)\s*(?:\([^)]{0,80}\)\s*)?,?\s+"
               r"(?:and\s+)?(?:the\s+)?[Pp]redecessor")


def detect_currency(text):
    """The currency a text cites most, 'unknown' below five mentions (A21).  Ties go to the first listed."""
    counts = F.array(*[F.struct(F.size(F.regexp_extract_all(col(text), F.lit(p), F.lit(0))).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code"))
                       for i, (code, p) in enumerate(CURRENCIES.items())])
    best = F.array_max(counts)
    return F.when(best["n"] >= MIN_MENTIONS, best["code"]).otherwise("unknown")


def predecessors(filings, companies):
    """The company whose reports a successor's filing names as its predecessor's.

    ``filings``: cik, form_type, text; ``companies``: cik, name.  Names meet on
    their conformed spelling's first word, then the whole name must lead.
    """
    named = filings.where(F.col("form_type").isin("8-K12B", "8-K12G3")).withColumn(
        "named", T.registrant_name(F.nullif(F.regexp_extract("text", PREDECESSOR, 1), F.lit("")))).where(F.col("named").isNotNull())
    a = named.select(F.col("cik").alias("successor"), "named", F.lower(F.element_at(F.split("named", " "), 1)).alias("word"))
    b = companies.withColumn("conformed", T.registrant_name("name")).select(
        F.col("cik").alias("predecessor"), "conformed", F.lower(F.element_at(F.split("conformed", " "), 1)).alias("word"))
    hit = F.startswith(F.upper("conformed"), F.upper("named")) & (F.col("successor") != F.col("predecessor"))
    return a.join(b, "word").where(hit).groupBy("successor").agg(F.min("predecessor").alias("predecessor"))


def score_wording(changes, anchors):
    """Wording changes sized by the largest amount they state; risk factors are not sized by amounts."""
    amounts = F.transform(F.filter(fig.claims("text"), lambda c: c.kind == "amount"), lambda c: c.value)
    rows = once(changes, amount=F.when(F.col("category") != "risk_factors", F.array_max(amounts)))
    plain_note = ((F.col("change_type") == "new") & (F.col("category") != "risk_factors") & F.coalesce(F.col("amount") == 0, F.lit(True))
                  & (F.size("triggers") == 0))
    ready = rows.join(anchors, "company_id").withColumns({
        "_type": F.col("change_type"), "_category": F.col("category"),
        "change_type": F.when(plain_note, "changed").otherwise(F.col("change_type")),
        "category": F.coalesce(lookup(STRATEGIC_KEY, "category"), F.col("category")),
        "unit": F.when(F.coalesce(F.col("amount") != 0, F.lit(False)), "currency").otherwise("text"),
        "base_amount": F.lit(None).cast("double"), "change": F.lit(None).cast("double"), "currency": F.col("anchor_currency"),
        "by_delta": F.lit(False), "balance": F.lit(False),
        "trigger_phrases": F.transform("triggers", lambda t: t.phrase), "trigger_weight": F.array_max(F.transform("triggers", lambda t: t.weight))})
    scored = with_score(ready).withColumn("change_type", F.col("_type")).withColumn("category", F.col("_category"))
    return scored.drop("_type", "_category", "base_amount", "by_delta", "balance").withColumn(
        "change_id", stable_id(F.lit("narrative"), "category", F.lit(""), "text"))


def kept_wording(scored):
    """Language worth storing: above the floor, the sixty highest per company (T4)."""
    return top_n(scored.where(F.col("score") >= fv.NARRATIVE_FLOOR), ["company_id"], [F.desc("score"), F.col("change_id")], fv.MAX_NARRATIVE, "place")


def all_changes(numeric, derived, wording):
    """Every change of a company's latest report in one ranked list."""
    cols = ["company_id", "kind", "category", "change_type", "label", "fact_key", "text", "value", "base_value", "change", "unit", "score", "tier", "reasons"]

    def shaped(df, kind):
        missing = {"fact_key": "string", "text": "string", "label": "string", "value": "double", "base_value": "double", "change": "double", "unit": "string"}
        out = df.withColumn("kind", F.lit(kind))
        for name, type_ in missing.items():
            if name not in out.columns:
                out = out.withColumn(name, F.lit(None).cast(type_))
        return out.select(*cols)

    words = kept_wording(wording).withColumn("label", T.first_sentence_label("text")).withColumn("value", F.col("amount"))
    return shaped(numeric, "numeric").unionByName(shaped(derived, "derived")).unionByName(shaped(words, "narrative"))


def base_report(changes, filings):
    """The report of the period a change is measured against; latest filed of that label."""
    named = filings.where(~F.col("form_type").endswith("/A")).select(
        "company_id", fiscal_label("fiscal_year", "fiscal_period").alias("base_period_label"), "filing_id", "form_type", "filing_date")
    best = named.groupBy("company_id", "base_period_label").agg(
        F.max_by(F.struct(F.col("filing_id").alias("base_report_id"), F.col("form_type").alias("base_form")), F.struct("filing_date", "filing_id")).alias("b"))
    return changes.join(best.select("company_id", "base_period_label", "b.*"), ["company_id", "base_period_label"], "left")


def shown_changes(groups, tier=None, kind=None):
    """Ranked groups of a tier and kind; a group counts as wording when any member is."""
    rows = groups if tier is None else groups.where(F.col("tier") == tier)
    wording = (F.col("kind") == "narrative") | F.exists("related", lambda r: r.kind == "narrative")
    return rows if kind is None else rows.where(wording if kind == "wording" else ~wording)


def unranked_risks(extracted, ranked):
    """Extracted company-specific risks not already among the ranked ones."""
    seen = ranked.select("company_id", F.lower("headline").alias("_h")).distinct()
    return extracted.where("company_specific").withColumn("_h", F.lower("headline")).join(seen, ["company_id", "_h"], "left_anti").drop("_h")


def prose_within(sections, keys, budget, text="text"):
    """Paragraphs without tables and page furniture, up to a budget of characters."""
    lines = sections.select(*keys, F.posexplode_outer(F.split(F.regexp_replace(T.plain_spaces(text), T.PAGE_FURNITURE, ""), "\n")).alias("pos", "line"))
    lines = once(lines.where(F.col("line").isNotNull()), l=F.trim("line")).where((F.col("l") != "") & ~(F.col("l").rlike(r"\d") & T.is_tabular(F.col("l"))))
    # the first line counts without a separator
    kept = take_within(lines, keys, ["pos"], F.length("l") + 1, budget + 1)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "l"))).alias("ls")).select(
        *keys, F.array_join(F.transform("ls", lambda x: x.l), "\n").alias("prose"))


def changed_risks(passages, keys, budget):
    """New and reworded risk passages, new ones and flagged language first, within a budget."""
    weight = F.coalesce(F.array_max(F.transform("triggers", lambda t: t.weight)), F.lit(0.0))
    rows = passages.where((F.col("kind") != "numbers") & F.col("change_type").isin("new", "changed")).withColumn("_w", -weight).withColumn(
        "block", F.concat(F.lit("["), F.col("change_type"), F.lit("] "), F.col("text")))
    order = [(F.col("change_type") != "new").cast("int"), F.col("_w"), F.col("position")]
    return take_within(rows, keys, order, F.length("block") + 2, budget + 2).drop("_w", "running")


def digest_lines(table, rows, currency="USD", columns=2):
    """'label: period value | period value' lines of the latest columns of a table."""
    label = fiscal_label("fiscal_year", "fiscal_period")
    value = F.when(F.col("unit") == "ratio", F.format_string("%.1f%%", F.col("value") * 100)).when(
        F.col("unit") == "days", F.format_string("%.0f days", "value")).when(
        F.col("unit") == "currency_per_share", F.format_string("%.2f per share", "value")).otherwise(labels.money_text("value", F.lit(currency)))
    cells = table.where(F.col("row_key").isin(list(rows)) & (F.col("age") <= columns)).select(
        "company_id", "row_order", "row_key", F.struct((-F.col("age")).alias("a"), F.concat_ws(" ", label, F.coalesce(value, F.lit("n/a"))).alias("t")).alias("c"))
    return cells.groupBy("company_id", "row_order", "row_key").agg(F.sort_array(F.collect_list("c")).alias("cs")).select(
        "company_id", "row_order", F.concat(F.replace("row_key", F.lit("_"), F.lit(" ")), F.lit(": "),
                                            F.array_join(F.transform("cs", lambda c: c.t), " | ")).alias("line"))


def digest_value(value, unit, currency):
    """A value as a digest words it: a percentage, days, an amount a share, or money."""
    v, u = col(value), col(unit)
    return (F.when(v.isNull(), "n/a").when(u.isin("ratio", "points"), F.format_string("%.1f%%", v * 100)).when(u == "days", F.format_string("%.0f days", v))
            .when(u == "currency_per_share", F.format_string("%.2f per share", v)).otherwise(labels.money_text(v, currency)))


def digest_changes(changes, most=MAX_DIGEST_CHANGES):
    """The most material changes of a company as lines under ids c1, c2, ....

    ``changes``: company_id, change_id, kind, change_type, category_label, label,
    text, value, base_value, change, unit, currency, period_label,
    base_period_label, score, flags, note.
    """
    top = top_n(changes, ["company_id"], [F.desc("score"), F.col("change_id")], most, "place")
    c = F.col("change")
    moved = (F.when(c.isNull(), "").when(F.col("unit").isin("ratio", "points"), F.format_string(" (%+.1f points)", c * 100))
             .when(F.col("unit") == "days", F.format_string(" (%+.0f days)", c)).otherwise(F.format_string(" (%+.1f%%)", c * 100)))
    name = F.concat(F.coalesce("label", F.lit("")), F.lit(" ("), F.coalesce("category_label", F.lit("")), F.lit(")"))

    def shown(value, period):
        return F.concat(digest_value(value, "unit", "currency"), F.lit(" ("), F.coalesce(period, F.lit("n/a")), F.lit(")"))

    wording = F.concat("change_type", F.lit(" wording in "), F.coalesce("category_label", F.lit("")), F.lit(': "'),
                       F.substring(F.coalesce("text", F.lit("")), 1, QUOTED_CHARS), F.lit('"'))
    gone = F.concat(name, F.lit(" no longer disclosed; was "), shown("base_value", "base_period_label"))
    base = F.when(F.col("base_value").isNotNull(), F.concat(F.lit(" from "), shown("base_value", "base_period_label"))).otherwise("")
    note = F.when(F.col("note") != "", F.concat(F.lit("; "), "note")).otherwise("")
    figures = F.concat("change_type", F.lit(": "), name, F.lit(" "), shown("value", "period_label"), base, moved, note)
    flags = F.when(F.size("flags") > 0, F.concat(F.lit(" ["), F.array_join("flags", ", "), F.lit("]"))).otherwise("")
    what = F.when(F.col("kind") == "narrative", wording).when(F.col("change_type") == "removed", gone).otherwise(figures)
    ref = F.concat(F.lit("c"), "place")
    return top.select("company_id", F.lit(0).alias("block"), F.lit("FILING CHANGES, most material first").alias("title"), F.col("place").cast("long").alias("place"),
                      ref.alias("ref"), F.col("change_id").alias("key"),
                      F.concat(ref, F.lit(" score "), F.format_string("%.2f", "score"), flags, F.lit(": "), what).alias("line"))


def digest_items(extracted):
    """Extracted items whose quotes were found as lines under ids; a letter's numbers run on over the filings.

    ``extracted``: company_id, filing_rank, report, field, position, status,
    trend, realized, direction, headline, detail.
    """
    order = F.array_position(F.array(*map(F.lit, ID_PREFIX)), F.col("field"))
    rows = extracted.where((F.col("status") != "unverified") & F.col("field").isin(*ID_PREFIX)).withColumn("order", order)
    number = F.row_number().over(Window.partitionBy("company_id", "field").orderBy("filing_rank", "position"))
    place = F.row_number().over(Window.partitionBy("company_id", "filing_rank").orderBy("order", "position"))
    ref = F.concat(lookup(ID_PREFIX, "field"), number)
    extra = F.when(F.col("field") == "risks", F.concat(F.lit(" ["), F.coalesce("trend", F.lit("ongoing")), F.when(F.col("realized"), ", has happened").otherwise(""), F.lit("]"))).when(
        F.col("field") == "drivers", F.concat(F.lit(" ["), F.coalesce("direction", F.lit("unclear")), F.lit("]"))).otherwise("")
    rows = rows.withColumns({"ref": ref, "place": place.cast("long")})
    return rows.select(
        "company_id", (F.col("filing_rank") + 1).cast("int").alias("block"), F.concat(F.lit("EXTRACTED FROM THE "), "report", F.lit(" (verified quotes)")).alias("title"),
        "place", "ref", F.concat_ws("|", "filing_rank", "headline").alias("key"),
        F.concat("ref", F.lit(" "), "field", extra, F.lit(": "), F.coalesce("headline", F.lit("")), F.lit(": "), F.coalesce("detail", F.lit(""))).alias("line"))


def digest_text(lines):
    """One digest per company: its blocks in order, each under its title (C18).  A company has at most a few hundred lines."""
    part = F.when(F.col("place") == 1, F.concat(F.lit("\n"), "title", F.lit("\n"), "line")).otherwise(F.col("line"))
    rows = lines.select("company_id", F.struct("block", "place", part.alias("part")).alias("p"))
    return rows.groupBy("company_id").agg(F.sort_array(F.collect_list("p")).alias("ps")).select(
        "company_id", F.array_join(F.transform("ps", lambda x: x.part), "\n").alias("text"))


def ranked_insights(ranked, extracted):
    """Ranked statements with the extracted item they refer to, by filing and headline; the last of equal ones."""
    known = extracted.groupBy("company_id", F.col("accession_number").alias("ref_filing"), F.col("headline").alias("ref_label")).agg(
        F.max_by("detail", "position").alias("extracted_detail"))
    return ranked.join(known, ["company_id", "ref_filing", "ref_label"], "left")


def insight_lists(extractions, items):
    """The lists of extracted items that a company shows.

    ``extractions``: company_id, accession_number, filing_rank (0: the latest
    filing), is_annual; ``items``: company_id, accession_number, field, position,
    headline, detail.  Some lists come from the latest filing read, segments from
    the annual report if one was read; the others run over all filings, the latest
    first, a headline once whatever its case, up to a limit.  Other fields are left out.
    """
    read = extractions.groupBy("company_id").agg(
        F.min("filing_rank").alias("latest"), F.min(F.when(F.col("is_annual"), F.col("filing_rank"))).alias("annual"))
    rows = items.where(F.col("field").isin(*LATEST_LISTS, *MERGED_LISTS)).join(
        extractions.select("company_id", "accession_number", "filing_rank"), ["company_id", "accession_number"]).join(read, "company_id")
    from_annual = (F.col("field") == "segments") & F.col("annual").isNotNull()
    single = F.col("field").isin(*LATEST_LISTS) | from_annual
    rows = rows.where(F.when(from_annual, F.col("filing_rank") == F.col("annual")).when(single, F.col("filing_rank") == F.col("latest")).otherwise(True))
    same = F.when(single, F.concat_ws("|", "accession_number", "position")).otherwise(F.lower("headline"))
    rows = rows.select("company_id", "field", "accession_number", "filing_rank", "position", "headline", "detail", same.alias("same"),
                       F.when(single, F.lit(None)).otherwise(lookup(MERGED_LISTS, "field")).alias("limit"))
    first = pick(rows, ["company_id", "field", "same"], ["filing_rank", "position"], largest=False)
    place = F.row_number().over(Window.partitionBy("company_id", "field").orderBy("filing_rank", "position"))
    return first.withColumn("place", place).where(F.col("limit").isNull() | (F.col("place") <= F.col("limit"))).drop("same", "limit")


def _within(lines, limit, extra, stops):
    """The lines of an array that fit a budget of characters, each with ``extra`` more; the first that does not fit ends it, or is passed over."""
    def step(state, line):
        fits = state["open"] & (state["size"] + F.length(line) <= limit)
        after = F.struct(F.when(fits, state["size"] + F.length(line) + extra).otherwise(state["size"]).alias("size"),
                         (fits if stops else F.lit(True)).alias("open"))
        return after, F.when(fits, F.array(line)).otherwise(F.array().cast("array<string>"))

    return folded(lines, F.struct(F.lit(0).alias("size"), F.lit(True).alias("open")), step, "string")["out"]


def prose(text, limit):
    """The paragraphs of a text without tables and page furniture, until one would exceed the limit (C17)."""
    lines = F.transform(F.split(F.regexp_replace(T.plain_spaces(text), T.PAGE_FURNITURE, ""), "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~(x.rlike(r"\d") & T.is_tabular(x)))
    return F.array_join(_within(kept, limit, 1, stops=True), "\n")


def risk_outline(text, limit):
    """The titles of a text's risks as a list; a title that no longer fits is passed over (C17)."""
    return F.array_join(F.transform(_within(T.outline_lines(text), limit, 3, stops=False), lambda x: F.concat(F.lit("- "), x)), "\n")


def extraction_inputs(companies, filings, sections, bases, limits=None):
    """The text that statements are extracted from, one row per filing (C17).

    ``companies``: company_id, name, ticker, reporting_currency; ``filings``:
    filing_id, company_id, form_type, fiscal_year, fiscal_period, period_end,
    is_annual; ``sections``: filing_id, category, ordinal, text; ``bases``:
    filing_id, base_filing_id (the annual report whose risks an annual report's
    are compared with).  Sections of a category are read in their order.  Business,
    discussion and risks follow each other, each within its own budget of
    characters: an annual report shows its risk titles and what is new or reworded,
    an interim one its updates.  A filing without texts has its heading alone.
    """
    limits = {**INPUT_CHARS, **(limits or {})}
    wanted = ("business", "management_discussion", "risk_factors")
    parts = {c: F.sort_array(F.collect_list(F.when((F.col("category") == c) & F.col("text").isNotNull(), F.struct("ordinal", "text")))) for c in wanted}
    texts = sections.where(F.col("category").isin(*wanted)).groupBy("filing_id").agg(*[
        F.nullif(F.array_join(F.transform(parts[c], lambda x: x.text), "\n"), F.lit("")).alias(c) for c in wanted])
    report = F.coalesce(fiscal_label("fiscal_year", "fiscal_period"), F.col("period_end").cast("string"))
    rows = filings.select("filing_id", "company_id", "form_type", "period_end", "is_annual", report.alias("label")).join(companies.select(
        "company_id", "name", "ticker", "reporting_currency"), "company_id").join(texts, "filing_id", "left")

    named = filings.select(F.col("filing_id").alias("base_filing_id"), F.col("form_type").alias("base_form"), fiscal_label("fiscal_year", "fiscal_period").alias("base_label"))
    risks = texts.where(F.col("risk_factors").isNotNull())
    annual = filings.where("is_annual").select("filing_id")
    pairs = bases.select("filing_id", "base_filing_id").join(annual, "filing_id").join(risks.select("filing_id", F.col("risk_factors").alias("new")), "filing_id").join(
        risks.select(F.col("filing_id").alias("base_filing_id"), F.col("risk_factors").alias("base")), "base_filing_id")
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("text")) for side in ("new", "base")])
    # both texts of a pair move together, and are split where they are compared
    pairs = gather(pairs.select("filing_id", "new", "base"), "filing_id")
    sentences = sentence_rows(pairs.select("filing_id", F.lit(False).alias("same_kind"), F.inline(sides)), ["filing_id", "side", "same_kind"])
    blocks = changed_risks(section_diff(sentences, "filing_id"), ["filing_id"], limits["risk_changes"])
    weight = F.coalesce(F.array_max(F.transform("triggers", lambda t: t.weight)), F.lit(0.0))
    place = F.struct((F.col("change_type") != "new").alias("kind"), (-weight).alias("weight"), "position", "block")
    changed = blocks.groupBy("filing_id").agg(F.sort_array(F.collect_list(place)).alias("b")).select(
        "filing_id", F.array_join(F.transform("b", lambda x: x.block), "\n\n").alias("changed"))
    since = bases.select("filing_id", "base_filing_id").join(named, "base_filing_id").join(changed, "filing_id").select("filing_id", "base_form", "base_label", "changed")
    rows = rows.join(since, "filing_id", "left")

    def part(title, body, when):
        return F.when(when, F.concat(F.lit(f"=== {title} ===\n"), body))

    discussion, risk = F.col("management_discussion"), F.col("risk_factors")
    heading = F.concat(F.lit("COMPANY: "), "name", F.lit(" ("), "ticker", F.lit("). FILING: "), "form_type", F.lit(" for "), "label", F.lit(", period ended "),
                       F.col("period_end").cast("string"), F.lit(". Reporting currency: "), F.coalesce("reporting_currency", F.lit("unknown")), F.lit("."))
    compared = F.concat(F.lit("=== NEW OR CHANGED RISK FACTORS (since the "), "base_form", F.lit(" for "), "base_label", F.lit(") ===\n"), "changed")
    shown = F.array_compact(F.array(
        heading, part("BUSINESS DESCRIPTION", prose("business", limits["business"]), F.col("business").isNotNull()),
        part("MANAGEMENT'S DISCUSSION AND ANALYSIS", prose(discussion, F.when(F.col("is_annual"), limits["discussion_annual"]).otherwise(
            limits["discussion_interim"])), discussion.isNotNull()),
        part("RISK FACTORS: OUTLINE", risk_outline(risk, limits["risk_outline"]), risk.isNotNull() & F.col("is_annual")), compared,
        part("RISK FACTOR UPDATES IN THIS QUARTERLY REPORT", prose(risk, limits["risk_updates"]), risk.isNotNull() & ~F.col("is_annual"))))
    return rows.select("company_id", "filing_id", F.array_join(shown, "\n\n").alias("text"))
