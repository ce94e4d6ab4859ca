"""The driver tables read as disclosures, so every operator runs over whole tables.

supplier = company, quarter of the order date = filing, order line = reported
value.  Line ``l_partkey`` picks the reported line (16 headline metrics, 8
disclosure lines) and ``l_linenumber`` the span it is reported for.  All values
are sums of exact cents, so both engines agree to the last bit.
"""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arith import gather, literal_map, once
from ..functions.fixed_values import METRIC_TABLE
from ..operators.wording import listed_rows

TWIN_METRICS = ["revenue", "cost_of_revenue", "gross_profit", "operating_income", "pretax_income", "income_tax", "net_income",
                "operating_cash_flow", "capex", "cash", "accounts_receivable", "inventory", "total_assets", "equity",
                "deposits", "net_interest_income"]
TWIN_INSTANTS = ["cash", "accounts_receivable", "inventory", "total_assets", "equity", "deposits"]
TWIN_FAMILIES = ["commitment", "guarantee", "debt", "investment"]
LINES = 24
INSTANT_LINES = [TWIN_METRICS.index(m) for m in TWIN_INSTANTS] + [len(TWIN_METRICS) + i for i in range(4)]
SPANS = ["prior", "ytd", "own"]
PRIOR, YTD, OWN = range(3)
#: Order lines of one task, on average, where they are read by company.
TASK_LINES = 100_000
#: Compared pairs of texts of one task, on average: their sentences are taken apart into words there.
TASK_TEXTS = 1_000


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark, folder, name, key=None):
    """A text table, its rows dealt out in turn, or by ``key`` where all that follows meets them by it.

    A row group is one task however many cores there are, and the work on a
    text costs far more than moving it.
    """
    rows, tasks = table(spark, folder, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, key) if key else rows.repartition(tasks)


def cents(c):
    return F.round(F.col(c) * 100).cast("long")


def quarter_end(year, quarter):
    return F.last_day(F.make_date(year, quarter * 3, F.lit(1)))


def _lines(spark, folder):
    """Order lines with the quarter they were ordered in; what is derived from one side is derived before the join moves it."""
    day = F.to_date("o_orderdate")
    orders = table(spark, folder, "orders").select("o_orderkey", (F.year(day) * 4 + F.quarter(day) - 1).alias("at"))
    line = (F.col("l_partkey") % LINES).cast("int")
    variant = F.col("l_linenumber") % 4
    # variant 0 repeats the year-earlier quarter, 1 and 2 report the quarter, 3 the year to date
    span = F.when(variant == 0, PRIOR).when((variant == 3) & ~line.isin(INSTANT_LINES), YTD).otherwise(OWN)
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", line.alias("line"), span.alias("span_no"), cents("l_extendedprice").alias("cents"),
        cents("l_discount").alias("disc"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _by_company(spark, folder, rows):
    """Rows of order lines brought together by company, in tasks of a bounded number of lines.

    What later becomes of a line is many times wider than what is moved, so the
    size of the moved partitions says nothing about the memory that a task needs.
    """
    count = table(spark, folder, "lineitem").count()
    if count <= 4 * TASK_LINES:
        return gather(rows, "company_id")
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK_LINES)), "company_id")


def _year():
    return F.shiftright("at", 2).alias("fy")


def _quarter():
    return (F.col("at").bitwiseAND(3) + 1).alias("q")


def filing_no(company, year, quarter):
    return F.col(company) * 1000 + (F.col(year) - 1990) * 4 + F.col(quarter)


def filings(spark, folder):
    """One filing per supplier and order quarter; the fourth quarter's is the annual report."""
    q = _lines(spark, folder).select(F.col("l_suppkey").alias("company_id"), "at").distinct().select("company_id", _year(), _quarter())
    annual = F.col("q") == 4
    end = quarter_end(F.col("fy"), F.col("q"))
    return q.select(
        "company_id", filing_no("company_id", "fy", "q").alias("filing_id"),
        F.when(annual, "10-K").otherwise("10-Q").alias("form_type"),
        F.date_add(end, 30).alias("filing_date"),
        F.when(annual, F.make_date(F.col("fy"), F.lit(1), F.lit(1)))
        .otherwise(F.make_date(F.col("fy"), F.col("q") * 3 - 2, F.lit(1))).alias("period_start"),
        end.alias("period_end"), F.col("fy").alias("fiscal_year"),
        F.when(annual, "FY").otherwise(F.concat(F.lit("Q"), F.col("q").cast("string"))).alias("fiscal_period"),
        F.when(annual, 12).otherwise(3).alias("period_months"), annual.alias("is_annual"))


def facts(spark, folder):
    """One fact per supplier, filing quarter, reported line and span."""
    n = len(TWIN_METRICS)
    rows = _lines(spark, folder).select(F.col("l_suppkey").alias("company_id"), "at", "line", "span_no", "cents")
    # companies are brought together while rows are a few numbers; no later step by company moves their names and labels
    grouped = _by_company(spark, folder, rows).groupBy("company_id", "at", "line", "span_no").agg(F.sum("cents").alias("cents")).select(
        "company_id", _year(), _quarter(), "line", F.col("line").isin(INSTANT_LINES).alias("instant"),
        F.element_at(F.array(*map(F.lit, SPANS)), F.col("span_no") + 1).alias("span"), "cents")
    year = F.when(F.col("span") == "prior", F.col("fy") - 1).otherwise(F.col("fy"))
    end = quarter_end(year, F.col("q"))
    first_month = F.when(F.col("span") == "ytd", 1).otherwise(F.col("q") * 3 - 2)
    period = (
        F.when(F.col("instant"), F.when(F.col("q") == 4, "FY").otherwise(F.concat(F.lit("Q"), F.col("q").cast("string"))))
        .when(F.col("span") == "ytd", F.element_at(F.array(*map(F.lit, ["Q1", "H1", "9M", "FY"])), F.col("q")))
        .otherwise(F.concat(F.lit("Q"), F.col("q").cast("string"))))
    metric = F.when(F.col("line") < n, F.element_at(F.array(*map(F.lit, TWIN_METRICS)), F.col("line") + 1))
    family = F.element_at(F.array(*map(F.lit, TWIN_FAMILIES)), (F.col("line") % 4).cast("int") + 1)
    months = F.when(~F.col("instant"), F.when(F.col("span") == "ytd", F.col("q") * 3).otherwise(3))
    key = F.when(F.col("line") < n, F.concat(F.lit("metric."), metric)).otherwise(
        F.concat(family, F.lit(".line_"), F.col("line").cast("string")))
    return grouped.select(
        "company_id", filing_no("company_id", "fy", "q").alias("filing_id"),
        F.date_add(quarter_end(F.col("fy"), F.col("q")), 30).alias("filing_date"),
        F.when(F.col("q") == 4, "10-K").otherwise("10-Q").alias("form_type"), (F.col("q") == 4).alias("is_annual"),
        F.concat_ws("|", "company_id", "fy", "q", "line", "span").alias("fact_id"),
        metric.alias("canonical_metric"), key.alias("fact_key"),
        F.when(F.col("line") < n, F.lit("financial_metric")).otherwise(family).alias("category"),
        F.translate(key, "._", "  ").alias("label"), F.concat(F.lit("us-gaap:"), key).alias("xbrl_concept"),
        (F.col("cents") / 100.0).alias("value"), F.lit("currency").alias("normalized_unit"), F.lit("USD").alias("currency"),
        F.when(F.col("instant"), "instant").otherwise("duration").alias("period_type"),
        F.when(~F.col("instant"), F.make_date(year, first_month, F.lit(1))).alias("period_start"), end.alias("period_end"),
        year.alias("fiscal_year"), period.alias("fiscal_period"), months.cast("int").alias("period_months"),
        (F.col("span") == "prior").alias("is_comparative"),
        F.when(F.col("cents") % 50 == 0, F.array(F.lit("subsequent_event"))).otherwise(F.array().cast("array<string>")).alias("triggers"))


NOTES = [
    "We recorded an impairment of ${n} million on goodwill during fiscal {y}, net of tax effects.",
    "The company could be unable to meet the terms of its credit support agreement by March {n}, {y}.",
    "There have been no material changes to our risk factors since the annual report for fiscal {y}.",
    "Revenue from Alpha Corp. Services grew {n}% in {y}, and the U.S. Treasury received the payment in full.",
    "A material weakness was identified and {n} controls were terminated during the year ended June 30, {y}.",
    "Total assets {n} {y} 12,345 67,890 (1,234) 5.6% 7,001",
    "Our guarantee of the lease may result in a payment of ${n}.5 billion if the tenant defaults on the loan.",
    "Management entered into an agreement; The board concluded that substantial doubt was resolved in {y}.",
]


def sections(spark, folder):
    """Documents as section texts, each with a closing note whose numbers and years depend on the document."""
    return _with_note(texts(spark, folder, "documents"))


def _with_note(docs):
    """The texts of documents, each with a closing note whose numbers and years depend on the document."""
    n, y = (F.col("doc_id") % 50 + 1).cast("string"), (F.col("doc_id") % 3 + 2020).cast("string")

    def note(template):
        return F.replace(F.replace(F.lit(template), F.lit("{n}"), n), F.lit("{y}"), y)

    pick_note = F.element_at(F.array(*[note(t) for t in NOTES]), (F.col("doc_id") % len(NOTES)).cast("int") + 1)
    return docs.select("doc_id", "lang", "source", F.concat("text", F.lit("\n"), pick_note).alias("text"))


def section_pairs(spark, folder):
    """Each document with the earlier one it is compared with.

    The earlier document that first used most of its long lines, else the one 8
    before it (which closes with the same kind of note).  Hashing a line costs no
    more than moving it, so texts are read where they are stored.
    """
    docs = _with_note(table(spark, folder, "documents"))
    lines = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).where(F.length("line") > 60)
    lines = lines.select("doc_id", F.unhex(F.md5("line")).alias("h"))
    first = lines.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    votes = lines.join(first, "h").where(F.col("first_id") < F.col("doc_id")).groupBy("doc_id", "first_id").agg(
        F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("doc_id").agg(F.max_by("first_id", F.struct("votes", (-F.col("first_id")).alias("f"))).alias("base_id"))
    return docs.select("doc_id").join(best, "doc_id", "left").withColumn("base_id", F.coalesce("base_id", F.col("doc_id") - 8))


def diff_inputs(spark, folder):
    """The sentences of both sides of every compared pair; a text is split once, before it goes to its pairs."""
    sides = F.array(F.struct(F.lit("new").alias("side"), F.col("doc_id").alias("id")),
                    F.struct(F.lit("base").alias("side"), F.col("base_id").alias("id")))
    wanted = section_pairs(spark, folder).select(F.col("doc_id").alias("pair_id"), F.inline(sides))
    docs = once(sections(spark, folder).select(F.col("doc_id").alias("id"), "text"), sentences=T.sentences("text")).drop("text")
    # a merge join keeps the texts spread over the tasks; broadcasting them would run everything after in one
    lists = wanted.hint("merge").join(docs, "id").select("pair_id", "side", "sentences", (F.col("pair_id") % 2 == 0).alias("same_kind"))
    tasks = -(-table(spark, folder, "documents").count() // TASK_TEXTS)
    lists = lists.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks), "pair_id")
    return listed_rows(lists, ["pair_id", "side", "same_kind"])


#: The tag that each metric of the twin is reported under; those that the series know are read as these.
FIRST_TAGS = {
    "revenue": "Revenues", "gross_profit": "GrossProfit", "operating_income": "OperatingIncomeLoss", "net_income": "NetIncomeLoss",
    "operating_cash_flow": "NetCashProvidedByUsedInOperatingActivities", "capex": "PaymentsToAcquirePropertyPlantAndEquipment",
    "cash": "CashAndCashEquivalentsAtCarryingValue", "cost_of_revenue": "ResearchAndDevelopmentExpense",
    "pretax_income": "PaymentsForRepurchaseOfCommonStock", "income_tax": "PaymentsOfDividends", "net_interest_income": "EarningsPerShareDiluted",
    "accounts_receivable": "LongTermDebt", "total_assets": "LongTermDebtNoncurrent", "inventory": "InventoryNet", "equity": "StockholdersEquity",
    "deposits": "Deposits"}
SECOND_TAGS = {"revenue": "RevenueFromContractWithCustomerExcludingAssessedTax", "capex": "PaymentsToAcquireProductiveAssets"}


def companyfacts_json(spark, folder):
    """The facts as reported-facts JSON, one object per filing (a filing has at most a few dozen facts).

    Filings since 1998 use the newer tags, so series switch tags between years.
    """
    f = facts(spark, folder).where(F.col("canonical_metric").isNotNull())
    newer = F.year("filing_date") >= 1998
    metric = F.col("canonical_metric")
    tag = F.coalesce(F.when(newer, F.try_element_at(literal_map(SECOND_TAGS), metric)), F.try_element_at(literal_map(FIRST_TAGS), metric))
    entry = F.struct(F.col("period_start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end"),
                     F.col("value").alias("val"), F.col("form_type").alias("form"), F.col("filing_date").cast("string").alias("filed"),
                     F.col("fiscal_year").alias("fy"), F.col("fiscal_period").alias("fp"))
    by_tag = f.withColumn("tag", tag).groupBy("company_id", "filing_id", "tag").agg(F.collect_list(entry).alias("entries"))
    unit = F.when(F.col("tag").startswith("EarningsPerShare"), "USD/shares").otherwise("USD")
    tags = by_tag.groupBy("company_id", "filing_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "tag", F.struct(F.create_map(unit, F.col("entries")).alias("units"))))).alias("tags"))
    return tags.select("company_id", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), "tags").alias("facts"))).alias("payload"))


def report_dates(spark, folder, annual):
    """The latest annual (or quarterly) report date of each company."""
    return filings(spark, folder).where(F.col("is_annual") == annual).groupBy("company_id").agg(F.max("period_end").alias("report_date"))


def listing(spark, folder):
    """Orders as filing lists: ten customers make a registrant, status and priority make the form."""
    o = table(spark, folder, "orders").withColumn("filing_date", F.to_date("o_orderdate"))
    base = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("6-K")
    form = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(base, F.lit("/A"))).otherwise(base)
    return o.select(
        F.floor(F.col("o_custkey") / 10).cast("long").alias("company_id"), F.col("o_orderkey").alias("filing_id"),
        F.concat(F.lit("A-"), F.col("o_orderkey").cast("string")).alias("accession_number"), form.alias("form_type"), "filing_date",
        quarter_end(F.year("filing_date"), F.quarter("filing_date")).alias("report_date"),
        quarter_end(F.year("filing_date"), F.quarter("filing_date")).alias("period_end"),
        (F.col("o_orderkey") % 2 == 0).alias("inline_xbrl"),
        (-F.unix_date("filing_date").cast("long") * 100000000 - F.col("o_orderkey")).alias("position"),
        F.col("o_orderstatus").isin("F").alias("is_annual"))


def submissions_json(spark, folder):
    """Each order as a small list kept as parallel arrays; odd orders lack the tagged flag."""
    o = listing(spark, folder)
    twice = F.col("filing_date").cast("string"), F.date_add("filing_date", 20).cast("string")
    even = F.struct(
        F.array("form_type", F.lit("8-K")).alias("form"), F.array("accession_number", F.concat("accession_number", F.lit("-b"))).alias("accessionNumber"),
        F.array(F.lit("a.htm"), F.lit("b.htm")).alias("primaryDocument"), F.array(*twice).alias("filingDate"),
        F.array(F.col("report_date").cast("string"), F.lit("")).alias("reportDate"),
        F.when(F.col("filing_id") % 2 == 0, F.array(F.lit(1), F.lit(0))).alias("isInlineXBRL"))
    return o.select("company_id", (F.lit(2001) - F.year("filing_date")).alias("page"), F.to_json(even).alias("payload"))


def written_items(spark, folder):
    """Items to verify: each document's first line quoted, with its closing note as the statement."""
    docs = sections(spark, folder)
    first = F.element_at(F.split("text", "\n"), 1)
    quote = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring(first, 1, 60), F.lit(" … "), F.substring(first, 61, 60))).when(
        F.col("doc_id") % 3 == 1, first).otherwise(F.concat(first, F.lit(" something that was never said")))
    n = F.col("doc_id") % 50 + 1
    claim = F.when(F.col("doc_id") % 2 == 0, F.format_string("Costs of $%d million", n)).otherwise(
        F.format_string("Growth of %d%% and $%d.5 billion", n, n))
    return docs.select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("source_id"), claim.alias("headline"),
                       F.lit("").alias("detail"), quote.alias("evidence")), docs.select(F.col("doc_id").alias("source_id"), "text")


def questions(spark, folder):
    """User turns as questions, each over the passages of one document source."""
    t = table(spark, folder, "conversations").where(F.col("role") == "user")
    before = t.select(F.col("conv_id"), (F.col("turn") + 2).alias("turn"), F.col("text").alias("follow_up"))
    return t.join(before, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("pool"),
        F.substring("text", 1, 500).alias("question"), F.substring("follow_up", 1, 500).alias("follow_up"))


def renamed_facts(spark, folder):
    """Disclosure lines under three-part keys, repeated a year later as comparatives.

    Every third company drops a word from its keys in 1999, so the comparatives of
    that year show the old values under the new keys.
    """
    own = facts(spark, folder).where("canonical_metric IS NULL AND NOT is_comparative")
    keyed = own.select(
        "company_id", "filing_id", "filing_date", "form_type", "fact_id", "canonical_metric", "category", "value", "currency", "period_start",
        "period_end", F.element_at(F.split("fact_key", "_"), -1).alias("no"), F.lit("us-gaap:Items").alias("xbrl_concept"))
    again = keyed.withColumn("filing_id", F.col("filing_id") + 4).withColumn("filing_date", F.add_months("filing_date", 12))

    def named(df, comparative):
        short = (F.col("company_id") % 3 == 0) & (F.year("filing_date") >= 1999)
        key = F.concat(F.col("category"), F.lit(".items."), F.when(short, "cloud_line_").otherwise("multi_cloud_line_"), F.col("no"))
        return df.withColumn("fact_key", key).withColumn("is_comparative", F.lit(comparative))

    return named(keyed, False).unionByName(named(again, True))


def breakdown_facts(spark, folder):
    """Flow metrics read as segments and regions."""
    f = facts(spark, folder).where("canonical_metric IN ('gross_profit', 'operating_income', 'net_income', 'cost_of_revenue', 'income_tax')")
    segment = F.col("canonical_metric").isin("gross_profit", "operating_income", "net_income")
    family = F.when(segment, "segment").otherwise("geography")
    measure = F.when(F.col("canonical_metric") == "net_income", "operating_income").otherwise("revenue")
    return f.withColumn("category", family).withColumn("fact_key", F.concat_ws(".", family, measure, F.col("canonical_metric")))


def share_facts(spark, folder):
    """Order lines as anonymized customers' shares of revenue: discount as the share, line number as the customer's letter."""
    f = _lines(spark, folder).select(
        F.col("l_suppkey").alias("company_id"), _year(), _quarter(), "l_linenumber", "disc")
    g = f.groupBy("company_id", "fy", "q", "l_linenumber").agg(F.max("disc").alias("disc"))
    end = quarter_end(F.col("fy"), F.col("q"))
    basis = F.when(F.col("l_linenumber") <= 4, "revenue").otherwise("receivable")
    return g.select(
        "company_id", filing_no("company_id", "fy", "q").alias("filing_id"), F.date_add(end, 30).alias("filing_date"),
        F.concat_ws("|", "company_id", "fy", "q", "l_linenumber").alias("fact_id"), F.lit("customer_concentration").alias("category"),
        F.concat(F.lit("customer_concentration.concentration_risk."), basis, F.lit(".customer_"), F.col("l_linenumber").cast("string")).alias("fact_key"),
        F.lit("ratio").alias("normalized_unit"), (F.col("disc") / 100.0).alias("value"), end.alias("period_end"),
        F.lit(3).alias("period_months"), F.lit(False).alias("is_comparative"))


def change_rows(changes):
    """Scored numeric changes in the shape the grouping and the omission check read."""
    return changes.where(F.col("change_type") != "repeated").select(
        "company_id", F.concat_ws("|", "fact_key", "period_type").alias("change_id"), "kind", "category", "change_type", "label",
        F.lit(None).cast("string").alias("text"), "value", "base_value", "unit", "currency", "score", "tier", "flags",
        F.lit(None).cast("string").alias("first_itemized"))


def mixed_changes(changes):
    """Scored changes with what groups fold: nearly equal amounts, lines of a concept that is new altogether, and wording that quotes an amount."""
    rows = changes.where(F.col("change_type") != "repeated").select(
        "company_id", F.concat_ws("|", "fact_key", "period_type").alias("change_id"), "kind", "category", "change_type", "label",
        F.lit(None).cast("string").alias("text"), "value", "base_value", "unit", "currency", "score", "tier")
    itemized = F.when(F.col("category") == "investment", F.concat(F.lit("investment:"), "change_type"))
    said = F.concat(F.lit("The guarantees of the year amount to "), F.col("value").cast("string"))

    def made(mark, factor, score, kind=F.col("kind"), text=F.col("text"), itemized=itemized):
        return F.struct(
            F.concat("change_id", F.lit(mark)).alias("change_id"), kind.alias("kind"), text.alias("text"), (F.col("value") * factor).alias("value"),
            F.round(F.col("score") * score, 3).alias("score"), itemized.alias("first_itemized"))

    wording = made("|w", 1.002, 1.2, F.lit("narrative"), said, F.lit(None).cast("string"))
    versions = F.inline(F.array(made("", 1.0, 1.0), made("|b", 1.004, 0.9), made("|c", 1.0085, 0.8), wording))
    rows = rows.select("company_id", "category", "change_type", "label", "base_value", "unit", "currency", "tier", F.col("change_id"), "kind", "text", "value", "score")
    rest = ["company_id", "category", "change_type", "label", "base_value", "unit", "currency", "tier"]
    reasons = F.array(F.concat(F.lit("is "), "kind"), F.concat(F.lit("of "), "category"))
    return rows.select(*rest, versions).withColumn("reasons", reasons)


def tagged_documents(spark, folder):
    """The facts of a filing as one tagged XHTML document: contexts, units, a statement table and a note.

    A filing has at most a few dozen facts.  Every other company prints decimal
    commas; every third prints cents with a scale of -2.
    """
    f = facts(spark, folder)
    context = F.concat(F.lit("c-"), F.coalesce(F.col("period_start").cast("string"), F.lit("i")), F.lit("-"), F.col("period_end").cast("string"))
    period = F.when(F.col("period_start").isNull(), F.concat(
        F.lit("<xbrli:instant>"), F.col("period_end").cast("string"), F.lit("</xbrli:instant>"))).otherwise(F.concat(
            F.lit("<xbrli:startDate>"), F.col("period_start").cast("string"), F.lit("</xbrli:startDate><xbrli:endDate>"),
            F.col("period_end").cast("string"), F.lit("</xbrli:endDate>")))
    ctx = F.concat(F.lit('<xbrli:context id="'), context, F.lit('"><xbrli:period>'), period, F.lit("</xbrli:period></xbrli:context>"))
    plain = F.format_number("value", 2)
    comma = F.col("company_id") % 2 == 1
    scaled = F.col("company_id") % 3 == 0
    shown = F.when(scaled, F.format_number(F.round(F.col("value") * 100).cast("long"), 0)).when(
        comma, F.translate(plain, ",.", ".,")).otherwise(plain)
    attributes = F.when(scaled, F.lit(' scale="-2"')).when(comma, F.lit(' format="ixt:num-comma-decimal"')).otherwise(F.lit(""))
    cell = F.concat(
        F.lit("<tr><td>"), F.col("label"), F.lit('</td><td><ix:nonFraction name="gaap:'), F.replace("fact_key", F.lit("."), F.lit("_")),
        F.lit('" contextRef="'), context, F.lit('" unitRef="u" decimals="2" id="'), F.col("fact_id"), F.lit('"'), attributes, F.lit(">"), shown,
        F.lit("</ix:nonFraction></td></tr>"))
    docs = f.groupBy("filing_id").agg(F.array_join(F.array_sort(F.collect_set(ctx)), "").alias("contexts"),
                                      F.array_join(F.array_sort(F.collect_list(cell)), "").alias("cells"))
    docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    head = ('<html xmlns="http://www.w3.org/1999/xhtml" xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" '
            'xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:gaap="http://fasb.org/us-gaap/2024"><body><ix:header><ix:resources>')
    unit = '<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit></ix:resources></ix:header><table>'
    note = ('</table><ix:nonNumeric name="gaap:CommitmentsDisclosureTextBlock" contextRef="c" id="n1" continuedAt="n2"><p>Commitments&nbsp;note</p>'
            '</ix:nonNumeric><p>between</p><ix:continuation id="n2"><p>and its end.</p></ix:continuation></body></html>')
    return docs.select("filing_id", F.concat(F.lit("d"), F.col("filing_id").cast("string"), F.lit(".htm")).alias("document"),
                       F.concat(F.lit(head), "contexts", F.lit(unit), "cells", F.lit(note)).alias("content"))


def disclosure_sections(spark, folder):
    """Every compared pair as a company with two annual reports that hold one section each: (sections, filings)."""
    sides = F.array(F.struct(F.lit(1).alias("side"), F.col("doc_id").alias("id")), F.struct(F.lit(0).alias("side"), F.col("base_id").alias("id")))
    wanted = section_pairs(spark, folder).select(F.col("doc_id").alias("company_id"), F.inline(sides))
    category = F.element_at(F.array(*map(F.lit, ["risk_factors", "subsequent_events", "guarantees", "commitments", "management_discussion"])),
                            (F.col("company_id") % 5).cast("int") + 1)
    docs = sections(spark, folder).select(F.col("doc_id").alias("id"), "text")
    texts = wanted.hint("merge").join(docs, "id").select(
        (F.col("company_id") * 2 + F.col("side")).alias("filing_id"), category.alias("category"), F.lit(0).alias("ordinal"), "text")
    end = F.make_date(F.lit(2024) + F.col("side"), F.lit(12), F.lit(31))
    reports = wanted.select("company_id", (F.col("company_id") * 2 + F.col("side")).alias("filing_id"), F.lit("10-K").alias("form_type"),
                            F.date_add(end, 40).alias("filing_date"), end.alias("period_end"), (F.lit(2024) + F.col("side")).alias("fiscal_year"),
                            F.lit("FY").alias("fiscal_period"), F.lit(True).alias("is_annual"))
    return texts, reports


def index_pages(spark, folder):
    """Each order's filing index as an HTML table with three documents."""
    o = listing(spark, folder).select("filing_id", F.col("company_id").alias("cik"), "accession_number", "form_type", F.lit("main.htm").alias("primary_doc"))

    def row(no, name, kind, size, tag=""):
        return F.concat(F.lit(f"<tr><td>{no}</td><td>{kind}</td><td><a href=\"/Archives/edgar/data/9/"), F.replace("accession_number", F.lit("-"), F.lit("")),
                        F.lit(f"/{name}\">{name}</a>{tag}</td><td>{kind}</td><td>"), size, F.lit("</td></tr>"))

    body = F.concat(F.lit("<table class=\"tableFile\"><tr><th>Seq</th></tr>"), row(1, "main.htm", "10-K", F.lit("1200"), " iXBRL"),
                    row(2, "ex99.htm", "EX-99.1", (F.col("filing_id") % 30000).cast("string")), row(3, "data.xml", "XML", F.lit("5")), F.lit("</table>"))
    return o.withColumn("html", body)


REPORT_PAGES, PEOPLE_PAGE = 24, 11


def annual_reports(spark, folder):
    """Each document as a report of 24 numbered pages, its words dealt out evenly, with a cross-reference table at its end.

    The cited pages depend on the document's number.  One chapter is cited by
    its first page only; the pages behind continue its title.
    """
    # pages, lines and titles all go by document, so whatever is made of a report stays where its text is
    docs = texts(spark, folder, "documents", "doc_id")
    words = F.split(F.translate("text", "\n", " "), " ")
    rows = once(docs.select("doc_id", "source", "text"), words=words)

    def page(n):
        first = F.floor((n - 1) * F.size("words") / REPORT_PAGES).cast("int")
        last = F.floor(n * F.size("words") / REPORT_PAGES).cast("int")
        body = F.array_join(F.slice("words", first + 1, last - first), " ")
        title = F.when(n == PEOPLE_PAGE, "Our People").when((n > PEOPLE_PAGE) & (n <= F.col("doc_id") % 4 + PEOPLE_PAGE), "OUR PEOPLE (continued)").when(
            n == PEOPLE_PAGE + 5, "Our people, cont'd")
        return F.concat_ws("\n", F.concat(F.lit("Report of "), "source"), n.cast("string"), title, F.concat(F.lit("Part "), n.cast("string"), F.lit(": "), body))

    def pages(first, count):
        return F.concat((first).cast("string"), F.lit("-"), (first + count - 1).cast("string"))

    d = F.col("doc_id")
    table = F.concat(
        F.lit("Form 20-F cross-reference Item 3 D. Risk factors Our risks "), pages(d % 5 + 1, 3),
        F.lit(" Item 4. Information on the Company B. Business overview Our business "), pages(d % 3 + 6, 4),
        F.lit(f", Our people {PEOPLE_PAGE}, Note 12 Governance 3 C. Organizational structure Item 5. Operating and Financial Review and Prospects A. Operating results Our strategy "),
        pages(d % 2 + 4, 3), F.lit(" Financial review "), pages(d % 4 + 8, 4),
        F.lit(" B. Liquidity and capital resources 23 D. Trend information Outlook 14 and 17 E. Critical estimates 2 "
              "Item 18. Financial statements Consolidated financial statements "), pages(F.lit(18) - d % 3, 12), F.lit(" Item 19. Exhibits"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(REPORT_PAGES)), page), "\n")
    return once(rows.drop("text"), text=F.concat(body, F.lit("\n"), table)).select("doc_id", "text")


def form_reports(spark, folder):
    """Each document as the discussion of an annual or interim report, between its headings and after a table of contents."""
    annual = F.col("doc_id") % 2 == 0
    heading = F.when(annual, "Item 7. Management's Discussion and Analysis").otherwise("Item 2. Management's Discussion and Analysis")
    after = F.when(annual, "Item 7A. Quantitative and Qualitative Disclosures").otherwise("Item 3. Quantitative and Qualitative Disclosures")
    return texts(spark, folder, "documents").select(
        F.col("doc_id").alias("filing_id"), F.when(annual, "10-K").otherwise("10-Q").alias("form_type"),
        F.concat_ws("\n", F.lit("Contents"), F.concat(heading, F.lit(" 20 "), after, F.lit(" 31")), F.concat(heading, F.lit(" of Operations")),
                    "text", after, F.lit("The end.")).alias("text"))


REPORT_SHAPES = 12
REPORT_LEAD = "The year went by in steady words, and what follows says in a calm voice how it went, where it led and what came of it in the end, month by month.\n"


def report_body(text="text"):
    """A document's text eight times over, behind an introduction and before a closing line."""
    return F.concat(F.lit(REPORT_LEAD * 6), F.repeat(F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")), 8), F.lit("End of part.\n"))


def filed_documents(spark, folder):
    """Each document as a filing of one of twelve shapes, with the exhibits that it needs: where its parts are depends on its number."""
    body, d = F.col("body"), F.col("doc_id")
    mdna = "Management's Discussion and Analysis"
    item5 = "Item 5. Operating and Financial Review and Prospects\n"
    item6 = "Item 6. Directors, Senior Management and Employees\nThe end.\n"
    item78 = f"Item 7. {mdna} 20 Item 8. Financial Statements 31\n"

    def doc(shape, form, kind, position, *pieces):
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
        return F.when(d % REPORT_SHAPES == shape, F.struct(F.lit(form).alias("form_type"), F.lit(kind).alias("document_type"),
                                                           F.lit(position).alias("position"), text.alias("text")))

    docs = [
        doc(0, "10-K", "primary", 0, item78, "Item 1. Business\n", body, "Item 1A. Risk Factors\n", body, "Item 1B. Unresolved Staff Comments\nNone.\n",
            f"Item 7. {mdna} of Operations\n", body, "Item 7A. Quantitative Disclosures\nThe end.\n"),
        doc(1, "10-K/A", "primary", 0, item78, f"Item 7. {mdna}. It appears on pages 46-160.\nItem 8. Financial Statements\nNone.\n{mdna}\n"
            f"The following is {mdna} of the financial condition.\n", body, "Management's report on internal control\nThe end.\n"),
        doc(2, "10-K", "primary", 0, f"Item 7. {mdna}. See the annual report.\nItem 8. Financial Statements\nNone.\n"),
        doc(2, "10-K", "EX-21", 2, f"{mdna} of financial condition\n", body, "Management's report on internal control\n"),
        doc(2, "10-K", "EX-13.1", 3, f"{mdna} of financial condition\n", body, "Management's report on internal control\nControls.\n"),
        doc(3, "10-K", "primary", 0, f"Item 7. {mdna}. Information is found in the annual report under \"Financial Review.\" That is it.\n"
            "Item 8. Financial Statements\nNone.\n"),
        doc(3, "10-K", "EX-13", 1, "Exhibit 13 Financial Review 2 Overview 2 Performance 5 Management 20\nThis report, including the Financial Review, "
            "looks ahead.\n", "Financial Review Overview\n", body, "Management's report on internal control\nControls.\n"),
        doc(4, "10-KT", "primary", 0, "About us.\n", body, f"{mdna.upper()} OVERVIEW\n", body, "Report of Independent Registered Public Accounting Firm\n"),
        doc(5, "20-F", "primary", 0, "Item 3. Key Information\nFigures.\nRisk Factors\n", body, "Item 4. Information on the Company\n", body, item5, body, item6),
        doc(6, "20-F", "primary", 0, item5, "The information in the annual report included as exhibit 15.1 to this form is incorporated by reference.\n", REPORT_LEAD, item6),
        doc(6, "20-F", "EX-15.2", 1, "Financial Review Background\n", body, body, "Corporate Governance Contents\nThe end.\n"),
        doc(6, "20-F", "EX-15.1", 2, "Financial Review Background\n", body, "Corporate Governance Contents\nThe end.\n"),
        doc(7, "20-F", "primary", 0, "OPERATING AND FINANCIAL REVIEW AND PROSPECTS 129 Overview 129 Results 133\n", REPORT_LEAD,
            "Business overview Corporate governance Financial statements Operating and financial review and prospects General facts Financial statements\n",
            body, "OPERATING AND FINANCIAL REVIEW AND PROSPECTS Overview\n", body, "CORPORATE GOVERNANCE Board of Directors.\n"),
        doc(8, "40-F", "primary", 0, "FORM 40-F\n99-3 Management's Discussion and Analysis\nThe documents follow, see Exhibit 99.2: Management's Discussion and Analysis.\n"),
        doc(8, "40-F", "EX-99.1", 1, "ANNUAL INFORMATION FORM\nFebruary 25, 2026\nGeneral Development of the Business\n4\nRisk Factors\n20\nDividends\n22\n"
            "General Development of the Business\n", body, "Risk Factors\n", REPORT_LEAD * 20, "Dividends\n", body),
        doc(8, "40-F", "EX-99.2", 2, "Management's Statement of Responsibility for Financial Reporting\n", body),
        doc(8, "40-F", "EX-99.3", 3, "Management's Discussion\nand Analysis\nFebruary 25, 2026\nThis Management's Discussion and Analysis (MD&A) follows.\n", body,
            "Risk Factors That May Affect Future Results\n", body, "GLOSSARY\nAIF\nAnnual Information Form\nMD&A\nManagement's Discussion and Analysis\n"),
        doc(9, "10-Q", "primary", 0, "Item 1.\nFinancial Statements.\n94\nItem 2.\nManagement's Discussion and Analysis of Financial Condition.\n"
            "Consolidated Financial Highlights\n3\nExecutive Overview\n5\nItem 3.\nQuantitative and Qualitative Disclosures.\n201\nThe Group\n"
            "Consolidated financial highlights (unaudited)\n", body, "Consolidated statements of income (unaudited)\nRevenue 100\n"),
        doc(10, "6-K", "primary", 0, "Management's Discussion and Analysis\nThis Management's Discussion and Analysis is a report.\n", body,
            "GLOSSARY\nLoss: what is lost.\nINTERIM CONSOLIDATED BALANCE SHEET\nAssets 1,000\n"),
        doc(11, "10-Q", "primary", 0, f"Item 2. {mdna} 20 Item 3. Quantitative 31\nItem 2. {mdna}\n", body, "Item 3. Quantitative Disclosures\nNone.\n"
            "Item 1A. Risk Factors\n", REPORT_LEAD * 2, "Item 6. Exhibits\n"),
    ]
    rows = once(texts(spark, folder, "documents").select("doc_id", "text"), body=report_body())
    rows = rows.select(F.col("doc_id").alias("filing_id"), F.inline(F.array_compact(F.array(*docs))))
    return rows.select("filing_id", F.concat_ws("/", "filing_id", "position").alias("document_id"), "form_type", "document_type", "position", "text")


FAMILY_CONCEPTS = {"commitment": "us-gaap:PurchaseObligation", "guarantee": "us-gaap:GuaranteeObligationsMaximumExposure",
                   "debt": "us-gaap:DebtInstrumentFaceAmount", "investment": "us-gaap:EquityMethodInvestments"}
FAMILY_AXES = {"commitment": "us-gaap:CommitmentsAxis", "guarantee": "us-gaap:GuaranteesAxis", "debt": "us-gaap:DebtInstrumentAxis",
               "investment": "us-gaap:InvestmentTypeAxis"}


def first_tag(metric):
    """The first US GAAP tag of a metric."""
    return next(row[4][0] for row in METRIC_TABLE if row[0] == metric)


def reported_facts(spark, folder):
    """The facts as numbers of tagged filings: (facts, covers).

    Metrics carry their first standard tag, but every fifth company tags its
    inventory by a name of its own.  Disclosure lines carry a member.  Every
    fourth company reports in euros, and disclosure lines of even numbers are in
    pounds.
    """
    f = facts(spark, folder)
    line = F.element_at(F.split("fact_id", r"\|"), 4).cast("int")
    metric = F.col("canonical_metric")
    tags = literal_map({m: f"us-gaap:{first_tag(m)}" for m in TWIN_METRICS})
    concept = F.when((metric == "inventory") & (F.col("company_id") % 5 == 0), "own:InventoryNet2").when(
        metric.isNotNull(), F.try_element_at(tags, metric)).otherwise(F.try_element_at(literal_map(FAMILY_CONCEPTS), F.col("category")))
    own = F.when(F.col("company_id") % 4 == 3, "EUR").otherwise("USD")
    currency = F.when(metric.isNull() & (line % 2 == 0), "GBP").otherwise(own)
    member = F.create_map(F.try_element_at(literal_map(FAMILY_AXES), F.col("category")), F.concat(F.lit("own:Line"), line.cast("string"), F.lit("Member")))
    source = F.struct(F.lit(True).alias("unlabelled"), F.col("fact_id").alias("document"), F.lit(0).alias("pos"), F.col("fact_id").alias("element_id"),
                      F.lit(None).cast("string").alias("row_text"), F.lit(None).cast("string").alias("row_label"), F.lit(None).cast("string").alias("text_block_id"))
    numbers = f.select(
        "filing_id", concept.alias("concept"), F.concat(F.lit("iso4217:"), currency).alias("unit"), "period_start", "period_end",
        F.when(metric.isNull(), member).otherwise(F.create_map().cast("map<string,string>")).alias("dimensions"), "value",
        F.lit(2).alias("decimals"), (F.col("value") > 90000).alias("conflicting"), F.array(source).alias("sources"),
        F.struct(F.col("fact_id").alias("document"), F.lit(0).alias("pos")).alias("order"))
    covers = filings(spark, folder).select(
        "filing_id", F.make_date("fiscal_year", F.lit(1), F.lit(1)).alias("cover_start"), F.col("period_end").alias("cover_end"),
        F.col("fiscal_year").alias("focus_year"), "form_type")
    return numbers, covers
