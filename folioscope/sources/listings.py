"""Filing lists, company directories, watchlists and filing index pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arith import col
from ..functions.text import normalized_name

BLOCK = ("struct<form:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,filingDate:array<string>,"
         "reportDate:array<string>,isInlineXBRL:array<int>>")


def submissions_rows(blocks, payload="payload"):
    """A list kept as parallel arrays, one row per filing (S1).  An absent flag array means not tagged."""
    b = blocks.select(*[c for c in blocks.columns if c != payload], F.from_json(payload, BLOCK).alias("b"))
    none = F.transform("b.form", lambda _: F.lit(0))
    zipped = F.arrays_zip(
        F.col("b.form").alias("form_type"), F.col("b.accessionNumber").alias("accession_number"),
        F.col("b.primaryDocument").alias("primary_doc"), F.col("b.filingDate").alias("filing_date"),
        F.col("b.reportDate").alias("report_date"), F.coalesce("b.isInlineXBRL", none).alias("inline_flag"))
    rows = b.select("*", F.posexplode(zipped).alias("position", "r")).select(
        *[c for c in blocks.columns if c != payload], "position", "r.*")
    return rows.withColumn("filing_date", F.to_date(F.nullif("filing_date", F.lit("")))).withColumn(
        "report_date", F.to_date(F.nullif("report_date", F.lit("")))).withColumn("inline_xbrl", F.col("inline_flag") == 1).drop("inline_flag")


def with_history(rows, annual=3, annual_forms=("10-K", "10-KT", "20-F", "40-F")):
    """Rows of the recent page and of older pages until ``annual`` annual reports are listed before them.

    ``page`` 0 is the recent list.  Counted per page first, so the running count
    is over pages, not filings.
    """
    pages = rows.groupBy("company_id", "page").agg(F.sum(F.col("form_type").isin(*annual_forms).cast("long")).alias("n"))
    w = Window.partitionBy("company_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    needed = pages.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(
        (F.col("page") == 0) | (F.col("before") < annual))
    return rows.join(needed.select("company_id", "page"), ["company_id", "page"])


def directory(raw, payload="payload"):
    """Companies in list order with normalized and compact names (S4).  ``raw`` holds one JSON object per entry."""
    d = raw.select("position", F.from_json(payload, "cik_str bigint, ticker string, title string").alias("c"))
    name = normalized_name("c.title")
    return d.select("position", F.col("c.cik_str").alias("cik"), F.upper("c.ticker").alias("ticker"), F.col("c.title").alias("name"),
                    name.alias("norm_name"), F.replace(name, F.lit(" "), F.lit("")).alias("compact_name"))


def watchlist(lines, column="value"):
    """Tickers of a watchlist file without comments and blanks."""
    return lines.select(F.trim(F.element_at(F.split(col(column), "#"), 1)).alias("ticker")).where(F.col("ticker") != "")


def index_documents(pages, html="html"):
    """Documents of a filing from its index page: type, role, tagged or not, size.

    ``pages``: filing_id, cik, accession_number, form_type, primary_doc, html.
    """
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode_outer(
        F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("ordinal", "row")).where(F.col("row").isNotNull())
    cells = rows.withColumn("cells", F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))).where(F.size("cells") >= 4)

    def plain(c):
        return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))

    link = F.regexp_extract(F.col("cells")[2], r'(?i)href="([^"]*)"', 1)
    href = F.replace(link, F.lit("/ix?doc="), F.lit(""))
    base = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("string"), F.lit("/"),
                    F.replace("accession_number", F.lit("-"), F.lit("")), F.lit("/"))
    url = F.when(href.contains("/Archives/edgar/data/"), F.concat(base, F.substring_index(href, "/", -1))).otherwise(
        F.concat(F.lit("https://www.sec.gov"), href))
    tagged = F.lower(plain(F.col("cells")[2])).contains("ixbrl") | link.contains("/ix?doc=")
    size = plain(F.try_element_at("cells", F.lit(5)))
    docs = cells.where(F.lower(href).rlike(r"\.(htm|html|xhtml)$")).withColumn("url", url)
    primary = F.col("url") == F.concat(base, F.col("primary_doc"))
    return docs.select("filing_id", "ordinal", "url", plain(F.col("cells")[3]).alias("type"), plain(F.col("cells")[1]).alias("description"),
                       tagged.alias("ixbrl"), F.when(primary, "primary").when(tagged, "xbrl_financials").otherwise("exhibit").alias("role"),
                       F.when(size.rlike(r"^\d+$"), size.cast("int")).alias("size"))
