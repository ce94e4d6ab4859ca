"""Readable names of tagged concepts and members, disclosure families, note categories."""

from pyspark.sql import functions as F

from . import fixed_values as fv
from .arith import col, literal_map

# FIXED VALUES: words and names.
WORD = r"([A-Z]+(?=[A-Z][a-z]|\d|\b|_|$)|[A-Z]?[a-z]+|\d+)"
SMALL_WORDS = "and of for the to in on or by with from at not yet".split()
ACRONYMS = {"us": "US", "usa": "USA", "uk": "UK", "eu": "EU", "emea": "EMEA", "apac": "APAC", "latam": "LATAM"}
PROPER_NAME_AXES = "Name|Counterparty|Investee|Acquiree|BusinessAcquisition|BusinessCombination"
COUNTRIES = {
    "US": "United States", "CN": "China", "TW": "Taiwan", "HK": "Hong Kong", "JP": "Japan", "KR": "South Korea", "SG": "Singapore", "IN": "India",
    "IL": "Israel", "DE": "Germany", "GB": "United Kingdom", "FR": "France", "NL": "Netherlands", "IE": "Ireland", "CH": "Switzerland",
    "CA": "Canada", "MX": "Mexico", "BR": "Brazil", "AU": "Australia", "MY": "Malaysia", "TH": "Thailand", "VN": "Vietnam", "PH": "Philippines",
    "ID": "Indonesia", "IT": "Italy", "ES": "Spain", "SE": "Sweden", "BE": "Belgium", "LU": "Luxembourg", "SA": "Saudi Arabia",
    "AE": "United Arab Emirates", "ZA": "South Africa", "NO": "Norway", "DK": "Denmark", "FI": "Finland"}
CONCEPT_LABELS = {
    "OtherCommitment": "Other commitments", "UnrecordedUnconditionalPurchaseObligationBalanceSheetAmount": "Purchase obligations",
    "PurchaseObligation": "Purchase obligations", "ContractualObligation": "Contractual obligations",
    "GuaranteeObligationsMaximumExposure": "Guarantees (maximum exposure)", "GuaranteeObligationsCurrentCarryingValue": "Guarantees (carrying value)",
    "LongTermDebt": "Long-term debt", "LongTermDebtCurrent": "Current portion of long-term debt", "LongTermDebtNoncurrent": "Long-term debt, noncurrent",
    "DebtInstrumentFaceAmount": "Debt principal", "DebtInstrumentCarryingAmount": "Debt carrying amount",
    "LineOfCreditFacilityMaximumBorrowingCapacity": "Credit facility capacity",
    "EquitySecuritiesFvNiUnrealizedGainLoss": "Unrealized gains (losses) on equity securities",
    "EquitySecuritiesFvNiRealizedGainLoss": "Realized gains (losses) on equity securities",
    "EquitySecuritiesFvNiGainLoss": "Gains (losses) on equity securities", "StockRepurchaseProgramAuthorizedAmount1": "Repurchase program authorized",
    "StockRepurchaseProgramRemainingAuthorizedRepurchaseAmount1": "Repurchase authorization remaining",
    "StockRepurchasedAndRetiredDuringPeriodValue": "Shares repurchased", "StockRepurchasedDuringPeriodValue": "Shares repurchased",
    "CommonStockDividendsPerShareDeclared": "Dividends declared per share", "ConcentrationRiskPercentage1": "Concentration",
    "RevenueRemainingPerformanceObligation": "Remaining performance obligations", "EffectiveIncomeTaxRateContinuingOperations": "Effective tax rate",
    "PaymentsToAcquireEquitySecuritiesFvNi": "Purchases of equity securities", "GainLossOnInvestments": "Gains (losses) on investments",
    "InventoryWriteDown": "Inventory write-downs", "AssetImpairmentCharges": "Asset impairments", "GoodwillImpairmentLoss": "Goodwill impairment",
    "InvestmentIncomeInterest": "Interest income", "InterestExpenseNonoperating": "Interest expense",
    "IncomeLossFromEquityMethodInvestments": "Income from equity-method investments", "PaymentsToAcquireInvestments": "Purchases of investments",
    "EquityMethodInvestments": "Equity-method investments", "UnrecognizedTaxBenefits": "Unrecognized tax benefits"}
MEMBER_NAMES_VALUE = ["OtherCommitment", "UnrecordedUnconditionalPurchaseObligationBalanceSheetAmount", "PurchaseObligation", "ContractualObligation",
                      "GuaranteeObligationsMaximumExposure"]
STANDARD_PREFIXES = ["us-gaap", "ifrs-full", "srt", "dei"]


def local_name(qname):
    return F.regexp_replace(col(qname), "^[^:]*:", "")


def _bare(qname):
    return F.regexp_replace(local_name(qname), "(Member|Axis|Domain)$", "")


def humanize(qname, proper=None):
    """'x:AICloudPartnershipCommitmentsMember' -> 'AI cloud partnership commitments'; names keep their capitals."""
    name = F.regexp_replace(_bare(qname), "^Ifrs(?=[A-Z])", "")
    found = F.regexp_extract_all(name, F.lit(WORD), F.lit(1))
    words = F.when(F.size(found) > 0, found).otherwise(F.array(name))
    keep = F.lit(False) if proper is None else proper
    acronyms = literal_map(ACRONYMS)

    def shown(w, i):
        low = F.lower(w)
        capital = F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
        return (
            F.when((w == F.upper(w)) & w.rlike("[A-Z]"), w)
            .when(low.isin(list(ACRONYMS)) & ((i == 0) | (low != "us")), F.try_element_at(acronyms, low))
            .when((i > 0) & low.isin(SMALL_WORDS), low).when(keep, capital)
            .when(i > 0, low).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))))

    return F.array_join(F.transform(words, shown), " ")


def slug(qname):
    """'x:SupplyAndCapacityMember' -> 'supply_and_capacity'."""
    found = F.regexp_extract_all(_bare(qname), F.lit(WORD), F.lit(1))
    words = F.array_join(F.transform(found, lambda w: F.lower(w)), "_")
    return F.when(words != "", words).otherwise(F.regexp_replace(F.lower(_bare(qname)), r"\W+", "_"))


def member_label(axis, member):
    code = local_name(member)
    country = F.when(col(member).startswith("country:"), F.try_element_at(literal_map(COUNTRIES), code))
    return F.coalesce(country, humanize(member, proper=local_name(axis).rlike(PROPER_NAME_AXES)))


def concept_label(concept):
    return F.coalesce(F.try_element_at(literal_map(CONCEPT_LABELS), local_name(concept)), humanize(concept))


def concentration_label(dims):
    """'Customer A (share of revenue)' from the subject and benchmark members."""
    d = F.transform_keys(col(dims), lambda k, v: local_name(k))
    subject = F.coalesce(*[F.try_element_at(d, F.lit(a)) for a in ("MajorCustomersAxis", "StatementGeographicalAxis", "EquitySecuritiesByIndustryAxis")])
    benchmark = F.try_element_at(d, F.lit("ConcentrationRiskByBenchmarkAxis"))
    of = (F.when(benchmark.rlike("Receivable"), "accounts receivable").when(benchmark.rlike("Revenue|Sales"), "revenue")
          .when(benchmark.rlike("Purchase|Supplier|Cost"), "purchases"))
    label = F.coalesce(humanize(subject), F.lit("Concentration"))
    return F.when(of.isNotNull(), F.concat(label, F.lit(" (share of "), of, F.lit(")"))).otherwise(label)


def family_of(concept, axes):
    """The disclosure family of a tagged value, NULL when it is noise or not followed.

    The first family whose pattern matches decides; when its axis test fails the
    value belongs to none.
    """
    name, a = local_name(concept), col(axes)
    noise = name.rlike(fv.NOISE_CONCEPTS) | F.arrays_overlap(a, F.array(*map(F.lit, fv.NOISE_AXES)))
    out = F.when(F.coalesce(noise, F.lit(False)), F.lit(None).cast("string"))
    for key, _, pattern, exclude, allowed, most, noisy in fv.FAMILIES:
        hit = name.rlike(pattern) if exclude is None else name.rlike(pattern) & ~name.rlike(exclude)
        fits = F.lit(True)
        if allowed is not None:
            fits = F.size(F.array_except(a, F.array(*map(F.lit, allowed)).cast("array<string>"))) == 0
        if most is not None:
            fits = fits & (F.size(a) <= most)
        if noisy is not None:
            fits = fits & ~_any_like(a, noisy)
        out = out.when(hit, F.when(fits, F.lit(key)))
    return out


def _any_like(array, pattern):
    return F.exists(array, lambda x: x.rlike(pattern))


def text_block_kind(concept):
    name = local_name(concept)
    return (F.when(name.endswith("PolicyTextBlock") | name.startswith("DescriptionOfAccountingPolic"), "policy")
            .when(name.contains("TableTextBlock") | name.startswith("ScheduleOf") | name.startswith("DisclosureOfDetailed"), "table")
            .when(name.endswith("TextBlock") | name.startswith("DisclosureOf"), "disclosure").otherwise("block"))


def text_block_categories(concept):
    """Semantic categories of a note text block, most specific rule first."""
    out = F.when(text_block_kind(concept) == "policy", F.array(F.lit("accounting_policies")))
    for pattern, categories in fv.TEXT_BLOCK_RULES:
        out = out.when(local_name(concept).rlike(pattern), F.array(*map(F.lit, categories)))
    return out.otherwise(F.array(F.lit("other")))


def money_text(value, currency):
    """'$27.7B', 'C$9.2B', 'CHF 1.2B' (X16)."""
    v, c = F.abs(col(value)), col(currency)
    prefix = F.coalesce(F.try_element_at(literal_map(fv.CURRENCY_PREFIX), c), F.concat(c, F.lit(" ")), F.lit(""))
    body = (F.when(v >= 1e12, F.format_string("%.1fT", v / 1e12)).when(v >= 1e9, F.format_string("%.1fB", v / 1e9))
            .when(v >= 1e6, F.format_string("%.1fM", v / 1e6)).otherwise(F.format_number(v, 0)))
    return F.when(col(value).isNull(), "n/a").otherwise(F.concat(F.when(col(value) < 0, "-").otherwise(""), prefix, body))


def change_text(change, unit):
    """'+1.2 pts', '-4 days', '12×', '+8.3%' (X17)."""
    c, u = col(change), col(unit)
    plus = F.when(c > 0, "+").otherwise("")
    return (F.when(u.isin("ratio", "points"), F.concat(plus, F.format_string("%.1f pts", c * 100)))
            .when(u == "days", F.concat(plus, F.format_string("%.0f days", c)))
            .when(c >= 9, F.format_string("%.0f×", c + 1)).otherwise(F.concat(plus, F.format_string("%.1f%%", c * 100))))


def one_off_name(label):
    """'Adjustments for gain loss on disposal: X' -> 'a gain on disposal (X)' (X39)."""
    t = F.regexp_replace(F.regexp_replace(col(label), "(?i)^Adjustments for ", ""), r"(?i)\bgains? (?:\(?loss(?:es)?\)?)", "gain")
    t = F.regexp_replace(t, r"^([^:]*): (.+)$", "$1 ($2)")
    t = F.concat(F.lower(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))
    return F.concat(F.when(t.rlike("^[aeiou]"), "an ").otherwise("a "), t)
