"""Sentences, fingerprints, tokens and trigger phrases as Column expressions."""

from functools import reduce

from pyspark.sql import functions as F

from . import fixed_values as fv
from .arith import col, once

# FIXED VALUES: text patterns (Java syntax).
PAGE_ARTIFACT = r"(?i)\s*\b\d{0,3}\s*Table of Contents\b\s*"
PAGE_FURNITURE = r"(?im)^(?:\d{1,3}|PART\s+[IV]+|Item\s+\d{1,2}[A-C]?\.?|Table of Contents)[ \t]*\n"
# what a match can begin with is asked first, then the positive look-behind: they fail at once almost everywhere
CURRENCY_BREAK = (r"(?=[ \t\n])(?:(?<=\b(?:USD|CHF|EUR|GBP|CAD|JPY|AUD|HKD|SGD|CNY|TWD|NTD|RMB))[ \t]*\n\s*(?=[\d(])"
                  r"|(?<=[$€£¥])[ \t]*\n\s*(?=\d))")
SENTENCE_BREAK = ("(?=[\\s•])(?:(?<=[.!?;])(?<![A-Z]\\.[A-Z]\\.)" + "".join(rf"(?<!\b{a}\.)" for a in fv.ABBREVIATIONS)
                  + "\\s+(?=[A-Z“\"(•])|\\s*•\\s*)")
FIGURE = r"^[$(]*[\d,.%)—–-]*\d[\d,.%)—–-]*$"
SENTENCE_END = "[.!?:;][”\"')]*$"
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"
DATE = rf"\b{fv.MONTHS}\s+\d{{1,2}},?\s+(?:19|20)\d\d\b|\b{fv.MONTHS}\s+(?:19|20)\d\d\b"
NEGATION = r"(?i)\b(?:no|not|none|never|neither|nor|without)\b|n't\b"
WIDE_SPACES = "\u00a0\u2007\u2009\u202f\u3000"


def plain_spaces(text):
    return F.translate(col(text), WIDE_SPACES, " " * len(WIDE_SPACES))


def collapse(text):
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def prose_text(text):
    """Text with page furniture dropped and wrapped lines joined; a line break ends a sentence."""
    t = F.coalesce(plain_spaces(text), F.lit(""))
    t = F.when(t.rlike("(?i)Table of Contents"), F.regexp_replace(t, PAGE_ARTIFACT, " ")).otherwise(t)
    t = F.regexp_replace(t, CURRENCY_BREAK, " ")
    t = F.regexp_replace(t, PAGE_FURNITURE, "")
    return F.regexp_replace(t, r"[ \t]*\n\s*(?=[a-z])", " ")


def is_tabular(text):
    """A flattened table row rather than prose: mostly figures, or a figure and no sentence end."""
    tokens = F.split(F.trim(text), r"\s+")
    figures = F.size(F.filter(tokens, lambda t: t.rlike(FIGURE)))
    return ((F.size(tokens) >= 8) & (figures / F.size(tokens) > 0.3)) | ((figures > 0) & ~F.trim(text).rlike(SENTENCE_END))


def is_boilerplate(text):
    return text.rlike("(?i)" + fv.BOILERPLATE)


def sentences(text):
    """The prose sentences of a text as an array."""
    marked = F.regexp_replace(prose_text(text), SENTENCE_BREAK, "\n")
    parts = F.transform(F.split(marked, "\n"), collapse)
    long = F.filter(parts, lambda s: (F.length(s) >= fv.MIN_SENTENCE_CHARS) & ~is_boilerplate(s))
    # only a sentence with a figure can be a flattened table row; its tokens are split once
    tokens = F.transform(long, lambda s: F.struct(s.alias("s"), F.when(s.rlike(r"\d"), F.split(s, " ")).alias("t")))
    counted = F.transform(tokens, lambda x: F.struct(x.s.alias("s"), F.size(x.t).alias("n"), F.size(
        F.filter(x.t, lambda t: t.rlike(FIGURE))).alias("figures")))
    prose = F.filter(counted, lambda x: x.n.isNull() | (x.n < 0) | ~(
        ((x.n >= 8) & (x.figures / x.n > 0.3)) | ((x.figures > 0) & ~x.s.rlike(SENTENCE_END))))
    return F.transform(prose, lambda x: x.s)


def letters_and_digits(text):
    """Lowercase runs of letters and digits joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " "))


def _shape(text):
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9#]+", " "))


def exact_fingerprint(sentence):
    return F.sha1(_shape(col(sentence)))


def masked_fingerprint(sentence):
    """The wording with dates and numbers masked."""
    return F.sha1(_shape(F.regexp_replace(F.regexp_replace(col(sentence), DATE, "#date"), NUMBER, "#")))


def content_tokens(sentence):
    """Distinct words of three letters or more without stopwords."""
    words = F.regexp_extract_all(F.lower(col(sentence)), F.lit("([a-z][a-z'-]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(fv.STOPWORDS)))


def only_years_changed(new, old):
    """Whether the numbers differ only by years rolling at most two forward or back."""
    def numbers(c):
        return F.regexp_extract_all(F.regexp_replace(col(c), DATE, " "), F.lit(f"({NUMBER})"), F.lit(1))

    def rolled(x, y):
        year = r"^(19|20)\d\d$"
        return (x == y) | (x.rlike(year) & y.rlike(year) & (F.abs(F.try_to_number(x, F.lit("9999")) - F.try_to_number(y, F.lit("9999"))) <= 2))

    return (F.size(numbers(new)) == F.size(numbers(old))) & F.forall(
        F.zip_with(numbers(new), numbers(old), lambda x, y: F.coalesce(rolled(x, y), F.lit(False))), lambda ok: ok)


def says_hypothetical(text):
    return text.rlike("(?i)" + fv.HYPOTHETICAL)


def says_realized(text):
    return text.rlike("(?i)" + fv.REALIZED)


def modality_shift(new, old):
    """Wording that moved from what could happen to what has happened."""
    return says_hypothetical(col(old)) & ~says_hypothetical(col(new)) & says_realized(col(new))


PRESENTATION = fv.PRESENTATION_RESTATEMENT


def _beginnings(pattern):
    """The first three letters of each alternative of a pattern that begins with plain letters."""
    depth, parts = 0, [""]
    for c in pattern:
        depth += (c == "(") - (c == ")")
        parts = [*parts, ""] if c == "|" and not depth else [*parts[:-1], parts[-1] + c]
    return {p.removeprefix(r"\b")[:3] for p in parts}


def _any_pattern(patterns):
    """One pattern that matches where any of several does: their beginnings, by first letter, are asked before all patterns are tried."""
    found = {}
    for start in sorted(set().union(*map(_beginnings, patterns))):
        found.setdefault(start[0], []).append(start[1:])
    ahead = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in found.items())
    return f"(?i)(?=[{''.join(found)}])(?={ahead})(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


ANY_TRIGGER = _any_pattern([p for p, _, _ in fv.TRIGGERS])
TRIGGER_TYPE = "array<struct<weight:double,phrase:string,realized:boolean>>"


def with_triggers(df, text="text", out="triggers"):
    """Adds the trigger phrases of a passage: weight halved where every mention is hypothetical, heaviest first.

    Each stage is its own column, so the sentences of a text are split once, and
    only sentences that use some phrase are tested against the single patterns.
    """
    t = col(text)
    staged = once(df, _all=F.when(t.rlike(ANY_TRIGGER), sentences(t)))
    units = F.when(F.size("_all") > 0, F.col("_all")).otherwise(F.array(t))
    units = F.when(F.col("_all").isNotNull(), F.filter(units, lambda s: s.rlike(ANY_TRIGGER)))
    staged = once(staged, _marked=F.transform(units, lambda s: F.struct(
        s.alias("s"), (says_realized(s) & ~says_hypothetical(s)).alias("realized"))))

    def one(rank, pattern, phrase, weight):
        def uses(m):
            hit = m.s.rlike("(?i)" + pattern)
            return hit & ~m.s.rlike("(?i)" + PRESENTATION) if phrase == "restatement" else hit

        mentions = F.transform(F.filter("_marked", uses), lambda m: m.realized.cast("int"))
        return F.struct(F.lit(rank).alias("rank"), F.lit(weight).alias("weight"), F.lit(phrase).alias("phrase"),
                        F.array_max(mentions).alias("realized"))

    every = F.filter(F.array(*[one(i, *t_) for i, t_ in enumerate(fv.TRIGGERS)]), lambda x: x.realized.isNotNull())
    weighed = F.transform(every, lambda x: F.struct(
        (-F.when(x.realized == 1, x.weight).otherwise(F.round(x.weight * fv.HYPOTHETICAL_FACTOR, 3))).alias("order"), x.rank.alias("rank"),
        x.phrase.alias("phrase"), (x.realized == 1).alias("realized")))
    kept = F.transform(F.array_sort(weighed), lambda x: F.struct(
        (-x.order).alias("weight"), x.phrase.alias("phrase"), x.realized.alias("realized")))
    result = F.when(F.size("_marked") > 0, kept).otherwise(F.array().cast(TRIGGER_TYPE))
    return once(staged, **{out: result}).drop("_all", "_marked")


def first_sentence_label(text, heading=None):
    """The first sentence without its heading, cut at a word to 140 characters."""
    t = col(text)
    if heading is not None:
        h = col(heading)
        has = h.isNotNull() & t.startswith(h) & (F.length(t) > F.length(h) + 20)
        t = F.when(has, F.regexp_replace(F.substr(t, F.length(h) + 1), r"^[ .:–—-]+", "")).otherwise(t)
    first = F.coalesce(F.try_element_at(sentences(t), F.lit(1)), t)
    cut = F.regexp_replace(F.substring(first, 1, fv.LABEL_CHARS - 1), r" [^ ]*$", "")
    return F.when(F.length(first) <= fv.LABEL_CHARS, first).otherwise(F.concat(cut, F.lit("…")))


def text_hash(text):
    return F.sha1(F.lower(collapse(col(text))))


def heading_of(text):
    """The first line, at most 160 characters."""
    first = F.trim(F.element_at(F.split(F.trim(col(text)), "\n"), 1))
    return F.nullif(F.substring(first, 1, 160), F.lit(""))


def normalized_name(name):
    """Lowercase letters, digits and single spaces."""
    return collapse(F.regexp_replace(F.lower(col(name)), "[^a-z0-9 ]", " "))


def registrant_name(name):
    """The conformed spelling of a legal name: Corp, Inc, Co, Ltd."""
    t = F.trim(F.regexp_replace(col(name), "[.,]", ""))
    for long, short in (("Corporation", "Corp"), ("Incorporated", "Inc"), ("Company", "Co"), ("Limited", "Ltd")):
        t = F.regexp_replace(t, rf"\b{long}$", short)
    return t


def statement_label_key(label):
    """A statement line's wording without note references and marks, lowercase (X11)."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(col(label), F.lit("")), r"\([^)]{1,8}\)|[:*]+", ""), r"\s+", " ")
    return F.lower(F.regexp_replace(t, r"^[ .]+|[ .]+$", ""))


def reported_label(label):
    """The line as the filing words it, without footnote marks; NULL when it only says 'Total' (X16)."""
    t = F.trim(F.regexp_replace(F.coalesce(col(label), F.lit("")), r"(?i)(\s*(\([a-z0-9]{1,2}\)|\*+))+\s*$", ""))
    bad = (t == "") | (F.length(t) > 80) | t.rlike(r"(?i)^(total|subtotal|net|other|none)\b[\w\s,]{0,14}$") | ~t.rlike("[A-Za-z]{3}")
    return F.when(~bad, t)


def tidy_answer(text):
    """Citations in one style, no emphasis, '$25.0 B' -> '$25.0B' (X31)."""
    t = col(text)
    cite = r"[【〔［\[]\s*((?:S\d+|F)(?:\s*[,;]\s*(?:S\d+|F))*)(?:\s*†[^】〕］\]]*)?\s*[】〕］\]]"
    t = F.regexp_replace(t, cite, "[$1]")
    # several references in one bracket become one bracket each, however many: a match begins at a bracket or where the last one ended
    t = F.regexp_replace(t, r"(\[|(?!\A)\G)(S\d+|F)\s*[,;]\s*(?=(?:S\d+|F)(?:\s*[,;]\s*(?:S\d+|F))*\])", "$1$2][")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\*\*|__", ""), r"(\$\d[\d,]*(?:\.\d+)?) ([KMBT])\b", "$1$2"))


def outline_lines(text):
    """Heading-like lines: 40 to 400 characters, one sentence, ending with '.' or ':', each once."""
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[•●▪\\- ]+", "")))
    fit = F.filter(lines, lambda x: F.length(x).between(40, 400) & x.rlike("[.:]$"))
    return F.array_distinct(F.filter(fit, lambda x: F.size(sentences(x)) == 1))


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions)
