"""Scalar functions: cleaning, parsing, codes, transforms. All are expressions over columns, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code length -> level of the five-level tree, and the prefix lengths by level.
LEVEL_LENGTHS = {1: 1, 3: 2, 4: 3, 5: 4, 7: 5}
PREFIXES = (1, 3, 4, 5)
#: The body of a code of level 2 to 5, and where it may stand: in an address, or bare; number formats; forms of quarters.
CODE_BODY = r"[A-Za-z]\d{2}[A-Za-z]{0,2}\d{0,2}"
CODE_IN_ADDRESS, BARE_CODE = rf"(?i)atc/({CODE_BODY})", rf"(?<![A-Za-z0-9/])({CODE_BODY})(?![A-Za-z0-9])"
US_NUMBER, EU_NUMBER = r"^-?(\d{1,3}(,\d{3})*|\d+)(\.\d+)?$", r"^-?(\d{1,3}(\.\d{3})*|\d+)(,\d+)?$"
YEAR_FIRST, QUARTER_FIRST = r"(20\d{2}|19\d{2})\s*[-_/ ]?\s*Q([1-4])", r"Q([1-4])\s*[-_/ ]?\s*(20\d{2}|19\d{2})"
YEAR_MONTH, MONTH_YEAR = r"^(20\d{2}|19\d{2})[-_/ ](\d{1,2})", r"^(\d{1,2})[./-](20\d{2}|19\d{2})$"
#: Dates that are read where no other form fits.
DATES = ("M/d/yyyy", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy", "MMM yyyy", "MMMM yyyy")
#: All white space, by rule.
BLANKS = "".join(chr(k) for k in range(0x3001) if chr(k).isspace())


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """Stripped; '', 'nan' and 'None' are NULL."""
    t = strip(c)
    return F.when(~t.isin("", "nan", "None"), t)


def clean_sales(c: Column) -> Column:
    """1,234.56 first, else 1.234,56, else NULL."""
    t = strip(c)
    us = F.when(t.rlike(US_NUMBER), F.regexp_replace(t, ",", ""))
    eu = F.when(t.rlike(EU_NUMBER), F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", "."))
    return F.coalesce(us, eu).try_cast("double")


def sales_or_blank(c: Column) -> tuple[Column, Column]:
    """(value, is blank): the number that stands in the text, whatever unit stands with it, by the rules of clean_sales; NULL where none does. Blank: NULL or white space."""
    t = strip(c)
    blank = t.isNull() | (t == "")
    return F.when(~blank, clean_sales(F.regexp_replace(t, r"[^\d,.\-]", ""))), blank


def _label(year: Column, quarter: Column) -> Column:
    return F.concat(year, F.lit("Q"), quarter.cast("string"))


def _found(t: Column, before: str, after: str) -> Column:
    first = F.regexp_extract(t, f"(?i){before}{YEAR_FIRST}{after}", 1)
    last = F.regexp_extract(t, f"(?i){before}{QUARTER_FIRST}{after}", 2)
    return F.when(first != "", _label(first, F.regexp_extract(t, f"(?i){before}{YEAR_FIRST}{after}", 2))).when(last != "", _label(last, F.regexp_extract(t, f"(?i){before}{QUARTER_FIRST}{after}", 1)))


def _month_quarter(year: Column, month: Column) -> Column:
    m = month.try_cast("int")
    return F.when(m.between(1, 12), _label(year, F.ceil(m / 3)))


def quarter_value(c: Column) -> Column:
    """YYYYQn of a value that is a quarter ('2014-Q2', 'q2 2014'), begins with a year and a month ('2014-5', '2014-05-31'), or is a date of one of DATES; else NULL."""
    t = strip(c)
    month = _month_quarter(F.regexp_extract(t, YEAR_MONTH, 1), F.regexp_extract(t, YEAR_MONTH, 2))
    date = F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in DATES))
    return F.coalesce(_found(t, "^", "$"), month, F.when(date.isNotNull(), _label(F.year(date).cast("string"), F.quarter(date))))


def quarter_search(c: Column) -> Column:
    """YYYYQn of the first quarter anywhere in a text ('Q2 2014_Standard Units'); NULL if there is none."""
    t = strip(c)
    where = lambda p: F.length(F.regexp_extract(t, f"(?is)^(.*?){p}", 1)) + F.when(F.regexp_extract(t, f"(?i){p}", 0) == "", None).otherwise(0)
    year, quarter = where(YEAR_FIRST), where(QUARTER_FIRST)
    one = _label(F.regexp_extract(t, f"(?i){YEAR_FIRST}", 1), F.regexp_extract(t, f"(?i){YEAR_FIRST}", 2))
    two = _label(F.regexp_extract(t, f"(?i){QUARTER_FIRST}", 2), F.regexp_extract(t, f"(?i){QUARTER_FIRST}", 1))
    return F.when(quarter.isNull() | (year <= quarter), F.when(year.isNotNull(), one)).otherwise(two)


def quarter_label(c: Column) -> Column:
    """quarter_value(), or else quarter_search()."""
    return F.coalesce(quarter_value(c), quarter_search(c))


def last_quarter(c: Column) -> Column:
    """YYYYQn of a month and a year ('03.2026'), or of quarter_value()."""
    t = strip(c)
    return F.coalesce(_month_quarter(F.regexp_extract(t, MONTH_YEAR, 2), F.regexp_extract(t, MONTH_YEAR, 1)), quarter_value(c))


def ordinal(label: Column) -> Column:
    """YYYYQn -> year * 4 + quarter - 1."""
    return (F.substring(label, 1, 4).try_cast("long") * 4 + F.substring(label, 6, 1).try_cast("long") - 1).cast("long")


def ordinal_label(q: Column) -> Column:
    """Quarter ordinal year * 4 + quarter - 1 -> YYYYQn."""
    return F.concat(F.floor(q / 4).cast("string"), F.lit("Q"), (q % 4 + 1).cast("string"))


def quarter_start(q: Column) -> Column:
    return F.make_date(F.floor(q / 4).cast("int"), ((q % 4) * 3 + 1).cast("int"), F.lit(1))


def normalize_key(c: Column) -> Column:
    return F.nullif(F.upper(strip(c)), F.lit(""))


def extract_codes(c: Column) -> Column:
    """Sorted distinct upper-case codes in a text: after `atc/`, and bare ones."""
    found = F.concat(F.regexp_extract_all(c, F.lit(CODE_IN_ADDRESS), F.lit(1)), F.regexp_extract_all(c, F.lit(BARE_CODE), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def short_class_id(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def namespace(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"ontology/([^/]+)/", 1), F.lit(""))


def sentence_case(c: Column) -> Column:
    """Without ' in ATC'; a label in capitals alone becomes a sentence."""
    t = F.trim(F.regexp_replace(c, " in ATC$", ""))
    return F.when(t == F.upper(t), F.concat(F.upper(F.substring(t, 1, 1)), F.lower(t.substr(F.lit(2), F.length(t))))).otherwise(t)


def level(code: Column) -> Column:
    out = F.when(F.length(code) == 1, 1)
    for n, k in LEVEL_LENGTHS.items():
        out = out.when(F.length(code) == n, k) if n != 1 else out
    return out


def parent(code: Column) -> Column:
    """The code of the level above; NULL for level 1."""
    k = level(code)
    return F.when(k == 2, F.substring(code, 1, 1)).when(k == 3, F.substring(code, 1, 3)).when(k == 4, F.substring(code, 1, 4)).when(k == 5, F.substring(code, 1, 5))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def inverse_signed_log(z: Column) -> Column:
    return F.signum(z) * F.expm1(F.abs(z))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


#: The names of the fourteen groups of level 1.
GROUPS = {
    "A": "Alimentary tract & metabolism", "B": "Blood & blood-forming organs", "C": "Cardiovascular system", "D": "Dermatologicals", "G": "Genito-urinary system & sex hormones",
    "H": "Systemic hormonal preparations", "J": "Anti-infectives (systemic)", "L": "Antineoplastic & immunomodulating", "M": "Musculo-skeletal system", "N": "Nervous system",
    "P": "Antiparasitic products", "R": "Respiratory system", "S": "Sensory organs", "V": "Various",
}


def group_name(code: Column) -> Column:
    """The name of a code's group; the letter itself where it has none."""
    letter = F.upper(F.substring(code, 1, 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in GROUPS.items() for x in kv)), letter), letter)


def series_id(product: Column, market: Column) -> Column:
    return F.concat(product, F.lit(" | "), market)


def split_series_id(c: Column) -> tuple[Column, Column]:
    """(product, market), cut at the last ' | '."""
    market = F.substring_index(c, " | ", -1)
    return F.substring(c, F.lit(1), F.length(c) - F.length(market) - 3), market
