"""Column expressions for strings, identifiers, dates and nulls, with the null and Unicode rules stated in each docstring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and Python's str.strip see it (Java's \s alone is ASCII).
SPACE = r"[\s\p{Z}\x0B\x85\x1C-\x1F]"
#: Texts that a CSV reader of data frames takes for a missing value.
CSV_NULLS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space of every kind off both ends; null stays null."""
    return F.regexp_replace(_c(c), f"^{SPACE}+|{SPACE}+$", "")


def plain_identifier(c: Column | str) -> Column:
    """Lower case, white space of every kind removed, a leading 'a/res/' removed; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(c)), f"{SPACE}+", ""), "^a/res/", "")


def canonical_symbol(c: Column | str, prefix: str = "A/RES/") -> Column:
    """Upper case without blanks, behind the prefix; null stays null."""
    return F.concat(F.lit(prefix), F.upper(F.replace(_c(c), F.lit(" "), F.lit(""))))


def contains_literal(text: Column | str, what: Column | str) -> Column:
    """Whether `what` occurs in `text`, ignoring case; False where either is null."""
    return F.coalesce(F.contains(F.lower(_c(text)), F.lower(_c(what))), F.lit(False))


def contains_regex(text: Column | str, pattern: str, strict: bool = False) -> Column:
    """Whether the pattern is found in `text`, ignoring case in all scripts. A null text is False, or an error if strict."""
    t = _c(text)
    hit = t.rlike("(?iu)" + pattern)
    if strict:
        return F.when(t.isNull(), F.raise_error("null text in a strict scan").cast("boolean")).otherwise(hit)
    return F.coalesce(hit, F.lit(False))


def not_equal_keep_null(c: Column | str, value) -> Column:
    """c != value, where a null c counts as different."""
    return ~_c(c).eqNullSafe(value)


def extract_or_null(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null without a match or where it is empty."""
    return F.nullif(F.regexp_extract(_c(c), pattern, group), F.lit(""))


def csv_null(c: Column | str) -> Column:
    """Null where the text is one of CSV_NULLS."""
    return F.when(~_c(c).isin(CSV_NULLS), _c(c))


def is_digits(c: Column | str) -> Column:
    return F.coalesce(_c(c).rlike(r"^\p{Nd}+$"), F.lit(False))


#: Notations of dates in the tables, tried in this order.
DATE_FORMATS = ["yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "yyyyMMdd", "yyyy-M-d"]


def parse_date(c: Column | str, formats: list[str] | None = None, strict: bool = False) -> Column:
    """Date of a text in one of the formats, white space around it ignored. Without a match null, or an error if strict."""
    s = strip(c)
    tried = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats or DATE_FORMATS]).cast("date")
    if strict:
        return F.when(s.isNull() | tried.isNotNull(), tried).otherwise(F.raise_error(F.concat(F.lit("no date: "), s)).cast("date"))
    return tried


def url_join(base_host: str, c: Column | str) -> Column:
    """Absolute addresses as they are; others behind the host ('https://host'); '//x' gets the host's scheme; null stays null."""
    u, scheme = strip(c), base_host.split("//", 1)[0]
    return (F.when(u.rlike("(?i)^https?://"), u).when(u.startswith("//"), F.concat(F.lit(scheme), u))
            .when(u.startswith("/"), F.concat(F.lit(base_host.rstrip("/")), u)).otherwise(F.concat(F.lit(base_host.rstrip("/") + "/"), u)))
