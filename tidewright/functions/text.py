"""Text expressions: stripping, key digits, name normalising, explanations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as surrounding white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def strip_to_null(c: Column) -> Column:
    """Stripped text; blank becomes null."""
    return F.nullif(strip(c), F.lit(""))


def digits_key(c: Column) -> Column:
    """Only the digits of a key, null when it has none."""
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Column name as lower-case words: `CustID`, `cust-id`, `cust_id` -> `cust id`."""
    words = F.regexp_replace(c, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return strip(F.lower(F.translate(words, "_-", "  ")))


def explanation(errors: Column) -> Column:
    """`field: CODE; field: CODE` in the order the errors were found."""
    return F.array_join(F.transform(errors, lambda e: F.concat(e["field"], F.lit(": "), e["code"])), "; ")


def distinct_codes(errors: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(errors, lambda e: e["code"])))
