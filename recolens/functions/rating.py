"""Parsing dirty score strings into a 0-10 rating.

Semantics (decided in SURVEY Q10/Q11): trim; null-like tokens -> null; take
the first number of 1-3 digits with an optional 1-2 digit decimal part
(``1234`` -> ``123``, ``-5`` -> ``5``); decimal comma -> dot; numeric cast
that yields null on failure; clip to [0, 10] keeping null as null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recolens.functions.text import WS

# Fixed values (must equal the reference's): null-like tokens and the number pattern.
NULL_TOKENS = ("", "nan", "None", "N/A", "na")
NUMBER_RE = r"([0-9]{1,3}(?:[.,][0-9]{1,2})?)"
LOW, HIGH = 0.0, 10.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _named(value: Column, use) -> Column:
    """``use`` of a value computed once: as an expression it would stand, and run, wherever it is used."""
    return F.transform(F.array(value), use)[0]


def normalize_rating(raw) -> Column:
    def of(s: Column) -> Column:
        s = F.when(~s.isin(*NULL_TOKENS), s)
        num = F.regexp_extract(s, NUMBER_RE, 1)                              # "" if there is none
        x = F.regexp_replace(num, ",", ".").try_cast("double")
        # least/greatest skip nulls, so guard to keep a null rating null (Q11)
        return _named(x, lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(LOW)), F.lit(HIGH))))

    return _named(F.regexp_replace(_c(raw).cast("string"), rf"^[{WS}]+|[{WS}]+$", ""), of)   # str.strip()


def unparsed(raw, clean) -> Column:
    """A value was given but could not be parsed."""
    return _c(clean).isNull() & _c(raw).isNotNull()
