"""Column expressions for text cleaning and tokenisation.

Everything is a native JVM expression (regexp_replace, split, transform,
filter, array_join); Unicode NFC, which Spark has no SQL function for, calls
ICU4J (a Spark runtime dependency) through ``reflect``, with an Arrow-batched
pandas UDF as a fallback.

Character classes are written out instead of ``\\w`` / ``\\s`` because the
JVM regex classes are ASCII-only by default; the explicit classes match what
Python's Unicode ``\\w`` / ``\\s`` match (letters, digits, underscore;
Unicode white space) and are also valid RE2 syntax.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The cleaning patterns (intent of the reference, single-escaped).
WS = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"          # Python str.isspace() set
WORD = r"\p{L}\p{N}_"                           # Python's Unicode \w
URL_RE = rf"http[^{WS}]+|www[^{WS}]+"
EMAIL_RE = rf"[{WORD}.-]+@[{WORD}.-]+"
DIGITS_RE = r"\p{Nd}+"
PUNCT_RE = rf"[^{WORD}{WS}]"
SPACES_RE = rf"[{WS}]+"
TOKEN_RE = rf"[{WORD}]{{2,}}"                   # vectoriser default: >= 2 word chars
# The same matches for the JVM in linear time.  A run before an @ is met at its start or not
# at all, so it is neither given back nor tried again from its second character.
EMAIL_JVM_RE = rf"(?<![{WORD}.-])[{WORD}.-]++@[{WORD}.-]++"
NO_LETTERS_RE = r"[^\p{L}\p{Nl}\p{No}_]++"       # runs of digits, punctuation and white space


ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"   # ICU4J ships with Spark 4 (collations)


def nfc(c) -> Column:
    """Unicode NFC inside the JVM: ``reflect`` on ICU4J's static
    ``Normalizer.compose(text, false)``.  Null stays null.  (Checked equal to
    Python's ``unicodedata.normalize('NFC')`` on every driver text.)"""
    col = _c(c)
    return F.when(col.isNotNull(), F.reflect(F.lit(ICU_NORMALIZER), F.lit("compose"),
                                             F.coalesce(col, F.lit("")), F.lit(False)))


@F.pandas_udf(StringType())
def nfc_py(s: pd.Series) -> pd.Series:
    """T1 fallback (Arrow-batched pandas UDF) for runtimes without ICU4J."""
    return s.str.normalize("NFC")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_text(c, null_token: str = "") -> Column:
    """Null -> ``null_token`` (default empty; the reference's ``str(nan)`` would give 'nan')."""
    return F.coalesce(_c(c).cast("string"), F.lit(null_token))


def lower_nfc(c) -> Column:
    """T2 then T1, in the reference's order (lower-case first)."""
    return nfc(F.lower(_c(c)))


def strip_urls(c) -> Column:
    return F.regexp_replace(_c(c), URL_RE, " ")


def strip_emails(c) -> Column:
    return F.regexp_replace(_c(c), EMAIL_JVM_RE, " ")


def strip_digits(c) -> Column:
    return F.regexp_replace(_c(c), DIGITS_RE, " ")


def strip_punct(c) -> Column:
    return F.regexp_replace(_c(c), PUNCT_RE, " ")


def collapse_ws(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), SPACES_RE, " "))


def clean_text_basic(c) -> Column:
    """T5a-e: URLs, e-mails, digits, punctuation -> space; collapse and trim.  The last
    three are one pass, as each of them and white space ends as one space."""
    return F.trim(F.regexp_replace(strip_emails(strip_urls(c)), NO_LETTERS_RE, " "))


def simple_clean(c, null_token: str = "") -> Column:
    """Lower, NFC, then T5."""
    return clean_text_basic(lower_nfc(as_text(c, null_token)))


def preprocess_text(c, null_token: str = "") -> Column:
    """T10 (search / app form): lower, NFC, punctuation -> space, collapse."""
    return collapse_ws(strip_punct(lower_nfc(as_text(c, null_token))))


def split_tokens(c) -> Column:
    """Whitespace tokens (Python ``str.split()``): runs of white space, no empties."""
    return F.filter(F.split(collapse_ws(c), " "), lambda t: t != F.lit(""))


def clean_tokens(c) -> Column:
    """The tokens of a text that ``clean_text_basic`` has collapsed already."""
    return F.filter(F.split(_c(c), " "), lambda t: t != F.lit(""))


def join_tokens(arr) -> Column:
    return F.array_join(_c(arr), " ")


def word_tokens(c) -> Column:
    """Vectoriser tokens, maximal runs of >= 2 word characters."""
    return F.regexp_extract_all(_c(c), F.lit(TOKEN_RE), 0)


def bigrams(tokens) -> Column:
    """Adjacent token pairs joined by a space."""
    t = _c(tokens)
    return F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                       lambda x, i: F.concat_ws(" ", F.element_at(t, i + 1), x))


def text_length(c) -> Column:
    """Length in characters."""
    return F.length(_c(c))
