"""DuckDB forms of the text expressions, for the oracle SQL.

The regular expressions are the very same strings as in
``recolens.functions.text`` (valid in both the JVM and RE2 dialects)."""

from __future__ import annotations

from recolens.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, rep: str = " ") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(rep)}, 'g')"


def as_text(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def lower_nfc(x: str) -> str:
    return f"nfc_normalize(lower({x}))"


def collapse_ws(x: str) -> str:
    return f"trim({rr(x, T.SPACES_RE)})"


def clean_text_basic(x: str) -> str:
    y = rr(x, T.URL_RE)
    y = rr(y, T.EMAIL_RE)
    y = rr(y, T.DIGITS_RE)
    y = rr(y, T.PUNCT_RE)
    return collapse_ws(y)


def simple_clean(x: str) -> str:
    return clean_text_basic(lower_nfc(as_text(x)))


def preprocess_text(x: str) -> str:
    return collapse_ws(rr(lower_nfc(as_text(x)), T.PUNCT_RE))


def split_tokens(x: str) -> str:
    return f"list_filter(string_split({collapse_ws(x)}, ' '), lambda t: t <> '')"


def drop_stop(tokens: str, stop_list: str) -> str:
    """Stopword removal (lower-cased lookup) plus tokens shorter than 2 chars."""
    return (f"list_filter({tokens}, lambda t: length(t) >= 2 "
            f"AND NOT list_contains({stop_list}, lower(t)))")


def preprocess_stop(x: str, stop_list: str) -> str:
    """T9 with only a stopword list (other dictionaries empty)."""
    return f"array_to_string({drop_stop(split_tokens(clean_text_basic(lower_nfc(as_text(x)))), stop_list)}, ' ')"


def word_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(T.TOKEN_RE)})"
