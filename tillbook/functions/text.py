"""Text expressions: encodings, escapes and parameter rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters trimmed from the ends of a parameter; all of Unicode's separators are among them.
WHITESPACE = "\t\n\x0b\f\r\x85 \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# HTML escapes; the ampersand must come first.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def base64_text(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def decoded_base64(text: Column) -> Column:
    """UTF-8 text behind base64, NULL when it is not that."""
    return F.try_validate_utf8(F.try_to_binary(text, F.lit("base64")).cast("string"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def html_escape(text: Column) -> Column:
    for raw, safe in HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def url_encode_lower(text: Column) -> Column:
    """Form encoding with lower-case hex digits; ``!()`` stay as they are."""
    pieces = F.split(F.url_encode(text), "%")
    lowered = F.transform(
        pieces,
        lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lower(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 30))),
    )
    joined = F.array_join(lowered, "%")
    for code, char in (("%21", "!"), ("%28", "("), ("%29", ")")):
        joined = F.replace(joined, F.lit(code), F.lit(char))
    return joined


def parameter_error(
    value: Column,
    *,
    required: bool = True,
    non_empty: bool = True,
    no_commas: bool = False,
    max_size: int = 0,
) -> Column:
    """First broken rule of a parameter after trimming, NULL when valid."""
    clean = trimmed(value)
    checks = F.when(value.isNull(), F.lit("null") if required else F.lit(None).cast("string"))
    if non_empty:
        checks = checks.when(F.length(clean) < 1, "empty")
    if max_size > 0:
        checks = checks.when(utf16_length(clean) > max_size, "too long")
    if no_commas:
        checks = checks.when(clean.contains(","), "comma")
    return checks


def only_listed_characters(text: Column) -> Column:
    """True when the whole text is letters, hyphen, space or underscore."""
    return text.rlike(r"\A[a-zA-Z\- _]*\z")
