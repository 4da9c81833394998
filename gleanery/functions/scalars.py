"""Column functions for the text, number, URL and date rules.

Scraped text is hostile, so nothing here throws: bad input becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the page language counts as white space.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Words accepted as booleans.
TRUE_WORDS = ("true", "yes", "1", "on")
FALSE_WORDS = ("false", "no", "0", "off")

# Date layouts accepted besides ISO-8601, each with the shape of its texts.
# The shape is tested first, so only the one layout that can fit is ever tried.
DATE_FORMATS = {
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}\z",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}\z",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}\z",
    "MMMM d, yyyy": r"^[A-Za-z]{4,9} \d{1,2}, \d{4}\z",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}\z",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{4,9} \d{4}\z",
}

_NUMBER = r"^-?(\d+\.?\d*|\.\d+)\z"
_FLOAT_PREFIX = r"^[+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
_HTTP = (
    r"(?is)\A\s*https?:[/\\]*([^/\\?#@\s]*@)?"
    r"(\[[0-9a-f:.]+\]|[^\s/\\?#:@<>\[\]^|]+)(:\d{0,5})?([/\\?#].*)?\z"
)


def nullif(c: Column, value: str = "") -> Column:
    return F.when(c != F.lit(value), c)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def squash(c: Column) -> Column:
    """Trim and turn every run of white space into one space (V4)."""
    return js_trim(F.regexp_replace(c, rf"[{WS}]+", " "))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    return nullif(F.regexp_extract(c, pattern, group))


def strict_number(c: Column) -> Column:
    """Keep digits, dots and minus signs, then read the whole rest as a number."""
    kept = F.regexp_replace(c, r"[^0-9.-]+", "")
    return F.when(c.isNull(), F.lit(None).cast("double")).when(kept == "", F.lit(0.0)).when(
        kept.rlike(_NUMBER), kept.try_cast("double")
    )


def prefix_number(c: Column) -> Column:
    """Drop currency marks and separators, then read the longest numeric prefix."""
    bare = F.regexp_replace(c, rf"[$,€£¥{WS}]", "")
    return nullif(F.regexp_extract(bare, _FLOAT_PREFIX, 0)).try_cast("double")


def word_boolean(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))


def is_http_url(c: Column) -> Column:
    return F.coalesce(c.rlike(_HTTP), F.lit(False))


def url_origin(url: Column) -> Column:
    return first_match(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)")


def url_host(url: Column) -> Column:
    return F.lower(first_match(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _drop_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path that starts with a slash."""
    segs = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    kept = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    ends_in_dot = path.rlike(r"/\.{1,2}\z")
    tail = F.when(ends_in_dot & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return F.when(path.rlike(r"/\.{1,2}(/|\z)"), joined).otherwise(path)


def percent_encode(c: Column) -> Column:
    """Escape the characters a URL may not hold, as UTF-8 bytes."""
    bad = r"[^\x21-\x7e]|[\"<>`{}]"
    each = F.transform(
        F.split(c, ""),
        lambda ch: F.when(ch == " ", F.lit("%20")).when(ch.rlike(bad), F.url_encode(ch)).otherwise(ch),
    )
    return F.when(c.rlike(bad), F.array_join(each, "")).otherwise(c)


def resolve_url(ref: Column, base: Column) -> Column:
    """``ref`` as an absolute URL seen from ``base``; NULL if it cannot be resolved."""
    ref = js_trim(ref)
    no_frag = F.regexp_replace(base, r"(?s)#.*\z", "")
    no_query = F.regexp_replace(base, r"(?s)[?#].*\z", "")
    origin, base_path = url_origin(base), url_path(base)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_extract(base_path, r"^(.*/)", 1))
    ref_path, ref_rest = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"(?s)^[^?#]*(.*)\z", 1)
    with_slash = F.when(base_path == "", F.concat(no_query, F.lit("/"))).otherwise(no_query)
    whole = F.when(base_path == "", F.concat(with_slash, F.regexp_extract(no_frag, r"(?s)(\?.*)\z", 1))).otherwise(no_frag)
    out = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(origin.isNull(), F.lit(None))
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), ref))
        .when(ref.startswith("/"), F.concat(origin, _drop_dots(ref_path), ref_rest))
        .when(ref.startswith("?"), F.concat(with_slash, ref))
        .when(ref.startswith("#"), F.concat(whole, ref))
        .when(ref == "", whole)
        .otherwise(F.concat(origin, _drop_dots(F.concat(folder, ref_path)), ref_rest))
    )
    return percent_encode(out)


def parse_date(c: Column) -> Column:
    """TIMESTAMP from the accepted layouts; a date alone means midnight UTC."""
    text = js_trim(c)
    out = F.when(text.rlike(r"^\d{4}(-\d{1,2}(-\d{1,2})?)?([T ].*)?\z"), F.try_to_timestamp(text))
    for layout, shape in DATE_FORMATS.items():
        out = out.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)))
    return out


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def truncated(c: Column, limit: int, marker: str) -> Column:
    """At most ``limit`` characters, with a marker where text was cut."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def css_escape(c: Column) -> Column:
    """Escape an id or class name for use in a CSS selector."""
    specials = F.regexp_replace(c, r"([^A-Za-z0-9_\-\u0080-\x{10FFFF}])", r"\\$1")
    lead = F.conv(F.hex(F.substring(c, 1, 1)), 16, 16)
    return F.when(
        c.rlike(r"^\d"), F.concat(F.lit("\\"), F.lower(lead), F.lit(" "), F.substring(specials, 2, 1 << 30))
    ).otherwise(specials)


def ordered_text(rows: Column, sep: str, field: str = "text") -> Column:
    """Join the named field of collected ``struct(order, text)`` rows in order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda s: s[field]), sep)
