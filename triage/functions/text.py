"""Text and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A tag, a run of ASCII white space, and the white space Unicode knows.
TAG = "<[^>]+>"
SPACES = "[\\t\\n\\f\\r ]+"
UNICODE_SPACES = (
    "\t\n\x0b\x0c\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trim_all(text: Column) -> Column:
    """Trim Unicode white space, not only U+0020 as plain ``trim`` does."""
    return F.btrim(text, F.lit(UNICODE_SPACES))


def strip_html(text: Column) -> Column:
    """Tags become spaces, runs of white space become one, ends are trimmed."""
    untagged = F.regexp_replace(text, TAG, " ")
    return trim_all(F.regexp_replace(untagged, SPACES, " "))


def preview(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def prefixed(prefix: str, identifier: Column) -> Column:
    """``post_17`` from 17; NULL stays NULL."""
    return F.concat(F.lit(prefix + "_"), identifier.cast("string"))


def full_name(first: Column, last: Column) -> Column:
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def found_in(text: Column, term: str, wildcards: bool = True) -> Column:
    """Case-insensitive search. ``%`` and ``_`` are wildcards unless told otherwise; a backslash is itself."""
    lowered = F.lower(text)
    needle = term.lower()
    if not wildcards:
        return lowered.contains(needle)
    return lowered.like("%" + needle.replace("\\", "\\\\") + "%")


def json_scalar(document: Column, path: str) -> Column:
    """Scalar at ``path`` as text; NULL for objects, arrays, nulls and broken documents."""
    parsed = F.try_parse_json(document)
    kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    return F.when(
        ~(kind.startswith("OBJECT") | kind.startswith("ARRAY")),
        F.try_variant_get(parsed, path, "string"),
    )
