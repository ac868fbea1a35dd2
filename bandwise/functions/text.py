"""Text helpers: missing-value tokens, blank handling, tag matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The strings a pandas CSV reader treats as missing by default
# (its documented ``na_values`` list). The reference loads its CSVs that way,
# so a cell holding one of these must arrive as NULL.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c: Column | str, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """NULL when the cell is one of the missing-value tokens, else the cell."""
    value = _col(c)
    return F.when(value.isin(*tokens), F.lit(None).cast("string")).otherwise(value)


def is_blank(c: Column | str) -> Column:
    """NULL or only spaces (TRIM removes spaces only, tabs are kept)."""
    value = _col(c)
    return value.isNull() | (F.trim(value) == "")


def blank_default(c: Column | str, default: str) -> Column:
    """COALESCE(NULLIF(TRIM(x), ''), default)."""
    return F.coalesce(F.nullif(F.trim(_col(c)), F.lit("")), F.lit(default))


def _like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def has_tag(text: Column | str, tag: str, match: str = "substring") -> Column:
    """Does the free-text tag list contain ``tag``?

    ``substring``: ``text ILIKE '%tag%'`` -- case-insensitive containment, so
    a tag also matches inside a longer word (the reference's rule).
    ``token``: comma-separated items, trimmed and compared ignoring case.
    """
    value = _col(text)
    if match == "substring":
        return value.ilike(f"%{_like_escape(tag)}%")
    if match == "token":
        items = F.transform(F.split(F.lower(value), ","), lambda s: F.trim(s))
        return F.array_contains(items, tag.lower())
    raise ValueError(f"unknown match rule {match!r}")


def matched_tags(text: Column | str, tags: Sequence[str], match: str = "substring") -> Column:
    """Array of the tags (in list order) that ``text`` carries; empty if none."""
    value = _col(text)
    candidates = F.array(*[F.when(has_tag(value, t, match), F.lit(t)) for t in tags])
    return F.filter(candidates, lambda t: t.isNotNull())
