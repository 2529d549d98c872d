"""Class labels as written by different sources, and the keys they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and characters that leave no mark: Unicode's Z and C categories,
#: and fillers, joiners, variation selectors and blanks outside them.
INVISIBLE = (
    r"[\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}"
    r"\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]"
)


def visible_lower(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, INVISIBLE, ""))


def _key(cut: Column, missing: tuple[str, ...]) -> Column:
    return F.when(cut.isin(*missing), None).otherwise(cut)


def superfamily_key(label: Column) -> Column:
    """Clans (``cl...``) end before the first dot; other labels keep three dot
    components. Null for a null, empty or placeholder label."""
    low = visible_lower(label)
    cut = F.when(low.startswith("cl"), F.substring_index(low, ".", 1)).otherwise(F.substring_index(low, ".", 3))
    return _key(cut, ("", "-", "x.x.x"))


def family_key(label: Column) -> Column:
    """Accessions (``pf...``) end before the first dot (their version); other
    labels stay whole. Null for a null, empty or placeholder label."""
    low = visible_lower(label)
    cut = F.when(low.startswith("pf"), F.substring_index(low, ".", 1)).otherwise(low)
    return _key(cut, ("", "-", "x.x.x.x"))


def superfamily_key_sql(column: str) -> str:
    """The DuckDB twin of :func:`superfamily_key`."""
    low = f"lower(regexp_replace({column}, '{INVISIBLE}', '', 'g'))"
    cut = f"case when starts_with({low}, 'cl') then split_part({low}, '.', 1) else array_to_string(string_split({low}, '.')[1:3], '.') end"
    return f"case when {cut} in ('', '-', 'x.x.x') then null else {cut} end"


def family_key_sql(column: str) -> str:
    """The DuckDB twin of :func:`family_key`."""
    low = f"lower(regexp_replace({column}, '{INVISIBLE}', '', 'g'))"
    cut = f"case when starts_with({low}, 'pf') then split_part({low}, '.', 1) else {low} end"
    return f"case when {cut} in ('', '-', 'x.x.x.x') then null else {cut} end"
