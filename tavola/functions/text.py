"""Text repair and normalisation expressions."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three corruption patterns used by the quality scans.
CORRUPT_PATTERN_1 = "�|Ã|Â|â"
CORRUPT_PATTERN_2 = "�|Ã|Â|â|_"
CORRUPT_PATTERN_3 = "�|ï¿½|۱|_|Ã|Â|â"
# Characters stripped from listing names after the repairs.
NAME_STRIP_PATTERN = "�|۱|_"

# Token pattern: two or more Unicode letters / digits / underscore.  Gives
# the same tokens as a Unicode-aware ``\b\w\w+\b`` and is read the same way
# by Spark (Java regex) and DuckDB (RE2).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _guard_chars(keys: Iterable[str]) -> list[str]:
    """One character per key that the value must contain for the key to match
    (the key's first non-ASCII character, else its first character)."""
    out = set()
    for k in keys:
        if k:
            out.add(next((ch for ch in k if ord(ch) > 127), k[0]))
    return sorted(out)


@functools.lru_cache(maxsize=64)
def _pair_array(pairs: tuple[tuple[str, str], ...]) -> Column:
    """The pair list as one ``array<struct<a, b>>`` literal, built once per dictionary."""
    body = ", ".join(f"named_struct('a', {_sql_str(a)}, 'b', {_sql_str(b)})" for a, b in pairs)
    return F.expr(f"array({body})")


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def replace_literals(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Apply literal replacements one after another, in the given order.

    One ``aggregate`` higher-order function folds the pair list over the
    value, so later pairs see the output of earlier ones; the expression
    stays the same size however long the dictionary is.  The fold only runs
    for values holding a character without which no key can match (a cheap
    regex test), so clean text costs one scan.
    """
    if not pairs:
        return c
    arr = _pair_array(tuple(pairs))
    folded = F.aggregate(arr, c, lambda acc, p: F.replace(acc, p["a"], p["b"]))
    chars = "".join(ch if ch.isalnum() else "\\" + ch for ch in _guard_chars(a for a, _ in pairs))
    return F.when(c.rlike(f"[{chars}]"), folded).otherwise(c)


def strip_regex(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def norm_text(c: Column, default: str = "Unknown", trim: bool = True) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(default))
    return F.trim(out) if trim else out


def to_number(c: Column, dtype: str = "double") -> Column:
    """``pd.to_numeric(errors="coerce")``: unparsable text becomes null."""
    return F.trim(c.cast("string")).try_cast(dtype) if dtype else c


def yes_no(c: Column) -> Column:
    """Trimmed, title-cased text equal to ``Yes`` -> ``Yes``; anything else (null too) -> ``No``."""
    return F.when(F.initcap(F.trim(c.cast("string"))) == F.lit("Yes"), F.lit("Yes")).otherwise(F.lit("No"))


def split_list(c: Column, drop_empty: bool = True, lower: bool = False) -> Column:
    """Comma list -> array of trimmed pieces (empty pieces dropped by default)."""
    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x)) if lower else F.trim(x))
    return F.filter(pieces, lambda x: x != F.lit("")) if drop_empty else pieces


def contains_any(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))
