"""Column expressions with the missing-value rules of data-frame languages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Taxonomic ranks from the broadest to the most specific.
RANKS = [
    "superkingdom",
    "phylum",
    "subphylum",
    "clade",
    "class",
    "order",
    "family",
    "genus",
    "species",
]

# Quality tiers in plotting order.
QUALITY_LEVELS = ["Contaminated", "Low", "Medium", "High"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ifelse_na(cond: Column, yes: Column, no: Column) -> Column:
    """Conditional that is NULL when the condition is NULL (CASE would take ELSE)."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def separate(c: str | Column, into: Sequence[str], regex: str) -> list[Column]:
    """Split on a regex into named text columns; extra pieces go, missing ones are NULL."""
    pieces = F.split(_col(c), regex, -1)
    return [F.get(pieces, i).alias(name) for i, name in enumerate(into)]


def unite(cols: Sequence[str | Column], sep: str = "_") -> Column:
    """Join as text; a missing value becomes the text NA."""
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols])


def strict_sum(c: str | Column) -> Column:
    """Sum that is NULL as soon as one value of the group is NULL."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def any_not_null(cols: Sequence[str | Column]) -> Column:
    return F.coalesce(*[_col(c) for c in cols]).isNotNull()


def any_positive(cols: Sequence[str | Column]) -> Column:
    """True when at least one value is above zero; NULLs never count."""
    return F.greatest(*[_col(c) for c in cols]) > 0


def replace_first(c: str | Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only (``regexp_replace`` replaces them all)."""
    return F.regexp_replace(_col(c), f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def numeric_value(c: str | Column, compat: bool = False) -> Column:
    """First number in a text as double.

    ``compat=True`` keeps every digit, dot and minus and drops the rest, so that
    ``1e-05`` turns into ``1-05`` and comes out NULL.
    """
    c = _col(c)
    if compat:
        return F.regexp_replace(c, "[^0-9.-]", "").try_cast("double")
    return F.regexp_extract(c, r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", 0).try_cast("double")


def decimal_mark(c: str | Column, mark: str) -> Column:
    """Number written with another decimal mark."""
    return F.translate(_col(c), mark, ".").try_cast("double")


def category_rank(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based position in the level list; NULL for a value outside of it."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(c))
    return F.nullif(position, F.lit(0)).cast("int")


def recode(c: str | Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Look a value up in a small fixed map; unmapped values take ``default`` (NULL if None)."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, _col(c))
    return found if default is None else F.coalesce(found, default)


def any_match(c: str | Column, patterns: Sequence[str]) -> Column:
    """True when one of the regexes occurs in the text."""
    c = _col(c)
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def split_list(c: str | Column, regex: str = " // | / ") -> Column:
    """Delimited list cell to the array of all its items."""
    return F.split(_col(c), regex, -1)


def quality_tier(completeness: str | Column, contamination: str | Column) -> Column:
    """High (>90, <5), Medium (>=50, <10), Low (<50, <10), otherwise Contaminated."""
    comp, cont = _col(completeness), _col(contamination)
    clean = cont < 10
    tier = ifelse_na((comp < 50) & clean, F.lit("Low"), F.lit("Contaminated"))
    tier = ifelse_na((comp >= 50) & clean, F.lit("Medium"), tier)
    return ifelse_na((comp > 90) & (cont < 5), F.lit("High"), tier)


def count_bucket(c: str | Column, lower: int | None = None) -> Column:
    """Transcript-count class; edges are (..100], (100,500], (500,1000], above."""
    c = _col(c)
    first = c <= 100 if lower is None else (c >= lower) & (c <= 100)
    return (
        F.when(c.isNull(), F.lit(None))
        .when(first, "1 to 100")
        .when((c > 100) & (c <= 500), "100 to 500")
        .when((c > 500) & (c <= 1000), "500 to 1,000")
        .when(c > 1000, "> 1,000")
        .otherwise("other")
    )


def best_classification(ranks: Mapping[str, Column] | None = None) -> Column:
    """Deepest rank that is filled."""
    ranks = ranks or {r: F.col(r) for r in RANKS}
    return F.coalesce(*[ranks[r] for r in reversed(RANKS) if r in ranks], F.lit("fill later"))
