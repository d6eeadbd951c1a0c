"""Text comparison and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def folded(value: ColumnLike) -> Column:
    """Key for comparisons that ignore case and trailing blanks."""
    return F.lower(F.rtrim(col(value)))


def same_text(value: ColumnLike, literal: str) -> Column:
    return folded(value) == F.lit(literal.lower())


def normalised_name(value: ColumnLike) -> Column:
    """Key for drug names: case and blanks on both sides ignored."""
    return F.lower(F.trim(col(value)))


def full_name(first: ColumnLike, last: ColumnLike) -> Column:
    """``first last``; NULL as soon as one part is NULL."""
    return F.concat(col(first), F.lit(" "), col(last))


def joined(*parts: ColumnLike) -> Column:
    """Concatenation in which a NULL part counts as empty text."""
    return F.concat(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
