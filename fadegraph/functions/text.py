"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as blank at both ends of a text.
BLANKS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
    0x3000]))


def strip(text: Column) -> Column:
    """Text without blanks at either end, Unicode blanks included."""
    return F.trim(text, F.lit(BLANKS))


def cell_text(cell: Column) -> Column:
    """A cell as stripped text."""
    return strip(cell.cast("string"))


def is_truthy(cell: Column, data_type: T.DataType) -> Column:
    """False for null, '', 0 and false; never null."""
    if isinstance(data_type, T.BooleanType):
        test = cell
    elif isinstance(data_type, T.NumericType):
        test = cell != F.lit(0)
    elif isinstance(data_type, (T.ArrayType, T.MapType)):
        test = F.size(cell) > 0
    elif isinstance(data_type, (T.StringType, T.BinaryType)):
        test = F.length(cell) > 0
    else:
        test = cell.isNotNull()
    return F.coalesce(test, F.lit(False))


def first_text(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def digest(content: Column) -> Column:
    """What stands for a content in joins and groupings, so that texts need not be shuffled."""
    return F.sha2(content, 256)
