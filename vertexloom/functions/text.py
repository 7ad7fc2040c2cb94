"""Column functions of the loaders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_string(text: Column, delimiter: str) -> Column:
    """Splits on a literal delimiter; empty tokens stay, and there is always one at least."""
    return F.split(text, re.escape(delimiter), -1)


def number(text: Column) -> Column:
    """The text as a double, null where it is none."""
    return text.try_cast("double")


def within(found: Column, wanted: Column, tolerance: float = 1e-4) -> Column:
    """Whether found is wanted up to a relative tolerance."""
    return (found == wanted) | (F.abs(found - wanted) <= tolerance * wanted)
