"""Display strings. Numbers are rounded half to even as Python's formatting does, at the sink only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _two_places(values: pd.Series) -> pd.Series:
    return values.map(lambda v: f"{v:.2f}")


def two_places(number: Column | str) -> Column:
    """``{:.2f}`` of the exact double, which no built-in format gives; null stays null."""
    number = F.col(number) if isinstance(number, str) else number
    return F.when(number.isNotNull(), _two_places(number))


def padded(number: Column, digits: int = 3) -> Column:
    """Zero-padded and never cut."""
    return F.format_string(f"%0{digits}d", number)


def frame_label(frame_idx: Column) -> Column:
    """The 1-based display name of a 0-based frame."""
    return F.concat(F.lit("Frame "), padded(frame_idx + 1))
