"""Rows of Spark and DuckDB in one form."""

from __future__ import annotations

import datetime
import math

import pandas as pd


def _value(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) or x is pd.NA:
        return None
    if isinstance(x, (bool,)):
        return x
    if isinstance(x, pd.Timestamp):
        x = x.to_pydatetime()
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, datetime.date):
        return datetime.datetime(x.year, x.month, x.day).isoformat()
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 6)
    return x


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted((tuple(_value(x) for x in r) for r in frame[cols].astype(object).itertuples(index=False)), key=repr)
