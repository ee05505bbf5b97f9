"""Functions that need Unicode normalisation, which Spark has no expression for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def nfc(c: Column) -> Column:
    """Canonical composition."""
    return F.pandas_udf(_nfc, "string")(c)


def fold(c: Column) -> Column:
    """Compatibility decomposition without what is not ASCII."""
    return F.pandas_udf(_fold, "string")(c)


def normalize_text(c: Column) -> Column:
    return T.normalize_lines(nfc(c))


def slug(c: Column) -> Column:
    return T.ascii_slug(fold(c))


def heading_key(c: Column) -> Column:
    """Letters and digits of a heading, without digits in front."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold(c)), r"[^a-z0-9]+", ""), r"^\d+", "")
