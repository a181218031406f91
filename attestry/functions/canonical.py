"""Canonical JSON: one text for one value, whatever wrote it. Keys are sorted, nothing is spaced, text stays UTF-8,
numbers that aren't finite become the strings NaN, Infinity and -Infinity, minus zero is zero, bytes are hexadecimal, dates are in
ISO form and decimals as written. Any other type is an error: a digest of how an object happens to print is none of its content."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import math

import pandas as pd
from pyspark.sql.functions import pandas_udf


def plain(value):
    """value in types that JSON has."""
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return "Infinity" if value > 0 else "-Infinity"
        return value + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((plain(v) for v in value), key=text)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    raise TypeError(f"{type(value).__name__} has no canonical form")


def text(value) -> str:
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(text(value).encode("utf-8", "surrogatepass")).hexdigest()


def canonical_udf():
    """A vectorised function: JSON text to its canonical text; null for what isn't JSON."""
    def one(s):
        try:
            return None if s is None else text(json.loads(s))
        except ValueError:
            return None

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run
