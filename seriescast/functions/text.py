"""Text functions for model names and stored metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The naming patterns of stored models, first match wins.
TICKER_PATTERNS = [
    r"(?i)^lstm_model_([A-Z]{1,5})$",
    r"(?i)_([A-Z]{1,5})\.(?:keras|joblib|pkl|h5)$",
    r"(?i)_([A-Z]{1,5})_\d+\.(?:keras|joblib|pkl|h5)$",
    r"(?i)([A-Z]{1,5})_model",
    r"(?i)_([A-Z]{1,5})$",
    r"(?i)([A-Z]{2,5})(?:_|\.|$)",
]

# Python literals and their JSON spelling.
PYTHON_TO_JSON = [
    (r"\bTrue\b", "true"),
    (r"\bFalse\b", "false"),
    (r"\bNone\b", "null"),
    (r"'", '"'),
    (r"\(", "["),
    (r"\)", "]"),
]


def ticker_from_name(name: Column) -> Column:
    hits = [F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in TICKER_PATTERNS]
    return F.upper(F.coalesce(*hits))


def python_to_json(text: Column) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), PYTHON_TO_JSON, text)


def parse_python(text: Column, schema: T.DataType | str) -> Column:
    """Python-repr text as a typed value; NULL when it does not parse."""
    return F.from_json(python_to_json(text), schema)


def to_python(params: dict) -> str:
    """Parameters as stored metadata text."""
    return repr(dict(params))
