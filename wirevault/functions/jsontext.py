"""JSON pretty printing, the one text function that Spark cannot express.

Spark's variant type sorts object keys and re-formats numbers, so pretty text made from
it would differ from the source. The printing runs as an Arrow-batched UDF and is only
called for values that start like JSON.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pretty_json(text: Column) -> Column:
    """Indented JSON, or the text itself when it does not parse."""

    # Nested, so that it travels with the UDF and executors need not have this package.
    def indented(value: str | None) -> str | None:
        try:
            return json.dumps(json.loads(value), indent=2, ensure_ascii=False)
        except (TypeError, ValueError, RecursionError):
            return value

    @F.pandas_udf("string")
    def pretty(values: pd.Series) -> pd.Series:
        return values.map(indented)

    return pretty(text)
