"""Access to JSON metadata, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or_number(json: Column, key: str) -> Column:
    """Value of a top-level key as text if it is a string or a number.

    NULL for other values, a missing key and broken JSON.
    """
    path = f"$.{key}"
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))
    return F.when(kind.rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.get_json_object(json, path))
