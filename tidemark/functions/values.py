"""Conversions between JSON text, scalars and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_field(json: Column | str, field: str) -> Column:
    """A field of a JSON object as text: strings bare, numbers and booleans as written; null if it is absent."""
    return F.get_json_object(json, f"$.{field}")


def json_string_field(json: Column | str, field: str) -> Column:
    """A field of a JSON object only where its value is a JSON string."""
    value = F.try_parse_json(json)
    return F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant")) == "STRING", F.try_variant_get(value, f"$.{field}", "string"))


def scalar_text(value: Column) -> Column:
    return value.cast("string")


def decode(json: Column | str, schema: StructType | str) -> Column:
    """A struct from JSON text; null where it is not valid."""
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})


def encode(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def naive_text(ts: Column | str) -> Column:
    """A timestamp without zone as text."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def rfc3339_text(ts: Column | str) -> Column:
    """A UTC instant as text."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def value_hash(*columns: str) -> Column:
    """64 bits over values, for conflict checks."""
    return F.xxhash64(*columns)
