"""The small text language of filters (``f=v``, ``f!=v``, ``f~v``) and sorts (``f:asc``, ``f:desc``).

Filters see strings only: on a field of another type ``=`` and ``~`` match nothing and ``!=`` everything.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tidemark.functions.values import json_string_field

ONE = re.compile(r"^([^=!~]+)(!=|=|~)(.*)$", re.S)


def parse(text: str) -> list[tuple[str, str, str]]:
    """(field, operator, value) of predicates parted by commas; a part that is none is an error."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        found = ONE.match(part)
        if not found:
            raise ValueError(f"not a filter: {part!r}")
        out.append((found[1].strip(), found[2], found[3].strip()))
    return out


def predicate(value: Column, operator: str, wanted: str) -> Column:
    """``value``: a string column, null where the field is missing or no string."""
    if operator == "!=":
        return ~value.eqNullSafe(F.lit(wanted))
    found = value == F.lit(wanted) if operator == "=" else value.contains(wanted)
    return F.coalesce(found, F.lit(False))


def filter_rows(df: DataFrame, text: str) -> DataFrame:
    def strings(field: str) -> Column:
        known = field in df.columns and isinstance(df.schema[field].dataType, StringType)
        return F.col(field) if known else F.lit(None).cast("string")

    return reduce(lambda d, p: d.filter(predicate(strings(p[0]), p[1], p[2])), parse(text), df)


def filter_json(df: DataFrame, json: str, text: str) -> DataFrame:
    """The same over the fields of a JSON column."""
    return reduce(lambda d, p: d.filter(predicate(json_string_field(json, p[0]), p[1], p[2])), parse(text), df)


def sort_keys(df: DataFrame, text: str, pk: str) -> list[Column]:
    """Missing values last ascending and first descending; ties by primary key. Other types than numbers compare as text."""
    field, _, way = text.partition(":")
    if way not in ("", "asc", "desc"):
        raise ValueError(f"not a sort: {text!r}")
    if field not in df.columns:
        return [F.col(pk).asc()]
    kind = df.schema[field].dataType
    key = F.col(field) if isinstance(kind, (StringType, NumericType)) else F.col(field).cast("string")
    return [key.desc_nulls_first() if way == "desc" else key.asc_nulls_last(), F.col(pk).asc()]


def page(df: DataFrame, pk: str, where: str = "", sort: str = "", limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total): the total is counted after the filter and before the page."""
    rows = filter_rows(df, where)
    keys = sort_keys(df, sort, pk) if sort else [F.col(pk).asc()]
    return rows.orderBy(*keys).offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))
