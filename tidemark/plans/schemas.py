"""Schemas: compatibility, a versioned registry, migrations and inference from JSON."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NONE, BACKWARD, FORWARD, FULL = "none", "backward", "forward", "full"


@dataclass(frozen=True)
class Change:
    field: str
    kind: str  # added, removed, type
    breaking: bool


def compare(old: StructType, new: StructType, mode: str = BACKWARD) -> list[Change]:
    """Removed fields and changed types break (in forward mode they only warn); added fields warn."""
    before, after = {f.name: f.dataType for f in old}, {f.name: f.dataType for f in new}
    hard = mode in (BACKWARD, FULL)
    out = [Change(n, "removed", hard) for n in before if n not in after]
    out += [Change(n, "type", hard) for n in before if n in after and before[n] != after[n]]
    out += [Change(n, "added", False) for n in after if n not in before]
    return [] if mode == NONE else out


@dataclass
class SchemaRegistry:
    """Versions of schemas by collection, from 1 on."""

    mode: str = BACKWARD
    versions: dict[str, list[tuple[StructType, str | None]]] = field(default_factory=dict)

    def register(self, name: str, schema: StructType, migration_id: str | None = None) -> int:
        """The new version; the same schema again keeps its version; a breaking change needs a migration id."""
        own = self.versions.setdefault(name, [])
        if own:
            if own[-1][0] == schema:
                return len(own)
            broken = [c.field for c in compare(own[-1][0], schema, self.mode) if c.breaking]
            if broken and migration_id is None:
                raise ValueError(f"breaking change of {', '.join(sorted(broken))} without a migration")
        own.append((schema, migration_id))
        return len(own)

    def get(self, name: str, version: int | None = None) -> StructType:
        own = self.versions[name]
        return own[(version or len(own)) - 1][0]

    def latest_version(self, name: str) -> int:
        return len(self.versions.get(name, []))

    def names(self) -> list[str]:
        return sorted(self.versions)


def migrate(df: DataFrame, version: int, target: int, steps: dict[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Applies the steps from ``version`` to ``target``; steps[v] leads from v - 1 to v."""
    for v in range(version + 1, target + 1):
        df = steps[v](df)
    return df


def analyze(df: DataFrame, exact: bool = False) -> DataFrame:
    """(field, type, nulls, distinct_values, is_key, samples): one row per field; samples are the least and the greatest value.

    A key is unique and never null. Distinct values are estimates, and a key is a guess, unless ``exact`` (which expands
    the rows by the fields).
    """
    parts, distinct = [F.count("*").alias("total")], F.countDistinct if exact else F.approx_count_distinct
    for k, f in enumerate(df.schema):
        text = F.col(f"`{f.name}`").cast("string")
        parts += [F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n_{k}"), distinct(text).alias(f"d_{k}"), F.array(F.min(text), F.max(text)).alias(f"s_{k}")]
    row = df.agg(*parts)
    rows = F.col("total")
    shape = [
        F.struct(
            F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n_{k}").alias("nulls"), F.col(f"d_{k}").alias("distinct_values"),
            ((F.col(f"n_{k}") == 0) & (F.col(f"d_{k}") >= (rows if exact else rows * 0.95))).alias("is_key"), F.col(f"s_{k}").alias("samples"),
        )
        for k, f in enumerate(df.schema)
    ]
    return row.select(F.explode(F.array(*shape)).alias("x")).select("x.*")


def analyze_json(df: DataFrame, column: str) -> DataFrame:
    """(field, type, entries): JSON types of the top-level fields of a JSON column."""
    value = F.try_parse_json(column)
    pairs = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("field", "text"), value.alias("v"))
    kind = F.when(F.col("text").isNull(), "null").when(F.col("text").rlike(r"^-?\d+$"), "integer").when(F.col("text").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").when(F.col("text").isin("true", "false"), "boolean").otherwise("string")
    return pairs.select("field", kind.alias("type")).groupBy("field", "type").agg(F.count("*").alias("entries"))


def describe(df: DataFrame, pk: str) -> DataFrame:
    """Rows, fields, distinct keys and whether the key is unique."""
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("fields"), F.countDistinct(pk).alias("keys")).withColumn("key_is_unique", F.col("rows") == F.col("keys"))
