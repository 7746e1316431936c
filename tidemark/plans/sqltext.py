"""SQL text builders with positional parameters, run by ``spark.sql(text, args=[...])``.

Terms are glued from left to right by their AND or OR without parentheses, so SQL's own precedence holds; IN terms follow
the plain ones. LIKE patterns are passed as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass
class Where:
    terms: list[tuple[str, str, list[Any]]] = field(default_factory=list)
    ins: list[tuple[str, str, list[Any]]] = field(default_factory=list)

    def text(self) -> tuple[str, list[Any]]:
        out, args = "", []
        for glue, term, values in [*self.terms, *self.ins]:
            out += f" {glue} {term}" if out else term
            args += values
        return out, args


class _Conditions:
    where: Where

    def where_op(self, column: str, operator: str, value: Any, glue: str = "AND"):
        if operator not in ("=", "!=", "<>", ">", ">=", "<", "<=", "LIKE"):
            raise ValueError(operator)
        self.where.terms.append((glue, f"{column} {operator} ?", [value]))
        return self

    def where_eq(self, column: str, value: Any):
        return self.where_op(column, "=", value)

    def or_where_eq(self, column: str, value: Any):
        return self.where_op(column, "=", value, "OR")

    def where_between(self, column: str, low: Any, high: Any):
        return self.where_op(column, ">=", low).where_op(column, "<=", high)

    def where_like(self, column: str, pattern: str, glue: str = "AND"):
        return self.where_op(column, "LIKE", pattern, glue)

    contains = starts_with = ends_with = where_like

    def where_in(self, column: str, values: list[Any], glue: str = "AND"):
        """An empty list matches nothing."""
        self.where.ins.append((glue, f"{column} IN ({', '.join('?' * len(values))})" if values else "1 = 0", list(values)))
        return self


class Select(_Conditions):
    def __init__(self, table: str, *columns: str):
        self.table, self.columns, self.where = table, columns, Where()
        self.joins: list[str] = []
        self.groups: list[str] = []
        self.having: list[tuple[str, str, list[Any]]] = []
        self.orders: list[str] = []
        self.top: int | None = None
        self.start: int | None = None

    def join(self, table: str, on: str, kind: str = "INNER") -> Select:
        self.joins.append(f"{kind} JOIN {table} ON {on}")
        return self

    def left_join(self, table: str, on: str) -> Select:
        return self.join(table, on, "LEFT")

    def right_join(self, table: str, on: str) -> Select:
        return self.join(table, on, "RIGHT")

    def group_by(self, *columns: str) -> Select:
        self.groups += columns
        return self

    def having_eq(self, expression: str, value: Any, glue: str = "AND") -> Select:
        return self.having_op(expression, "=", value, glue)

    def having_op(self, expression: str, operator: str, value: Any, glue: str = "AND") -> Select:
        self.having.append((glue, f"{expression} {operator} ?", [value]))
        return self

    def order_by(self, column: str, way: str = "ASC") -> Select:
        self.orders.append(f"{column} {way}")
        return self

    def limit(self, n: int) -> Select:
        self.top = n
        return self

    def offset(self, n: int) -> Select:
        self.start = n
        return self

    def build(self) -> tuple[str, list[Any]]:
        out = [f"SELECT {', '.join(self.columns) or '*'} FROM {self.table}", *self.joins]
        text, args = self.where.text()
        if text:
            out.append("WHERE " + text)
        if self.groups:
            out.append("GROUP BY " + ", ".join(self.groups))
        if self.having:
            text, more = Where(terms=self.having).text()
            out.append("HAVING " + text)
            args = args + more
        if self.orders:
            out.append("ORDER BY " + ", ".join(self.orders))
        if self.top is not None:
            out.append(f"LIMIT {int(self.top)}")
        if self.start is not None:
            out.append(f"OFFSET {int(self.start)}")
        return " ".join(out), args

    def fetch_all(self, spark: SparkSession) -> DataFrame:
        text, args = self.build()
        return spark.sql(text, args=args)

    def fetch_optional(self, spark: SparkSession):
        rows = self.fetch_all(spark).limit(1).collect()
        return rows[0] if rows else None

    def fetch_one(self, spark: SparkSession):
        row = self.fetch_optional(spark)
        if row is None:
            raise LookupError("no row")
        return row


class Insert:
    def __init__(self, table: str, **values: Any):
        self.table, self.values = table, values

    def build(self) -> tuple[str, list[Any]]:
        return f"INSERT INTO {self.table} ({', '.join(self.values)}) VALUES ({', '.join('?' * len(self.values))})", list(self.values.values())

    def apply(self, df: DataFrame) -> DataFrame:
        kinds = StructType([f for f in df.schema if f.name in self.values])
        return df.unionByName(df.sparkSession.createDataFrame([tuple(self.values[f.name] for f in kinds)], kinds), allowMissingColumns=True)


class Update(_Conditions):
    """Without a condition every row is updated."""

    def __init__(self, table: str, **values: Any):
        self.table, self.values, self.where = table, values, Where()

    def build(self) -> tuple[str, list[Any]]:
        text, args = self.where.text()
        return f"UPDATE {self.table} SET {', '.join(f'{c} = ?' for c in self.values)}" + (f" WHERE {text}" if text else ""), [*self.values.values(), *args]

    def apply(self, df: DataFrame) -> DataFrame:
        text, args = self.where.text()
        df.createOrReplaceTempView(self.table)
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        hit = f"coalesce({text}, false)" if text else "true"
        columns, every = [], []
        for c in df.columns:
            if c in self.values:
                columns.append(f"CASE WHEN {hit} THEN CAST(? AS {kinds[c]}) ELSE {c} END AS {c}")
                every += [*args, self.values[c]]
            else:
                columns.append(c)
        return df.sparkSession.sql(f"SELECT {', '.join(columns)} FROM {self.table}", args=every)


class Delete(_Conditions):
    """Without a condition every row goes. A limit takes the first rows by ``order``."""

    def __init__(self, table: str):
        self.table, self.where = table, Where()
        self.top: tuple[int, int, str] | None = None

    def limit(self, n: int, order: str, offset: int = 0) -> Delete:
        self.top = n, offset, order
        return self

    def build(self) -> tuple[str, list[Any]]:
        text, args = self.where.text()
        out = f"DELETE FROM {self.table}" + (f" WHERE {text}" if text else "")
        if self.top:
            out += f" LIMIT {self.top[0]}" + (f" OFFSET {self.top[1]}" if self.top[1] else "")
        return out, args

    def apply(self, df: DataFrame, pk: str) -> DataFrame:
        text, args = self.where.text()
        df.createOrReplaceTempView(self.table)
        spark = df.sparkSession
        gone = spark.sql(f"SELECT {pk} FROM {self.table}" + (f" WHERE {text}" if text else "") + (f" ORDER BY {self.top[2]} LIMIT {self.top[0]} OFFSET {self.top[1]}" if self.top else ""), args=args)
        return df.join(gone, pk, "left_anti").select(*df.columns)


def select_with_relations(table: str, columns: list[str], relations: list[tuple[str, str, str]]) -> Select:
    """Inner joins from declared relations (table, foreign key in it, key here)."""
    out = Select(table, *columns)
    for other, foreign, key in relations:
        out.join(other, f"{other}.{foreign} = {table}.{key}")
    return out


TYPES = {"string": "STRING", "int": "INT", "bigint": "BIGINT", "smallint": "SMALLINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "binary": "BINARY", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP_NTZ"}


def create_table_sql(name: str, schema: StructType, pk: str | None = None) -> str:
    """DDL of a schema; nested types as they are written, the key marked NOT NULL."""
    parts = []
    for f in schema:
        kind = TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper() if ":" not in f.dataType.simpleString() else f.dataType.simpleString())
        parts.append(f"{f.name} {kind}{' NOT NULL' if f.name == pk or not f.nullable else ''}")
    return f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(parts)}) USING parquet"
