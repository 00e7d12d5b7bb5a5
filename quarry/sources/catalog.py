"""A catalog of tables with declared keys: what rule mining starts from."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
SCALAR = (*INTEGRAL, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Constraints:
    """primary: table -> key columns. foreign: (table, column) -> (table, column), one target per column."""

    primary: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    foreign: Mapping[tuple[str, str], tuple[str, str]] = field(default_factory=dict)


@dataclass(frozen=True, order=True)
class Attribute:
    table: str
    column: str
    domain: str = field(compare=False, default="")
    is_key: bool = field(compare=False, default=False)

    def __str__(self) -> str:
        return f"{self.table}.{self.column}"


class Catalog:
    """Tables by name with their constraints. Table order is by name, attribute order by table and then column position."""

    def __init__(self, tables: Mapping[str, DataFrame], constraints: Constraints = Constraints()) -> None:
        self.tables = dict(sorted(tables.items()))
        self.constraints = constraints
        if not self.tables:
            raise ValueError("a catalog needs a table")
        for (table, column), (to, key) in constraints.foreign.items():
            for name, needed in ((table, column), (to, key)):
                if name in self.tables and needed not in self.tables[name].columns:
                    raise ValueError(f"a foreign key names {name}.{needed}, which is not there")

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, columns: Mapping[str, Iterable[str] | None], constraints: Constraints = Constraints()) -> Catalog:
        """columns: table -> the columns wanted, None for all."""
        tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in columns}
        return cls({n: t if columns[n] is None else t.select(*columns[n]) for n, t in tables.items()}, constraints)

    @classmethod
    def csv(cls, spark: SparkSession, folder: str, names: Iterable[str], constraints: Constraints = Constraints(), empty_is_null: bool = True) -> Catalog:
        """Header files of text columns. CSV can't tell null from the empty string: empty_is_null says which one it is."""
        tables = {n: spark.read.option("header", True).option("emptyValue", "").csv(f"{folder}/{n}.csv") for n in names}
        filled = lambda t: t.select(*((F.nullif(F.col(f"`{c}`"), F.lit("")) if empty_is_null else F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in t.columns))
        return cls({n: filled(t) for n, t in tables.items()}, constraints)

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, names: Iterable[str], constraints: Constraints = Constraints(), **options: str) -> Catalog:
        """Tables of a database; give partitionColumn, lowerBound, upperBound and numPartitions for parallel reads."""
        return cls({n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names}, constraints)

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.tables:
            raise KeyError(f"no table {table}; there are {', '.join(self.tables)}")
        return self.tables[table]

    def scan(self, table: str, columns: Iterable[str]) -> DataFrame:
        """The columns that exist, in the order asked for."""
        here = self[table]
        return here.select(*[c for c in columns if c in here.columns])

    def attributes(self, scalar_only: bool = True) -> list[Attribute]:
        return [
            Attribute(name, f.name, f.dataType.simpleString(), f.name in self.constraints.primary.get(name, ()))
            for name, table in self.tables.items()
            for f in table.schema.fields
            if not scalar_only or isinstance(f.dataType, SCALAR)
        ]

    def is_foreign_key(self, a: Attribute, b: Attribute) -> bool:
        """Whether a refers to b."""
        return self.constraints.foreign.get((a.table, a.column)) == (b.table, b.column)

    def row_counts(self) -> dict[str, int]:
        """Rows of every table, in one job."""
        parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in self.tables.items()]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return {r["table"]: r["n"] for r in union.collect()}  # a row per table


def canon(column: Column, kind: T.DataType) -> Column:
    """The text by which values of any type are compared: integers in decimal, floats and decimals without zeros at the end of
    their fraction, booleans True and False, timestamps to the microsecond."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, column.cast("decimal(20,0)").cast("string")).otherwise(column.cast("string"))
    if isinstance(kind, T.DecimalType):
        text = column.cast("string")
        return F.when(column == 0, "0").otherwise(F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text))
    if isinstance(kind, T.TimestampType):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return column.cast("string")
