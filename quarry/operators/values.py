"""The value index: one pass over all tables that answers overlap, compatibility, Jaccard and inclusion at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.catalog import INTEGRAL, Attribute, Catalog, canon


#: Texts longer than this stand in the index as their digest, so that a column of whole documents shuffles a digest per value.
LONG_TEXT = 64


class ValueIndex:
    """Distinct (attribute, value) of a catalog, grouped by value in one pass over all tables. attributes: their numbers are
    positions in this list. kinds: types indexed. nulls: "drop", or "literal" to let null count as the value None. empty: whether
    the empty text is a value."""

    def __init__(self, catalog: Catalog, kinds: tuple = (*INTEGRAL, T.StringType), nulls: str = "drop", empty: bool = False) -> None:
        if nulls not in ("drop", "literal"):
            raise ValueError("nulls is drop or literal")
        self.catalog = catalog
        types = {(n, f.name): f.dataType for n, t in catalog.tables.items() for f in t.schema.fields}
        self.attributes: list[Attribute] = [a for a in catalog.attributes() if isinstance(types[a.table, a.column], kinds)]
        number = {a: i for i, a in enumerate(self.attributes)}
        parts = []
        for name, table in catalog.tables.items():
            own = [a for a in self.attributes if a.table == name]
            if own:
                cells = []
                for a in own:
                    text = canon(F.col(f"`{a.column}`"), types[a.table, a.column])
                    text = F.when(F.length(text) > LONG_TEXT, F.concat(F.lit("\x01"), F.sha2(text, 256))).otherwise(text)
                    cells.append(F.struct(F.lit(number[a]).alias("attr"), (F.coalesce(text, F.lit("None")) if nulls == "literal" else text).alias("value")))
                parts.append(table.select(F.inline(F.array(*cells))))
        if not parts:
            raise ValueError("no column of the wanted types")
        cells = reduce(DataFrame.unionByName, parts)
        filled = cells.where(F.col("value").isNotNull() if empty else F.col("value").isNotNull() & (F.col("value") != ""))
        words = range(-(-len(self.attributes) // 63))  # a bit per attribute: fixed-size buffers, which a hash aggregate needs
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("attr") % 63)
        held = filled.groupBy("value").agg(*(F.bit_or(F.when(F.floor(F.col("attr") / 63) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words))
        own = [F.when(F.col(f"w{i // 63}").bitwiseAND(F.lit(1 << i % 63).cast("long")) != 0, F.lit(i)) for i in range(len(self.attributes))]
        self.sets = held.select("value", F.array_compact(F.array(*own)).alias("s"))

    def named(self, number: str) -> Column:
        """The name of a numbered attribute."""
        return F.element_at(F.array(*(F.lit(str(a)) for a in self.attributes)), F.col(number) + 1)

    def cached(self) -> ValueIndex:
        """Keeps the index for several questions; memory and disk, as executors have room."""
        self.sets = self.sets.persist()
        return self

    def sizes(self) -> DataFrame:
        """attr, n: distinct values."""
        return self.sets.select(F.explode("s").alias("attr")).groupBy("attr").agg(F.count("*").alias("n"))

    def overlaps(self) -> DataFrame:
        """a, b, n, n_a, n_b: distinct values that attributes a <= b share, and have. A value's set holds an attribute once, so its
        pairs are bounded by the schema; pairs are counted before they are shuffled, and an attribute's own size is its pair
        with itself."""
        pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        counted = self.sets.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))
        own = F.when(F.col("a") == F.col("b"), F.col("n"))
        return counted.select("*", F.max(own).over(Window.partitionBy("a")).alias("n_a"), F.max(own).over(Window.partitionBy("b")).alias("n_b"))

    def measured(self, own: bool = False) -> DataFrame:
        """left, right (names), n_ab, n_a, n_b, jaccard, for pairs that share a value; own: also of an attribute with itself."""
        pairs = self.overlaps().where(F.lit(own) | (F.col("a") != F.col("b")))
        union = F.col("n_a") + F.col("n_b") - F.col("n")
        return pairs.select(
            self.named("a").alias("left"), self.named("b").alias("right"), F.col("n").alias("n_ab"), "n_a", "n_b", (F.col("n") / union).alias("jaccard")
        )

    def compatible(self, min_shared: int = 4, min_jaccard: float | None = None, foreign_keys: bool = True) -> DataFrame:
        """left, right, n_ab, declared: pairs (self pairs too) that share min_shared values or have a declared reference from left
        to right, with as many values as they share. min_jaccard narrows by similarity instead."""
        number = {(a.table, a.column): i for i, a in enumerate(self.attributes)}
        declared = [
            (str(self.attributes[number[f]]), str(self.attributes[number[t]]))
            for f, t in self.catalog.constraints.foreign.items()
            if foreign_keys and f in number and t in number and number[f] <= number[t]
        ]
        spark = self.sets.sparkSession
        keys = F.broadcast(spark.createDataFrame(declared, "left string, right string").withColumn("declared", F.lit(True)))
        found = self.measured(own=True).select("left", "right", "n_ab", "jaccard").join(keys, ["left", "right"], "full_outer")
        fits = F.col("n_ab") >= min_shared if min_jaccard is None else F.col("jaccard") > min_jaccard
        found = found.where(F.coalesce(fits, F.lit(False)) | F.col("declared").isNotNull())
        return found.select("left", "right", F.coalesce("n_ab", F.lit(0)).alias("n_ab"), F.coalesce("declared", F.lit(False)).alias("declared"))

    def inclusions(self, least: float = 1.0, same_table: bool = True) -> DataFrame:
        """dependant, referenced, n_ab, n_a, coverage: the share of the dependant's distinct values that the referenced one has; then
        jaccard. Each pair is turned both ways as it comes, not measured twice."""
        one = F.struct(F.col("left").alias("left"), F.col("right").alias("right"), F.col("n_a").alias("n_a"))
        other = F.struct(F.col("right").alias("left"), F.col("left").alias("right"), F.col("n_b").alias("n_a"))
        ordered = self.measured().select("n_ab", "jaccard", F.inline(F.array(one, other)))
        kept = ordered.withColumn("coverage", F.col("n_ab") / F.col("n_a")).where(F.col("coverage") >= least)
        if not same_table:
            kept = kept.where(F.substring_index("left", ".", 1) != F.substring_index("right", ".", 1))
        return kept.select(F.col("left").alias("dependant"), F.col("right").alias("referenced"), "n_ab", "n_a", "coverage", "jaccard")


def ind_measures(catalog: Catalog, pairs: list[tuple[str, str]], threshold: float = 0.5) -> DataFrame:
    """dependant, referenced, overlap, support, confidence, joined, valid, for each "table.column" pair: overlap counts distinct
    dependant values that occur in the referenced column; confidence is by the dependant's rows, support by both tables' rows;
    joined counts the rows of their join, and the dependency is valid if that is over the threshold. A table or column that
    isn't there gives zeros. All pairs come from one pass over their tables: values are counted per column before they meet."""
    spark = next(iter(catalog.tables.values())).sparkSession
    split = [(p, tuple(x.split(".", 1) for x in p)) for p in pairs]
    here = lambda c: c[0] in catalog.tables and c[1] in catalog[c[0]].columns
    known = sorted({tuple(c) for _, both in split if all(map(here, both)) for c in both})
    names = {".".join(c): i for i, c in enumerate(known)}
    wanted = spark.createDataFrame([(*p, names.get(p[0], -1) if all(map(here, both)) else -1, names.get(p[1], -1)) for p, both in split], "dependant string, referenced string, a int, b int")
    found = spark.createDataFrame([], "a int, b int, overlap long, joined long, n_d long, n_r long")
    if known:
        parts, rows = [], []
        for table in dict.fromkeys(t for t, _ in known):
            own = [(t, c) for t, c in known if t == table]
            text = {c: canon(F.col(f"`{c}`"), catalog[table].schema[c].dataType) for _, c in own}
            cells = [F.struct(F.lit(names[f"{table}.{c}"]).alias("attr"), text[c].alias("value")) for _, c in own]
            parts.append(catalog[table].select(F.inline(F.array(*cells))))
            rows.append(catalog[table].agg(F.count("*").alias("n")).select(F.explode(F.array(*(F.lit(names[f"{table}.{c}"]) for _, c in own))).alias("attr"), "n"))
        cells = reduce(DataFrame.unionByName, parts).where(F.col("value").isNotNull())
        counted = cells.groupBy("value", "attr").agg(F.count("*").alias("k")).groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("attr", "k"))).alias("m"))  # an entry per column
        asked = sorted({(names[p[0]], names[p[1]]) for p, both in split if all(map(here, both))})
        pairs_of = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in asked))
        met = counted.select("m", F.inline(pairs_of)).select("a", "b", F.try_element_at("m", F.col("a")).alias("x"), F.try_element_at("m", F.col("b")).alias("y"))
        met = met.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("a", "b").agg(F.count("*").alias("overlap"), F.sum(F.col("x") * F.col("y")).alias("joined"))
        sizes = reduce(DataFrame.unionByName, rows)
        every = spark.createDataFrame(asked, "a int, b int")
        found = every.join(met, ["a", "b"], "left").join(sizes.select(F.col("attr").alias("a"), F.col("n").alias("n_d")), "a").join(sizes.select(F.col("attr").alias("b"), F.col("n").alias("n_r")), "b")
        found = found.select("a", "b", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("overlap", "joined", "n_d", "n_r")))
    full = wanted.join(F.broadcast(found), ["a", "b"], "left")  # a row per pair
    n = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("overlap", "joined", "n_d", "n_r")}
    share = lambda x, y: F.when(y > 0, x / F.nullif(y, F.lit(0))).otherwise(0.0)
    return full.select(
        "dependant", "referenced", n["overlap"].alias("overlap"), share(n["overlap"], n["n_d"] + n["n_r"]).alias("support"), share(n["overlap"], n["n_d"]).alias("confidence"),
        n["joined"].alias("joined"), (n["joined"] > threshold).alias("valid"),
    )


def orphans(catalog: Catalog, table: str, column: str, to: str, key: str) -> DataFrame:
    """Rows of table whose non-null column value isn't in the referenced key."""
    keys = catalog[to].select(F.col(key).alias(column)).distinct()
    return catalog[table].where(F.col(column).isNotNull()).join(keys, column, "left_anti")
