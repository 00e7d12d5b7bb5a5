"""Synthetic relational data of any size, made on the executors from seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.catalog import Catalog, Constraints


def chain(spark: SparkSession, rows: int, tables: int = 5, columns: int = 5, seed: int = 0) -> Catalog:
    """table1 ... tableN, each with an id, columns of random integers, texts and reals in turn, and a reference to the one before."""
    per = max(1, rows // tables)
    out, primary, foreign = {}, {}, {}
    for t in range(1, tables + 1):
        df = spark.range(1, per + 1)
        for c in range(1, columns + 1):
            draw = F.rand(seed * 10_007 + t * 101 + c)
            value = {0: (draw * 1000).cast("long"), 1: F.concat(F.lit("v"), (draw * 1000).cast("long").cast("string")), 2: draw * 1000}[c % 3]
            df = df.withColumn(f"col{c}", value)
        if t > 1:
            df = df.withColumn(f"table{t - 1}_id", (F.rand(seed + t) * per).cast("long") + 1)
            foreign[f"table{t}", f"table{t - 1}_id"] = (f"table{t - 1}", "id")
        out[f"table{t}"], primary[f"table{t}"] = df, ("id",)
    return Catalog(out, Constraints(primary, foreign))


def patients(spark: SparkSession, n: int, seed: int = 0) -> Catalog:
    """patient, liver_test and diagnosis, one row of each to a patient."""
    ids = spark.range(1, n + 1)
    draw = lambda k, low, high: low + F.rand(seed * 31 + k) * (high - low)
    tests = ids.select("id", F.col("id").alias("patient_id"), *(draw(k, 10.0, 150.0).alias(c) for k, c in enumerate(("mcv", "alkphos", "sgpt", "sgot", "gammagt"))))
    diagnoses = ids.select("id", F.col("id").alias("patient_id"), draw(9, 0.0, 20.0).alias("drinks"), (F.lit(1) + (F.rand(seed + 10) * 2).cast("int")).alias("selector"))
    tables = {"patient": ids.withColumn("name", F.concat(F.lit("patient"), "id")), "liver_test": tests, "diagnosis": diagnoses}
    keys = {t: ("id",) for t in tables}
    return Catalog(tables, Constraints(keys, {(t, "patient_id"): ("patient", "id") for t in ("liver_test", "diagnosis")}))


def shop(spark: SparkSession, rows: int, seed: int = 0) -> Catalog:
    """customers, products, orders and shipments (3 : 2 : 4 : 1), where an order repeats its customer's name and city and its
    product's name, so that rules between them hold."""
    n_c, n_p, n_o, n_s = (max(1, rows * share // 10) for share in (3, 2, 4, 1))
    customers = spark.range(1, n_c + 1).select(F.col("id").alias("customer_id"), F.concat(F.lit("customer"), "id").alias("name"), F.concat(F.lit("city"), F.col("id") % 50).alias("city"))
    products = spark.range(1, n_p + 1).select(F.col("id").alias("product_id"), F.concat(F.lit("product"), "id").alias("product"), (F.rand(seed) * 100).alias("price"))
    drawn = spark.range(1, n_o + 1).select(F.col("id").alias("order_id"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_c)) + 1).alias("customer_id"), (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n_p)) + 1).alias("product_id"))
    orders = drawn.select("*", F.concat(F.lit("customer"), "customer_id").alias("name"), F.concat(F.lit("city"), F.col("customer_id") % 50).alias("city"), F.concat(F.lit("product"), "product_id").alias("product"))
    shipments = spark.range(1, n_s + 1).select(F.col("id").alias("shipment_id"), (F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(n_o)) + 1).alias("order_id"))
    keys = {"customers": ("customer_id",), "products": ("product_id",), "orders": ("order_id",), "shipments": ("shipment_id",)}
    refs = {("orders", "customer_id"): ("customers", "customer_id"), ("orders", "product_id"): ("products", "product_id"), ("shipments", "order_id"): ("orders", "order_id")}
    return Catalog({"customers": customers, "products": products, "orders": orders, "shipments": shipments}, Constraints(keys, refs))


def broken(df: DataFrame, column: str, share: float, value: object, seed: int = 0) -> DataFrame:
    """df with about that share of rows holding value in column: planted violations (None for nulls)."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(F.rand(seed) < share, F.lit(value).cast(kind)).otherwise(F.col(column)))


def university(spark: SparkSession, students: int = 100, professors: int = 20, courses: int = 50, departments: int = 5, bad: int = 5, seed: int = 0) -> Catalog:
    """Students, professors and courses with names and departments apart, and planted violations: bad students with a name and bad
    with a department that isn't there, bad without one, and two courses of a professor who isn't there."""
    code = lambda mark, n: F.concat(F.lit(mark), F.lpad(n.cast("string"), 3, "0"))
    i = F.col("id")
    dept = lambda salt: code("D", F.pmod(F.xxhash64(i, F.lit(seed + salt)), F.lit(departments)) + 1)
    student = spark.range(1, students + 1).select(
        code("S", i).alias("arg1"), F.when(i <= bad, "SN999").otherwise(code("SN", i)).alias("arg2"),
        F.when(i.between(bad + 1, 2 * bad), "BAD").when(~i.between(2 * bad + 1, 3 * bad), dept(1)).alias("arg3"),
    )
    course = spark.range(1, courses + 1).select(
        code("C", i).alias("arg1"), code("CN", i).alias("arg2"), F.when(i <= 2, "P999").otherwise(code("P", F.pmod(i, F.lit(professors)) + 1)).alias("arg3")
    )
    names = lambda mark, n: spark.range(1, n + 1).select(code(mark, i).alias("arg1"), F.concat(F.lit("name"), i).alias("arg2"))
    tables = {
        "students": student, "student_names": names("SN", students), "departments": names("D", departments), "courses": course, "course_names": names("CN", courses),
        "professors": spark.range(1, professors + 1).select(code("P", i).alias("arg1"), code("PN", i).alias("arg2"), dept(2).alias("arg3")), "professor_names": names("PN", professors),
    }
    refs = {
        ("students", "arg2"): ("student_names", "arg1"), ("students", "arg3"): ("departments", "arg1"), ("professors", "arg2"): ("professor_names", "arg1"),
        ("professors", "arg3"): ("departments", "arg1"), ("courses", "arg2"): ("course_names", "arg1"), ("courses", "arg3"): ("professors", "arg1"),
    }
    return Catalog(tables, Constraints({t: ("arg1",) for t in tables}, refs))


def clinic(spark: SparkSession, patients: int = 345, missing: int = 0, odd_share: float = 0.0, seed: int = 0) -> Catalog:
    """A star around patients T1, T2, ...: a class of two, and six measures in tables of their own. missing: patients without a name
    row; odd_share: the share of patients with a class that isn't listed."""
    i = F.col("id")
    who = F.concat(F.lit("T"), i).alias("arg1")
    draw = lambda salt: F.rand(seed * 131 + salt)
    kind = F.when(draw(0) < odd_share, "9").otherwise((F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(2)) + 1).cast("string"))
    ids = spark.range(1, patients + 1)
    spread = {"alkphos": 78, "drinks": 16, "gammagt": 94, "mcv": 26, "sgot": 47, "sgpt": 67}
    tables = {"visit": ids.select(who, kind.alias("arg2")), "visit_name": ids.where(i > missing).select(who), "visit_type": spark.createDataFrame([("1",), ("2",)], "arg1 string")}
    tables |= {t: ids.select(who, (F.floor(draw(k + 1) * n) + 1).cast("string").alias("arg2")) for k, (t, n) in enumerate(spread.items())}
    refs = {(t, "arg1"): ("visit_name", "arg1") for t in tables if t not in ("visit_name", "visit_type")} | {("visit", "arg2"): ("visit_type", "arg1")}
    return Catalog(tables, Constraints({t: ("arg1",) for t in tables}, refs))
