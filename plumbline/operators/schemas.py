"""Schemas: drift, contracts, topic compatibility, message types, casts that fail on real rows, time formats, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import share

# Ladders of types that widen from left to right.
LADDERS = (("tinyint", "smallint", "int", "bigint"), ("float", "double"))


def widens(old: T.DataType, new: T.DataType) -> bool | None:
    """True if ``new`` holds every value of ``old``, False if it is narrower, None if they do not compare."""
    a, b = old.simpleString(), new.simpleString()
    for ladder in LADDERS:
        if a in ladder and b in ladder:
            return ladder.index(b) > ladder.index(a)
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType) and old.scale == new.scale:
        return new.precision > old.precision
    return None


def schema_drift(spark: SparkSession, old: T.StructType, new: T.StructType) -> DataFrame:
    """``column_name, change, severity``: removed, narrowed or otherwise changed columns break, widened and renamed ones are a risk, added ones for information.

    A rename is taken if exactly one removed and one added column have one type and names alike by 0.6.
    """
    a, b = ({f.name.lower(): f for f in s.fields} for s in (old, new))
    gone, came = [c for c in a if c not in b], [c for c in b if c not in a]
    rows = []
    if len(gone) == len(came) == 1 and a[gone[0]].dataType == b[came[0]].dataType and SequenceMatcher(None, gone[0], came[0]).ratio() >= 0.6:
        rows.append((f"{gone[0]}->{came[0]}", "renamed", "risk"))
    else:
        rows += [(c, "removed", "breaking") for c in gone] + [(c, "added", "info") for c in came]
    for c in a:
        if c in b and a[c].dataType != b[c].dataType:
            wide = widens(a[c].dataType, b[c].dataType)
            rows.append((c, "widened", "risk") if wide else (c, "narrowed" if wide is False else "type_changed", "breaking"))
        elif c in b and a[c].metadata.get("comment") != b[c].metadata.get("comment"):
            rows.append((c, "comment", "info"))
    return spark.createDataFrame(rows, "column_name string, change string, severity string")


@dataclass(frozen=True)
class Contract:
    """What a table promises: column types by name, and the partition columns."""

    table: str
    columns: Mapping[str, str]
    partitions: tuple[str, ...] = ()


def draft_contract(name: str, df: DataFrame, partitions: Sequence[str] = ()) -> Contract:
    return Contract(name, {f.name: f.dataType.simpleString() for f in df.schema.fields}, tuple(partitions))


def contract_rows(spark: SparkSession, c: Contract) -> DataFrame:
    return spark.createDataFrame(list(c.columns.items()), "column_name string, data_type string")


def check_contract(df: DataFrame, c: Contract) -> DataFrame:
    """``column_name, status``: ok, missing, type_mismatch or undeclared."""
    has = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    said = {k.lower(): v for k, v in c.columns.items()}
    rows = [(k, "missing" if k not in has else "ok" if has[k] == v else "type_mismatch") for k, v in said.items()] + [(k, "undeclared") for k in has if k not in said]
    return df.sparkSession.createDataFrame(rows, "column_name string, status string")


def required(schema: T.StructType, names: Sequence[str]) -> T.StructType:
    """The schema with these fields not nullable and the others nullable."""
    return T.StructType([T.StructField(f.name, f.dataType, f.name not in names, f.metadata) for f in schema.fields])


def topic_compatibility(spark: SparkSession, old: T.StructType, new: T.StructType, mode: str = "backward") -> DataFrame:
    """``field, change, breaks, severity``: breaking if it breaks the selected mode (backward, forward, full), else a risk, else information."""
    a, b = ({f.name: f for f in s.fields} for s in (old, new))
    rows = [(c, "added_optional", "none") if b[c].nullable else (c, "added_required", "backward") for c in b if c not in a]
    rows += [(c, "removed_optional", "none") if a[c].nullable else (c, "removed_required", "forward") for c in a if c not in b]
    promoted = ("int", "bigint", "float", "double")
    for c in a:
        if c in b:
            x, y = a[c].dataType.simpleString(), b[c].dataType.simpleString()
            up = x in promoted and y in promoted and promoted.index(x) < promoted.index(y) or {x, y} == {"string", "binary"}
            if x != y:
                rows.append((c, "promoted", "none") if up else (c, "type_changed", "both"))
            elif a[c].nullable and not b[c].nullable:
                rows.append((c, "now_required", "backward"))
    hit = lambda k: k == "both" or mode == "full" and k != "none" or k == mode
    return spark.createDataFrame([(*r, "breaking" if hit(r[2]) else "risk" if r[2] != "none" else "info") for r in rows], "field string, change string, breaks string, severity string")


def json_schema_type(spec: Mapping) -> T.DataType:
    """The type of a JSON Schema; null with one other type is that type, other unions are texts."""
    kind = spec.get("type", "string")
    if isinstance(kind, list):
        rest = [k for k in kind if k != "null"]
        return json_schema_type({**spec, "type": rest[0]}) if len(rest) == 1 else T.StringType()
    if kind == "object":
        if "properties" in spec:
            return T.StructType([T.StructField(k, json_schema_type(v), True) for k, v in spec["properties"].items()])
        return T.MapType(T.StringType(), json_schema_type(spec["additionalProperties"]) if isinstance(spec.get("additionalProperties"), Mapping) else T.StringType())
    if kind == "array":
        return T.ArrayType(json_schema_type(spec.get("items", {})))
    if kind == "string" and spec.get("format") in ("date-time", "date"):
        return T.TimestampType() if spec["format"] == "date-time" else T.DateType()
    return {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, T.StringType())


def avro_type(spec) -> T.DataType:
    """The type of an Avro schema: records, arrays, maps, nullable unions and logical types; other unions are texts."""
    if isinstance(spec, list):
        rest = [s for s in spec if s != "null"]
        return avro_type(rest[0]) if len(rest) == 1 else T.StringType()
    if isinstance(spec, Mapping):
        logical = spec.get("logicalType")
        if logical == "decimal":
            return T.DecimalType(spec.get("precision", 10), spec.get("scale", 0))
        if logical in ("timestamp-millis", "timestamp-micros"):
            return T.TimestampType()
        if logical == "date":
            return T.DateType()
        kind = spec["type"]
        if kind == "record":
            return T.StructType([T.StructField(f["name"], avro_type(f["type"]), True) for f in spec["fields"]])
        if kind == "array":
            return T.ArrayType(avro_type(spec["items"]))
        if kind == "map":
            return T.MapType(T.StringType(), avro_type(spec["values"]))
        return avro_type(kind)
    return {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(), "fixed": T.BinaryType()}.get(spec, T.StringType())


def cast_failures(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """``column_name, target, failures``: values that the target type of a column cannot hold, counted in one scan."""
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in targets.items()]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("target"), F.col(c).alias("failures")) for c, t in targets.items()])
    return df.agg(*bad).select(F.explode(cells).alias("r")).select("r.*")


def _classes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    v, zone = F.col("v"), r"(Z|[+-]\d{2}:?\d{2})$"
    kind = (
        F.when(v.rlike(r"^\d{10}$"), "epoch_s").when(v.rlike(r"^\d{13}$"), "epoch_ms").when(v.rlike(r"^\d{16}$"), "epoch_us")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}[ T].*" + zone), F.concat(F.lit("offset "), F.regexp_extract(v, zone, 1))).when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), "no offset").otherwise("other")
    )
    return df.select(pairs.alias("p")).select("p.*").filter("v is not null").withColumn("class", kind)


def time_classes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_name, class, n``: offsets, epoch units and plain texts of timestamp columns."""
    return _classes(df, columns).groupBy("column_name", "class").agg(F.count(F.lit(1)).alias("n"))


def time_findings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``code, severity, subject, value``: TZ001 offsets mixed, TZ002 epoch units mixed, TZ003 two peaks 7 to 9 hours apart, TZ004 years out of range."""
    c = _classes(df, columns)
    kinds = c.groupBy("column_name").agg(F.count_distinct(F.when(F.col("class").startswith("offset") | (F.col("class") == "no offset"), F.col("class"))).alias("zones"), F.count_distinct(F.when(F.col("class").startswith("epoch"), F.col("class"))).alias("units"))
    mixed = kinds.filter("zones > 1").select(F.lit("TZ001").alias("code"), F.lit("high").alias("severity"), F.col("column_name").alias("subject"), F.col("zones").cast("double").alias("value"))
    units = kinds.filter("units > 1").select(F.lit("TZ002").alias("code"), F.lit("high").alias("severity"), F.col("column_name").alias("subject"), F.col("units").cast("double").alias("value"))
    dated = c.filter(~F.col("class").startswith("epoch") & (F.col("class") != "other"))
    hours = dated.groupBy("column_name", F.substring("v", 12, 2).try_cast("int").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("h is not null")
    total = hours.groupBy("column_name").agg(F.sum("n").alias("all"))
    peaks = hours.join(total, "column_name").filter("n >= 0.2 * all and all >= 10")
    a, b = peaks.select("column_name", F.col("h").alias("h1")), peaks.select("column_name", F.col("h").alias("h2"))
    apart = a.join(b, "column_name").filter("h2 - h1 between 7 and 9").groupBy("column_name").agg(F.max(F.col("h2") - F.col("h1")).cast("double").alias("value"))  # at most five peaks a column
    two = apart.select(F.lit("TZ003").alias("code"), F.lit("mid").alias("severity"), F.col("column_name").alias("subject"), "value")
    year = F.substring("v", 1, 4).try_cast("int")
    old = dated.groupBy("column_name").agg(F.count_if((year < 1980) | (year > 2100)).cast("double").alias("value")).filter("value > 0")
    return mixed.unionByName(units).unionByName(two).unionByName(old.select(F.lit("TZ004").alias("code"), F.lit("mid").alias("severity"), F.col("column_name").alias("subject"), "value"))


def coverage(catalog: DataFrame, rules: DataFrame) -> DataFrame:
    """``table_name, columns, covered, share`` of columns that some rule names."""
    named = rules.select("table_name", "column_name").distinct().withColumn("__r", F.lit(1))
    return catalog.join(named, ["table_name", "column_name"], "left").groupBy("table_name").agg(F.count(F.lit(1)).alias("columns"), F.count("__r").alias("covered")).withColumn("share", share(F.col("covered"), F.col("columns")))
