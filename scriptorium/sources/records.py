"""Records of any shape: made safe for JSON, kept as VARIANT, and read by path.

``sanitized`` turns a column of any type into one that JSON can hold: keys of maps are strings, numbers that are not finite are null,
bytes are base64, times and what else JSON has no form for are strings. ``parsed`` reads JSON texts of unlike shapes into one VARIANT
column, so that no common schema is needed; ``shape`` finds what they have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: a string literal, or what stands between two
_PIECES = r'"(?:[^"\\]|\\.)*+"|[^"]+|"'
_NOT_FINITE = r"[-+]?(?:Infinity|\bNaN\b)"
_PLAIN = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.NullType, T.VariantType)


def sanitized(value: Column, kind: T.DataType) -> Column:
    """``value`` of a type with JSON's types alone, inside out; null stays null. Of map keys that are equal as strings the last counts (a
    null key is the string null)."""
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, T.StructType):
        fields = [sanitized(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sanitized(x, kind.elementType))
    if isinstance(kind, T.MapType):
        # later entries win: they are put first, and of equal keys the first stays
        entries = F.reverse(F.map_entries(value))
        keyed = F.transform(entries, lambda e: F.struct(F.coalesce(F.base64(e["key"]) if isinstance(kind.keyType, T.BinaryType) else e["key"].cast("string"), F.lit("null")).alias("k"), sanitized(e["value"], kind.valueType).alias("v")))
        names = F.transform(keyed, lambda e: e["k"])
        own = F.filter(F.transform(keyed, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), (F.array_position(names, e["k"]) == i + 1).alias("first"))), lambda e: e["first"])
        return F.map_from_entries(F.reverse(F.transform(own, lambda e: F.struct(e["k"], e["v"]))))
    if isinstance(kind, _PLAIN):
        return value
    return value.cast("string")


def sanitize(df: DataFrame) -> DataFrame:
    """``df`` with all columns made safe, under their names."""
    return df.select(*(sanitized(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def to_variant(df: DataFrame, name: str = "record") -> DataFrame:
    """One VARIANT per row with all its columns, made safe. Rows of unlike tables can then stand in one."""
    safe = sanitize(df)
    return safe.select(F.to_variant_object(F.struct("*")).alias(name))


def finite(text: Column) -> Column:
    """JSON text as Python writes it, with null for NaN and the infinities; strings stay."""
    pieces = F.regexp_extract_all(text, F.lit(f"({_PIECES})"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith('"'), p).otherwise(F.regexp_replace(p, _NOT_FINITE, "null"))), "")


def parsed(texts: DataFrame, text: str = "text", name: str = "record") -> DataFrame:
    """``texts`` with the VARIANT of its JSON text; null where it is no JSON (also of a null text, or a repeated key). Of several
    values in a text the first counts."""
    return texts.withColumn(name, F.try_parse_json(finite(F.col(text))))


def value(record: Column, path: str, kind: str = "string") -> Column:
    """What a path ($.a[0].b) holds as a type; null where it is missing or doesn't fit."""
    return F.try_variant_get(record, path, kind)


def shape(records: DataFrame, name: str = "record") -> str:
    """The type that all records fit, of fields that any of them has."""
    return records.agg(F.schema_of_variant_agg(name)).first()[0]


def fields(records: DataFrame, keys: list[str], name: str = "record") -> DataFrame:
    """The keys, field and its value (VARIANT) of each record that is an object."""
    spark = records.sparkSession
    records.createOrReplaceTempView(view := f"records_{id(records):x}")
    try:
        listed = "".join(f"r.`{k}`, " for k in keys)
        return spark.sql(f"SELECT {listed}e.key AS field, e.value FROM {view} r, LATERAL variant_explode_outer(r.`{name}`) e WHERE e.key IS NOT NULL")
    finally:
        spark.catalog.dropTempView(view)
