"""Items as a key-value store's change feed has them: each value an object with its type's name as its only key.

`{"S": "x"}` is a string, `{"N": "1.5"}` a number, BOOL, NULL, B (bytes in base64), L a list, M a
map, and SS, NS and BS sets, which come as arrays. Nothing is known of an item's attributes
beforehand, so what is decoded is a VARIANT. All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NullType, NumericType, StringType, StructType

#: How deep values are decoded. The expression grows with it: the store's own limit of 32 needs a
#: larger stack in the driver (-Xss) and seconds to plan.
DEPTH = 16


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _listed(parts: Column, begin: str, end: str) -> Column:
    return F.concat(F.lit(begin), F.array_join(parts, ","), F.lit(end))


#: A typed value, as what it is read into: its type's name and what it holds.
_VALUE = "map<string, variant>"


def _plain(value: Column, depth: int) -> Column:
    """The JSON of a typed value; what nests deeper than depth, is of no known type, or holds what isn't of its type, is null."""
    kind, held = F.map_keys(value)[0], F.map_values(value)[0]

    def of(as_: str) -> Column:
        return F.try_variant_get(held, "$", as_)

    simple = (
        F.when(kind.isin("S", "B"), _quoted(of("string")))
        .when(kind == "N", of("string"))
        .when(kind == "BOOL", of("boolean").cast("string"))
        .when(kind.isin("SS", "BS"), F.to_json(of("array<string>")))
        .when(kind == "NS", F.concat(F.lit("["), F.array_join(of("array<string>"), ","), F.lit("]")))
    )
    if depth == 0:
        return F.coalesce(simple, F.lit("null"))
    # members and elements alike as entries and in one place, so that the expression grows in proportion to the depth
    members, elements = F.map_entries(of(f"map<string, {_VALUE}>")), F.transform(of(f"array<{_VALUE}>"), lambda e: F.struct(F.lit(None).cast("string").alias("key"), e.alias("value")))
    is_map = kind == "M"
    inner = F.transform(F.when(is_map, members).otherwise(elements), lambda e: F.concat(F.when(e["key"].isNotNull(), F.concat(_quoted(e["key"]), F.lit(":"))).otherwise(""), _plain(e["value"], depth - 1)))
    nested = F.concat(F.when(is_map, "{").otherwise("["), F.array_join(inner, ","), F.when(is_map, "}").otherwise("]"))
    return F.coalesce(simple.when(kind.isin("M", "L"), nested), F.lit("null"))


def decoded(value: Column, depth: int = DEPTH) -> Column:
    """The plain value, a VARIANT, of the JSON of a typed one; null for what is no JSON."""
    parsed = F.try_parse_json(value)
    return F.when(parsed.isNotNull(), F.try_parse_json(_plain(F.try_variant_get(parsed, "$", _VALUE), depth)))


def decoded_item(item: Column, depth: int = DEPTH) -> Column:
    """The plain object, a VARIANT, of the JSON of an item, an object of attributes with typed values."""
    return decoded(F.concat(F.lit('{"M":'), item, F.lit("}")), depth)


def _typed(value: Column, kind: DataType) -> Column:
    none = F.lit('{"NULL":true}')
    if isinstance(kind, StructType):
        fields = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), _typed(value[f.name], f.dataType)) for f in kind.fields]
        body = F.concat(F.lit('{"M":{'), F.concat_ws(",", *fields), F.lit("}}"))
    elif isinstance(kind, MapType):
        body = F.concat(F.lit('{"M":'), _listed(F.transform(F.map_entries(value), lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(":"), _typed(e["value"], kind.valueType))), "{", "}"), F.lit("}"))
    elif isinstance(kind, ArrayType):
        body = F.concat(F.lit('{"L":'), _listed(F.transform(value, lambda e: _typed(e, kind.elementType)), "[", "]"), F.lit("}"))
    elif isinstance(kind, BooleanType):
        body = F.concat(F.lit('{"BOOL":'), value.cast("string"), F.lit("}"))
    elif isinstance(kind, NumericType):
        body = F.concat(F.lit('{"N":'), _quoted(value.cast("string")), F.lit("}"))
    elif isinstance(kind, NullType):
        return none
    elif isinstance(kind, StringType):
        body = F.concat(F.lit('{"S":'), _quoted(value), F.lit("}"))
    else:
        raise TypeError(f"{kind.simpleString()} has no type in an item")
    return F.when(value.isNull(), none).otherwise(body)


def encoded_item(row: Column, kind: StructType) -> Column:
    """The JSON of a struct column of that type as an item: nulls are NULL values."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(_quoted(F.lit(f.name)), F.lit(":"), _typed(row[f.name], f.dataType)) for f in kind.fields]), F.lit("}"))
