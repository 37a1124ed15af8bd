"""Canonical JSON of nested columns, and its digest.

The text is that of json.dumps(value, sort_keys=True, separators=(",", ":")): keys sorted by code point, no blanks,
everything but printable ASCII escaped, null kept as null. It does not depend on the order of fields, so equal
contents have equal digests, and (a, null, b) differs from (a, b).

Schemas without floating-point fields are written by native expressions. The shortest text of a double is Python's
own, so a schema that holds one is written by json itself on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for an escaped backslash while \\u escapes are looked for; JSON holds no such character itself.
_MARK = "\x01"


def json_string(text: Column) -> Column:
    """The text in quotes, everything but printable ASCII escaped, with lower-case digits."""
    raw = F.to_json(F.array(text), {"writeNonAsciiCharacterAsCodePoint": "true"})
    body = raw.substr(F.lit(2), F.length(raw) - 2)
    parts = F.split(F.replace(F.replace(body, F.lit("\x7f"), F.lit("\\u007f")), F.lit("\\\\"), F.lit(_MARK)), r"\\u")
    lowered = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lower(F.substring(p, 1, 4)), F.substring(p, 5, 2**31 - 1))))
    escaped = F.replace(F.array_join(lowered, "\\u"), F.lit(_MARK), F.lit("\\\\"))
    return F.when(body.contains("\\u") | body.contains("\x7f"), escaped).otherwise(body)


def _floating(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_floating(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _floating(t.elementType)
    if isinstance(t, T.MapType):
        return _floating(t.valueType)
    return isinstance(t, (T.DoubleType, T.FloatType))


def _members(entries: list[tuple[str, Column]]) -> Column:
    """An object of (key text, value text or null where the key is left out)."""
    parts = F.array(*(F.concat(F.lit(k + ":"), v) for k, v in entries)) if entries else F.array().cast("array<string>")
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ","), F.lit("}"))


def _text(c: Column, t: T.DataType, optional: Collection[str] = ()) -> Column:
    if isinstance(t, T.StructType):
        import json

        fields = sorted(t.fields, key=lambda f: f.name)
        value = _members([(json.dumps(f.name), F.when(c[f.name].isNotNull(), _text(c[f.name], f.dataType)) if f.name in optional else _text(c[f.name], f.dataType)) for f in fields])
    elif isinstance(t, T.ArrayType):
        value = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _text(x, t.elementType)), ","), F.lit("]"))
    elif isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType):
        entries = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.concat(json_string(k), F.lit(":"), _text(c[k], t.valueType)))
        value = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    elif isinstance(t, (T.StringType, T.DecimalType, T.DateType)):
        value = json_string(c.cast("string"))
    elif isinstance(t, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        value = c.cast("string")
    elif isinstance(t, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no canonical JSON of {t.simpleString()}")
    return F.when(c.isNull(), F.lit("null")).otherwise(value)


def canonical_json(c: Column, t: T.DataType, optional: Collection[str] = ()) -> Column:
    """The canonical text of a column of type t; a null value is "null".

    Fields named in `optional` are left out of the outermost object where they are null. Decimals and dates are written
    as strings of themselves.
    """
    if not _floating(t):
        return _text(c, t, optional)
    left_out = frozenset(optional)

    @F.arrow_udf("string")
    def dump(values):
        import json

        import pyarrow as pa

        def plain(v, t):
            if v is None:
                return None
            if isinstance(t, T.StructType):
                return {f.name: plain(v[f.name], f.dataType) for f in t.fields}
            if isinstance(t, T.ArrayType):
                return [plain(x, t.elementType) for x in v]
            if isinstance(t, T.MapType):
                return {k: plain(x, t.valueType) for k, x in (v.items() if isinstance(v, dict) else v)}
            return str(v) if isinstance(t, (T.DecimalType, T.DateType)) else v

        def one(v):
            v = plain(v, t)
            if isinstance(v, dict):
                v = {k: x for k, x in v.items() if x is not None or k not in left_out}
            return json.dumps(v, sort_keys=True, separators=(",", ":"))

        return pa.array([one(v) for v in values.to_pylist()], pa.string())

    return dump(c)


def digest(c: Column, t: T.DataType, optional: Collection[str] = ()) -> Column:
    """SHA-256 of the canonical text, in lower-case hex."""
    return F.sha2(canonical_json(c, t, optional), 256)


#: Fields of what a policy acts on; the execution context may be absent.
POLICY_INPUT = T.StructType([
    T.StructField("feature_sha256", T.StringType()), T.StructField("market_probability_outcome0", T.DoubleType()), T.StructField("portfolio_features", T.ArrayType(T.DoubleType())),
    T.StructField("prediction_memory_features", T.ArrayType(T.DoubleType())), T.StructField("previous_action_id", T.LongType()), T.StructField("physical_action_mask", T.ArrayType(T.BooleanType())),
    T.StructField("execution_context", T.ArrayType(T.DoubleType())),
])


def policy_input_digest(state: dict[str, Column]) -> Column:
    """Binds an action to its features, portfolio, memory and possible actions; null unless the feature digest has 64 digits."""
    payload = F.struct(*(state.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in POLICY_INPUT.fields))
    return F.when(F.length(state["feature_sha256"]) == 64, digest(payload, POLICY_INPUT, {"execution_context"}))
