"""Canonical form and digest of values: for Python values, and for DataFrame columns as JVM expressions.

Every value is written as a tag, a length where it has one, and its content, so different types never compare equal
(1, 1.0 and true differ), -0.0 differs from 0.0, and NaN equals NaN.  Maps and sets are in order of their parts' digests.
"""

from __future__ import annotations

import hashlib
import math
import os
import struct
from dataclasses import fields, is_dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnsupportedValueError

MAX_DEPTH = 200


def _sized(tag: str, body: bytes) -> bytes:
    return f"{tag}{len(body)}:".encode() + body


def encode(value, depth: int = 0) -> bytes:
    """Canonical bytes of a Python value."""
    if depth > MAX_DEPTH:
        raise UnsupportedValueError(f"nested deeper than {MAX_DEPTH}")
    rec = lambda x: encode(x, depth + 1)
    by_digest = lambda parts: b"".join(sorted(parts, key=lambda p: hashlib.sha256(p).digest()))
    if value is None:
        return b"n"
    kind = type(value)
    if kind is bool:
        return b"b1" if value else b"b0"
    if kind is int:
        return _sized("i", str(value).encode())
    if kind is float:
        return b"f" + (struct.pack(">d", math.nan) if value != value else struct.pack(">d", value))
    if kind is complex:
        return b"c" + rec(value.real) + rec(value.imag)
    if kind is str:
        return _sized("s", value.encode("utf-8", "surrogatepass"))
    if kind in (bytes, bytearray):
        return _sized("x", bytes(value))
    if kind is list:
        return _sized("l", b"".join(map(rec, value)))
    if kind is tuple:
        return _sized("t", b"".join(map(rec, value)))
    if kind is range:
        return rec(("range", value.start, value.stop, value.step))
    if kind in (set, frozenset):
        _no_clash(value)
        return _sized("u" if kind is set else "v", by_digest([rec(x) for x in value]))
    if kind is dict:
        _no_clash(value)
        return _sized("m", by_digest([_sized("e", rec(k) + rec(v)) for k, v in value.items()]))
    if is_dataclass(value) and not isinstance(value, type):
        return _sized("r", rec(kind.__qualname__) + b"".join(rec(f.name) + rec(getattr(value, f.name)) for f in fields(value)))
    if isinstance(value, os.PathLike):
        return rec(os.fspath(value))
    raise UnsupportedValueError(f"no canonical form for {kind.__name__}")


def _no_clash(keys) -> None:
    if len({encode(k) for k in keys}) != len(keys):
        raise UnsupportedValueError("members collapse")


def decode(data: bytes):
    """The value of canonical bytes; refuses anything that isn't exactly one canonical value."""
    value, at = _decode(data, 0)
    if at != len(data) or encode(value) != data:
        raise UnsupportedValueError("not canonical")
    return value


def _decode(d: bytes, at: int):
    tag = d[at : at + 1].decode()
    if tag == "n":
        return None, at + 1
    if tag == "b":
        return d[at + 1 : at + 2] == b"1", at + 2
    if tag == "f":
        return struct.unpack(">d", d[at + 1 : at + 9])[0], at + 9
    if tag == "c":
        a, at = _decode(d, at + 1)
        b, at = _decode(d, at)
        return complex(a, b), at
    try:
        colon = d.index(b":", at)
        start, end = colon + 1, colon + 1 + int(d[at + 1 : colon])
    except ValueError as e:
        raise UnsupportedValueError("not canonical") from e
    body = d[start:end]
    if len(body) != end - start:
        raise UnsupportedValueError("cut short")
    if tag == "i":
        return int(body), end
    if tag == "s":
        return body.decode("utf-8", "surrogatepass"), end
    if tag == "x":
        return body, end
    parts, i = [], start
    while i < end:
        part, i = _decode(d, i)
        parts.append(part)
    if tag == "l":
        return parts, end
    if tag == "t":
        return tuple(parts), end
    if tag == "u":
        return set(parts), end
    if tag == "v":
        return frozenset(parts), end
    if tag == "e":
        return (parts[0], parts[1]), end
    if tag == "m":
        return dict(parts), end
    if tag == "r":
        return {parts[i]: parts[i + 1] for i in range(1, len(parts), 2)}, end
    raise UnsupportedValueError("not canonical")


def digest(value) -> str:
    return hashlib.sha256(encode(value)).hexdigest()


def canonical_equal(a, b) -> bool:
    return encode(a) == encode(b)


def tagged(c: Column, t: T.DataType) -> Column:
    """Canonical text of a column, never null; stays in the JVM."""
    sized = lambda tag, x: F.concat(F.lit(tag), F.length(x).cast("string"), F.lit(":"), x)
    if isinstance(t, T.BooleanType):
        body = F.when(c, F.lit("b1")).otherwise(F.lit("b0"))
    elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        body = sized("i", c.cast("string"))
    elif isinstance(t, T.DecimalType):
        body = sized("d", c.cast("string"))
    elif isinstance(t, (T.FloatType, T.DoubleType)):
        body = sized("f", c.cast("double").cast("string"))
    elif isinstance(t, T.StringType):
        body = sized("s", c)
    elif isinstance(t, T.BinaryType):
        body = sized("x", F.hex(c))
    elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        body = sized("z", c.cast("string"))
    elif isinstance(t, T.ArrayType):
        body = sized("l", F.array_join(F.transform(c, lambda x: tagged(x, t.elementType)), ""))
    elif isinstance(t, T.MapType):
        entry = lambda e: F.concat(tagged(e["key"], t.keyType), tagged(e["value"], t.valueType))
        parts = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(F.sha2(entry(e), 256).alias("d"), entry(e).alias("t"))))
        body = sized("m", F.array_join(F.transform(parts, lambda p: p["t"]), ""))
    elif isinstance(t, T.StructType):
        body = sized("r", F.concat(F.lit(""), *[F.concat(F.lit(f"{f.name}="), tagged(c[f.name], f.dataType)) for f in t.fields]))
    else:
        raise UnsupportedValueError(f"no canonical form for {t.simpleString()}")
    return F.coalesce(body, F.lit("n"))


def row_digest(df, columns: list[str] | None = None) -> Column:
    """SHA-256 over the named columns of df (default: all), by position."""
    names = df.columns if columns is None else columns
    return F.sha2(F.concat(F.lit("T1;"), *[tagged(F.col(f"`{n}`"), df.schema[n].dataType) for n in names]), 256)
