"""The text kernels as SQL functions.

``register(spark)`` makes ``count_tokens(text)``, ``split_text(text, splitter, size, overlap)``,
``same_json(a, b)``, ``csv_cells(line)`` and ``trim_blanks(text)`` usable in ``spark.sql``.  Null
arguments give null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.functions.jstext import trim
from sedimenta.functions.tokens import counter


def _each(kind: T.DataType, arrow: pa.DataType, function):
    """A vectorised function of columns; rows with a null argument are null."""

    def run(*columns):
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array([None if None in r else function(*r) for r in rows], arrow)

    # the number of arguments is told by the signature
    n = function.__code__.co_argcount
    named = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 4: lambda a, b, c, d: run(a, b, c, d)}[n]
    named.__annotations__ = dict.fromkeys("abcd"[:n], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(named, kind)


def register(spark: SparkSession, tokens: str = "byte_bpe_50k") -> list[str]:
    """Register the functions for this session; returns their names."""
    from sedimenta.operators.chunking import split_text
    from sedimenta.operators.malformed import csv_cells
    from sedimenta.operators.snapshots import same_json

    strings = T.ArrayType(T.StringType())
    functions = {
        "count_tokens": _each(T.IntegerType(), pa.int32(), lambda text: counter(tokens)(text)),
        "split_text": _each(strings, pa.list_(pa.string()), lambda text, splitter, size, overlap: split_text(text, splitter, size, overlap, counter(tokens))),
        "same_json": _each(T.BooleanType(), pa.bool_(), lambda a, b: same_json(a, b)),
        "csv_cells": _each(strings, pa.list_(pa.string()), lambda line: csv_cells(line)),
        "trim_blanks": _each(T.StringType(), pa.string(), lambda text: trim(text)),
    }
    for name, f in functions.items():
        spark.udf.register(name, f)
    return list(functions)
