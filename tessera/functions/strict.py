"""Strict JSON: what is wrong with a text, at every depth, and three ways to deal with it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python types of each Spark type; a whole number is a number too, and true is none.
PLAIN = {T.StringType: str, T.BooleanType: bool, T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float)}
RANGE = {T.IntegerType: 1 << 31, T.LongType: 1 << 63}


class _Pairs(list):
    """An object's members in order, repeated keys too."""


def _no_constant(name: str):
    raise ValueError(name)


def _check(value, kind: T.DataType, where: str, optional: frozenset[str], out: list[str]) -> None:
    if isinstance(kind, T.StructType):
        if not isinstance(value, _Pairs):
            out.append(f"{where or '$'}: no object")
            return
        keys, fields = [k for k, _ in value], {f.name: f for f in kind}
        path = lambda k: f"{where}.{k}" if where else k
        out += [f"{path(k)}: repeated" for k in dict.fromkeys(k for k in keys if keys.count(k) > 1)]
        out += [f"{path(k)}: unknown" for k in dict.fromkeys(keys) if k not in fields]
        out += [f"{path(k)}: missing" for k in fields if k not in keys and path(k) not in optional]
        for k, v in value:
            if k in fields and not (v is None and path(k) in optional):
                _check(v, fields[k].dataType, path(k), optional, out)
    elif isinstance(kind, T.ArrayType):
        if type(value) is not list:
            out.append(f"{where}: no array")
            return
        for i, v in enumerate(value):
            _check(v, kind.elementType, f"{where}[{i}]", optional, out)
    elif isinstance(kind, T.MapType):
        if not isinstance(value, _Pairs):
            out.append(f"{where}: no object")
            return
        keys = [k for k, _ in value]
        out += [f"{where}.{k}: repeated" for k in dict.fromkeys(k for k in keys if keys.count(k) > 1)]
        for k, v in value:
            _check(v, kind.valueType, f"{where}.{k}", optional, out)
    else:
        wanted = PLAIN[type(kind)]
        if not isinstance(value, wanted) or isinstance(value, bool) != (wanted is bool):
            out.append(f"{where}: no {kind.simpleString()}")
        elif type(kind) in RANGE and not -RANGE[type(kind)] <= value < RANGE[type(kind)]:
            out.append(f"{where}: out of range")


def problems_of(text: str | None, kind: T.StructType, optional: frozenset[str] = frozenset()) -> list[str]:
    """What is wrong, in the order of the text; nothing if it is right. One object and white space around it is all that may be there."""
    if text is None:
        return ["null"]
    try:
        value = json.loads(text, object_pairs_hook=_Pairs, parse_constant=_no_constant)
    except RecursionError:
        return ["too deep"]
    except ValueError:
        return ["no JSON"]
    out: list[str] = []
    _check(value, kind, "", optional, out)
    return out


def problems(text: Column, schema: str, optional: tuple[str, ...] = ()) -> Column:
    """array<string>: repeated, unknown and missing keys and wrong types at every depth; empty if text is what the schema says.

    optional names paths (a.b) that may be absent or null. A null text has the problem 'null'.
    """
    kind, spared = T.StructType.fromDDL(schema), frozenset(optional)

    @F.pandas_udf("array<string>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            yield pd.Series([problems_of(t, kind, spared) for t in x])

    return find(text)


def parse(rows: DataFrame, text: str, schema: str, name: str, wrong: str, optional: tuple[str, ...] = (), also: Column | None = None) -> DataFrame:
    """rows with name, the typed value of the JSON in text. wrong says what becomes of a text that is not strictly right:

    'error': the run fails and names the problem; 'skip': the row goes; 'degrade': the value is null, and name_problems says why.
    also may add a problem of its own (a text) to values that the schema admits; it may use name.
    """
    found = rows.withColumn("_problems", problems(F.col(text), schema, optional)).withColumn(name, F.when(F.size("_problems") == 0, F.from_json(F.col(text), schema)))
    if also is not None:
        own = F.when(F.size("_problems") == 0, also)
        found = found.withColumn("_problems", F.when(own.isNotNull(), F.array(own)).otherwise(F.col("_problems")))
        found = found.withColumn(name, F.when(F.size("_problems") == 0, F.col(name)))
    bad = F.size("_problems") > 0
    if wrong == "skip":
        return found.filter(~bad).drop("_problems")
    if wrong == "degrade":
        return found.withColumnRenamed("_problems", f"{name}_problems")
    if wrong != "error":
        raise ValueError(f"error, skip or degrade, not {wrong}")
    failed = F.raise_error(F.concat(F.lit("not strictly right: "), F.array_join("_problems", "; "))).cast(T.StructType.fromDDL(schema))
    return found.withColumn(name, F.when(bad, failed).otherwise(F.col(name))).drop("_problems")


EXTRACTION = "dispositivos array<struct<texto: string>>, ncm array<string>, temas array<string>"


def extraction(rows: DataFrame, text: str, wrong: str, name: str = "extraction") -> DataFrame:
    """rows with the typed extraction of a model's answer in text: a code fence is taken off, the schema holds strictly, and no provision may be blank."""
    from tessera.operators.catalog import unfenced

    blank = F.exists(F.col(name)["dispositivos"], lambda x: F.regexp_replace(x["texto"], r"\s", "") == "")
    return parse(rows.withColumn("_answer", unfenced(F.col(text))), "_answer", EXTRACTION, name, wrong, also=F.when(blank, "a blank provision")).drop("_answer")
