"""Array helpers shared by the text and URL expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def constant(value, schema: str) -> Column:
    """A nested constant as one folded literal; the plan stays small for long lists."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def literal_array(values) -> Column:
    return constant(list(values), "array<string>")


def in_list(value: Column, values) -> Column:
    """Membership in a parameter list."""
    return F.array_contains(literal_array(values), value)


def let(value: Column, body) -> Column:
    """Bind a value once and use it many times inside one expression.

    Without it every use repeats the whole sub-expression in the plan and at run time.
    """
    return F.transform(F.array(value), body).getItem(0)


def first_by_key(arr: Column, key) -> Column:
    """Elements whose key has not occurred earlier in the array, in array order.

    Sorting by (key, position) keeps this n log n inside the row, with no shuffle.
    """
    tagged = F.array_sort(
        F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("v")))
    )

    def firsts(rows):
        previous = F.concat(
            F.array(F.lit(None).cast("string")), F.transform(rows, lambda t: t["k"])
        )
        pairs = F.zip_with(rows, previous, lambda t, p: F.struct(t.alias("t"), p.alias("p")))
        kept = F.filter(pairs, lambda z: z["t"].isNotNull() & ~z["t"]["k"].eqNullSafe(z["p"]))
        return F.array_sort(F.transform(kept, lambda z: F.struct(z["t"]["i"], z["t"]["v"])))

    return F.transform(let(tagged, firsts), lambda s: s["v"])


def contained_words(text: Column, words) -> Column:
    """Sorted list of the words contained in an already lower-cased text; a null text contains none.

    The search for each word runs in Arrow batches, several times quicker than ``contains`` on the JVM, whose
    cost for a long list was half of the rule layer's.  Not for use inside a lambda.
    """
    words = sorted(set(words))

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [w for w in words if w in t])

    return found(text)


def any_contained(text: Column, words) -> Column:
    """True where the lower-cased text contains one of the words (short-circuits)."""
    return F.exists(literal_array(words), lambda w: text.contains(w))


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def round6(value: Column) -> Column:
    return py_round(value, 6)


def weighted_lookup(key: Column, table: dict, default: float) -> Column:
    """Constant lookup as one folded map, so it stays an expression and needs no join."""
    found = F.try_element_at(constant(table, "map<string,double>"), key)
    return F.coalesce(found, F.lit(float(default)))


def text_lookup(key: Column, table: dict) -> Column:
    return F.try_element_at(constant(table, "map<string,string>"), key)


def exploded(df: DataFrame, keys, array_col: str) -> DataFrame:
    """(keys, pos, item) rows of an array column.

    The outer form is used on purpose: for the inner one the optimizer infers a filter on
    the array, which would evaluate a computed array once more per row.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    long = df.select(*keys, F.posexplode_outer(array_col).alias("pos", "item"))
    return long.where(F.col("pos").isNotNull())


def py_round(value: Column, digits: int) -> Column:
    """Round on the exact binary value, ties to even.

    Spark's own rounding works on the shortest decimal form of a double, which differs only
    where that form looks like a tie.  There, the double is scaled by a power of two to an
    integer and compared with the midpoint in exact decimal arithmetic.
    """
    def rounded(v):
        scaled = v * float(10 ** digits)
        tie = F.abs(scaled - F.floor(scaled) - 0.5) <= 1e-6
        return F.when(tie, _round_binary(v, digits)).otherwise(F.bround(v, digits))

    return let(value, rounded)


def _round_binary(v: Column, digits: int) -> Column:
    bits = F.when(v < 1.9, 62).when(v < 1900, 52).otherwise(20)
    unit = F.pow(F.lit(2.0), bits)
    whole = unit.cast("long").cast("decimal(19,0)")
    target = (v * unit).cast("long").cast("decimal(19,0)") * F.lit(10 ** digits).cast("decimal(7,0)")
    q = F.floor(v * float(10 ** digits)).cast("decimal(18,0)")
    twice = (target - q * whole) * F.lit(2).cast("decimal(1,0)")
    up = (twice > whole) | ((twice == whole) & (q % 2 == 1))
    return (q + up.cast("int")).cast("double") / float(10 ** digits)
