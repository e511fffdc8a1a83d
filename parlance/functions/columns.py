"""Scalar functions as Column expressions; all stay on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import patterns as P


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+\z", "")


def normalize_key(x: Column) -> Column:
    return F.lower(trimmed(F.coalesce(x, F.lit(""))))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) < 1e-9, 0.0).otherwise(a / b)


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def words(x: Column) -> Column:
    """ASCII letters and digits, lower case; all else parts them."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.char_length(x) / 4)).cast("long")


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, "[^a-zA-Z0-9._-]", "_")


def file_stamp(x: Column) -> Column:
    return F.regexp_replace(x, "[:.]", "-")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"[\\/]+\z", ""), r"[\\/]"), -1)


def classified(key: Column) -> Column:
    """What a key says of its value: placeholder, category and id, null if it is not sensitive. Patterns match anywhere in the key."""
    out = F.when(F.lower(key).isin(*P.STRUCTURAL), F.lit(None).cast("struct<placeholder:string,category:string,name:string>"))
    for pattern, *said in P.KEYS:
        out = out.when(key.rlike("(?i)" + pattern), hit(*map(F.lit, said)))
    return out


def hit(placeholder: Column, category: Column, name: Column) -> Column:
    return F.struct(placeholder.alias("placeholder"), category.alias("category"), name.alias("name"))


def classify(key: Column, part: int = 0) -> Column:
    """The placeholder (part 0), category (1) or id (2) of a key, null if it is not sensitive."""
    return classified(key)[("placeholder", "category", "name")[part]]


def tally(names: Column) -> Column:
    """How often each name occurs, as a map in the order of names."""
    keys = F.array_sort(F.array_distinct(names))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(names, lambda n: n == k)).cast("long")))
