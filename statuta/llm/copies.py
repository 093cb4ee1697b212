"""Problem 7: records that are equal but for formatting, by hashing nested records from the leaves up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm.labels import letters_digits
from statuta.runtime import join_groups, kept

#: Between a tag, a key and a value of the structural form; no normalised text holds it.
MARK = "\x1f"


def _leaf(c: Column) -> Column:
    return F.coalesce(letters_digits(c.cast("string")), F.lit(""))


def structural(c: Column, kind: T.DataType, ordered: bool = True) -> Column:
    """A string equal for two values that differ only in formatting and field order.

    Leaves are normalised; the fields of a struct and the entries of a map are sorted by normalised name; arrays keep
    their order unless `ordered` is false. Null equals empty.
    """
    if isinstance(kind, T.StructType):
        parts = F.array(*[F.concat(F.lit(letters_digits_py(f.name) + MARK), structural(c[f.name], f.dataType, ordered)) for f in kind.fields])
        return F.concat(F.lit("{"), F.array_join(F.array_sort(parts), MARK), F.lit("}"))
    if isinstance(kind, T.MapType):
        parts = F.transform(F.map_entries(F.coalesce(c, F.from_json(F.lit("{}"), T.MapType(kind.keyType, kind.valueType)))), lambda e: F.concat(_leaf(e["key"]), F.lit(MARK), structural(e["value"], kind.valueType, ordered)))
        return F.concat(F.lit("{"), F.array_join(F.array_sort(parts), MARK), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        parts = F.transform(c, lambda x: structural(x, kind.elementType, ordered))
        parts = parts if ordered else F.array_sort(parts)
        return F.concat(F.lit("["), F.coalesce(F.array_join(parts, MARK), F.lit("")), F.lit("]"))
    return _leaf(c)


def letters_digits_py(s: str) -> str:
    return "".join(ch for ch in s.lower() if ch.isalpha() or ch.isdecimal())


def digest(c: Column, kind: T.DataType, ordered: bool = True) -> Column:
    """SHA-256 of a value from the bottom up: a node's digest is that of its children's, sorted where order is free."""
    h = lambda x: F.sha2(x, 256)
    if isinstance(kind, T.StructType):
        kids = F.array(*[h(F.concat(F.lit(h_name(f.name)), digest(c[f.name], f.dataType, ordered))) for f in kind.fields])
        return h(F.concat(F.lit("{"), F.array_join(F.array_sort(kids), "")))
    if isinstance(kind, T.MapType):
        kids = F.transform(F.map_entries(F.coalesce(c, F.from_json(F.lit("{}"), T.MapType(kind.keyType, kind.valueType)))), lambda e: h(F.concat(_leaf(e["key"]), F.lit(MARK), digest(e["value"], kind.valueType, ordered))))
        return h(F.concat(F.lit("{"), F.array_join(F.array_sort(kids), "")))
    if isinstance(kind, T.ArrayType):
        kids = F.transform(c, lambda x: digest(x, kind.elementType, ordered))
        return h(F.concat(F.lit("["), F.coalesce(F.array_join(kids if ordered else F.array_sort(kids), ""), F.lit(""))))
    return h(_leaf(c))


def h_name(name: str) -> str:
    return letters_digits_py(name) + MARK


def collapse(df: DataFrame, key: str, value: str, ordered: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with their root digest and structural form, one record per group of equal values).

    Groups are `root`, `form`, `keep_id` (the smallest key) and `copies`. Rows are grouped by the 32 bytes of the root
    digest; only the rows of groups with several are then compared by their whole form, which is null for a value that
    stands alone, so values whose digests collided are told apart. Values without any letter or digit are in no group.
    Both counts are pre-aggregated, so a value with a third of all rows is no hot key. Leaves are normalised once.
    """
    kind = df.schema[value].dataType
    form = structural(F.col(value), kind, ordered)
    if isinstance(kind, (T.MapType, T.StructType, T.ArrayType)):
        filled = F.regexp_replace(_values(F.col(value), kind), r"[^\p{L}\p{Nd}]", "") != ""
    else:
        filled = form != ""
    rows = kept(df.where(filled).select(F.col(key).alias("id"), F.unhex(digest(F.col(value), kind, ordered)).alias("root"), form.alias("form")))
    by_root = kept(rows.groupBy("root").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")))
    several = by_root.where("copies > 1").select("root", "copies")
    equal = join_groups(rows, several, ["root"], "copies", rows.count()).groupBy("root", "form").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    alone = by_root.where("copies = 1").select("root", F.lit(None).cast("string").alias("form"), "keep_id", "copies")
    return rows, kept(equal.unionByName(alone))


def _values(c: Column, kind: T.DataType) -> Column:
    """The leaves of a nested value as one text, null as ''."""
    if isinstance(kind, T.StructType):
        return F.concat(*[_values(c[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return F.coalesce(F.array_join(F.transform(F.map_values(c), lambda x: _values(x, kind.valueType)), ""), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(c, lambda x: _values(x, kind.elementType)), ""), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def copies(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(keep_id, copy_id) of every row that isn't the one its group keeps.

    A row meets its groups by the root digest and stays if its form is the group's.
    """
    several = groups.where("copies > 1").withColumnRenamed("form", "whole")
    j = join_groups(rows, several, ["root"], "copies", rows.count())
    return j.where("form = whole and id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def payload_fields(candidates: DataFrame, fields: tuple[str, ...] = ("query", "query_type", "difficulty", "persona", "source_article")) -> DataFrame:
    """record_id and the payload's fields as a struct, whatever the spelling of its keys; null where it isn't JSON.

    Where two keys come down to one field, the one last in the object's text counts, as it does for most readers.
    """
    m = F.from_json("payload", "map<string,string>")
    entries = F.transform(F.map_entries(m), lambda e: F.struct(letters_digits(e["key"]).alias("k"), e["value"].alias("v")))

    def pick(f: str) -> Column:
        found = F.filter(F.col("__e"), lambda e: e["k"] == letters_digits_py(f))
        return F.try_element_at(F.transform(found, lambda e: e["v"]), F.lit(-1)).alias(f)

    return candidates.select("record_id", entries.alias("__e")).select("record_id", F.struct(*[pick(f) for f in fields]).alias("fields"))
