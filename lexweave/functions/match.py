"""Citations as structs, and when one matches another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_path, strip

FIELDS = ("article", "clause", "item", "sub_item", "node_id", "regulation_title", "source_file")
TYPE = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"


def citation(**fields: Column | str | None) -> Column:
    """A citation with the given fields; the others are null."""
    made = lambda v: F.lit(None).cast("string") if v is None else F.col(v) if isinstance(v, str) else v
    return F.struct(*[made(fields.get(f)).cast("string").alias(f) for f in FIELDS])


def _wrapped(value: Column, before: str, after: str) -> Column:
    done = value.startswith(before) & value.endswith(after)
    return F.when(done, value).otherwise(F.concat(F.lit(before), value, F.lit(after)))


def normal(field: str, value: Column) -> Column:
    if field == "clause":
        return _wrapped(value, "제", "항")
    if field == "item":
        return _wrapped(value, "제", "호")
    if field == "sub_item":
        return _wrapped(value, "", "목")
    return canonical_path(value) if field == "source_file" else strip(value)


def matches(gold: Column, found: Column, empty_is_null: bool = False) -> Column:
    """Whether found lies under the anchor gold: the same node, or equal in all fields that gold has."""
    get = lambda x, f: F.nullif(x[f], F.lit("")) if empty_is_null else x[f]
    same = F.lit(True)
    for f in FIELDS:
        if f != "node_id":
            same = same & (get(gold, f).isNull() | F.coalesce(normal(f, get(gold, f)) == normal(f, get(found, f)), F.lit(False)))
    node = get(gold, "node_id")
    return F.when(node.isNotNull(), F.coalesce(node == get(found, "node_id"), F.lit(False))).otherwise(same)


def any_match(gold: Column, found: Column, empty_is_null: bool = False) -> Column:
    return F.exists(gold, lambda g: F.exists(found, lambda c: matches(g, c, empty_is_null)))


def supported(cites: Column, evidence: Column) -> Column:
    """The citations that some evidence's citation bears out."""
    return F.filter(cites, lambda c: F.exists(evidence, lambda e: matches(c, e["citation"])))


def deduplicated(cites: Column) -> Column:
    """The first of citations with equal fields, in order."""
    return F.array_distinct(cites)
