"""Paths into JSON: parse, check, project, extract."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = re.compile(r"\.?([^.\[\]]+)|\[(-?\d+)\]")


class PathError(ValueError):
    pass


def parse(path: str) -> list[str | int]:
    """a.b[0].c as its segments; anything left over is an error."""
    out: list[str | int] = []
    at = 0
    while at < len(path):
        m = SEGMENT.match(path, at)
        if not m or (m[1] is not None and at and path[at] != "."):
            raise PathError(f"{path!r} isn't a path at {at}")
        out.append(m[1] if m[1] is not None else int(m[2]))
        at = m.end()
    if not out:
        raise PathError("empty path")
    return out


def check(path: str, records: bool = False) -> list[str | int]:
    """A negative index may only come first, and only where records have an end to count from."""
    held = parse(path)
    for i, x in enumerate(held):
        if isinstance(x, int) and x < 0 and not (records and i == 0):
            raise PathError("a negative index can only pick a record")
    return held


def json_path(path: str) -> str:
    return "$" + "".join(f"[{x}]" if isinstance(x, int) else f"['{x}']" for x in check(path))


def get(doc: Column | str, path: str, kind: str = "string") -> Column:
    """The value at a path of a VARIANT; null where there is none."""
    return F.try_variant_get(doc, json_path(path), kind)


def cell(doc: Column | str, path: str) -> Column:
    """As a cell: nothing where missing, null for a JSON null, JSON for containers."""
    at = F.try_variant_get(doc, json_path(path), "variant")
    return F.when(at.isNull(), "").when(F.is_variant_null(at), "null").otherwise(F.coalesce(F.try_variant_get(at, "$", "string"), F.to_json(at)))


def select(df: DataFrame, column: str, paths: list[str], keep: list[str] = ()) -> DataFrame:
    """Columns named by their paths, in order; the text is parsed once a row."""
    parsed = df.select(*keep, F.try_parse_json(F.col(column)).alias("__doc"))
    return parsed.select(*keep, *(get("__doc", p).alias(p) for p in paths))


def subtree(df: DataFrame, column: str, path: str) -> DataFrame:
    """Only the part at a path, as text, for profiling it by itself."""
    return df.withColumn(column, F.get_json_object(column, json_path(path)))


def raw(doc: Column | str, path: str) -> Column:
    """Text as it is, other values as JSON."""
    return F.coalesce(F.try_variant_get(doc, json_path(path), "string"), F.to_json(F.try_variant_get(doc, json_path(path), "variant")))


def nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n-th record from the start, or from the end for a negative n."""
    keys = [F.col(c).desc() if n < 0 else F.col(c).asc() for c in order]
    at = -n if n < 0 else n + 1
    first = df.orderBy(*keys).limit(at)
    back = [F.col(c).asc() if n < 0 else F.col(c).desc() for c in order]
    held = first.orderBy(*back).limit(1)
    return held.where(F.lit(at) <= df.select(F.lit(1)).limit(at).count())
