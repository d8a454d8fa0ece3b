"""Tag filters: a small boolean tree compiled to a Column over a map of strings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Equals:
    key: str
    value: str


@dataclass(frozen=True)
class NotEquals:
    key: str
    value: str


@dataclass(frozen=True)
class In:
    key: str
    values: tuple = ()


@dataclass(frozen=True)
class Exists:
    key: str


@dataclass(frozen=True)
class NotExists:
    key: str


@dataclass(frozen=True)
class And:
    parts: tuple = field(default=())


@dataclass(frozen=True)
class Or:
    parts: tuple = field(default=())


def compile_filter(node, tags: str = "tags", promoted: dict[str, str] | None = None) -> Column:
    """The Column of a filter tree; a null map counts as empty.

    `promoted` names tag keys that are columns of their own, whose predicates
    then reach the Parquet scan.
    """
    promoted = promoted or {}
    get = lambda k: F.col(promoted[k]) if k in promoted else F.try_element_at(F.col(tags), F.lit(k))
    has = lambda k: F.col(promoted[k]).isNotNull() if k in promoted else F.coalesce(F.map_contains_key(tags, k), F.lit(False))
    if isinstance(node, Equals):
        return F.coalesce(get(node.key) == node.value, F.lit(False))
    if isinstance(node, NotEquals):
        return ~get(node.key).eqNullSafe(F.lit(node.value))
    if isinstance(node, In):
        return F.coalesce(get(node.key).isin(*node.values), F.lit(False)) if node.values else F.lit(False)
    if isinstance(node, Exists):
        return has(node.key)
    if isinstance(node, NotExists):
        return ~has(node.key)
    parts = [compile_filter(p, tags, promoted) for p in node.parts]
    if isinstance(node, And):
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def from_clauses(must: dict | None = None, must_not: dict | None = None, should: dict | None = None):
    """A filter of clauses, or None if there is no clause."""
    parts = [Equals(k, v) for k, v in (must or {}).items()] + [NotEquals(k, v) for k, v in (must_not or {}).items()]
    if should:
        parts.append(Or(tuple(Equals(k, v) for k, v in should.items())))
    return And(tuple(parts)) if parts else None
