"""Feature groups as an extension point: a name, the columns it makes, and how.

A group's function takes the candidates (with their context) and the records and
returns (e, src, r) and its columns, one row a candidate.  Registered groups can be
named in a run; the country may not be a column of any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from quillon.operators import features as X

KEYS = X.KEYS


@dataclass(frozen=True)
class FeatureGroup:
    name: str
    columns: tuple[str, ...]
    compute: Callable[[DataFrame, DataFrame], DataFrame]


GROUPS: dict[str, FeatureGroup] = {}


def register(name: str, columns: Iterable[str]):
    """Decorator that registers a function (pairs, records) -> frame as a group."""
    columns = tuple(columns)
    if "country" in columns:
        raise ValueError("country is not a feature")

    def add(compute: Callable[[DataFrame, DataFrame], DataFrame]):
        GROUPS[name] = FeatureGroup(name, columns, compute)
        return compute

    return add


def with_groups(pairs: DataFrame, records: DataFrame, names: Iterable[str]) -> DataFrame:
    """The candidates with the columns of the named groups, in their order."""
    made = [GROUPS[n].compute(pairs, records).select(*KEYS, *GROUPS[n].columns) for n in names]
    return reduce(lambda a, b: a.join(b, KEYS), made, pairs)


@register("kinds", [f"k_{k}" for k in X.rules.KIND_BITS])
def _kinds(pairs: DataFrame, records: DataFrame) -> DataFrame:
    return X.kind_flags(pairs)


@register("consistency", ["r_c_tset", "r_a_tset", "r_hn_eq", "has_ref"])
def _consistency(pairs: DataFrame, records: DataFrame) -> DataFrame:
    return X.reference_features(pairs, records)


@register("equality", ["core_eq", "cc_eq"])
def _equality(pairs: DataFrame, records: DataFrame) -> DataFrame:
    return X.equality_flags(X.attach(pairs.select(*KEYS), records, ["core", "cc"]))


@register("look-alike", "u_n1 u_n2 u_eq u_conf hs_1 hs_2 hs_eq hs_conf hs_one h_pre x1_in_a2 x2_in_a1 h_lev x1_df x2_df".split())
def _lookalike(pairs: DataFrame, records: DataFrame) -> DataFrame:
    return X.lookalike_features(X.attach(pairs.select(*KEYS), records, ["units", "hsuf", "hmain", "ct", "at", "ctdf"]))
