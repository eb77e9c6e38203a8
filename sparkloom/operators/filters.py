"""The filter language of vector searches: nested dicts compiled to one Column.

Clauses: {"must": [...]} (all), {"should": [...]} (at least one), {"must_not":
[...]} (none); a dict with a clause ignores its other keys. Conditions:
{"match": {field: value}}, {"match_any": {field: [values]}}, {"range": {field:
{"gt", "gte", "lt", "lte"}}} look at their first field only; any other dict is
an AND of equalities over all its fields. Fields may be dotted paths into
structs. A condition on a null value is null, which a filter takes as no match,
and must_not takes it so too. Comparisons stay bare outside must_not, so that
the scan gets them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compile_filter(spec: dict | None, prefix: str = "") -> Column:
    """The condition of a filter dict; prefix (such as "payload.") goes before every field."""
    if not spec:
        return F.lit(True)
    clauses = []
    if "must" in spec:
        clauses.append(reduce(and_, [compile_filter(x, prefix) for x in spec["must"]], F.lit(True)))
    if "should" in spec:
        clauses.append(reduce(or_, [compile_filter(x, prefix) for x in spec["should"]], F.lit(not spec["should"])))
    if "must_not" in spec:
        clauses.append(~_known(reduce(or_, [compile_filter(x, prefix) for x in spec["must_not"]], F.lit(False))))
    if clauses:
        return reduce(and_, clauses)

    def first(kind: str) -> tuple[Column, object]:
        field, value = next(iter(spec[kind].items()))
        return F.col(prefix + field), value

    if spec.get("match"):
        column, value = first("match")
        return column == F.lit(value)
    if "match_any" in spec and spec["match_any"]:
        column, values = first("match_any")
        return column.isin(list(values)) if values else F.lit(False)
    if spec.get("range"):
        column, bounds = first("range")
        return reduce(and_, [_COMPARE[k](column, F.lit(v)) for k, v in bounds.items() if v is not None], F.lit(True))
    return reduce(and_, [F.col(prefix + k) == F.lit(v) for k, v in spec.items()])
