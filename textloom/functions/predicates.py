"""The thirteen metadata predicates.

``field`` is the metadata value of a row and ``kind`` says what it is: ``text`` (a map entry or string
column, null when the key is missing), ``array`` (of strings) or ``native`` (a promoted number, date or
boolean column, compared as such so that the comparison reaches the scan).
How each operator treats missing keys and numbers is this library's own definition:

- complements (``!=``, ``nin``) match rows where the key is missing, the others never do;
- orderings compare numbers when the filter value is a number (text that is no number never matches)
  and compare strings otherwise;
- equality and membership compare text;
- ``any`` / ``all`` / ``contains`` work on array fields, and on a scalar field as a one-element array
  (``contains`` on a scalar is a case-sensitive substring test).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _values(values: Any) -> list[Any]:
    if isinstance(values, (str, bytes)) or not hasattr(values, "__iter__"):
        return [values]
    return list(values)


def _literal_array(values: Any) -> Column:
    return F.array(*[F.lit(_text(v)) for v in _values(values)]).cast("array<string>")


def _ordered(compare: Callable[[Column, Column], Column]) -> Callable[[Column, Any, str], Column]:
    def build(field: Column, value: Any, kind: str) -> Column:
        if kind == "native":
            return compare(field, F.lit(value))
        if is_number(value):
            return compare(field.try_cast("double"), F.lit(float(value)))
        return compare(field, F.lit(_text(value)))

    return build


def _constant(value: Any, kind: str) -> Column:
    return F.lit(value) if kind == "native" else F.lit(_text(value))


def _member(field: Column, value: Any, kind: str) -> Column:
    constants = [_constant(v, kind) for v in _values(value)]
    return field.isin(*constants) if constants else F.lit(False)


def _eq(field: Column, value: Any, kind: str) -> Column:
    return field == _constant(value, kind)


def _ne(field: Column, value: Any, kind: str) -> Column:
    return ~field.eqNullSafe(_constant(value, kind))


def _in(field: Column, value: Any, kind: str) -> Column:
    return _member(field, value, kind)


def _nin(field: Column, value: Any, kind: str) -> Column:
    return field.isNull() | ~_member(field, value, kind)


def _any(field: Column, value: Any, kind: str) -> Column:
    if kind == "array":
        return F.arrays_overlap(field, _literal_array(value))
    return _member(field, value, kind)


def _all(field: Column, value: Any, kind: str) -> Column:
    held = field if kind == "array" else F.array(field.cast("string"))
    return field.isNotNull() & (F.size(F.array_except(_literal_array(value), held)) == 0)


def _text_match(field: Column, value: Any, kind: str) -> Column:
    needle = F.lower(F.lit(_text(value)))
    if kind == "array":
        return F.exists(field, lambda item: F.lower(item).contains(needle))
    return F.lower(field.cast("string")).contains(needle)


def _contains(field: Column, value: Any, kind: str) -> Column:
    if kind == "array":
        return F.array_contains(field, _text(value))
    return field.cast("string").contains(_text(value))


def _is_empty(field: Column, value: Any, kind: str) -> Column:
    if kind == "array":
        return field.isNull() | (F.size(field) == 0)
    return field.isNull() if kind == "native" else field.isNull() | (field == "")


PREDICATES: dict[str, Callable[[Column, Any, str], Column]] = {
    "==": _eq,
    "!=": _ne,
    ">": _ordered(lambda a, b: a > b),
    "<": _ordered(lambda a, b: a < b),
    ">=": _ordered(lambda a, b: a >= b),
    "<=": _ordered(lambda a, b: a <= b),
    "in": _in,
    "nin": _nin,
    "any": _any,
    "all": _all,
    "text_match": _text_match,
    "contains": _contains,
    "is_empty": _is_empty,
}


def predicate(field: Column, op: str, value: Any = None, kind: str = "text") -> Column:
    """One metadata predicate as a boolean Column."""
    if op not in PREDICATES:
        raise ValueError(f"unknown filter operator {op!r}; known: {', '.join(PREDICATES)}")
    return PREDICATES[op](field, value, kind)
