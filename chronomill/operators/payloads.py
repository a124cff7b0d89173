"""Payloads whose schema changes: rows of older and newer form read together, as VARIANT.

A field names where its value lies in each form, newest first. The first place that holds a value of the field's kind
counts; a missing place, a JSON null and a value of another kind are passed over, and the default stands if none is left.
A text that is no JSON, a null and a JSON value that is no object have no fields.

Defined cases: whole numbers beyond 64 bits and numbers with a point are no ``long``; any number is a ``double``; numbers
and booleans are no ``string``. Columns beside the payload are kept; of an empty table nothing is read. All of it is
column work of a scan: no row moves.
"""

from __future__ import annotations

from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the schema of a value of each kind reads.
KINDS = {"long": "BIGINT", "double": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)", "string": "STRING", "boolean": "BOOLEAN"}


class Field(NamedTuple):
    name: str
    kind: str  # one of KINDS
    default: Any
    places: tuple[str, ...]  # JSON paths, newest form first


def parsed(text: Column) -> Column:
    """A JSON text as VARIANT, null where it is none."""
    return F.try_parse_json(text)


def _found(payload: Column, field: Field) -> list[Column]:
    values = [F.try_variant_get(payload, place, "variant") for place in field.places]
    return [F.when(F.schema_of_variant(v).rlike(f"^({KINDS[field.kind]})$"), F.try_variant_get(v, "$", field.kind)) for v in values]


def value_of(payload: Column, field: Field) -> Column:
    return F.coalesce(*_found(payload, field), F.lit(field.default).cast(field.kind))


def evolved(rows: DataFrame, payload: str, fields: list[Field]) -> DataFrame:
    """rows with all fields as columns, whatever form a row has.

    A column of the field's name that the table has already counts first, where it isn't null; then the payload (a VARIANT
    or a JSON text), then the default.
    """
    is_text = rows.schema[payload].dataType.simpleString() == "string"
    held = parsed(F.col(payload)) if is_text else F.col(payload)
    own = lambda f: [F.col(f.name).cast(f.kind)] if f.name in rows.columns else []
    return rows.withColumns({f.name: F.coalesce(*own(f), value_of(held, f)) for f in fields})


def together(tables: list[DataFrame], payload: str, fields: list[Field], columns: list[str]) -> DataFrame:
    """The rows of tables of several schemas as one: ``columns`` that all have, then the fields."""
    names = [*columns, *[f.name for f in fields if f.name not in columns]]
    return reduce(DataFrame.unionByName, [evolved(t, payload, fields).select(names) for t in tables])
