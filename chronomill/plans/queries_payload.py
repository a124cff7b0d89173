"""The query of payloads in three forms: events, whose payloads and columns differ by event."""

from __future__ import annotations

from ..operators import payloads
from .queries import Tables, query

_PAYLOAD = """CASE event_id % 9 WHEN 0 THEN '{"lines": ' || user_id || ', "author": "' || event_type || '"}' WHEN 1 THEN '{"metrics": {"lines": ' || user_id || '}, "author": null}'
WHEN 2 THEN '{"size": {"lines": ' || user_id || '}, "by": {"name": "' || event_type || '"}, "fix": true}' WHEN 3 THEN '{"lines": "12", "fix": "yes"}'
WHEN 4 THEN '{"lines": 1.5, "by": {"name": 7}, "author": "' || event_type || '"}' WHEN 5 THEN '[' || user_id || ']' WHEN 6 THEN 'no json'
WHEN 7 THEN '{"lines": null, "metrics": {"lines": ' || user_id || '}, "fix": false}' END"""
_LINES = "CASE WHEN event_id % 5 <> 0 THEN user_id * 2 END"
_AUTHOR = "CASE WHEN event_id % 7 <> 0 THEN event_type END"

FIELDS = [
    payloads.Field("lines", "long", 0, ("$.size.lines", "$.metrics.lines", "$.lines")),
    payloads.Field("author", "string", "unknown", ("$.by.name", "$.author")),
    payloads.Field("fix", "boolean", False, ("$.fix",)),
]


def _sql(kinds: str, kind: str, *places: str) -> str:
    return ", ".join(f"CASE WHEN json_type(j, '{p}') IN ({kinds}) THEN CAST(j ->> '{p}' AS {kind}) END" for p in places)


@query(f"""WITH p AS (SELECT *, {_PAYLOAD} AS raw FROM events), v AS (SELECT *, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM p)
SELECT event_id, coalesce(CASE WHEN event_id % 3 > 0 THEN {_LINES} END, {_sql("'UBIGINT', 'BIGINT'", 'BIGINT', *FIELDS[0].places)}, 0) AS lines,
coalesce(CASE WHEN event_id % 3 = 2 THEN {_AUTHOR} END, {_sql("'VARCHAR'", 'VARCHAR', *FIELDS[1].places)}, 'unknown') AS author, coalesce({_sql("'BOOLEAN'", 'BOOLEAN', *FIELDS[2].places)}, false) AS fix FROM v""")
def payloads_of_three_schemas(spark, sf_dir):
    """Rows of three tables, the later ones with further columns, whose payloads have three forms, nulls and wrong types."""
    e = Tables(spark, sf_dir).events
    part = lambda k, *more: e.where(f"event_id % 3 = {k}").selectExpr("event_id", f"{_PAYLOAD} AS metrics", *more)
    tables = [part(0), part(1, f"{_LINES} AS lines"), part(2, f"{_LINES} AS lines", f"{_AUTHOR} AS author")]
    return payloads.together(tables, "metrics", FIELDS, ["event_id"])
