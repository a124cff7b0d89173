"""The query of definitions by scope: orders bind names in 50 files, line items use them; a third of both is one file's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scopes
from .queries import Tables, query

_FILE = "CASE WHEN {0} % 3 = 0 THEN 0 ELSE {0} % 50 END"
_BINDINGS = f"""SELECT {_FILE.format('o_custkey')} AS file_id, CASE WHEN o_orderkey % 16 = 4 THEN 'm' || o_custkey % 5 ELSE 'n' || o_orderkey % 40 END AS name, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 10 * 100 + o_orderkey % 3 * 10 END AS scope_start,
CASE WHEN o_orderkey % 4 = 0 THEN 1000 ELSE o_orderkey % 10 * 100 + 99 - o_orderkey % 3 * 10 END AS scope_end, o_orderkey AS place, CASE WHEN o_orderkey % 16 = 4 OR (o_orderkey % 4 = 0 AND o_custkey % 2 = 0) THEN (o_custkey * 7 + o_orderkey) % 60 END AS target_file,
CASE WHEN o_orderkey % 16 <> 4 AND o_orderkey % 4 = 0 AND o_custkey % 2 = 0 THEN 'n' || (o_orderkey + o_custkey) % 41 END AS target_name FROM orders"""
_USES = f"""SELECT {_FILE.format('l_suppkey')} AS file_id, 'n' || l_partkey % 44 AS name, CASE WHEN l_linenumber = 3 THEN 'm' || l_partkey % 6 END AS qualifier, l_orderkey % 1001 AS place FROM lineitem"""


@query(f"""WITH RECURSIVE b AS ({_BINDINGS}), u AS (SELECT *, row_number() OVER () AS i FROM ({_USES}) AS x),
w AS (SELECT file_id, min(scope_start) AS s, max(scope_end) AS e FROM b GROUP BY file_id),
x AS (SELECT file_id, name, max({{'place': place, 'f': target_file, 'n': target_name}}) AS t FROM b JOIN w USING (file_id) WHERE scope_start = s AND scope_end = e GROUP BY file_id, name),
c(file_id, name, at_file, at_name, steps) AS (SELECT file_id, name, file_id, name, 0 FROM x UNION ALL SELECT c.file_id, c.name, x.t.f, x.t.n, steps + 1 FROM c JOIN x ON x.file_id = at_file AND x.name = at_name WHERE x.t.n IS NOT NULL AND steps < (SELECT count(*) FROM x)),
d AS (SELECT c.file_id, c.name, x.file_id AS def_file, x.t.place AS def_place FROM c JOIN x ON x.file_id = at_file AND x.name = at_name WHERE x.t.f IS NULL),
o AS (SELECT i, max({{'s': scope_start, 'e': -scope_end, 'p': b.place, 'f': target_file, 'n': target_name}}) AS t FROM u JOIN b ON b.file_id = u.file_id AND b.name = coalesce(qualifier, u.name) AND u.place BETWEEN scope_start AND scope_end GROUP BY i),
r AS (SELECT u.*, o.t, CASE WHEN qualifier IS NULL THEN o.t.n WHEN o.t.n IS NULL THEN u.name END AS next FROM u LEFT JOIN o USING (i)),
f AS (SELECT r.*, CASE WHEN qualifier IS NULL AND t IS NOT NULL AND t.f IS NULL THEN r.file_id ELSE d.def_file END AS def_file, CASE WHEN qualifier IS NULL AND t IS NOT NULL AND t.f IS NULL THEN t.p ELSE d.def_place END AS def_place FROM r LEFT JOIN d ON d.file_id = t.f AND d.name = next)
SELECT file_id, name, qualifier, place, def_file, def_place, count(*) AS n FROM f GROUP BY ALL""")
def definitions_by_scope(spark, sf_dir):
    """What every use of a name means: shadowed, qualified and re-exported names, over files that import from each other."""
    t = Tables(spark, sf_dir)
    t.orders.createOrReplaceTempView("chronomill_orders")
    t.lineitem.createOrReplaceTempView("chronomill_lineitem")
    bindings = spark.sql(_BINDINGS.replace("FROM orders", "FROM chronomill_orders"))
    uses = spark.sql(_USES.replace("FROM lineitem", "FROM chronomill_lineitem"))
    found = scopes.resolve(uses, bindings)
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n"))
