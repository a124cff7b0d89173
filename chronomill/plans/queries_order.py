"""Queries of the operators that work along an order: scans of large groups, sweeps over spans, pages by place, nearest times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nearest, pages, rollup, tokens
from .queries import Tables, query

_CHANGES = """s AS (SELECT user_id, ts, event_id, event_type <> 'error' AS ok, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE {}),
d AS (SELECT ts, event_id, CASE WHEN ok THEN 1 ELSE 0 END AS a, CASE WHEN ok THEN coalesce(v, 0) ELSE 0 END AS b, user_id FROM s),
l AS (SELECT ts, event_id, a - coalesce(lag(a) OVER w, 0) AS da, b - coalesce(lag(b) OVER w, 0) AS db FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT ts, event_id, CAST(greatest(sum(da) OVER r, 0) AS BIGINT) AS files, CAST(greatest(sum(db) OVER r, 0) AS BIGINT) AS total_v FROM l WINDOW r AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def _one_log(t: Tables):
    return t.events.select(F.lit(0).alias("codebase"), F.col("user_id").alias("path"), "ts", "event_id", (F.col("event_type") != "error").alias("exists"), F.round(F.col("value") * 100).cast("long").alias("v"))


@query(f"WITH {_CHANGES.format('TRUE')} SELECT event_id, files, total_v FROM t")
def hot_codebase_timeline(spark, sf_dir):
    """Totals at all versions of one codebase that has every row."""
    return rollup.version_totals_scanned(_one_log(Tables(spark, sf_dir)), "codebase", "path", ["ts", "event_id"], ["v"]).select("event_id", "files", "total_v")


@query(f"""WITH {_CHANGES.format("event_type <> 'view'")}
SELECT e.event_id, coalesce(last_value(files IGNORE NULLS) OVER w, 0) AS files, coalesce(last_value(total_v IGNORE NULLS) OVER w, 0) AS total_v FROM events e LEFT JOIN t USING (ts, event_id)
WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def hot_codebase_carried(spark, sf_dir):
    """As above, but versions that touch nothing (here: views) have the totals of the version before."""
    log = _one_log(Tables(spark, sf_dir))
    touched = log.join(Tables(spark, sf_dir).events.where("event_type <> 'view'").select("event_id"), "event_id")
    totals = rollup.version_totals_scanned(touched, "codebase", "path", ["ts", "event_id"], ["v"])
    return rollup.carried_to_versions(log.select("codebase", "ts", "event_id"), totals, "codebase", ["ts", "event_id"]).drop("codebase", "ts")


# One file has a third of all tokens and functions; functions are nested (the outer ones hold 4,000 lines) and overlap.
_SWEPT = """f AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 50 END AS file_id, 'f' || o_orderkey AS name, o_orderkey AS f_start, o_orderkey + CASE WHEN o_orderkey % 500 = 0 THEN 4000 ELSE o_custkey % 40 END AS f_end FROM orders),
t AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 50 END AS file_id, l_orderkey * 8 + l_linenumber AS k, l_partkey, l_orderkey AS line, l_orderkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS e FROM lineitem)"""


def _third(column: str):
    return F.when(F.col(column) % 3 == 0, 0).otherwise(F.col(column) % 50)


def _tokens_and_functions(t: Tables):
    k, line = F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_orderkey")
    found = t.lineitem.select(_third("l_suppkey").alias("file_id"), k.alias("token_no"), line.alias("line"), line.alias("start_line"), (line + (F.col("l_linenumber") == 7).cast("int")).alias("end_line"))
    width = F.when(F.col("o_orderkey") % 500 == 0, 4000).otherwise(F.col("o_custkey") % 40)
    return found, t.orders.select(_third("o_custkey").alias("file_id"), F.concat(F.lit("f"), F.col("o_orderkey")).alias("name"), F.col("o_orderkey").alias("start_line"), (F.col("o_orderkey") + width).alias("end_line"))


@query(f"WITH {_SWEPT} SELECT file_id, name AS function, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM t JOIN f USING (file_id) WHERE line BETWEEN f_start AND f_end GROUP BY ALL")
def token_sweep(spark, sf_dir):
    """Tokens of every function, nested ones too, by a sweep along the lines of each file."""
    found = tokens.swept_tokens(*_tokens_and_functions(Tables(spark, sf_dir)))
    return found.groupBy("file_id", "function").agg(F.count(F.lit(1)).alias("n"), F.sum("token_no").alias("s"))


@query(f"""WITH {_SWEPT}, p AS (SELECT *, lag(line, 1, 1) OVER (PARTITION BY file_id ORDER BY k) AS b FROM t)
SELECT file_id, name AS function, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM p JOIN f USING (file_id) WHERE b >= f_start AND e <= f_end GROUP BY ALL""")
def token_sweep_prev(spark, sf_dir):
    """As above; a token counts from where the token before it started."""
    found = tokens.swept_tokens_by_previous(*_tokens_and_functions(Tables(spark, sf_dir)))
    return found.groupBy("file_id", "function").agg(F.count(F.lit(1)).alias("n"), F.sum("token_no").alias("s"))


@query(f"WITH {_SWEPT} SELECT file_id, k AS token_no, arg_max(name, {{'s': f_start, 'e': -f_end, 'n': name}}) AS function FROM t JOIN f USING (file_id) WHERE line BETWEEN f_start AND f_end GROUP BY file_id, k")
def innermost_function(spark, sf_dir):
    """The innermost function of every token that is in any."""
    found, functions = _tokens_and_functions(Tables(spark, sf_dir))
    return tokens.innermost_functions(found.select("file_id", "token_no", "line"), functions).select("file_id", "token_no", "function").distinct()


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS day FROM orders),
n AS (SELECT count(*) // 6 + 1 AS width FROM o), r AS (SELECT *, row_number() OVER (ORDER BY priority DESC NULLS FIRST, day NULLS LAST, o_orderkey) - 1 AS i FROM o)
SELECT o_orderkey, priority, day, CAST(i // width AS INTEGER) AS page FROM r, n""")
def pages_by_place(spark, sf_dir):
    """All rows as six pages, each from the cursor that the one before ends at; orders with nulls and ties. Only the last row of a page reaches the driver."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("day"))
    width, order, down = o.count() // 6 + 1, ["priority", "day", "o_orderkey"], frozenset(["priority"])
    cursor, out = None, None
    for k in range(6):
        page = pages.page_after(o, order, width, cursor, down)
        named = page.drop(pages.TIES).withColumn("page", F.lit(k))
        out = named if out is None else out.unionByName(named)
        cursor = pages.end_of(page, order, cursor, down)
    return out


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_shipdate AS moment, l_suppkey % 10 AS g FROM lineitem), p AS (SELECT user_id % 10 AS g, ts - INTERVAL 1 DAY * (event_id % 900) AS t, min(event_id) AS id FROM events GROUP BY ALL),
a AS (SELECT c.*, p.t AS t1, p.id AS id1 FROM c ASOF LEFT JOIN p ON c.g = p.g AND c.moment >= p.t), b AS (SELECT a.*, p.t AS t2, p.id AS id2 FROM a ASOF LEFT JOIN p ON a.g = p.g AND a.moment <= p.t)
SELECT l_orderkey, l_linenumber, moment, CASE WHEN id2 IS NULL OR (id1 IS NOT NULL AND (moment - t1 < t2 - moment OR (moment - t1 = t2 - moment AND id1 <= id2))) THEN id1 ELSE id2 END AS event_id FROM b""")
def nearest_to_every_time(spark, sf_dir):
    """The event nearest in time to every line item, both ways, in groups of a tenth of both tables."""
    t = Tables(spark, sf_dir)
    times = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("moment"), (F.col("l_suppkey") % 10).alias("g"))
    points = t.events.select((F.col("user_id") % 10).alias("g"), (F.col("ts") - F.make_dt_interval((F.col("event_id") % 900).cast("int"))).alias("t"), "event_id")
    return nearest.nearest_points(times, points, ["g"], "moment", "t", "event_id").select("l_orderkey", "l_linenumber", "moment", "event_id")
