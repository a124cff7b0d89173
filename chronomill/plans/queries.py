"""Every operator as a query over the driver's tables, which stand in for code history, each with its SQL.

events are path states (user_id a path, event_id a version, error a deletion), documents are sources, pages are paths,
parts are functions, nation to lineitem the hierarchy of codebase to hunk, conversations commits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, halstead, ignore, keys, text, trigrams
from ..operators import asof, calls, charts, diffs, listing, merge, rollup, search, tokens
from ..shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _history(t: Tables):
    versions = t.events.select(F.col("event_id").alias("id"), F.lit(0).alias("codebase_id"), F.col("ts").alias("created_at"))
    states = t.events.select(F.col("event_id").alias("id"), F.lit(0).alias("codebase_id"), F.col("event_id").alias("version_id"), F.col("user_id").alias("path"), F.col("event_type").alias("status"), (F.col("event_type") != "error").alias("exists"), F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("file_id"))
    middle = (t.events.agg(F.max("event_id")).first()[0] or 0) // 2
    return states, versions, middle


ASOF = """b AS (SELECT ts, event_id FROM events WHERE event_id = (SELECT max(event_id) // 2 FROM events)),
r AS (SELECT user_id AS path, e.event_id AS version_id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY e.ts DESC, e.event_id DESC) AS rank
      FROM events e, b WHERE e.ts < b.ts OR (e.ts = b.ts AND e.event_id <= b.event_id)),
c AS (SELECT path, version_id, status FROM r WHERE rank = 1 AND status <> 'error')"""


@query(f"WITH {ASOF} SELECT path, version_id, status FROM c")
def asof_files(spark, sf_dir):
    return asof.asof_files(*_history(Tables(spark, sf_dir))).select("path", "version_id", "status")


FUNCTIONS = """f AS (SELECT o_orderkey AS function_id, path, c_mktsegment AS language, o_orderpriority AS name, CAST(o_orderkey % 100 AS INTEGER) AS start_line
      FROM c JOIN customer ON c_custkey = path AND path % 7 <> 0 JOIN orders ON o_custkey = c_custkey)"""


def _functions(t: Tables):
    files = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("language"))
    functions = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 100).cast("int").alias("start_line"), (F.col("o_orderkey") % 100 + 5).cast("int").alias("end_line"))
    return files, functions


@query(f"WITH {ASOF}, {FUNCTIONS} SELECT * FROM f")
def asof_functions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    states, versions, at = _history(t)
    return asof.asof_functions(states, versions, *_functions(t), at).select("function_id", "path", "language", "name", "start_line")


@query(f"WITH {ASOF}, {FUNCTIONS} SELECT * FROM f WHERE path = 11 AND name = '1-URGENT'")
def current_functions_filtered(spark, sf_dir):
    t = Tables(spark, sf_dir)
    states, versions, at = _history(t)
    return asof.asof_functions(states, versions, *_functions(t), at, 0, 11, "1-URGENT").select("function_id", "path", "language", "name", "start_line")


@query("SELECT o_orderkey AS function_id, c_custkey AS path, o_orderpriority AS name FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3")
def functions_changed_in_version(spark, sf_dir):
    t = Tables(spark, sf_dir)
    files = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("version_id"), F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("language"))
    return asof.functions_changed_in(files, _functions(t)[1], 3).select(F.col("id").alias("function_id"), "path", "name")


@query("""WITH s AS (SELECT user_id % 5 AS codebase, user_id, ts, event_id, event_type <> 'error' AS ok, CAST(round(value * 100) AS BIGINT) AS v FROM events),
d AS (SELECT codebase, ts, event_id, CASE WHEN ok THEN 1 ELSE 0 END AS a, CASE WHEN ok THEN coalesce(v, 0) ELSE 0 END AS b, user_id FROM s),
l AS (SELECT codebase, ts, event_id, a - coalesce(lag(a) OVER w, 0) AS da, b - coalesce(lag(b) OVER w, 0) AS db FROM d WINDOW w AS (PARTITION BY codebase, user_id ORDER BY ts, event_id))
SELECT codebase, event_id, CAST(greatest(sum(da) OVER r, 0) AS BIGINT) AS files, CAST(greatest(sum(db) OVER r, 0) AS BIGINT) AS total_v FROM l
WINDOW r AS (PARTITION BY codebase ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def version_timeline(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    log = e.select((F.col("user_id") % 5).alias("codebase"), F.col("user_id").alias("path"), "ts", "event_id", (F.col("event_type") != "error").alias("exists"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return rollup.version_totals(log, "codebase", "path", ["ts", "event_id"], ["v"]).select("codebase", "event_id", "files", "total_v")


@query("SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS total_n_chars, CAST(sum(n_chars) AS DOUBLE) / count(*) AS mean_n_chars_per_file FROM documents GROUP BY source")
def mean_per_file(spark, sf_dir):
    return rollup.with_means(rollup.totals(Tables(spark, sf_dir).documents, ["source"], ["n_chars"]), ["n_chars"])


@query("""WITH a AS (SELECT lang, count(*) AS files, sum(n_chars) AS n FROM documents GROUP BY lang), b AS (SELECT lang, count(*) AS files, sum(n_chars) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY lang)
SELECT lang, CAST(greatest(a.files - coalesce(b.files, 0), 0) + coalesce(b.files, 0) * 2 AS BIGINT) AS files, CAST(greatest(a.n - coalesce(b.n, 0), 0) + coalesce(b.n, 0) * 2 AS BIGINT) AS total_n_chars FROM a LEFT JOIN b USING (lang)""")
def reconcile_totals(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    old = d.where("doc_id % 3 = 0")
    sums = lambda x: rollup.totals(x, ["lang"], ["n_chars"])
    return rollup.reconcile(sums(d), sums(old), sums(old.union(old)), ["lang"], ["n_chars"])


@query("SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations")
def prev_commit_lag(spark, sf_dir):
    return rollup.previous(Tables(spark, sf_dir).conversations, "conv_id", ["turn"], "role", "previous_role").select("conv_id", "turn", "previous_role")


@query("SELECT o_custkey % 4 AS codebase_id, o_orderkey AS id, o_orderdate AS created_at, lag(o_orderpriority) OVER (PARTITION BY o_custkey % 4 ORDER BY o_orderdate, o_orderkey) AS old_commit_hash FROM orders")
def previous_commit_hash(spark, sf_dir):
    v = Tables(spark, sf_dir).orders.select((F.col("o_custkey") % 4).alias("codebase_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("commit_hash"))
    return diffs.with_previous_commit(v).drop("commit_hash")


@query("SELECT lang AS programming_language, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY n_chars, doc_id) AS ids FROM documents GROUP BY lang")
def group_by_language(spark, sf_dir):
    c = Tables(spark, sf_dir).documents.select(F.col("lang").alias("programming_language"), F.col("n_chars").alias("created_at"), F.col("doc_id").alias("id"))
    return listing.grouped_by_language(c).select("programming_language", F.array_join(F.transform("codebases", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def rows_as_json(spark, sf_dir):
    n = Tables(spark, sf_dir).nation.select("n_nationkey", "n_name")
    return listing.as_json(n, beside=["n_nationkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf_dir):
    return listing.lookup(Tables(spark, sf_dir).customer, c_custkey=42).select("c_custkey", "c_name")


@query("""WITH v AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS committed_at FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY committed_at NULLS LAST, o_orderkey) AS place FROM v""")
def list_versions_nulls_last(spark, sf_dir):
    v = Tables(spark, sf_dir).orders.withColumn("committed_at", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")))
    return v.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*keys.ascending("committed_at", "o_orderkey"))).cast("long").alias("place"))


@query("""WITH h AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS new_path, 'm' AS old_path FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(new_path, old_path) NULLS LAST, turn) AS place FROM h""")
def changes_sorted_coalesce(spark, sf_dir):
    h = Tables(spark, sf_dir).conversations.withColumns({"new_path": F.when(F.col("turn") % 2 == 0, F.col("role")), "old_path": F.lit("m")})
    h = h.withColumns({"old_start_line": F.col("turn"), "new_start_line": F.lit(0)})
    w = Window.partitionBy("conv_id").orderBy(*listing.hunk_order())
    return h.select("conv_id", "turn", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 20")
def paginate_files(spark, sf_dir):
    return listing.page(Tables(spark, sf_dir).orders, ["o_orderdate", "o_orderkey"], 10, 20).select("o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 25 OFFSET 5")
def paginate_functions(spark, sf_dir):
    return listing.page(Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], 25, 5, l_returnflag="R").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT o_orderkey AS id, count(l_orderkey) AS n_hunks, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linestatus, l_linenumber, l_partkey), '') AS hunks
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def diff_with_changes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.orders.select(F.col("o_orderkey").alias("id"))
    c = t.lineitem.select(F.col("l_orderkey").alias("diff_id"), F.col("l_linestatus").alias("new_path"), F.lit(None).cast("string").alias("old_path"), F.col("l_linenumber").alias("old_start_line"), F.col("l_partkey").alias("new_start_line"))
    return listing.diff_with_hunks(d, c).select("id", F.size("hunks").cast("long").alias("n_hunks"), F.array_join(F.transform("hunks", lambda h: h["old_start_line"].cast("string")), ",").alias("hunks"))


@query("SELECT o_orderkey, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7")
def list_diffs_by_codebase(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = t.orders.select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("version_id"), F.col("o_orderdate").alias("created_at"))
    v = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("codebase_id"), F.col("c_acctbal").alias("committed_at"))
    return listing.diffs_of_codebase(d, v, 7).select("o_orderkey", "o_orderdate")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_missing_diff(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return diffs.without(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("SELECT doc_id, lang FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_changed_paths(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rollup.changed_before(t.documents.select("doc_id", "lang"), t.labels.union(t.labels), "doc_id")


@query("SELECT d.doc_id, lang, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def lookup_analyses(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id")


@query("SELECT o_orderkey, o_custkey, coalesce(c_name, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 = 0")
def update_from_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    source = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return diffs.updated_from(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), source, "o_custkey", o_orderstatus="c_name")


DELTAS = """d AS (SELECT event_id // 50 AS version_id, event_id AS seq, user_id AS old_path, user_id + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS new_path,
      CASE event_type WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'renamed' ELSE 'modified' END AS status FROM events)"""


def _deltas(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "purchase", "renamed").otherwise("modified")
    moved = F.col("user_id") + F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    return t.events.select(F.expr("event_id div 50").alias("version_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("old_path"), moved.alias("new_path"), status.alias("status"))


@query(f"""WITH {DELTAS}, a AS (SELECT DISTINCT version_id, new_path AS path FROM d WHERE new_path % 3 <> 0),
s AS (SELECT version_id, old_path AS path, status, FALSE AS present, NULL AS source_path, seq FROM d WHERE status IN ('deleted', 'renamed') OR new_path <> old_path
      UNION ALL SELECT d.version_id, new_path, status, TRUE, nullif(old_path, new_path), seq FROM d JOIN a ON a.version_id = d.version_id AND a.path = d.new_path WHERE status <> 'deleted'),
r AS (SELECT *, row_number() OVER (PARTITION BY version_id, path ORDER BY seq DESC, present DESC) AS n FROM s)
SELECT version_id, path, status, present, CAST(source_path AS VARCHAR) AS source_path FROM r WHERE n = 1""")
def version_file_states(spark, sf_dir):
    d = _deltas(Tables(spark, sf_dir))
    text_paths = d.withColumns({"old_path": F.col("old_path").cast("string"), "new_path": F.col("new_path").cast("string")})
    analyses = d.where("new_path % 3 <> 0").select("version_id", F.col("new_path").cast("string").alias("path")).distinct().withColumns({"file_id": F.col("path"), "metrics": F.lit(1)})
    states = diffs.file_states(text_paths, analyses, ["version_id"])
    return states.select("version_id", F.col("path").cast("long").alias("path"), "status", F.col("exists").alias("present"), "source_path")


@query("""WITH fc AS (SELECT event_id AS diff_id, user_id AS old_path, user_id AS new_path, CASE event_type WHEN 'error' THEN 'deleted' ELSE 'modified' END AS status FROM events),
f AS (SELECT event_id AS version_id, user_id AS path FROM events WHERE event_id % 2 = 0), g AS (SELECT diff_id AS version_id, old_path AS path, status FROM fc WHERE status = 'deleted')
SELECT version_id, path, 'analyzed' AS status, TRUE AS present FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.version_id = f.version_id AND g.path = f.path) UNION ALL SELECT version_id, path, status, FALSE FROM g""")
def tombstone_backfill(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    path = F.col("user_id").cast("string")
    fc = e.select(F.col("event_id").alias("diff_id"), path.alias("old_path"), path.alias("new_path"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("status"))
    d = e.select(F.col("event_id").alias("id"), F.col("event_id").alias("version_id"))
    v = e.select(F.col("event_id").alias("id"), F.lit("c").alias("codebase_id"))
    f = e.where("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("version_id"), path.alias("path"))
    return diffs.tombstone_backfill(fc, d, v, f).select("version_id", F.col("path").cast("long").alias("path"), "status", F.col("exists").alias("present"))


@query(f"WITH {DELTAS} SELECT version_id, old_path AS path FROM d UNION SELECT version_id, new_path FROM d")
def union_paths(spark, sf_dir):
    return diffs.touched_paths(_deltas(Tables(spark, sf_dir)), ["version_id"])


@query("SELECT user_id AS path, event_id FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 9 = 0) UNION ALL SELECT user_id, -event_id FROM events WHERE event_id % 9 = 0")
def overwrite_merge(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select(F.col("user_id").alias("path"), "event_id")
    new = e.where("event_id % 9 = 0").withColumn("event_id", -F.col("event_id"))
    return rollup.carried_forward(e.where("event_id % 2 = 0"), new, new)


@query("SELECT doc_id % 5000 AS path FROM documents EXCEPT SELECT doc_id % 5000 FROM labels")
def list_difference(spark, sf_dir):
    t = Tables(spark, sf_dir)
    path = (F.col("doc_id") % 5000).alias("path")
    return diffs.path_difference(t.documents.select(path), t.labels.select(path))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedup_first(spark, sf_dir):
    return diffs.first_of_each(Tables(spark, sf_dir).events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("SELECT l_suppkey AS diff_id, CAST(count(*) AS INTEGER) AS files_changed, CAST(sum(l_linenumber) AS INTEGER) AS insertions, CAST(sum(l_partkey % 7) AS INTEGER) AS deletions, CAST(sum(l_linenumber) + sum(l_partkey % 7) AS INTEGER) AS changed_lines FROM lineitem GROUP BY l_suppkey")
def diff_statistics(spark, sf_dir):
    d = Tables(spark, sf_dir).lineitem.select(F.col("l_suppkey").alias("diff_id"), F.col("l_linenumber").alias("insertions"), (F.col("l_partkey") % 7).alias("deletions"))
    return diffs.diff_stats(d, ["diff_id"])


@query("""WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS g, n_chars % 5 AS c FROM documents),
m AS (SELECT doc_id, c, CASE WHEN text = '' THEN 0 WHEN suffix(text, chr(10)) THEN len(g) - 1 ELSE len(g) END AS loc, len(list_filter(g[2:-2], lambda x: x = '')) AS blank,
      len(list_filter(g, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') IN ('[', ']', '{', '}', '(', ')', ';;', ';'))) AS bracket FROM s)
SELECT doc_id, CAST(loc AS BIGINT) AS lines_of_code, CAST(blank AS BIGINT) AS blank_lines, CAST(bracket AS BIGINT) AS bracket_lines_of_code, CAST(greatest(greatest(loc - c, 0) - blank, 0) AS BIGINT) AS effective_lines_of_code FROM m""")
def line_metrics(spark, sf_dir):
    t = F.col("text")
    loc, blank = text.line_count(t), text.blank_lines(t)
    return Tables(spark, sf_dir).documents.select("doc_id", loc.alias("lines_of_code"), blank.alias("blank_lines"), text.bracket_lines(t).alias("bracket_lines_of_code"), text.effective_lines(loc, F.col("n_chars") % 5, blank).alias("effective_lines_of_code"))


MESSAGES = ["Fix bug", "prefix x", "bugfixes done", "fixing it", "Resolved: y", "a hotfix, late", "incorrect", "repairs", "Patched", "correct_ed"]


@query(f"""SELECT event_id, message, regexp_matches(message, '{classify.FIX_WORDS}') AS is_fix FROM (SELECT event_id, CASE event_id % 10 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES))} END || ' ' || event_type AS message FROM events)""")
def is_fix(spark, sf_dir):
    m = F.concat(F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 10 + 1).cast("int")), F.lit(" "), "event_type")
    return Tables(spark, sf_dir).events.select("event_id", m.alias("message")).withColumn("is_fix", classify.is_fix(F.col("message")))


ENDINGS = ["/a.py", "/b.PYI", "/c.ml", "/d.hs", "/e.go", "/f", "/g.txt", "/.py", "/h.mli"]


@query(f"""WITH p AS (SELECT page_id, url || CASE page_id % 9 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS))} END AS path FROM pages), e AS (SELECT *, nullif(regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1), '') AS x FROM p)
SELECT page_id, path, CASE lower(x) WHEN 'py' THEN 'python' WHEN 'pyw' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'ml' THEN 'ocaml' WHEN 'mli' THEN 'ocaml' WHEN 'hs' THEN 'haskell' WHEN 'lhs' THEN 'haskell' WHEN 'go' THEN 'golang' END AS language,
coalesce(x, '') IN ('py', 'ml', 'mli', 'go') AS analysed FROM e""")
def detect_by_extension(spark, sf_dir):
    path = F.concat("url", F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % 9 + 1).cast("int")))
    return Tables(spark, sf_dir).pages.select("page_id", path.alias("path")).withColumns({"language": classify.detect_language(F.col("path")), "analysed": classify.analysable(F.col("path"))})


STARTS = ["#!/usr/bin/env python3\n", "\n  #!/usr/bin/ocaml\n", "package main\n\nfunc f() {}\n", "module A where\n", "let a = 1;;\n", "match x with A -> 1\n", "class A:\n", "x\nimport y\n", "#!/bin/sh go\n", ""]


def _sql_text(s: str) -> str:
    return "'" + s.replace("\n", "' || chr(10) || '") + "'"


CONTENT_CASE = f"""CASE WHEN starts_with(f, '#!') AND contains(f, 'python') THEN 'python' WHEN starts_with(f, '#!') AND (contains(f, 'runhaskell') OR contains(f, 'ghc')) THEN 'haskell'
WHEN starts_with(f, '#!') AND contains(f, 'ocaml') THEN 'ocaml' WHEN starts_with(f, '#!') AND contains(f, 'go') THEN 'golang'
WHEN starts_with(s, 'package ') AND (contains(s, chr(10) || 'func ') OR contains(s, chr(10) || 'import (')) THEN 'golang'
WHEN starts_with(s, 'module ') AND contains(s, ' where') OR contains(s, chr(10) || 'import qualified ') THEN 'haskell'
WHEN starts_with(s, 'let ') AND contains(s, ' =') AND contains(s, ';;') THEN 'ocaml' WHEN contains(s, 'match ') AND contains(s, ' with') AND contains(s, '->') THEN 'ocaml'
WHEN starts_with(s, 'def ') OR starts_with(s, 'class ') OR starts_with(s, 'import ') OR contains(s, chr(10) || 'def ') OR contains(s, chr(10) || 'class ') OR contains(s, chr(10) || 'import ') THEN 'python' END"""


@query(f"""WITH t AS (SELECT doc_id, CASE doc_id % 10 {' '.join(f"WHEN {i} THEN {_sql_text(s)}" for i, s in enumerate(STARTS))} END || text AS x FROM documents),
u AS (SELECT doc_id, x, lower(regexp_extract(x, '(?m)^([^\\n]*\\S[^\\n]*)$', 1)) AS f, regexp_replace(x, '^\\s+', '') AS s FROM t)
SELECT doc_id, {CONTENT_CASE} AS language FROM u""")
def detect_by_content(spark, sf_dir):
    x = F.concat(F.element_at(F.array(*map(F.lit, STARTS)), (F.col("doc_id") % 10 + 1).cast("int")), "text")
    return Tables(spark, sf_dir).documents.select("doc_id", classify.language_by_content(x).alias("language"))


@query(f"""WITH t AS (SELECT doc_id, CASE doc_id % 10 {' '.join(f"WHEN {i} THEN {_sql_text(s)}" for i, s in enumerate(STARTS))} END || text AS x FROM documents),
u AS (SELECT doc_id, x, lower(regexp_extract(x, '(?m)^([^\\n]*\\S[^\\n]*)$', 1)) AS f, regexp_replace(x, '^\\s+', '') AS s FROM t),
v AS (SELECT *, CASE doc_id % 9 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS))} END AS path FROM u), e AS (SELECT *, lower(nullif(regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1), '')) AS ext FROM v)
SELECT doc_id, coalesce(CASE ext WHEN 'py' THEN 'python' WHEN 'pyw' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'ml' THEN 'ocaml' WHEN 'mli' THEN 'ocaml' WHEN 'hs' THEN 'haskell' WHEN 'lhs' THEN 'haskell' WHEN 'go' THEN 'golang' END, {CONTENT_CASE}) AS language FROM e""")
def detect_by_name_or_text(spark, sf_dir):
    """The language by the file's name, or else by its text."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    return Tables(spark, sf_dir).documents.select("doc_id", classify.detect_language(pick(ENDINGS), F.concat(pick(STARTS), "text")).alias("language"))


RULES = ["# rules", "*.log", "/build/", "doc/**/old", "!keep.log", "tmp?", "a/b", "*.[oa]", "vendor/", "!vendor/mine.go"]
# Paths, and whether these rules leave them out.
PLACES = {
    "src/{}/x.log": True, "src/{}/keep.log": False, "build/{}.go": True, "lib/build/{}.go": False, "doc/{}/old/x.go": True, "doc/old": True, "tmp1/{}.go": True,
    "tmp12/{}.go": False, "a/b/{}.go": True, "z/a/b/{}.go": False, "x/{}.o": True, "x/{}.go": False, "p/vendor/{}.go": True, "vendor/mine.go": True, "vendor{}": False, "build{}": False,
}


@query(f"""SELECT page_id, replace(CASE page_id % {len(PLACES)} {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PLACES))} END, '{{}}', CAST(page_id AS VARCHAR)) AS path, CASE page_id % {len(PLACES)} {' '.join(f"WHEN {i} THEN {x}" for i, x in enumerate(PLACES.values()))} END AS ignored FROM pages""")
def ignored_paths(spark, sf_dir):
    """Which paths a list of ignore rules leaves out."""
    place = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("page_id") % len(PLACES) + 1).cast("int"))
    path = F.replace(place, F.lit("{}"), F.col("page_id").cast("string"))
    return Tables(spark, sf_dir).pages.select("page_id", path.alias("path")).withColumn("ignored", ignore.ignored(F.col("path"), RULES))


REPOS = ["/u/Django.git", "/u/ocaml-lib/", "/u/haskell", "/u/python-x.git", "/u/other"]


@query(f"""WITH r AS (SELECT page_id, 'https://host.test/' || page_id || CASE page_id % 5 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(REPOS))} END AS url FROM pages)
SELECT page_id, CASE WHEN contains(lower(url), 'go') THEN 'Golang' WHEN contains(lower(url), 'ocaml') THEN 'Ocaml' WHEN contains(lower(url), 'haskell') THEN 'Haskell' WHEN contains(lower(url), 'python') THEN 'Python' END AS language,
split_part(regexp_replace(regexp_replace(url, '/+$', ''), '(\\.git)+$', ''), '/', -1) AS name FROM r""")
def repo_language_and_name(spark, sf_dir):
    url = F.concat(F.lit("https://host.test/"), "page_id", F.element_at(F.array(*map(F.lit, REPOS)), (F.col("page_id") % 5 + 1).cast("int")))
    return Tables(spark, sf_dir).pages.select("page_id", classify.repo_language(url).alias("language"), text.repo_name(url).alias("name"))


@query("SELECT page_id, split_part(url, '/', -1) AS basename, concat_ws(':', url, page_id, 3) AS qualified FROM pages")
def path_parts(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", text.basename(F.col("url")).alias("basename"), text.qualified_name(F.col("url"), F.col("page_id"), F.lit(3)).alias("qualified"))


@query("""WITH f AS (SELECT doc_id, replace(text, chr(10), '\\n') AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 80 THEN left(x, 80) || '...' ELSE x END AS snippet FROM f""")
def snippets(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", text.snippet(F.col("text")).alias("snippet"))


def _sql_trigrams(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _sql_similarity(a: str, b: str) -> str:
    """Of two columns that hold trigram lists."""
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN CAST(CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}) AS FLOAT) ELSE CAST(0 AS FLOAT) END"


@query(f"""WITH g AS (SELECT p_partkey, {_sql_trigrams('p_name')} AS a, {_sql_trigrams("'blue bolt'")} AS b FROM part) SELECT p_partkey, round(CAST({_sql_similarity('a', 'b')} AS DOUBLE), 6) AS score FROM g""")
def trigram_similarity(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", F.round(trigrams.similarity(F.col("p_name"), F.lit("blue bolt")).cast("double"), 6).alias("score"))


@query(f"""WITH g AS (SELECT p_partkey, {_sql_trigrams('p_name')} AS a, {_sql_trigrams("'blue bolt'")} AS b FROM part), s AS (SELECT p_partkey, {_sql_similarity('a', 'b')} AS x FROM g) SELECT p_partkey, round(CAST(x AS DOUBLE), 6) AS score FROM s WHERE x >= CAST(0.3 AS FLOAT)""")
def trigram_index_candidates(spark, sf_dir):
    index = search.trigram_index(Tables(spark, sf_dir).part, "p_partkey", "p_name")
    return search.candidates(index, "p_partkey", "blue bolt").select("p_partkey", F.round(F.col("score").cast("double"), 6).alias("score"))


SEARCHED = f"""WITH g AS (SELECT page_id, url AS path, {_sql_trigrams('url')} AS a, {_sql_trigrams("split_part(url, '/', -1)")} AS b, {_sql_trigrams("'page 7'")} AS q FROM pages),
s AS (SELECT page_id, path, {_sql_similarity('a', 'q')} AS x, {_sql_similarity('b', 'q')} AS y FROM g)
SELECT page_id, path, round(CAST(greatest(x, y) AS DOUBLE), 6) AS score FROM s WHERE x >= CAST(0.3 AS FLOAT) OR y >= CAST(0.3 AS FLOAT) OR path ILIKE '%page 7%' ORDER BY score DESC, path LIMIT 50"""


@query(SEARCHED)
def search_filenames(spark, sf_dir):
    files = Tables(spark, sf_dir).pages.select("page_id", F.col("url").alias("path"))
    return search.rank_files(files, "page 7").select("page_id", "path", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(SEARCHED)
def search_filenames_indexed(spark, sf_dir):
    files = Tables(spark, sf_dir).pages.select("page_id", F.col("url").alias("path"))
    paths = search.trigram_index(files, "page_id", "path")
    names = search.trigram_index(files.select("page_id", text.basename(F.col("path")).alias("name")), "page_id", "name")
    return search.rank_files_indexed(files, paths, names, "page_id", "page 7").select("page_id", "path", F.round(F.col("score").cast("double"), 6).alias("score"))


@query(f"""WITH g AS (SELECT p_partkey, p_name AS name, p_type AS path, {_sql_trigrams('p_name')} AS a, {_sql_trigrams('p_type')} AS b, {_sql_trigrams("'_ue bolt'")} AS q FROM part),
s AS (SELECT p_partkey, name, path, {_sql_similarity('a', 'q')} AS x, {_sql_similarity('b', 'q')} AS y FROM g)
SELECT p_partkey, name, round(CAST(greatest(x, y) AS DOUBLE), 6) AS score FROM s WHERE x >= CAST(0.3 AS FLOAT) OR y >= CAST(0.3 AS FLOAT) OR name ILIKE '%_ue bolt%' OR path ILIKE '%_ue bolt%' ORDER BY greatest(x, y) DESC, path, p_partkey, name LIMIT 25""")
def search_functions(spark, sf_dir):
    f = Tables(spark, sf_dir).part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("path"), F.col("p_partkey").alias("start_line"))
    return search.rank_functions(f, "_ue bolt", 25).select("p_partkey", "name", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("SELECT page_id, url AS path FROM pages WHERE FALSE")
def search_blank(spark, sf_dir):
    return search.rank_files(Tables(spark, sf_dir).pages.select("page_id", F.col("url").alias("path")), "   ").select("page_id", "path")


TOKENS = """t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[^\\sA-Za-z]')) AS x FROM documents)"""


def _words(t: Tables) -> DataFrame:
    x = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+|[^\sA-Za-z]"), F.lit(0)))
    return t.documents.select("doc_id", x.alias("text")).withColumn("class", F.when(F.col("text").rlike("^[A-Za-z]"), "operand").otherwise("operator"))


@query(f"""WITH {TOKENS} SELECT doc_id, count(DISTINCT CASE WHEN NOT regexp_matches(x, '^[A-Za-z]') THEN x END) AS unique_operators, count(DISTINCT CASE WHEN regexp_matches(x, '^[A-Za-z]') THEN x END) AS unique_operands,
count(*) FILTER (NOT regexp_matches(x, '^[A-Za-z]')) AS operators, count(*) FILTER (regexp_matches(x, '^[A-Za-z]')) AS operands FROM t GROUP BY doc_id""")
def halstead_counts(spark, sf_dir):
    return halstead.base_counts(_words(Tables(spark, sf_dir)), ["doc_id"])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber - 1 AS BIGINT) AS n1, CAST(l_partkey % 5 AS BIGINT) AS n2, CAST(l_suppkey % 50 AS BIGINT) AS b1, CAST(l_quantity AS BIGINT) AS b2 FROM lineitem),
v AS (SELECT *, CASE WHEN b1 + b2 > 0 AND n1 + n2 > 0 THEN (b1 + b2) * log2(n1 + n2) ELSE 0.0::DOUBLE END AS volume, CASE WHEN n2 > 0 THEN n1 / 2.0::DOUBLE * (CAST(b2 AS DOUBLE) / n2) ELSE 0.0::DOUBLE END AS difficulty,
      CASE WHEN n1 > 0 THEN n1 * log2(greatest(n1, 1)) ELSE 0 END + CASE WHEN n2 > 0 THEN n2 * log2(greatest(n2, 1)) ELSE 0 END AS cl FROM c)
SELECT l_orderkey, l_linenumber, b1 + b2 AS length, n1 + n2 AS vocabulary, round(cl, 6) AS calculated_length, round(volume, 6) AS volume, round(difficulty, 6) AS difficulty, round(difficulty * volume, 3) AS effort, round(volume / 3000.0::DOUBLE, 6) AS bugs FROM v""")
def halstead_derived(spark, sf_dir):
    c = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).cast("long").alias("unique_operators"), (F.col("l_partkey") % 5).cast("long").alias("unique_operands"), (F.col("l_suppkey") % 50).cast("long").alias("operators"), F.col("l_quantity").cast("long").alias("operands"))
    m = halstead.with_measures(c)
    return m.select("l_orderkey", "l_linenumber", "length", "vocabulary", *[F.round(x, n).alias(x) for x, n in (("calculated_length", 6), ("volume", 6), ("difficulty", 6), ("effort", 3), ("bugs", 6))])


SPANS = "f AS (SELECT s_suppkey, i AS function, i * 2 - 1 AS f_start, i * 2 + 1 AS f_end FROM supplier, (SELECT unnest([1, 2, 3]) AS i))"


def _spans(t: Tables):
    f = t.supplier.select(F.col("s_suppkey").alias("file_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("name"))
    functions = f.withColumns({"start_line": F.col("name") * 2 - 1, "end_line": F.col("name") * 2 + 1})
    rows = t.lineitem.select(F.col("l_suppkey").alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("token_no"), F.col("l_linenumber").alias("line"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"))
    return rows, functions


@query(f"WITH {SPANS} SELECT l_suppkey AS file_id, function, count(*) AS n, CAST(sum(l_orderkey * 10 + l_linenumber) AS BIGINT) AS s FROM lineitem JOIN f ON s_suppkey = l_suppkey AND l_linenumber BETWEEN f_start AND f_end GROUP BY ALL")
def token_range_join(spark, sf_dir):
    return tokens.tokens_in_functions(*_spans(Tables(spark, sf_dir))).groupBy("file_id", "function").agg(F.count(F.lit(1)).alias("n"), F.sum("token_no").alias("s"))


@query(f"""WITH {SPANS}, t AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS k, l_linenumber AS line, lag(l_linenumber, 1, 1) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS p FROM lineitem)
SELECT l_suppkey AS file_id, function, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM t JOIN f ON s_suppkey = l_suppkey AND p >= f_start AND line <= f_end GROUP BY ALL""")
def token_range_join_prev(spark, sf_dir):
    return tokens.tokens_in_functions_by_previous(*_spans(Tables(spark, sf_dir))).groupBy("file_id", "function").agg(F.count(F.lit(1)).alias("n"), F.sum("token_no").alias("s"))


@query("SELECT p.p_partkey, p.p_brand, q.p_size AS first_size FROM part p LEFT JOIN (SELECT p_brand, arg_min(p_size, p_partkey) AS p_size FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand) q ON q.p_brand = p.p_brand")
def halstead_first_match(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    helper = p.where("p_partkey % 3 = 0").select("p_brand", F.col("p_partkey").alias("no"), F.col("p_size").alias("first_size"))
    return tokens.apply_by_name(p.select("p_partkey", "p_brand"), helper, ["p_brand"], "no").select("p_partkey", "p_brand", "first_size")


EDGES = "e AS (SELECT DISTINCT l_suppkey % 10 AS file_id, 'f' || (l_suppkey % 50) AS caller, 'f' || (l_partkey % 60) AS callee FROM lineitem), n AS (SELECT DISTINCT file_id, caller AS name FROM e)"


def _edges(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_suppkey") % 10).alias("file_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 50).alias("caller"), F.concat(F.lit("f"), F.col("l_partkey") % 60).alias("callee"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("column"))


@query(f"""WITH {EDGES}, o AS (SELECT file_id, caller AS name, count(*) AS outdegree FROM e GROUP BY ALL), i AS (SELECT file_id, callee AS name, count(DISTINCT caller) AS indegree, string_agg(DISTINCT caller, ',' ORDER BY caller) AS r FROM e WHERE caller <> callee GROUP BY ALL)
SELECT n.file_id, n.name, outdegree, coalesce(indegree, 0) AS indegree, coalesce(r, '') AS refs FROM n JOIN o USING (file_id, name) LEFT JOIN i USING (file_id, name)""")
def call_degree(spark, sf_dir):
    e = _edges(Tables(spark, sf_dir))
    nodes = e.select("file_id", F.col("caller").alias("name")).distinct()
    return calls.degrees(nodes, e).select("file_id", "name", "outdegree", "indegree", F.array_join("references", ",").alias("refs"))


@query("""WITH e AS (SELECT l_suppkey % 10 AS file_id, 'f' || (l_suppkey % 50) AS caller, 'f' || (l_partkey % 60) AS callee, l_linenumber AS line, l_orderkey AS col FROM lineitem),
d AS (SELECT s_suppkey % 10 AS file_id, 'f' || (s_suppkey % 50) AS name, min(s_suppkey) AS d_line FROM supplier GROUP BY ALL), a AS (SELECT name, arg_min(d_line, file_id) AS a_line FROM d GROUP BY name)
SELECT e.file_id, caller, callee, CAST(coalesce(d_line, a_line) AS BIGINT) AS def_line, count(*) AS n FROM e LEFT JOIN d ON d.file_id = e.file_id AND d.name = e.callee LEFT JOIN a ON a.name = e.callee WHERE coalesce(d_line, a_line) IS NOT NULL GROUP BY ALL""")
def resolve_calls(spark, sf_dir):
    t = Tables(spark, sf_dir)
    definitions = t.supplier.select((F.col("s_suppkey") % 10).alias("file_id"), (F.col("s_suppkey") % 10).alias("path"), F.concat(F.lit("f"), F.col("s_suppkey") % 50).alias("name"), F.col("s_suppkey").alias("line"), F.lit(1).alias("column"))
    found = calls.resolve_calls(_edges(t), definitions)
    return found.groupBy("file_id", "caller", "callee", F.col("definition.line").alias("def_line")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_suppkey AS file, 'digraph CallGraph {' || chr(10) || string_agg(chr(9) || '"' || l_returnflag || ':' || l_linenumber || ':' || l_orderkey || '" -> "' || l_suppkey || ':' || l_linestatus || ':' || l_partkey || ':' || l_orderkey || '"', chr(10)
ORDER BY l_linenumber, l_orderkey, l_partkey, l_returnflag, l_linestatus) || chr(10) || '}' || chr(10) AS dot FROM lineitem GROUP BY l_suppkey""")
def dot_edges(spark, sf_dir):
    e = Tables(spark, sf_dir).lineitem.select(F.col("l_suppkey").alias("path"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("column"), F.col("l_linestatus").alias("callee"), F.col("l_partkey").alias("call_line"), F.col("l_orderkey").alias("call_column"))
    return calls.dot_graph(e, ["path"]).withColumnRenamed("path", "file")


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.gone') AS BIGINT), 0) AS gone FROM events")
def json_path_default(spark, sf_dir):
    return Tables(spark, sf_dir).events.select("event_id", text.number_at(F.col("props"), "k").alias("k"), text.number_at(F.col("props"), "gone").alias("gone"))


LONG = "u AS (SELECT o_orderkey, o_orderdate, metric, value FROM (SELECT o_orderkey, o_orderdate, o_totalprice, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS o_custkey FROM orders) UNPIVOT INCLUDE NULLS (value FOR metric IN (o_totalprice, o_custkey)))"


def _long(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")))
    return charts.long_metrics(rows, ["o_orderkey", "o_orderdate"], ["o_totalprice", "o_custkey"])


@query(f"WITH {LONG} SELECT * FROM u")
def metrics_unpivot(spark, sf_dir):
    return _long(Tables(spark, sf_dir))


@query(f"WITH {LONG} SELECT metric, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, max(coalesce(value, 0)) AS largest, bool_or(value IS NOT NULL) AS available FROM u GROUP BY metric")
def series_extent(spark, sf_dir):
    return charts.extents(_long(Tables(spark, sf_dir)), "o_orderdate")


@query("SELECT user_id, arg_min(event_id, {'g': abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), 'o': event_id}) AS event_id FROM events GROUP BY user_id")
def nearest_point(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("user_id", "event_id", "ts")
    import datetime

    return charts.nearest_point(e, ["user_id"], datetime.datetime(2024, 1, 15, 12, tzinfo=datetime.timezone.utc), "ts", "event_id").select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END, 0) DESC, o_orderdate DESC, o_orderkey) AS place FROM orders")
def table_sort(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.withColumn("m", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    w = Window.partitionBy("o_custkey").orderBy(*charts.order_of("m", "desc", "o_orderdate"), "o_orderkey")
    return o.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT string_agg(source, ',' ORDER BY source) FILTER (lang = 'de') AS de, string_agg(source, ',' ORDER BY source) FILTER (lang = 'en') AS en FROM (SELECT DISTINCT lang, source FROM documents)")
def language_pivot(spark, sf_dir):
    c = Tables(spark, sf_dir).documents.select(F.col("lang").alias("programming_language"), F.col("source").alias("name")).distinct()
    wide = charts.language_columns(c, ["de", "en"])
    return wide.select(*[F.array_join(x, ",").alias(x) for x in ("de", "en")])


@query("""WITH b AS (SELECT o_orderkey AS k, -o_orderkey AS id, 'new' AS status FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT -o_orderkey, 0, 'added' FROM orders WHERE o_orderkey % 5 = 0),
n AS (SELECT k, arg_max(id, status) AS id, max(status) AS status FROM b GROUP BY k)
SELECT o_orderkey AS k, o_custkey AS id, coalesce(n.status, o_orderstatus) AS status FROM orders LEFT JOIN n ON n.k = o_orderkey UNION ALL SELECT k, id, status FROM n WHERE k NOT IN (SELECT o_orderkey FROM orders)""")
def keyed_merge(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    old = o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), (-F.col("o_orderkey")).alias("id"), F.lit("new").alias("status"))
    added = o.where("o_orderkey % 5 = 0").select((-F.col("o_orderkey")).alias("k"), F.lit(0).cast("long").alias("id"), F.lit("added").alias("status"))
    return merge.keyed_merge(old, new.union(added), ["k"], ["status"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 3 = 0")
def replace_partition(spark, sf_dir):
    t = Tables(spark, sf_dir)
    new = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"))
    return merge.replace_groups(t.lineitem.select("l_orderkey", "l_linenumber"), new, "l_orderkey")


@query("""WITH v AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey <> 3), f AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM v)), n AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT id FROM f))
SELECT 'codebases' AS name, count(*) AS n FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'versions', count(*) FROM v UNION ALL SELECT 'files', count(*) FROM f UNION ALL SELECT 'functions', count(*) FROM n""")
def cascade_delete(spark, sf_dir):
    t = Tables(spark, sf_dir)
    store = {
        "codebases": t.nation.select(F.col("n_nationkey").cast("long").alias("id")),
        "versions": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("codebase_id")),
        "files": t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("version_id")),
        "functions": t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("file_id")),
    }
    after, _ = merge.cascade_delete(store, "codebases", spark.createDataFrame([(3,)], "id long"))
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in after.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query("""SELECT l_orderkey, l_linenumber, CAST(l_linenumber + l_suppkey % 4 AS INTEGER) AS old_end_line, CAST(greatest(l_suppkey % 4, 0) AS INTEGER) AS old_span_length, CAST(l_partkey % 9 + 3 AS INTEGER) AS new_end_line, 3 AS new_span_length FROM lineitem""")
def hunk_spans(spark, sf_dir):
    h = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("old_start_line"), (F.col("l_suppkey") % 4).cast("int").alias("old_lines"), (F.col("l_partkey") % 9).cast("int").alias("new_start_line"), F.lit(3).alias("new_lines"))
    return diffs.with_spans(h).select("l_orderkey", "l_linenumber", "old_end_line", "old_span_length", "new_end_line", "new_span_length")


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'modified' WHEN 3 THEN 'renamed' ELSE 'unmodified' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 40, '0') END AS oid,
o_orderkey % 5 IN (1, 3) AS gone, CAST(greatest(o_custkey - 700, 0) AS BIGINT) AS rest FROM orders""")
def delta_columns(spark, sf_dir):
    letter = F.element_at(F.array(*map(F.lit, "ADMR-")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    oid = F.when(F.col("o_orderkey") % 5 == 0, F.lit("0" * 40)).otherwise(F.lpad(F.col("o_orderkey").cast("string"), 40, "0"))
    o = Tables(spark, sf_dir).orders.select("o_orderkey", classify.delta_status(letter).alias("status"), classify.oid_or_null(oid).alias("oid"), "o_custkey")
    return o.select("o_orderkey", "status", "oid", classify.path_gone(F.lit("p"), F.lit("p"), F.col("status")).alias("gone"), text.saturating_sub(F.col("o_custkey"), F.lit(700)).cast("long").alias("rest"))


@query("SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM (SELECT c_custkey, sha256('c|' || c_custkey || '|' || c_name) AS h FROM customer)")
def natural_ids(spark, sf_dir):
    return Tables(spark, sf_dir).customer.select("c_custkey", keys.natural_id(F.lit("c"), F.col("c_custkey"), F.col("c_name")).alias("id"))


@query("""WITH n AS (SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY user_id) SELECT * FROM n""")
def stream_current_states(spark, sf_dir):
    """The stream form: all events as one available-now batch through the streaming aggregate."""
    from ..streaming.ingest import current_states, latest_table

    folder = new_folder(spark, "current-states")
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("user_id").alias("path"), "ts", "event_id")
    latest_table(current_states(stream, order=["ts", "event_id"]), f"{folder}/out", f"{folder}/log").awaitTermination()
    result = spark.read.parquet(f"{folder}/out")
    return result.where(F.col("n") == result.agg(F.max("n")).first()[0]).select(F.col("path").alias("user_id"), "event_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    """Events per hour and type as a streaming aggregate with a watermark, all of them as one available-now batch."""
    from ..streaming.ingest import latest_table, windowed_counts

    folder = new_folder(spark, "windowed-counts")
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(stream, "ts", "1 hour", "1 day", ["event_type"]).withColumnRenamed("n", "events")
    latest_table(counts, f"{folder}/out", f"{folder}/log").awaitTermination()
    result = spark.read.parquet(f"{folder}/out")
    newest = result.where(F.col("n") == result.agg(F.max("n")).first()[0])
    return newest.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.col("events").alias("n"))


@query("SELECT event_type AS name, CAST(arg_max(event_id, {'t': ts, 'e': event_id}) AS VARCHAR) AS url, max(ts) AS created_at FROM events GROUP BY event_type")
def stream_merged_rows(spark, sf_dir):
    """All events as rows of the store, merged by a stream: the newest of each key stays."""
    from ..streaming.ingest import merge_stream
    from .catalog import Catalog

    folder = new_folder(spark, "merged-rows")
    catalog = Catalog.open(spark, f"{folder}/store")
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = F.col("event_id").cast("string")
    rows = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*").select(F.lpad(number, 20, "0").alias("id"), F.col("event_type").alias("name"), number.alias("url"), F.lit("Golang").alias("programming_language"), F.col("ts").cast("timestamp").alias("created_at"))
    merge_stream(rows, catalog, "codebases", f"{folder}/log", ["created_at", "id"]).awaitTermination()
    return catalog.table("codebases").select("name", "url", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


GO = "package main\n\n// main\nfunc main() {\n\tif a && b {\n\t\tfmt.Println(add(1, 2))\n\t}\n}\n\nfunc add(a int, b int) int { return a + b }\n"
OCAML = "let rec total items =\n  match items with\n  | [] -> 0\n  | first :: rest when first > limit -> first + total rest\n  | _ :: rest -> total rest\n\nlet limit = 3\n"
PYTHON = '"""doc"""\n\ndef f(x):\n    # note\n    return g(x) if x and y else f(x - 1)\n'


def _sources(t: Tables) -> DataFrame:
    """Every document as a source in one of three languages: a program, then its whole text as comments, line by line."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z\n]+", " ")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.concat(F.trim(x), F.lit(".")))
    each = lambda mark: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(mark), x, F.lit("\n"))), "")
    texts = [F.concat(F.lit(GO), each("// ")), F.concat(F.lit(OCAML), F.lit("(* "), F.array_join(lines, "\n * "), F.lit(" *)\n")), F.concat(F.lit(PYTHON), each("# "))]
    pick = lambda xs: F.element_at(F.array(*xs), (F.col("doc_id") % 3 + 1).cast("int"))
    kind = F.col("doc_id") % 3
    text_ = F.when(kind == 0, texts[0]).when(kind == 1, texts[1]).otherwise(texts[2])
    language, ending = pick(map(F.lit, ("golang", "ocaml", "python"))), pick(map(F.lit, (".go", ".ml", ".py")))
    return t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), ending).alias("path"), language.alias("language"), text_.alias("text"))


# What the three programs hold: lines, comment, blank and bracket lines and complexity; functions; calls; counts; comments.
SOURCES = r"""p(k, language, ending, loc, comments, blank, bracket, total) AS (VALUES (0, 'golang', '.go', 10, 1, 2, 2, 4), (1, 'ocaml', '.ml', 7, 0, 1, 0, 6), (2, 'python', '.py', 5, 2, 1, 0, 3)),
f(k, name, line, col, start_line, end_line, cyclomatic, single, n_calls) AS (VALUES (0, 'main', 4, 6, 4, 8, 3, 3, 2), (0, 'add', 10, 6, 10, 10, 1, 1, 0), (1, 'total', 1, 9, 1, 5, 5, 2, 2), (1, 'limit', 7, 5, 7, 7, 1, 1, 0), (2, 'f', 3, 5, 3, 5, 3, 3, 2)),
calls(k, place, caller, line, col, callee, c_line, c_col) AS (VALUES (0, 0, 'main', 4, 6, 'fmt.Println', 6, 3), (0, 1, 'main', 4, 6, 'add', 6, 15), (1, 0, 'total', 1, 9, 'total', 4, 49), (1, 1, 'total', 1, 9, 'total', 5, 18), (2, 0, 'f', 3, 5, 'g', 5, 12), (2, 1, 'f', 3, 5, 'f', 5, 33)),
h(k, name, n1, n2, b1, b2) AS (VALUES (0, 'main', 3, 8, 3, 8), (0, 'add', 3, 4, 3, 8), (1, 'total', 11, 7, 16, 15), (1, 'limit', 1, 2, 1, 2)),
own(k, line, text) AS (VALUES (0, 3, '// main'), (2, 1, '""" + "\"\"\"doc\"\"\"" + r"""'), (2, 4, '# note')),
l AS (SELECT doc_id, doc_id % 3 AS k, list_transform(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z\n]+', ' ', 'g'), chr(10)), lambda x: trim(x) || '.') AS lines FROM documents),
s AS (SELECT doc_id, l.k, 'd' || doc_id || ending AS path, language, lines, loc, CAST(loc + len(lines) AS BIGINT) AS lines_of_code, CAST(blank AS BIGINT) AS blank_lines, CAST(bracket AS BIGINT) AS bracket_lines_of_code,
CAST(comments + len(lines) AS BIGINT) AS comment_lines_of_code, CAST(loc - comments - blank AS BIGINT) AS effective_lines_of_code, CAST(total AS BIGINT) AS total_cyclomatic FROM l JOIN p USING (k))"""


@query(f"""WITH {SOURCES} SELECT path, language, lines_of_code, blank_lines, comment_lines_of_code, effective_lines_of_code, total_cyclomatic, name, start_line, end_line, cyclomatic, single AS cyclomatic_single, n_calls FROM s JOIN f USING (k)""")
def analyse_sources(spark, sf_dir):
    """Line metrics and functions of sources in the three languages."""
    from ..sources.analysis import file_analysis

    a = file_analysis(_sources(Tables(spark, sf_dir)))
    f = F.explode_outer("functions").alias("f")
    return a.select("path", "language", "lines_of_code", "blank_lines", "comment_lines_of_code", "effective_lines_of_code", "total_cyclomatic", f).select("*", "f.name", "f.start_line", "f.end_line", "f.cyclomatic", "f.cyclomatic_single", F.size("f.calls").alias("n_calls")).drop("f")


@query(f"""WITH {SOURCES} SELECT path AS content_key, language, name AS function, CAST(n1 AS BIGINT) AS unique_operators, CAST(n2 AS BIGINT) AS unique_operands, CAST(b1 AS BIGINT) AS operators, CAST(b2 AS BIGINT) AS operands, CAST(b1 + b2 AS BIGINT) AS length, round((b1 + b2) * log2(n1 + n2), 6) AS volume FROM s JOIN h USING (k)""")
def source_halstead(spark, sf_dir):
    """Halstead measures per function, Go and OCaml."""
    from ..sources.analysis import function_halstead, parsed

    sources = _sources(Tables(spark, sf_dir)).withColumn("content_key", F.col("path"))
    return function_halstead(parsed(sources)).select("content_key", "language", "function", "unique_operators", "unique_operands", "operators", "operands", "length", F.round("volume", 6).alias("volume"))


@query(f"""WITH {SOURCES}, e AS (SELECT doc_id, string_agg(chr(9) || '"' || caller || ':' || line || ':' || col || '" -> "' || path || ':' || callee || ':' || c_line || ':' || c_col || '"' || chr(10), '' ORDER BY place) AS edges FROM s JOIN calls USING (k) GROUP BY doc_id),
g AS (SELECT k, string_agg('  - ' || name || ':' || start_line || '..' || end_line || ' length=' || (end_line - start_line) || ' cyclomatic=' || cyclomatic || ' cyclomatic_match_as_single_branch=' || single || chr(10), '' ORDER BY start_line) AS functions FROM f GROUP BY k),
c AS (SELECT doc_id, line AS a, line AS b, text FROM s JOIN own USING (k) UNION ALL SELECT doc_id, loc + i, loc + i, CASE k WHEN 0 THEN '// ' ELSE '# ' END || lines[i] FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM s WHERE k <> 1)
      UNION ALL SELECT doc_id, loc + 1, loc + len(lines), '(* ' || array_to_string(lines, '\\n * ') || ' *)' FROM s WHERE k = 1),
t AS (SELECT doc_id, string_agg('  - ' || a || '..' || b || ' length=' || (b - a + 1) || ' text="' || replace(replace(CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END, '\\', '\\\\'), '"', '\\"') || '"' || chr(10), '' ORDER BY a) AS comments FROM c GROUP BY doc_id)
SELECT path, 'lines_of_code: ' || lines_of_code || chr(10) || 'blank_lines: ' || blank_lines || chr(10) || 'bracket_lines_of_code: ' || bracket_lines_of_code || chr(10) || 'comment_lines_of_code: ' || comment_lines_of_code || chr(10) || 'effective_lines_of_code: ' || effective_lines_of_code
|| chr(10) || 'total_cyclomatic: ' || total_cyclomatic || chr(10) || 'functions:' || chr(10) || chr(10) || chr(10) || 'digraph CallGraph {{' || chr(10) || edges || '}}' || chr(10) || chr(10) || functions || 'comments:' || chr(10) || comments AS report
FROM s JOIN e USING (doc_id) JOIN g USING (k) JOIN t USING (doc_id)""")
def source_reports(spark, sf_dir):
    from ..operators.reports import file_report
    from ..sources.analysis import file_analysis

    return file_report(file_analysis(_sources(Tables(spark, sf_dir))))


def _order_reports(t: Tables, orders: DataFrame) -> DataFrame:
    from ..operators.reports import diff_report

    orders = orders.select(F.col("o_orderkey").alias("id"))
    d = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("insertions"), (F.col("l_partkey") % 7).alias("deletions"))
    counted = orders.join(diffs.diff_stats(d, ["id"]), "id", "left").na.fill(0)
    path = F.concat(F.lit("p"), F.col("l_suppkey"))
    hunks = t.lineitem.select(F.col("l_orderkey").alias("id"), F.lit(None).cast("string").alias("old_path"), path.alias("new_path"), F.col("l_linenumber").alias("old_start_line"), (F.col("l_linenumber") + 2).alias("old_end_line"), F.col("l_partkey").alias("new_start_line"), (F.col("l_partkey") + 3).alias("new_end_line"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 10).alias("hunk_no"))
    return diff_report(counted, t.lineitem.select(F.col("l_orderkey").alias("id"), path.alias("path")), hunks, "id")


@query("""SELECT o_orderkey AS id, 'files changed: ' || count(l_orderkey) || chr(10) || 'insertions: ' || coalesce(sum(l_linenumber), 0) || chr(10) || 'deletions: ' || coalesce(sum(l_partkey % 7), 0) || chr(10) || 'total line changes: ' || (coalesce(sum(l_linenumber), 0) + coalesce(sum(l_partkey % 7), 0))
|| chr(10) || 'files:' || coalesce(chr(10) || string_agg(DISTINCT '  - p' || l_suppkey, chr(10) ORDER BY '  - p' || l_suppkey), '') || chr(10) || 'hunks:'
|| coalesce(chr(10) || string_agg('  - -:' || l_linenumber || '..' || (l_linenumber + 2) || ' -> p' || l_suppkey || ':' || l_partkey || '..' || (l_partkey + 3), chr(10) ORDER BY l_linenumber * 1000000 + l_partkey * 10, '  - -:' || l_linenumber || '..' || (l_linenumber + 2) || ' -> p' || l_suppkey || ':' || l_partkey || '..' || (l_partkey + 3)), '') AS report
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def diff_reports(spark, sf_dir):
    """The text of every order as a diff whose hunks are its lines; lines alike in their place are in order of their text."""
    t = Tables(spark, sf_dir)
    return _order_reports(t, t.orders)


@query("""SELECT o_orderkey, 1 + o_custkey % 7 + o_custkey % 5 + o_custkey % 3 AS cyclomatic, 1 + o_custkey % 7 + o_custkey % 2 + o_custkey % 3 AS single_branch, to_timestamp(o_orderkey * 86400)::TIMESTAMP AS committed_at, CAST(o_custkey AS INTEGER) AS narrow FROM orders""")
def counters_and_times(spark, sf_dir):
    c = F.col("o_custkey")
    o = Tables(spark, sf_dir).orders
    return o.select(
        "o_orderkey",
        halstead.cyclomatic(c % 7, c % 5, c % 3).alias("cyclomatic"),
        halstead.cyclomatic_match_as_single_branch(c % 7, c % 2, c % 3).alias("single_branch"),
        F.timestamp_seconds(F.col("o_orderkey") * 86400).cast("timestamp_ntz").alias("committed_at"),
        text.narrowed(c).alias("narrow"),
    )


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, printf('length=%d, vocabulary=%d, calculated_length=%.3f, volume=%.3f, difficulty=%.3f, effort=%.3f, time=%.3f, bugs=%.6f', a + 8, 6, 10.0::DOUBLE, (a + 8) * log2(6), 2.0::DOUBLE, 2 * (a + 8) * log2(6), 2 * (a + 8) * log2(6) / 18, (a + 8) * log2(6) / 3000) AS text FROM c""")
def halstead_texts(spark, sf_dir):
    a = F.col("l_quantity").cast("long")
    m = halstead.derived(F.lit(2).cast("long"), F.lit(4).cast("long"), a, F.lit(8).cast("long"))
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", halstead.halstead_text(m).alias("text"))


def _history_folder(spark, sf_dir: str) -> str:
    """A repository with a commit per nation, each adding a line to its region's file."""
    import os
    import subprocess

    folder = new_folder(spark, "history").removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError("git needs a shared folder that is mounted")
    os.makedirs(folder)
    who = {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "A"), ("EMAIL", "a@example.com"), ("DATE", "2024-01-01T00:00:00Z"))}
    git = lambda *args: subprocess.run(["git", "-C", folder, *args], check=True, capture_output=True, env=os.environ | who)
    git("init", "-q", "-b", "main")
    for n in Tables(spark, sf_dir).nation.orderBy("n_nationkey").collect():  # 25 nations at any scale
        path = os.path.join(folder, f"r{n['n_regionkey']}.go")
        with open(path, "a", encoding="utf-8") as f:
            f.write(("" if f.tell() else GO) + f"// {n['n_name']}\n")
        git("add", "-A")
        git("commit", "-q", "-m", f"Fix {n['n_name']}" if n["n_nationkey"] % 4 == 0 else f"Add {n['n_name']}")
    return folder


COMMITS = """c AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS seq, n_nationkey, n_name, 'r' || n_regionkey || '.go' AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 AS first FROM nation)"""


@query(f"""WITH {COMMITS} SELECT seq, 0 AS delta_no, path AS old_path, path AS new_path, CASE WHEN first THEN 'added' ELSE 'modified' END AS status, CASE WHEN first THEN 11 ELSE 1 END AS insertions, 0 AS deletions FROM c""")
def gitlog_deltas(spark, sf_dir):
    """The git source over a repository made of a table."""
    from ..sources import gitlog

    return gitlog.read(spark, _history_folder(spark, sf_dir), "deltas").select("seq", "delta_no", "old_path", "new_path", "status", "insertions", "deletions")


@query(f"""WITH {COMMITS}, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) + 9 AS lines FROM c)
SELECT seq, 0 AS hunk_no, path AS old_path, path AS new_path, CAST(CASE WHEN first THEN 0 ELSE lines - 2 END AS INTEGER) AS old_start_line, CASE WHEN first THEN 0 ELSE 3 END AS old_lines, CAST(CASE WHEN first THEN 1 ELSE lines - 2 END AS INTEGER) AS new_start_line, CASE WHEN first THEN 11 ELSE 4 END AS new_lines FROM n""")
def gitlog_hunks(spark, sf_dir):
    """The hunks of a repository made of a table: a new file, then a line at its end each time."""
    from ..sources import gitlog

    return gitlog.read(spark, _history_folder(spark, sf_dir), "hunks").drop("commit_hash")


@query(f"""WITH {COMMITS} SELECT seq, CASE WHEN n_nationkey % 4 = 0 THEN 'Fix ' ELSE 'Add ' END || n_name AS message, 'A' AS author_name, 'a@example.com' AS author_email, seq = 0 AS root, TIMESTAMP '2024-01-01 00:00:00' AS committed_at FROM c""")
def gitlog_commits(spark, sf_dir):
    """The commits of a repository made of a table."""
    from ..sources import gitlog

    rows = gitlog.read(spark, _history_folder(spark, sf_dir), "commits")
    utc = F.timestamp_seconds(F.unix_timestamp("committed_at"))
    return rows.select("seq", "message", "author_name", "author_email", F.col("parent_hash").isNull().alias("root"), F.to_utc_timestamp(utc, F.current_timezone()).cast("timestamp_ntz").alias("committed_at"))


def _ingested(spark, sf_dir: str):
    from .catalog import Catalog
    from .ingest import ingest

    catalog = Catalog.open(spark, new_folder(spark, "store"))
    return catalog, ingest(catalog, _history_folder(spark, sf_dir), url="https://host.test/golang-sample")


@query(f"""WITH {COMMITS} SELECT seq, rtrim(CASE WHEN n_nationkey % 4 = 0 THEN 'Fix ' ELSE 'Add ' END || n_name) AS message, n_nationkey % 4 = 0 AS is_fix, CAST(sum(CAST(first AS INTEGER)) OVER r AS BIGINT) AS files,
CAST(sum(CASE WHEN first THEN 11 ELSE 1 END) OVER r AS BIGINT) AS total_lines_of_code, CAST(4 * sum(CAST(first AS INTEGER)) OVER r AS BIGINT) AS total_cyclomatic FROM c WINDOW r AS (ORDER BY seq)""")
def ingested_timeline(spark, sf_dir):
    """A repository through the whole ingest: each version with its totals."""
    catalog, codebase = _ingested(spark, sf_dir)
    return catalog.table("versions").where(F.col("codebase_id") == codebase).select("seq", F.rtrim(F.replace("message", F.lit("\n"), F.lit(""))).alias("message"), "is_fix", "metrics.files", "metrics.total_lines_of_code", "metrics.total_cyclomatic")


@query(f"""WITH {COMMITS} SELECT seq, CAST(1 AS BIGINT) AS file_changes, CAST(1 AS BIGINT) AS hunks, CAST(1 AS BIGINT) AS files, CAST(2 AS BIGINT) AS functions, CAST(1 AS BIGINT) AS states FROM c""")
def ingested_counts(spark, sf_dir):
    """How many rows the ingest of every version has stored."""
    from .api import Queries

    catalog, codebase = _ingested(spark, sf_dir)
    return Queries(catalog).ingest_counts(codebase).select("seq", "file_changes", "hunks", "files", "functions", "states")


def _named_history(t: Tables):
    states, versions, at = _history(t)
    return states.withColumn("path", F.concat(F.lit("src/page "), F.col("path").cast("string"))), versions, at


@query(f"""WITH {ASOF}, n AS (SELECT version_id AS file_state_id, CASE WHEN path % 7 <> 0 THEN path END AS file_id, 'src/page ' || path AS path, status FROM c),
g AS (SELECT *, {_sql_trigrams('path')} AS a, {_sql_trigrams("split_part(path, '/', -1)")} AS b, {_sql_trigrams("'page 7'")} AS q FROM n), s AS (SELECT *, {_sql_similarity('a', 'q')} AS x, {_sql_similarity('b', 'q')} AS y FROM g)
SELECT file_state_id, file_id, path, status, round(CAST(greatest(x, y) AS DOUBLE), 6) AS score FROM s WHERE x >= CAST(0.3 AS FLOAT) OR y >= CAST(0.3 AS FLOAT) OR path ILIKE '%page 7%' ORDER BY greatest(x, y) DESC, path LIMIT 50""")
def asof_search_filenames(spark, sf_dir):
    """Fuzzy search over the paths that exist as of a version."""
    found = search.search_filenames(*_named_history(Tables(spark, sf_dir)), "page 7")
    return found.withColumn("score", F.round(F.col("score").cast("double"), 6))


@query(f"""WITH {ASOF}, n AS (SELECT o_orderkey AS function_id, c_custkey AS file_id, 'src/page ' || path AS file_path, c_mktsegment AS file_language, o_orderpriority || ' ' || o_orderkey AS name, CAST(o_orderkey % 100 AS INTEGER) AS start_line, CAST(o_orderkey % 100 + 5 AS INTEGER) AS end_line
FROM c JOIN customer ON c_custkey = path AND path % 7 <> 0 JOIN orders ON o_custkey = c_custkey),
g AS (SELECT *, {_sql_trigrams('name')} AS a, {_sql_trigrams('file_path')} AS b, {_sql_trigrams("'urgent 1'")} AS q FROM n), s AS (SELECT *, {_sql_similarity('a', 'q')} AS x, {_sql_similarity('b', 'q')} AS y FROM g)
SELECT function_id, file_id, file_path, file_language, name, start_line, end_line, round(CAST(greatest(x, y) AS DOUBLE), 6) AS score FROM s WHERE x >= CAST(0.3 AS FLOAT) OR y >= CAST(0.3 AS FLOAT) OR name ILIKE '%urgent 1%' OR file_path ILIKE '%urgent 1%'
ORDER BY greatest(x, y) DESC, file_path, start_line, name LIMIT 25""")
def asof_search_functions(spark, sf_dir):
    """Fuzzy search over the functions of the files that exist as of a version."""
    t = Tables(spark, sf_dir)
    states, versions, at = _named_history(t)
    files, functions = _functions(t)
    functions = functions.withColumn("name", F.concat_ws(" ", "name", F.col("id").cast("string")))
    found = search.search_functions(states, versions, files, functions, at, "urgent 1", 25)
    return found.withColumn("score", F.round(F.col("score").cast("double"), 6))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'root..' || lpad(CAST(o_custkey AS VARCHAR), 8, 'b') WHEN 1 THEN lpad(CAST(o_orderkey AS VARCHAR), 7, 'a') || '..' || lpad(CAST(o_custkey AS VARCHAR), 40, 'b') WHEN 2 THEN 'a..b' WHEN 3 THEN lpad(CAST(o_orderkey AS VARCHAR), 12, 'c') || '...' || lpad(CAST(o_custkey AS VARCHAR), 12, 'c') END AS r FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(r, '^(root|[0-9a-f]{7,40})\\.\\.[0-9a-f]{7,40}$') THEN nullif(split_part(r, '..', 1), 'root') END AS old_commit_hash, CAST(NULL AS VARCHAR) AS doubled FROM r""".replace("\\\\", "\\"))
def commit_ranges(spark, sf_dir):
    """The commit that a range starts from, where the text is a range of commits."""
    padded = lambda c, n, fill: F.lpad(F.col(c).cast("string"), n, fill)
    k = F.col("o_orderkey") % 5
    r = F.when(k == 0, F.concat(F.lit("root.."), padded("o_custkey", 8, "b"))).when(k == 1, F.concat(padded("o_orderkey", 7, "a"), F.lit(".."), padded("o_custkey", 40, "b")))
    r = r.when(k == 2, F.lit("a..b")).when(k == 3, F.concat(padded("o_orderkey", 12, "c"), F.lit("..."), padded("o_custkey", 12, "c")))
    return Tables(spark, sf_dir).orders.select("o_orderkey", text.commit_range_start(r).alias("old_commit_hash"), text.commit_range_start(r, doubled=True).alias("doubled"))


@query("""WITH d AS (SELECT doc_id, text, substr(text, 1, length(text) // 4) AS a, substr(text, 1, length(text) // 2 + 1) AS b FROM documents), x AS (SELECT *, regexp_extract_all(hex(encode(a)), '..') AS h, regexp_extract_all(hex(encode(b)), '..') AS i FROM d)
SELECT doc_id, CASE WHEN text <> '' THEN CAST(len(list_filter(h, lambda c: c = '0A')) + 1 AS BIGINT) END AS start_line, CASE WHEN text <> '' THEN CAST(len(list_filter(i[:-2], lambda c: c = '0A')) + 1 AS BIGINT) END AS end_line,
CASE WHEN text <> '' THEN CAST(len(list_filter(i[:-2], lambda c: c = '0A')) - len(list_filter(h, lambda c: c = '0A')) + 1 AS BIGINT) END AS lines, CASE WHEN text <> '' THEN substr(b, length(a) + 1) ELSE '' END AS content FROM x""")
def spans_of_text(spark, sf_dir):
    """Lines, number of lines and text of a span of bytes in every document; a null or empty text has no lines and an empty span."""
    t = F.when(F.col("text") != "", F.col("text"))
    start = F.octet_length(F.substring(t, F.lit(1), F.floor(F.length(t) / 4).cast("int")))
    end = F.octet_length(F.substring(t, F.lit(1), (F.floor(F.length(t) / 2) + 1).cast("int")))
    d = Tables(spark, sf_dir).documents.select("doc_id", t.alias("text"), start.alias("s"), end.alias("e"))
    t, s, e = F.col("text"), F.col("s"), F.col("e")
    return d.select("doc_id", text.line_span(t, s, e).alias("span"), text.lines_of_span(t, s, e).alias("lines"), F.coalesce(text.span_text(t, s, e), F.lit("")).alias("content")).select("doc_id", "span.start_line", "span.end_line", "lines", "content")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(greatest(l_linenumber - 2, 0) AS INTEGER) AS zero_line, CAST(greatest(l_linenumber - 2, 0) + 1 AS INTEGER) AS one_line, CAST(l_partkey - l_linenumber AS BIGINT) AS length FROM lineitem")
def places_and_lengths(spark, sf_dir):
    """Places that count from 1 and from 0, and function lengths."""
    zero = text.zero_based(F.col("l_linenumber") - 1)
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", zero.alias("zero_line"), text.one_based(zero).alias("one_line"), text.function_length(F.col("l_linenumber"), F.col("l_partkey")).alias("length"))


def _sql_counts(a: str, b: str, c: str, d: str, level: int) -> str:
    pad = "chr(10) || '" + "    " * (level + 1)
    return "'{' || " + " || ',' || ".join(f"{pad}\"{n}\": ' || {x}" for n, x in (("unique_operators", a), ("unique_operands", b), ("operators", c), ("operands", d))) + f" || chr(10) || '{'    ' * level}}}'"


@query(f"""WITH f AS (SELECT l_suppkey AS file, 'f"' || l_orderkey || l_linestatus AS name, min(l_linenumber) AS a, max(l_linenumber) AS b, sum(l_linenumber) AS c, count(*) AS d FROM lineitem GROUP BY ALL),
j AS (SELECT file, CAST(sum(a) AS BIGINT) AS ta, CAST(sum(b) AS BIGINT) AS tb, CAST(sum(c) AS BIGINT) AS tc, CAST(sum(d) AS BIGINT) AS td, count(*) AS n_functions, string_agg(chr(10) || '        {{' || chr(10) || '            "name": "' || replace(name, '"', '\\"') || '",' || chr(10) || '            "metrics": ' || {_sql_counts('a', 'b', 'c', 'd', 3)} || chr(10) || '        }}', ',' ORDER BY name) AS listed FROM f GROUP BY file)
SELECT file, '{{' || chr(10) || '    "totals": ' || {_sql_counts('ta', 'tb', 'tc', 'td', 1)} || ',' || chr(10) || '    "functions": [' || listed || chr(10) || '    ]' || chr(10) || '}}' AS json, tc AS operators, n_functions FROM j""")
def counts_as_json(spark, sf_dir):
    """Counts of files and functions written as indented JSON, and read back from it."""
    l = Tables(spark, sf_dir).lineitem  # noqa: E741
    name = F.concat(F.lit('f"'), F.col("l_orderkey").cast("string"), "l_linestatus")
    n = F.col("l_linenumber").cast("long")
    f = l.groupBy(F.col("l_suppkey").alias("file"), name.alias("name")).agg(F.min(n).alias("unique_operators"), F.max(n).alias("unique_operands"), F.sum(n).alias("operators"), F.count(F.lit(1)).alias("operands"))
    names = ["unique_operators", "unique_operands", "operators", "operands"]
    files = f.groupBy("file").agg(F.struct(*[F.sum(c).alias(c) for c in names]).alias("totals"), F.array_sort(F.collect_list(F.struct("name", F.struct(*names).alias("metrics")))).alias("functions"))
    written = files.select("file", halstead.counts_json(F.col("totals"), F.col("functions"), 4).alias("json"))
    return written.withColumn("read", halstead.read_counts(F.col("json"))).select("file", "json", F.col("read.totals.operators").alias("operators"), F.size("read.functions").cast("long").alias("n_functions"))


@query("""WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS committed_at, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate + INTERVAL 1 DAY END AS created_at FROM orders) SELECT id, coalesce(committed_at, created_at) AS date FROM v WHERE coalesce(committed_at, created_at) IS NOT NULL""")
def timeline_dates(spark, sf_dir):
    """The date of each version on a chart; versions without one are left out."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    v = Tables(spark, sf_dir).orders.select(k.alias("id"), F.when(k % 3 != 0, day).alias("committed_at"), F.when(k % 6 != 0, day + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    return charts.dated(v).select("id", "date")


@query("""WITH e AS (SELECT l_suppkey % 10 AS file_id, 'f' || (l_suppkey % 50) AS caller, 'f' || (l_partkey % 60) AS callee, l_linenumber AS line, l_orderkey AS col FROM lineitem),
d AS (SELECT s_suppkey % 10 AS file_id, 'f' || (s_suppkey % 50) AS name, min(s_suppkey) AS d_line FROM supplier GROUP BY ALL), a AS (SELECT name, arg_min(d_line, file_id) AS a_line, min(file_id) AS a_file FROM d GROUP BY name)
SELECT CASE WHEN d_line IS NOT NULL THEN e.file_id ELSE a_file END AS path, CAST(coalesce(d_line, a_line) AS BIGINT) AS line, count(*) AS uses, CAST(min(e.line) AS INTEGER) AS first_line FROM e LEFT JOIN d ON d.file_id = e.file_id AND d.name = e.callee LEFT JOIN a ON a.name = e.callee WHERE coalesce(d_line, a_line) IS NOT NULL GROUP BY ALL""")
def references_of_definitions(spark, sf_dir):
    """The use sites of every definition."""
    t = Tables(spark, sf_dir)
    definitions = t.supplier.select((F.col("s_suppkey") % 10).alias("file_id"), (F.col("s_suppkey") % 10).alias("path"), F.concat(F.lit("f"), F.col("s_suppkey") % 50).alias("name"), F.col("s_suppkey").alias("line"), F.lit(1).alias("column"))
    found = calls.find_references(calls.resolve_calls(_edges(t), definitions))
    return found.select("definition.path", "definition.line", F.size("uses").cast("long").alias("uses"), F.array_min(F.transform("uses", lambda u: u["line"])).alias("first_line"))


# The further queries register themselves with the functions above.
from . import queries_diff, queries_order, queries_payload, queries_scope, queries_search, queries_stream  # noqa: E402, F401
