"""Both searches as of a version, and the similarity they rank by, as SQL functions of a session.

``register`` makes temporary functions over any tables or views of the store's columns::

    SELECT * FROM search_version_filenames('v7', 'parse')
    SELECT * FROM search_version_functions('v7', 'parse', 25)
    SELECT v.id, f.path FROM versions v, LATERAL search_version_filenames(v.id, 'parse', 3) f

They give what operators/search.py gives: nothing for an unknown version or a blank query.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.trigrams import THRESHOLD

TABLES = ("versions", "file_states", "files", "functions")

TRIGRAMS = r"""CREATE OR REPLACE TEMPORARY FUNCTION trigrams(text STRING) RETURNS ARRAY<STRING>
RETURN array_distinct(flatten(transform(filter(split(lower(text), '[^\\p{L}\\p{N}]+'), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"""

SIMILARITY = """CREATE OR REPLACE TEMPORARY FUNCTION trigram_similarity(a STRING, b STRING) RETURNS FLOAT
RETURN CAST(CASE WHEN size(array_union(trigrams(a), trigrams(b))) > 0 THEN size(array_intersect(trigrams(a), trigrams(b))) / size(array_union(trigrams(a), trigrams(b))) ELSE 0.0 END AS FLOAT)"""

#: A backslash before an ordinary character is that character; one at the end is itself.
PATTERN = r"""CREATE OR REPLACE TEMPORARY FUNCTION holding_pattern(query STRING) RETURNS STRING
RETURN concat('%', regexp_replace(regexp_replace(query, '(\\\\[%_\\\\])|\\\\(?=.)', '$1'), '^((?:[^\\\\]|\\\\.)*)\\\\$', '$1\\\\\\\\'), '%')"""

#: The path is taken from the newest row: a filter on the grouping key would be moved before the grouping, to every state.
CURRENT = """CREATE OR REPLACE TEMPORARY FUNCTION current_states(version {id}) RETURNS TABLE (id {state}, file_id {file}, path STRING, status STRING)
RETURN SELECT newest.id, newest.file_id, newest.path, newest.status FROM (
  SELECT max_by(struct(s.id, s.file_id, s.path, s.status, s.exists), struct(v.created_at, v.id)) AS newest
  FROM {file_states} s JOIN {versions} v ON v.id = s.version_id JOIN {versions} t ON t.id = current_states.version
  WHERE s.codebase_id = t.codebase_id AND v.codebase_id = t.codebase_id AND (v.created_at < t.created_at OR v.created_at = t.created_at AND v.id <= t.id) GROUP BY s.path
) WHERE newest.exists"""

FILENAMES = f"""CREATE OR REPLACE TEMPORARY FUNCTION search_version_filenames(version {{id}}, query STRING, most INT DEFAULT 50)
RETURNS TABLE (file_state_id {{state}}, file_id {{file}}, path STRING, status STRING, score FLOAT)
RETURN SELECT id, file_id, path, status, score FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, path ASC NULLS LAST) AS place FROM (
    SELECT *, trigram_similarity(path, search_version_filenames.query) AS whole, trigram_similarity(substring_index(path, '/', -1), search_version_filenames.query) AS part, greatest(whole, part) AS score
    FROM current_states(search_version_filenames.version)
  ) WHERE trim(search_version_filenames.query) <> '' AND (score >= CAST({THRESHOLD} AS FLOAT) OR path ILIKE holding_pattern(search_version_filenames.query))
) WHERE place <= search_version_filenames.most"""

FUNCTIONS = f"""CREATE OR REPLACE TEMPORARY FUNCTION search_version_functions(version {{id}}, query STRING, most INT DEFAULT 50)
RETURNS TABLE (function_id {{function}}, file_id {{file}}, file_path STRING, file_language STRING, name STRING, start_line INT, end_line INT, score FLOAT)
RETURN SELECT function_id, file_id, path, language, name, start_line, end_line, score FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, path ASC NULLS LAST, start_line ASC NULLS LAST, name ASC NULLS LAST) AS place FROM (
    SELECT n.id AS function_id, f.id AS file_id, c.path, f.language, n.name, n.start_line, n.end_line,
      greatest(trigram_similarity(n.name, search_version_functions.query), trigram_similarity(c.path, search_version_functions.query)) AS score
    FROM current_states(search_version_functions.version) c JOIN {{files}} f ON f.id = c.file_id JOIN {{functions}} n ON n.file_id = f.id
  ) WHERE trim(search_version_functions.query) <> '' AND (score >= CAST({THRESHOLD} AS FLOAT) OR name ILIKE holding_pattern(search_version_functions.query) OR path ILIKE holding_pattern(search_version_functions.query))
) WHERE place <= search_version_functions.most"""


def register(spark: SparkSession, **views: str) -> None:
    """Makes the functions over the named tables or views; those not named are called versions, file_states, files, functions."""
    names = {t: views.get(t, t) for t in TABLES}
    kind = lambda table, column: spark.table(names[table]).schema[column].dataType.simpleString()
    known = names | {"id": kind("versions", "id"), "state": kind("file_states", "id"), "file": kind("file_states", "file_id"), "function": kind("functions", "id")}
    for text in (TRIGRAMS, SIMILARITY, PATTERN):
        spark.sql(text)
    for text in (CURRENT, FILENAMES, FUNCTIONS):
        spark.sql(text.format(**known))
