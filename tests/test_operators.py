import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronomill.functions.text import basename
from chronomill.operators import asof, diffs, listing, merge, rollup, search, tokens
from chronomill.streaming.ingest import merge_stream
from chronomill.plans.catalog import Catalog

T0 = datetime.datetime(2024, 1, 1)


def history(spark):
    at = lambda h: T0 + datetime.timedelta(hours=h)
    versions = spark.createDataFrame([("v1", "c", at(1)), ("v2", "c", at(2)), ("v3a", "c", at(3)), ("v3b", "c", at(3)), ("w1", "d", at(1)), ("v4", "c", at(4))], "id string, codebase_id string, created_at timestamp")
    rows = [("v1", "a", True), ("v1", "b", True), ("v2", "a", False), ("v2", "x", True), ("v3a", "b", False), ("v3b", "b", True), ("v3b", "a", True)]
    states = spark.createDataFrame([(f"s{i}", "c", v, p, e) for i, (v, p, e) in enumerate(rows)] + [("s9", "d", "w1", "a", True)], "id string, codebase_id string, version_id string, path string, exists boolean")
    return states, versions


def test_asof_cases(spark):
    states, versions = history(spark)
    paths = lambda v, **k: [r["path"] for r in asof.asof_files(states, versions, v, **k).collect()]
    assert paths("v1") == ["a", "b"]
    assert paths("v2") == ["b", "x"]  # deleted
    assert paths("v3a") == ["x"]
    assert paths("v3b") == ["a", "b", "x"]  # the same time, the id decides; a is back
    assert paths("v4") == ["a", "b", "x"]  # touches nothing
    assert paths("w1") == ["a"] and paths("none") == [] and paths("v4", codebase_id="d") == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans(), st.integers(0, 9)), min_size=1, max_size=15))
def test_running_totals_equal_snapshots(spark, log):
    rows = [("g", i, p, e, m) for i, (p, e, m) in enumerate(log)]
    df = spark.createDataFrame(rows, "g string, seq int, path int, exists boolean, m int")
    got = {r["seq"]: (r["files"], r["total_m"]) for r in rollup.version_totals(df, "g", "path", ["seq"], ["m"]).collect()}
    state = {}
    for _, i, p, e, m in rows:
        state[p] = m if e else None
        alive = [v for v in state.values() if v is not None]
        assert got[i] == (len(alive), sum(alive))


def test_reconcile_and_totals(spark):
    files = spark.createDataFrame([("x", 10, 8, 2, 1, 3), ("x", 20, 15, 5, 3, 7)], ["g", *rollup.METRICS])
    row = rollup.totals(files, ["g"]).first()
    assert tuple(row)[1:] == (2, 30, 23, 7, 4, 10)
    names = ["g", "files", *[f"total_{m}" for m in rollup.METRICS]]
    side = lambda *v: spark.createDataFrame([("x", *v)], names)
    got = rollup.reconcile(side(3, 60, 50, 10, 9, 15), side(1, 20, 16, 4, 3, 3), side(1, 15, 12, 3, 2, 5), ["g"]).first()
    assert tuple(got)[1:] == (3, 55, 46, 9, 8, 17)
    assert rollup.reconcile(side(0, 0, 0, 0, 0, 0), side(1, 5, 5, 5, 5, 5), side(1, 1, 1, 1, 1, 1), ["g"]).first()["files"] == 1


def test_means_without_files_are_zero(spark):
    empty = spark.createDataFrame([("x", 0, 0, 0, 0, 0, 0)], ["g", "files", *[f"total_{m}" for m in rollup.METRICS]])
    assert rollup.with_means(empty).first()["mean_lines_of_code_per_file"] == 0.0


def test_merge_twice_is_merge_once(spark):
    old = spark.createDataFrame([("k1", "i1", 1), (None, "i2", 2)], "k string, id string, v int")
    new = spark.createDataFrame([("k1", "x", 5), (None, "y", 6), ("k2", "z", 7), ("k2", "z2", 8)], "k string, id string, v int")
    once = merge.keyed_merge(old, new, ["k"], order=["v"])
    assert sorted(map(str, once.collect())) == sorted(map(str, merge.keyed_merge(once, new, ["k"], order=["v"]).collect()))
    assert {r["k"]: (r["id"], r["v"]) for r in once.collect()} == {"k1": ("i1", 5), None: ("i2", 6), "k2": ("z2", 8)}
    assert merge.keyed_merge(old, new.limit(0), ["k"], ["v"]).count() == 2


def test_last_delta_of_a_path_wins(spark):
    deltas = spark.createDataFrame([("v", 0, "p", "p", "deleted"), ("v", 1, "p", "p", "added"), ("v", 2, "o", "n", "renamed"), ("v", 3, "q", "q", "modified")], "version_id string, seq int, old_path string, new_path string, status string")
    analyses = spark.createDataFrame([("v", "p", "f1", 1), ("v", "n", "f2", 2)], "version_id string, path string, file_id string, metrics int")
    got = {r["path"]: (r["exists"], r["source_path"]) for r in diffs.file_states(deltas, analyses, ["version_id"]).collect()}
    assert got == {"p": (True, None), "o": (False, None), "n": (True, "o")}


def test_stream_merge_equals_batch(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "store"))
    rows = [(f"c{i}", f"n{i % 3}", "u", "Golang", T0 + datetime.timedelta(hours=i)) for i in range(6)]
    table = spark.createDataFrame(rows, catalog.table("codebases").schema)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again it finds nothing new
        merge_stream(stream, catalog, "codebases", str(tmp_path / "check"), order=["created_at"]).awaitTermination()
    assert catalog.table("codebases").count() == 3
    assert catalog.table("codebases").select(F.count_distinct("name")).first()[0] == 3


def test_late_batches_and_repeated_keys(spark):
    kind = "k string, id string, at int, v string"
    old = spark.createDataFrame([("a", "i1", 5, "old"), ("b", "i2", 5, "old")], kind)
    late = spark.createDataFrame([("a", "x", 4, "late"), ("b", "y", 6, "new"), ("b", "z", 6, "new too"), ("c", "w", 1, "first")], kind)
    got = {r["k"]: (r["id"], r["at"], r["v"]) for r in merge.keyed_merge(old, late, ["k"], ["at"]).collect()}
    assert got["a"] == ("i1", 5, "old") and got["b"][:2] == ("i2", 6) and got["c"] == ("w", 1, "first")
    assert merge.keyed_merge(old, late, ["k"], ["at"]).count() == 3


def test_callers_columns_stay(spark):
    rows = spark.createDataFrame([("a", 1, 9, 7), ("a", 2, 8, 6)], "path string, at int, n int, rank int")
    assert [tuple(r) for r in asof.newest(rows, ["path"], ["at"]).collect()] == [("a", 2, 8, 6)]
    assert [tuple(r) for r in diffs.first_of_each(rows, ["path"], ["at"]).collect()] == [("a", 1, 9, 7)]
    assert tokens.first_by_name(rows, ["path"], "at").columns == rows.columns


def codebases(spark, catalog, *names):
    return spark.createDataFrame([(f"i-{n}", n, "u", "Golang", T0) for n in names], catalog.table("codebases").schema)


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """A commit of another writer between a reader's look and its own commit is not lost."""
    a, b = (Catalog.open(spark, str(tmp_path / "store")) for _ in range(2))
    write = a._write_data
    meets = iter([True])

    def slow(name, rows):
        data = write(name, rows)
        if next(meets, False):
            b.upsert("codebases", codebases(spark, b, "two"))
        return data

    monkeypatch.setattr(a, "_write_data", slow)
    a.upsert("codebases", codebases(spark, a, "one"))
    assert sorted(r["name"] for r in a.table("codebases").collect()) == ["one", "two"]
    assert a.vacuum() == 0 and a.vacuum(hours=0) > 0 and b.table("codebases").count() == 2


def test_a_change_writes_its_codebases_only(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "store"))
    kind = catalog.table("file_states").schema
    rows = lambda *xs: spark.createDataFrame([(f"s{c}{v}{p}", c, v, p, None, "added", True, None, None, T0) for c, v, p in xs], kind)
    catalog.upsert("file_states", rows(("c1", "v1", "a"), ("c/2", "v2", "b")))
    before = catalog._state("file_states")[1]
    catalog.upsert("file_states", rows(("c/2", "v2", "b"), ("c/2", "v3", "x")))
    after = catalog._state("file_states")[1]
    assert set(before) == set(after) == {"c1", "c/2"} and before["c1"] == after["c1"] and before["c/2"] != after["c/2"]
    assert sorted((r["codebase_id"], r["path"]) for r in catalog.table("file_states").collect()) == [("c/2", "b"), ("c/2", "x"), ("c1", "a")]


def test_a_late_stream_batch_changes_nothing(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "store"))
    rows = [("i", "n", f"u{h}", "Golang", T0 + datetime.timedelta(hours=h)) for h in (1, 5, 3)]
    schema = catalog.table("codebases").schema
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in/{i}"))
        merge_stream(stream, catalog, "codebases", str(tmp_path / f"check{i}"), ["created_at"]).awaitTermination()
    assert [r["url"] for r in catalog.table("codebases").collect()] == ["u5"]


def test_hunks_of_one_diff_only(spark):
    d = spark.createDataFrame([("d1", "v1"), ("d2", "v2")], "id string, version_id string")
    c = spark.createDataFrame([("d1", "b", 3, 1), ("d2", "a", 1, 1), ("d1", "a", 2, 1)], "diff_id string, new_path string, old_start_line int, new_start_line int").withColumn("old_path", F.lit(None).cast("string"))
    (row,) = listing.diff_with_hunks(d, c, version_id="v1").collect()
    assert [h["new_path"] for h in row["hunks"]] == ["a", "b"]
    assert len(listing.diff_with_hunks(d, c).collect()) == 2


def test_a_version_again_loses_its_diff_until_it_is_set(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "store"))
    fields = catalog.table("versions").schema
    row = lambda **v: spark.createDataFrame([tuple(v.get(c) for c in fields.names)], fields)
    catalog.upsert("versions", row(id="v1", codebase_id="c", commit_hash="h", seq=0, diff="d1", created_at=T0))
    later = T0 + datetime.timedelta(hours=1)
    catalog.upsert("versions", row(id="other", codebase_id="c", commit_hash="h", seq=0, message="again", created_at=later))
    (got,) = catalog.table("versions").collect()
    assert (got["id"], got["created_at"], got["message"], got["diff"]) == ("v1", T0, "again", None)


def test_indexed_search_finds_what_scoring_all_rows_finds(spark):
    parts = ["src", "Page_7", "page 7b", "größe", "x%y", "a", "list.ml", "b\\c", "ΟΔΟΣ"]
    paths = [f"{p}/{q}{i if i % 3 else ''}/{r}" for i, (p, q, r) in enumerate((p, q, r) for p in parts for q in parts[:4] for r in parts)]
    files = spark.createDataFrame([*enumerate([*paths, "", "a", None])], "id long, path string")
    index = search.trigram_index(files, "id", "path").cache()
    names = search.trigram_index(files.select("id", basename(F.col("path")).alias("name")), "id", "name").cache()
    open_ = []  # queries without a trigram that every text holding them has
    for query in ["page_7", "age 7", "st.m", "RÖSS", "x%y", "c/gr", "b\\\\c", "\\%y", "ge 7b/l", "ΔΟΣ", "7", " ", "a"]:
        rows = lambda found: [(r["id"], r["score"]) for r in found.orderBy("id").collect()]
        assert rows(search.rank_files_indexed(files, index, names, "id", query, 1000)) == rows(search.rank_files(files, query, 1000)), query
        open_ += [query] if search.holders(index, "id", query) is None else []
    assert open_ == ["x%y", "b\\\\c", "\\%y", "7", " ", "a"]


def test_rows_of_another_writer_survive_a_delete(spark, tmp_path, monkeypatch):
    """A row that comes between what a delete reads and what it writes stays, and so does its uncommitted data."""
    store = Catalog.open(spark, f"file://{tmp_path}/store")
    row = lambda name: spark.createDataFrame([(name, name, None, None, None)], "id string, name string, url string, programming_language string, created_at timestamp")
    store.upsert("codebases", row("a").union(row("b")))
    other = Catalog.open(spark, f"file://{tmp_path}/store")
    real = Catalog._write_data
    calls = []

    def late(self, name, rows):
        out = real(self, name, rows)
        if name == "codebases" and not calls:
            calls.append(name)
            other.upsert("codebases", row("c"))
            other.vacuum()
        return out

    monkeypatch.setattr(Catalog, "_write_data", late)
    assert store.delete("codebases", "a") and not store.delete("codebases", "a")
    assert sorted(r["id"] for r in store.table("codebases").collect()) == ["b", "c"] and calls == ["codebases"]


def test_an_unfinished_commit_is_waited_for(spark, tmp_path, monkeypatch):
    from chronomill.plans import catalog
    from chronomill.shared import file_system

    store = Catalog.open(spark, f"file://{tmp_path}/store")
    fs, where = file_system(spark, f"file://{tmp_path}/store/codebases/_commits/{2:012d}")
    fs.create(where, False).close()
    monkeypatch.setattr(catalog, "WAITS", 2)
    with pytest.raises(catalog.Conflict):
        store.table("codebases")
    fs.delete(where, False)
    assert store.table("codebases").count() == 0


def test_ties_of_a_merge_are_settled_alike(spark):
    old = spark.createDataFrame([], "k int, id int, a string, b string")
    rows = [(1, 1, None, "x"), (1, 1, "x", None), (1, 1, "y", "y")]
    once = [merge.keyed_merge(old, spark.createDataFrame(r, old.schema), ["k"], ["id"]).collect() for r in (rows, rows[::-1])]
    assert once[0] == once[1] and len(once[0]) == 1


def test_innermost_functions_of_one_name_in_two_files(spark):
    """A function is known by its file and place, not by its name; a token gives one row however many functions hold it."""
    found = spark.createDataFrame([("a", 1, 5), ("a", 2, 15), ("a", 3, 99), ("b", 1, 5), ("c", 1, 5)], "file_id string, token_no int, line int")
    functions = spark.createDataFrame([("a", "f", 0, 20), ("a", "g", 3, 6), ("a", "f", 4, 5), ("b", "g", 0, 9), ("b", "f", 0, 9)], "file_id string, name string, start_line int, end_line int")
    got = tokens.innermost_functions(found, functions)
    assert sorted(tuple(r) for r in got.select("file_id", "token_no", "function").collect()) == [("a", 1, "f"), ("a", 2, "f"), ("b", 1, "g")]
