import subprocess

import pytest
from pyspark.sql import functions as F

from chronomill.plans.api import NotFound, Queries
from chronomill.plans.catalog import Catalog
from chronomill.plans.ingest import ingest
from chronomill.sources import gitlog, go_source, ocaml_source, python_source
from chronomill.sources.entities import Places

GO = """package shop

// price gives what a basket costs
// after all reductions
func price(items []Item, member bool) int {
    total := 0 // so far
    for _, it := range items {
        if it.Count > 0 && !it.Free {
            total += it.Count * it.Cents
        }
    }
    if member || total > 10000 {
        total -= total / 10
    }
    switch {
    case total > 50000:
        return total - 500
    case total > 20000:
        return total - 100
    case total < 0:
        return 0
    }
    return total
}
"""


def test_go_counts():
    a = go_source.analyse(GO)
    assert len(a.functions) == 1 and len(a.comments) == 3
    # One loop, two ifs, && and ||: 6 with the function itself; three cases, or one switch.
    assert (a.functions[0].cyclomatic, a.functions[0].cyclomatic_single) == (9, 7)


def test_go_straight_line_is_one():
    f = go_source.analyse("package main\n\nfunc identity(value int) int {\n    result := value + 1\n    return result\n}\n").functions[0]
    assert (f.cyclomatic, f.cyclomatic_single, f.name, f.start_line, f.end_line) == (1, 1, "identity", 3, 6)


def test_go_methods_literals_and_calls():
    a = go_source.analyse('package m\nfunc (r *T[K]) Do(x interface{}) (struct{}, error) { go func() { a.b(c[0](1), []byte("s")) }(); return z() }\nfunc Ext(x int) int\n')
    assert [(f.name, f.start_line) for f in a.functions] == [("Do", 2), ("Ext", 3)]
    assert {c[0] for c in a.functions[0].calls} >= {"a.b", "c[0]", "z"} and "byte" not in {c[0] for c in a.functions[0].calls}


def test_ocaml_guards_and_wildcards():
    f = ocaml_source.analyse("let rec total items =\n  match items with\n  | [] -> 0\n  | first :: rest when first > 0 -> first + total rest\n  | _ :: rest -> total rest\n").functions
    # Three arms and a guard, or one match.
    assert len(f) == 1 and (f[0].cyclomatic, f[0].cyclomatic_single) == (5, 2)


def test_ocaml_parenthesised_callee():
    f = ocaml_source.analyse("let twice x =\n  let y = (step) x in\n  (step) y\n").functions[0]
    assert [c for c in f.calls if c[1] == 3] == [("step", 3, 4)]


def test_ocaml_nested_bindings_and_modules():
    a = ocaml_source.analyse("let rec f x = let y = g x in if y then h y else 0\nand w () = f 1\nmodule M = struct\n  let z = try q 1 with Not_found -> 2\nend\n(* a (* nested *) comment *)\n")
    assert [(f.name, f.start_line, f.end_line) for f in a.functions] == [("f", 1, 1), ("y", 1, 1), ("w", 2, 2), ("z", 4, 4)]
    assert len(a.comments) == 1 and a.error is None
    assert ocaml_source.analyse("let x = (* open").error


def test_python_counts():
    a = python_source.analyse("class A:\n    @d(1)\n    async def f(self):\n        'doc'\n        if a and b or c: g(1)\n        elif d: pass\n        match x:\n            case 1: pass\n            case _: pass\n        def inner(): return self.k(2) if p else 3\n")
    f, inner = a.functions
    assert (f.name, f.line, f.column, f.cyclomatic, f.cyclomatic_single) == ("f", 3, 15, 7, 6)
    assert [c[0] for c in f.calls] == ["g"] and [c[0] for c in inner.calls] == ["self.k"] and inner.cyclomatic == 2
    assert len(a.comments) == 1
    assert python_source.analyse("def f(:").error


def test_python_compat_counts_any_statement_expression():
    source = "f()\n'doc'\n"
    assert len(python_source.analyse(source).comments) == 1
    assert len(python_source.analyse(source, compat=True).comments) == 2


def test_places():
    p = Places("first\nsécond")
    assert p.place(6) == (2, 1) and p.offset(2, 1) == 6 and p.place(8) == (2, 4) and p.offset(9, 1) is None


def run(folder, *args):
    subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_AUTHOR_NAME": "Test Author", "GIT_AUTHOR_EMAIL": "test@example.com", "GIT_COMMITTER_NAME": "Test Author", "GIT_COMMITTER_EMAIL": "test@example.com", "HOME": str(folder)})


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    folder = tmp_path_factory.mktemp("history") / "gopher.git"
    folder.mkdir()
    run(folder, "init", "-q", "-b", "main")
    steps = [
        ("Initial commit", {"main.go": "package main\n\nfunc main() {\n\thelp(1)\n}\n", "README": "x\n"}, []),
        ("Fix: add lib", {"lib/help.go": "package lib\n\n// help\nfunc help(a int) int {\n\tif a > 0 && a < 9 {\n\t\treturn help(a - 1)\n\t}\n\treturn a\n}\n"}, []),
        ("Change main", {"main.go": "package main\n\nfunc main() {\n\thelp(2)\n\thelp(3)\n}\n"}, []),
        ("Docs only", {"README": "y\n"}, []),
        ("Drop lib", {}, ["lib/help.go"]),
    ]
    for message, files, gone in steps:
        for name, content in files.items():
            (folder / name).parent.mkdir(exist_ok=True)
            (folder / name).write_text(content)
        for name in gone:
            (folder / name).unlink()
        run(folder, "add", "-A")
        run(folder, "commit", "-q", "-m", message)
    return str(folder)


def test_git_tables(spark, repo):
    commits = gitlog.read(spark, repo, "commits").orderBy("seq").collect()
    assert [c["message"].rstrip() for c in commits] == ["Initial commit", "Fix: add lib", "Change main", "Docs only", "Drop lib"]
    assert commits[0]["parent_hash"] is None and commits[1]["author_email"] == "test@example.com"
    deltas = {(r["seq"], r["new_path"]): (r["status"], r["insertions"], r["deletions"]) for r in gitlog.read(spark, repo, "deltas").collect()}
    assert deltas[0, "main.go"] == ("added", 5, 0) and deltas[2, "main.go"] == ("modified", 2, 1) and deltas[4, "lib/help.go"] == ("deleted", 0, 9)
    hunks = gitlog.read(spark, repo, "hunks").where("seq = 2").collect()
    assert [(h["old_start_line"], h["old_lines"], h["new_start_line"], h["new_lines"]) for h in hunks] == [(1, 5, 1, 6)]
    blobs = gitlog.read(spark, repo, "blobs").count()
    assert blobs == 5


@pytest.fixture(scope="module")
def store(spark, repo, tmp_path_factory):
    catalog = Catalog.open(spark, str(tmp_path_factory.mktemp("store")))
    return catalog, ingest(catalog, repo)


def test_ingest_and_queries(spark, store):
    catalog, codebase = store
    q = Queries(catalog)
    versions = q.codebase_metrics(codebase).orderBy("seq").collect()
    assert [v["is_fix"] for v in versions] == [False, True, False, False, False]
    assert [v["metrics"]["files"] for v in versions] == [1, 2, 2, 2, 1]
    assert versions[1]["metrics"]["total_lines_of_code"] == 14 and versions[3]["metrics"] == versions[2]["metrics"]
    assert [r["path"] for r in q.current_files(versions[3]["id"]).collect()] == ["lib/help.go", "main.go"]
    assert [r["path"] for r in q.current_files(versions[4]["id"]).collect()] == ["main.go"]
    functions = q.all_functions(versions[2]["id"]).collect()
    assert [(f["path"], f["name"]) for f in functions] == [("lib/help.go", "help:4:6"), ("main.go", "main:3:6")]
    assert functions[0]["metrics"]["cyclomatic"] == 3 and functions[0]["metrics"]["indegree"] == 0 and functions[0]["metrics"]["outdegree"] == 1
    assert q.search_filenames(versions[2]["id"], "help").first()["path"] == "lib/help.go"
    assert q.search_functions(versions[2]["id"], "main").first()["name"] == "main:3:6"
    assert q.search_filenames(versions[2]["id"], " ").count() == 0
    diff = q.version_diff_changes(versions[2]["id"]).first()
    assert (diff["files_changed"], diff["changed_lines"], len(diff["hunks"])) == (1, 3, 1) and b"+\thelp(3)" in diff["patch"]
    with pytest.raises(NotFound):
        q.changed_files("none")
    assert q.current_files("none").count() == 0
    assert q.chart(codebase).where("metric = 'files'").count() == 5
    assert q.codebases_by_language().first()["programming_language"] == "Golang"


def test_ingest_again_changes_nothing(spark, store, repo):
    catalog, codebase = store
    before = {n: catalog.table(n).drop("created_at").collect() for n in ("versions", "functions", "file_states", "changes")}
    assert ingest(catalog, repo) == codebase
    assert ingest(catalog, repo, from_seq=3) == codebase
    for n, rows in before.items():
        assert sorted(map(str, rows)) == sorted(map(str, catalog.table(n).drop("created_at").collect())), n


def test_delete_cascades(spark, store):
    catalog, _ = store
    file_id = catalog.table("files").where("path = 'main.go'").first()["id"]
    functions = catalog.table("functions").where(F.col("file_id") == file_id).count()
    assert functions and catalog.delete("files", file_id) and not catalog.delete("files", file_id)
    assert catalog.table("functions").where(F.col("file_id") == file_id).count() == 0
    assert catalog.table("file_states").where(F.col("file_id") == file_id).count() == 0
    assert catalog.table("file_states").where("file_id is null and exists").count() == 1


def test_files_with_ignore_rules_and_together(spark, store, tmp_path):
    for name, text in {"a.py": "def f():\n    return 1", "b.py": "def g():\n    return 2\n", "skip.py": "def h(): pass\n", ".rules": "skip.*\n"}.items():
        (tmp_path / name).write_text(text)
    q = Queries(store[0])
    rows = q.analyse_file(f"{tmp_path}/*.py", "python", ignore=f"{tmp_path}/.rules").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rows) == ["a.py", "b.py"]
    (both,) = q.analyse_file(f"{tmp_path}/*.py", "python", ignore=f"{tmp_path}/.rules", together=True).collect()
    assert [f["name"] for f in both["functions"]] == ["f", "g"] and both["lines_of_code"] == 4


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_what_was_analysed_is_read_by_all_branches(spark):
    """Four branches of the Halstead measures share one pass of the parser."""
    from chronomill.sources import analysis

    sources = spark.createDataFrame([("a", "golang", "package p\nfunc f() int { return 1 }\n"), ("b", "ocaml", "let f = 1\n")], "content_key string, language string, text string")
    found = analysis.function_halstead(analysis.parsed(sources))
    assert "MapInArrow" not in _optimized(found)
    assert sorted((r["content_key"], r["function"], r["operands"]) for r in found.collect()) == [("a", "f", 3), ("b", "f", 2)]


def test_a_text_is_made_once_for_parser_and_metrics(spark):
    from chronomill.sources import analysis

    files = spark.createDataFrame([(str(k), "golang", f"package p\n// {k}\n ;  \n\n ;; \n[]\nfunc f() {{}}\n") for k in range(600)], "path string, language string, text string").withColumn("text", F.regexp_replace("text", "[0-9]+", "x$0"))
    found = analysis.file_analysis(files)
    assert "regexp_replace" not in _optimized(found)
    assert {(r["lines_of_code"], r["blank_lines"], r["bracket_lines_of_code"], len(r["functions"]), r["comments"][0]["text"] == f"// x{r['path']}") for r in found.collect()} == {(7, 1, 2, 1, True)}
