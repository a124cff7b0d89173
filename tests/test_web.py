"""The HTTP server against a small store."""

import datetime
import json
import threading
import urllib.error
import urllib.request

import pytest

from chronomill.plans.catalog import Catalog
from chronomill.plans.web import server

T0 = datetime.datetime(2024, 1, 1)
METRICS = (1, 2, 2, 0, 0, 1, 2.0, 2.0, 0.0, 0.0, 1.0)


@pytest.fixture(scope="module")
def ask(spark, tmp_path_factory):
    catalog = Catalog.open(spark, str(tmp_path_factory.mktemp("web")))
    make = lambda name, rows: catalog.write(name, spark.createDataFrame(rows, catalog.table(name).schema))
    fields = {n: catalog.table(n).columns for n in ("codebases", "versions", "files", "functions", "file_states", "diffs", "changes")}
    row = lambda table, **v: tuple(v.get(c) for c in fields[table])
    make("codebases", [row("codebases", id="c1", name="one", url="u", programming_language="Golang", created_at=T0), row("codebases", id="c2", name="two", url="u", programming_language="Ocaml", created_at=T0)])
    make("versions", [row("versions", id="v1", codebase_id="c1", seq=0, commit_hash="h", message="m", created_at=T0, metrics=METRICS, is_fix=False)])
    make("files", [row("files", id="f1", version_id="v1", path="lib/help.go", language="golang", created_at=T0), row("files", id="f2", version_id="v1", path="main.go", language="golang", created_at=T0)])
    make("functions", [row("functions", id="g1", file_id="f1", name="help:1:1", start_line=1, end_line=2, created_at=T0)])
    make("file_states", [row("file_states", id=f"s{i}", codebase_id="c1", version_id="v1", path=p, file_id=f"f{i}", status="added", exists=True, created_at=T0) for i, p in ((1, "lib/help.go"), (2, "main.go"))])
    make("diffs", [row("diffs", id="d1", version_id="v1", new_commit_hash="h", files_changed=2, insertions=3, deletions=0, changed_lines=3, summary="m", created_at=T0)])
    make("changes", [row("changes", id="x1", diff_id="d1", new_path="main.go", old_start_line=0, new_start_line=1, new_end_line=3, old_end_line=0, created_at=T0)])
    s = server(catalog, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}{path}") as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    yield get
    s.shutdown()


def test_routes(ask):
    assert ask("/health") == (200, {"status": "ok"})
    status, languages = ask("/codebases")
    assert status == 200 and {k: [c["name"] for c in v] for k, v in languages.items()} == {"Golang": ["one"], "Ocaml": ["two"]}
    assert ask("/codebase/c1")[1]["name"] == "one" and ask("/codebase/none") == (404, "codebase none not found")
    assert [d["id"] for d in ask("/codebase/c1/diff")[1]] == ["d1"] and ask("/codebase/none/diff") == (200, [])
    assert ask("/codebase/c1/metrics")[1][0]["metrics"]["files"] == 1
    version = ask("/version/v1")[1]
    assert version["commit_hash"] == "h" and version["committed_at"] is None
    assert ask("/version/v9") == (404, "version v9 not found")
    assert [f["path"] for f in ask("/version/v1/changed_files?limit=1&offset=1")[1]] == ["main.go"]
    assert [f["path"] for f in ask("/version/v1/files")[1]] == ["lib/help.go", "main.go"] and ask("/version/v9/files") == (200, [])
    assert ask("/version/v1/diff")[1]["files_changed"] == 2 and len(ask("/version/v1/diffchange")[1]["hunks"]) == 1
    assert [f["name"] for f in ask("/version/v1/functions")[1]] == ["help:1:1"]
    assert ask("/version/v1/files/search?q=help")[1][0]["path"] == "lib/help.go"
    assert ask("/version/v1/functions/search?q=help&limit=9999")[1][0]["file_path"] == "lib/help.go"


def test_errors(ask):
    assert ask("/version/v1/files/search")[0] == 400 and ask("/version/v1/changed_files?limit=x")[0] == 400
    assert ask("/version/v9/functions/search?q=a")[0] == 404 and ask("/version/v9/changed_files")[0] == 404
    assert ask("/nothing")[0] == 404 and ask("/version/v1/files/search?q=%20") == (200, [])
