import subprocess

import pytest
from pyspark.sql import functions as F

from chronomill.functions.ignore import ignored
from chronomill.plans.queries import PLACES, RULES

SETS = [
    RULES,
    ["*", "!*/", "!*.go"],
    ["**/foo/bar", "a/**/b", "c/**", "!c/keep"],
    ["x y\\ ", "\\#hash", "\\!not", "[!a-c]z", "*.tar.*", "deep/*/f", "/top"],
    ["foo/", "!foo/x.go", "bar", "!bar/"],
]
PATHS = [*(p.replace("{}", "7") for p in PLACES), "foo/bar", "k/foo/bar/x.go", "a/b", "a/x/b", "a/x/y/b", "c/keep", "c/d/e", "x y ", "#hash", "!not", "az", "dz", "q/dz", "p.tar.gz", "deep/k/f", "deep/k/l/f", "top", "s/top", "foo/x.go", "s/foo/y.go", "bar/z.go", "main.go", "m/main.go", "ü.log"]


@pytest.mark.parametrize("rules", SETS)
def test_rules_equal_git(spark, tmp_path, rules):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True, capture_output=True)
    (tmp_path / ".gitignore").write_text("\n".join(rules) + "\n")
    asked = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(PATHS).encode(), capture_output=True)
    want = set(asked.stdout.decode().split("\0")) - {""}
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    got = {r["p"] for r in df.where(ignored(F.col("p"), rules)).collect()}
    assert got == want
