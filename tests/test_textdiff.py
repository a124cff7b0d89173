"""Hunks between texts: edits rebuild the new text, keep as many lines as a plain program where lines are unlike, and give git's hunks."""

import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from chronomill.operators import textdiff

T = "id long, text string, edits string"


def scripts(spark, pairs):
    old, new = (spark.createDataFrame([(p[0], p[k], "x") for p in pairs], T) for k in (1, 2))
    return textdiff.edit_scripts(old, new, ["id"])


def cut(text):
    return [x for x in re.split("(?<=\n)", text or "") if x]


TEXTS = [
    (1, "a\nb\nc\n", "a\nb\nc\n"),
    (2, "", "a\nb"),
    (3, "a\nb", ""),
    (4, None, None),
    (5, "a\nb\nc", "a\nb\nc\n"),
    (6, "a\n\nb\n\nc\n\n", "a\n\nx\n\nb\n\nc\n\n"),
    (7, "a\nb\nc\nd\ne\n", "e\nb\nc\nd\na\n"),
    (None, "ä\nß\n", "ß\nä\n"),
    (8, "\n\n\n", "\n"),
]


def rebuilt(old, edits):
    lines, out, at = cut(old), [], 0
    for e in edits:
        assert e.old_from >= at and (e.old_to > e.old_from or e.added)
        out += lines[at : e.old_from] + list(e.added)
        at = e.old_to
    return "".join(out + lines[at:])


def random_pairs(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        old = [f"{rng.randrange(rng.choice([3, 12, 400]))}\n" for _ in range(rng.randrange(60))]
        new = [x for x in old if rng.random() > 0.1]
        for _ in range(rng.randrange(6)):
            new.insert(rng.randrange(len(new) + 1), f"{rng.randrange(20)}\n")
        if len(new) > 9 and rng.random() < 0.4:
            new = new[5:] + new[:5]
        yield 100 + i, "".join(old), "".join(new).removesuffix("\n" if rng.random() < 0.3 else "-")


def test_edits_make_the_new_text(spark):
    pairs = TEXTS + list(random_pairs(1, 120))
    rows = scripts(spark, pairs).withColumn("made", textdiff.patched(F.col("old_text"), F.col("edits"))).collect()
    assert sorted(r.id for r in rows) == sorted(p[0] for p in pairs if p[0] is not None)
    for r in rows:
        assert r.made == r.new_text == rebuilt(r.old_text, r.edits)
    of = {r.id: [(e.old_from, e.old_to, e.new_from, e.new_to) for e in r.edits] for r in rows}
    assert of[1] == [] and of[4] == []
    assert of[2] == [(0, 0, 0, 2)] and of[3] == [(0, 2, 0, 0)]
    assert of[5] == [(2, 3, 2, 3)]
    assert of[6] == [(2, 2, 2, 4)]
    assert of[7] == [(0, 1, 0, 1), (4, 5, 4, 5)]


def recursive(old, new):
    """The length of a longest common subsequence."""
    best = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, x in enumerate(old):
        for j, y in enumerate(new):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_fewest_changes_where_lines_are_unlike(spark):
    rng = random.Random(2)
    pairs = []
    for i in range(40):
        old = [f"{x}\n" for x in rng.sample(range(60), 30)]
        new = [f"{x}\n" for x in rng.sample(range(60), 30)]
        pairs.append((i, "".join(old), "".join(new)))
    for r in scripts(spark, pairs).collect():
        old, new = cut(r.old_text), cut(r.new_text)
        # A shared first or last line always belongs to some longest common subsequence, so the whole is one.
        assert len(old) - sum(e.old_to - e.old_from for e in r.edits) == recursive(old, new)


def test_hunks_equal_those_of_git(spark, tmp_path):
    pairs = [(i, o, n) for i, o, n in random_pairs(3, 40) if o != n]
    unlike = [(1, "".join(f"{i}\n" for i in range(50)), "".join(f"{i}\n" for i in range(50) if i not in (0, 7, 9, 30, 49)) + "end"), (2, "x\n", ""), (3, "", "x\n"), (4, "a\nb\n", "a\nb\nc\n"), (5, "".join(f"{i}\n" for i in range(30)), "".join(f"{i}\n" for i in range(30) if i not in (5, 12, 20)))]
    found = {}
    for r in textdiff.hunks(scripts(spark, unlike + pairs), ["id"]).orderBy("id", "hunk").collect():
        assert r.old_end_line == r.old_start_line + r.old_lines and r.new_span_length == r.new_lines
        found.setdefault(r.id, []).append((r.old_start_line, r.old_lines, r.new_start_line, r.new_lines))
    for i, old, new in unlike:
        (tmp_path / "old").write_text(old)
        (tmp_path / "new").write_text(new)
        out = subprocess.run(["git", "diff", "--no-index", "--no-color", "-U3", "--patience", "old", "new"], cwd=tmp_path, capture_output=True, text=True).stdout
        heads = [x.split()[1:3] for x in out.splitlines() if x.startswith("@@ ")]
        number = lambda t: (int(t[1:].split(",")[0]), int(t.split(",")[1]) if "," in t else 1)
        assert found[i] == [(*number(a), *number(b)) for a, b in heads]


def test_repeated_rows_and_keys(spark):
    rows = scripts(spark, [(1, "a\n", "b\n"), (1, "a\n", "a\n"), (2, "a\n", "c\n")]).collect()
    assert sorted((r.id, r.new_text, len(r.edits)) for r in rows) == [(1, "a\n", 0), (1, "a\n", 0), (1, "b\n", 1), (1, "b\n", 1), (2, "c\n", 1)]
    assert textdiff.hunks(scripts(spark, []), ["id"]).collect() == []


@pytest.mark.parametrize("values", [[], [3], [2, 0, 1, 4, 3], [5, 4, 3, 2, 1, 0]])
def test_longest_rise(values):
    got = [values[i] for i in textdiff.longest_rise(values)]
    assert got == sorted(got) and len(got) == recursive(values, sorted(values))
