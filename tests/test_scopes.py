"""Definitions by scope against walking scopes and imports name by name."""

import random

from chronomill.operators import scopes

B = "file_id string, name string, scope_start int, scope_end int, place int, target_file string, target_name string"
U = "file_id string, name string, qualifier string, place int"


def found(spark, uses, bindings):
    rows = scopes.resolve(spark.createDataFrame(uses, U), spark.createDataFrame(bindings, B))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def walked(uses, bindings):
    key = lambda b: (b[4], b[5] is not None, b[5] or "", b[6] is not None, b[6] or "")
    known = [b for b in bindings if b[0] is not None and b[1] is not None]
    out = []

    def exported(file, name, seen=()):
        own = [b for b in known if b[0] == file]
        if not own or (file, name) in seen or name is None:
            return None, None
        wide = [b for b in own if b[1] == name and b[2] == min(x[2] for x in own) and b[3] == max(x[3] for x in own)]
        if not wide:
            return None, None
        last = max(wide, key=key)
        if last[5] is None:
            return file, last[4]
        return exported(last[5], last[6], (*seen, (file, name)))

    for file, name, qualifier, place in uses:
        asked = name if qualifier is None else qualifier
        held = [b for b in known if b[0] == file and b[1] == asked and place is not None and b[2] <= place <= b[3]]
        definition = None, None
        if held:
            b = max(held, key=lambda b: (b[2], -b[3], *key(b)))
            if qualifier is None:
                definition = (file, b[4]) if b[5] is None else exported(b[5], b[6])
            elif b[5] is not None and b[6] is None:
                definition = exported(b[5], name)
        out.append((file, name, qualifier, place, *definition))
    return sorted(out, key=repr)


def test_shadowed_qualified_and_re_exported(spark):
    bindings = [
        ("a", "f", 0, 99, 1, None, None), ("a", "f", 10, 20, 11, None, None), ("a", "f", 12, 15, 13, None, None), ("a", "f", 0, 99, 5, None, None),
        ("b", "f", 0, 50, 2, "a", "f"), ("b", "g", 0, 50, 3, "b", "f"), ("b", "m", 0, 50, 4, "a", None),
        ("c", "x", 0, 9, 1, "d", "x"), ("d", "x", 0, 9, 1, "c", "x"), ("c", "z", 0, 9, 1, "nowhere", "z"),
    ]
    uses = [("a", "f", None, 14), ("a", "f", None, 18), ("a", "f", None, 50), ("b", "g", None, 7), ("b", "f", "m", 7), ("b", "f", "f", 7), ("b", "q", None, 7), ("c", "x", None, 2), ("c", "z", None, 2), ("a", "f", None, None), (None, "f", None, 1)]
    got = found(spark, uses, bindings)
    assert got == walked(uses, bindings)
    assert {(r[3], r[5]) for r in got if r[0] == "a" and r[3] is not None} == {(14, 13), (18, 11), (50, 5)}


def test_long_chains_and_circles(spark):
    """A chain of 40 re-exports, with a circle that is never closed."""
    bindings = [(f"f{k}", "x", 0, 9, 1, f"f{k + 1}", "x") for k in range(40)] + [("f40", "x", 0, 9, 7, None, None)]
    bindings += [(f"r{k}", "x", 0, 9, 1, f"r{(k + 1) % 5}", "x") for k in range(5)] + [("in", "x", 0, 9, 1, "r2", "x")]
    uses = [(f"f{k}", "x", None, 3) for k in range(41)] + [("r1", "x", None, 3), ("in", "x", None, 3)]
    assert found(spark, uses, bindings) == walked(uses, bindings)


def test_any_files(spark):
    draw = random.Random(2)
    files, names = [*"abcde", None], [*"xyz", None]
    bindings = []
    for k in range(120):
        a = draw.choice([0, 0, 0, 10, 20])
        target = draw.choice([None, None, *"abcdef"])
        bindings.append((draw.choice(files), draw.choice(names), a, 99 - a, k, target, draw.choice(["x", "y", "z", None]) if target else None))
    uses = [(draw.choice(files), draw.choice(names), draw.choice([None, None, "x", "y"]), draw.choice([None, 0, 5, 15, 25, 85])) for _ in range(300)]
    assert found(spark, uses, bindings) == walked(uses, bindings)


def test_uses_of_definitions(spark):
    rows = spark.createDataFrame([("a", "f", None, 3, "b", 1), ("a", "f", None, 1, "b", 1), ("a", "g", None, 1, None, None)], f"{U}, def_file string, def_place int")
    assert [(r["place"], r["use_no"]) for r in scopes.uses_of_definitions(rows).orderBy("use_no").collect()] == [(1, 1), (3, 2)]


def test_many_bindings_of_one_scope(spark):
    """10^5 uses of a name that one scope binds 10^4 times: 10^9 pairs if each use met each binding."""
    uses = spark.range(100_000).selectExpr("'a' file_id", "'x' name", "cast(null as string) qualifier", "cast(id % 100 as int) place")
    bindings = spark.range(10_000).selectExpr("'a' file_id", "'x' name", "0 scope_start", "99 scope_end", "cast(id as int) place", "cast(null as string) target_file", "cast(null as string) target_name")
    assert [tuple(r) for r in scopes.resolve(uses, bindings).groupBy("def_file", "def_place").count().collect()] == [("a", 9_999, 100_000)]
