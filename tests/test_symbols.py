"""Symbol resolution and call edges against a depth-first walk and by hand."""

import random

import pytest

from strata.operators import symbols as Y

DEFS, RE, STARS, REQ = "file string, name string", "file string, name string, to_file string, to_name string, ord int", "file string, to_file string, ord int", "file string, name string"


def walked(request, defs, reexports, stars):
    """Depth first: a definition, else the first named re-export, else the stars in order."""
    own = {}
    for f, n, tf, tn, o in sorted(reexports, key=lambda r: (r[4], r[2], r[3])):
        own.setdefault((f, n), (tf, tn))

    def go(f, n, been):
        if (f, n) in defs:
            return f, n
        if (f, n) in been:
            return None
        been = been | {(f, n)}
        if (f, n) in own:
            return go(*own[f, n], been)
        if n != "default":
            for a, b, _ in sorted(stars, key=lambda s: s[2]):
                if a == f and (got := go(b, n, been)):
                    return got
        return None

    return go(*request, frozenset())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_walk(spark, seed):
    rng = random.Random(seed)
    files, names = [f"f{i}" for i in range(14)], ["a", "b", "c", "default"]
    defs = {(f, n) for f in files for n in names if rng.random() < 0.12}
    reexports = [(f, n, rng.choice(files), rng.choice(names), k) for f in files for n in names for k in range(2) if rng.random() < 0.2]
    stars = [(f, rng.choice(files), k) for f in files for k in range(3) if rng.random() < 0.4]
    requests = [(f, n) for f in files for n in names]
    got = Y.resolved_symbols(spark.createDataFrame(requests, REQ), spark.createDataFrame(sorted(defs), DEFS), spark.createDataFrame(reexports, RE), spark.createDataFrame(stars, STARS))
    want = {r: w for r in requests if (w := walked(r, defs, reexports, stars))}
    assert {(r["file"], r["name"]): (r["def_file"], r["def_name"]) for r in got.collect()} == want


def test_long_chain_and_cycle(spark):
    chain = [(f"f{i}", "x", f"f{i + 1}", "x", 0) for i in range(40)] + [("c0", "x", "c1", "x", 0), ("c1", "x", "c2", "x", 0), ("c2", "x", "c0", "x", 0), ("in", "x", "c0", "x", 0)]
    got = Y.chain_ends(spark.createDataFrame(chain, RE)).collect()
    assert {r["file"]: r["to_file"] for r in got} == {f"f{i}": "f40" for i in range(40)}
    one = Y.resolved_symbols(spark.createDataFrame([("f0", "x"), ("in", "x")], REQ), spark.createDataFrame([("f40", "x")], DEFS), spark.createDataFrame(chain, RE), spark.createDataFrame([], STARS))
    assert [tuple(r) for r in one.collect()] == [("f0", "x", "f40", "x")]


def test_python_calls(spark):
    defs = [("p/a.py", "p.a", "f", 0), ("p/a.py", "p.a", "C.m", 0), ("p/a.py", "p.a", "C.n", 0), ("p/sub/b.py", "p.sub.b", "g", 1), ("p/sub/b.py", "p.sub.b", "K.run", 1), ("x.py", "x", "h", 2), ("x2.py", "x", "h", 3)]
    imports = [("p/a.py", "p", ".sub.b", "g", "gg", 0), ("p/a.py", "p", "..", "p", None, 1), ("p/a.py", "p", ".sub", "b", None, 2), ("p/a.py", "p", "x", None, "xx", 3), ("p/a.py", "p", "x", "h", None, 4), ("p/a.py", "p", "x", "*", None, 5), ("p/a.py", "p", "p.sub", "b.g", "deep", 6), ("p/a.py", "p", "p", None, "pp", 7), ("p/a.py", "p", ".none", "zip", "zz", 8)]
    aliases = Y.module_aliases(spark.createDataFrame(imports, "file string, package string, spec string, name string, alias string, ord int"), spark.createDataFrame([("p.a",), ("p.sub.b",), ("x",)], "module string"), spark.createDataFrame(defs, "file string, module string, name string, ord int"))
    found = {(r["alias"], r["kind"], r["module"], r["function"]) for r in aliases.collect()}
    assert {("gg", "function", "p.sub.b", "g"), ("b", "module", "p.sub.b", None), ("xx", "module", "x", None), ("h", "function", "x", "h"), ("deep", "function", "p.sub.b", "g"), ("pp", "module", "p", None), ("zz", "function", "p.none", "zip")} <= found
    asked = {"f": "p/a.py#f", "gg": "p/sub/b.py#g", "h": "x.py#h", "deep": "p/sub/b.py#g", "self.m": "p/a.py#C.m", "self.zzz": None, "C.n": "p/a.py#C.n", "C.zzz": None, "b.g": "p/sub/b.py#g", "b.K.run": "p/sub/b.py#K.run", "xx.h": "x.py#h", "pp.sub.b.g": "p/sub/b.py#g", "p.sub.b.g": "p/sub/b.py#g", "print": None, "zz": None, "a.b.c.d": None}
    calls = spark.createDataFrame([("p/a.py", f"c:{t}", "C", t) for t in asked], "file string, caller string, in_class string, text string")
    got = Y.python_call_edges(calls, spark.createDataFrame(defs, "file string, module string, name string, ord int"), aliases)
    assert {r["caller"]: r["callee"] for r in got.collect()} == {f"c:{t}": v for t, v in asked.items() if v}


def test_script_calls(spark):
    defs = [("a.ts", "f"), ("a.ts", "C.m"), ("b.ts", "g"), ("b.ts", "D.run"), ("b.ts", "default")]
    imports = [("a.ts", "gg", "index.ts", "g"), ("a.ts", "ns", "index.ts", "*"), ("a.ts", "E", "index.ts", "D"), ("a.ts", "f", "b.ts", "g"), ("a.ts", "dflt", "index.ts", "default")]
    asked = {"f": "a.ts#f", "gg": "b.ts#g", "ns.g": "b.ts#g", "ns.D.run": "b.ts#D.run", "E.run": "b.ts#D.run", "this.m": "a.ts#C.m", "C.m": "a.ts#C.m", "dflt": None, "nope": None}
    calls = spark.createDataFrame([("a.ts", f"c:{t}", "C", t) for t in asked], "file string, caller string, in_class string, text string")
    got = Y.script_call_edges(calls, spark.createDataFrame(defs, DEFS), spark.createDataFrame(imports, "file string, alias string, to_file string, symbol string"), spark.createDataFrame([], RE), spark.createDataFrame([("index.ts", "b.ts", 0)], STARS))
    want = {f"c:{t}": v for t, v in asked.items() if v}
    assert {r["caller"]: r["callee"] for r in got.collect()} == want
