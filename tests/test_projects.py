"""Manifests, sections, settings, project roots, diagrams, ordered numbers, walks and modularity on small cases, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strata.operators import diagrams, graph
from strata.operators import reports as R
from strata.operators.numbering import numbered
from strata.sources import documents as D
from strata.sources import roots


def test_manifests_of_all_kinds(spark):
    rows = [
        ("a/package.json", '{"scripts": {"x": "y"}, "devDependencies": {"t": "2"}}'), ("b/package.json", "{broken"), ("c/package.json", None), ("d/build.gradle", 'implementation("g:h:1")\napi "k"'), ("e/pom.xml", "<artifactId>m</artifactId>"), ("f/run.sh", ""), ("g/NOTES.md", "# One\ntext # no\n### Two words  \n"),
        ("h/.github/workflows/ci.yml", "jobs:\n  t:\n    runs-on: u\n    needs: b\n"), ("i/compose.yaml", "services: [1"), ("j/compose.yml", "services:\n  s: null\n"), ("k/other.txt", "FROM x"), ("l/pyproject.toml", "[project]\ndependencies = ['a[b]>=1', \"c\"]\n"), ("m/Dockerfile", "from x\nCMD y z\n"), ("n/go.mod", "require (\n\ta.b/c v1.0\n)\n"),
    ]
    got = sorted(tuple(r)[1:] for r in D.manifests(spark.createDataFrame(rows, "path string, content string")).collect())
    assert got == sorted([
        ("npm", "scripts", "x", "y"), ("npm", "devDependencies", "t", "2"), ("jvm", "dependencies", "g:h:1", ""), ("jvm", "dependencies", "k", ""), ("jvm", "dependencies", "m", ""), ("shell", "scripts", "run.sh", ""), ("markdown", "h1", "One", ""), ("markdown", "h3", "Two words", ""),
        ("github", "jobs", "t", "u"), ("github", "depends_on", "t", "b"), ("compose", "services", "s", ""), ("python", "dependencies", "a", "a[b]>=1"), ("python", "dependencies", "c", "c"), ("docker", "docker", "FROM", "x"), ("docker", "docker", "CMD", "y z"), ("go", "dependencies", "a.b/c", "v1.0"),
    ])
    assert D.manifests(spark.createDataFrame([], "path string, content string")).count() == 0


def test_sections(spark):
    texts = ["# A\nx\n## B\ny\n### C\nz\n## D\n", "## B\nlast", "no", "", None, "# B\n# B\nx", "## B  \n\n a \n# E"]
    got = [r["section"] for r in D.sections(spark.createDataFrame(list(enumerate(texts)), "i int, content string"), "B").orderBy("i").collect()]
    assert got == ["y\n### C\nz", "last", "", "", "", "", "a"]


def test_settings(spark, tmp_path):
    assert D.settings(spark) == D.settings(spark, str(tmp_path / "none.json")) == D.DEFAULTS
    at = tmp_path / "s.json"
    at.write_text(json.dumps({"drift": {"graph_level": "file", "weights": {"cycles": 0}, "capacity": {"total_edges": 9}}, "frontend": {"routeDirs": ["app"]}, "project": {"discovery": {"auto_detect": False}}, "more": 1}))
    got = D.settings(spark, str(at))
    assert got["drift"]["graphLevel"] == "file" and got["drift"]["weights"] == {"entropy": 0.4, "crossLayer": 0.3, "cycles": 0, "modularity": 0.1} and got["drift"]["capacity"]["total"] == 9
    assert got["frontend"]["routeDirs"][-1] == "app" and len(got["frontend"]["routeDirs"]) == 5 and got["more"] == 1
    for bad, name in (("{", "can't be read"), ("[1]", "no object"), ('{"drift": {"weights": {"cycles": "x"}}, "docs": 1}', "drift.weights.cycles, docs")):
        at.write_text(bad)
        with pytest.raises(ValueError, match=name):
            D.settings(spark, str(at))
    two = spark.createDataFrame([(1, "x"), (100, "yy")], "a int, b string")
    assert D.report(two, "text") == "a    b\n1    x\n100  yy\n"


def test_project_roots(spark):
    rows = [
        ("w/one", "src/a.py", None), ("w/one", "readme", ""), ("w/two", "services/x/package.json", "{}"), ("w/two", "services/y/package.json", "{}"), ("w/two", "ui/package.json", '{"a": "React"}'), ("w/two", "ui/src/app/p.tsx", ""),
        ("w/api", "manage.py", ""), ("w/api", "src/x.py", ""), ("w/tie", "web/a", ""), ("w/tie", "client/a", ""),
    ]
    got = {tuple(r)[:2]: tuple(r)[2:] for r in roots.project_roots(spark.createDataFrame(rows, "root string, path string, content string")).collect()}
    assert got == {
        ("w/one", "backend"): ("", 0, "none"), ("w/one", "frontend"): ("", 0, "none"), ("w/two", "backend"): ("services", 14, "found"), ("w/two", "frontend"): ("ui", 16, "found"),
        ("w/api", "backend"): ("src", 9, "found"), ("w/api", "frontend"): ("", 0, "none"), ("w/tie", "backend"): ("", 0, "none"), ("w/tie", "frontend"): ("", 5, "ambiguous"),
    }


def test_system_edges(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    modules, imports = df([("a",), ("b",)], "id string"), df([("a", "b"), ("a", "gone")], "from_module string, to_module string")
    ends = df([(1, "/x/{id}", "b"), (2, "/x", "a"), (3, "/y", "a")], "eid int, path string, module string")
    calls = df([(3, "conn.run"), (2, "_proxy_to_z"), (1, None)], "eid int, call string")
    edges = lambda m, pages: sorted(map(tuple, diagrams.system_edges(m, imports, df(pages, "path string"), ends, calls).collect()))
    inner = [("a", "External", "proxy"), ("a", "Postgres", "stores"), ("a", "b", "imports")]
    assert edges(modules, [("/v1/x/7",), (None,)]) == sorted([*inner, ("Pages", "b", "calls")])
    assert edges(modules, [("/none",)]) == sorted([*inner, ("Pages", "a", "calls"), ("Pages", "b", "calls")])
    assert edges(modules, []) == inner and edges(modules.filter("id = 'a'"), [("/y",)]) == []


def test_numbers_and_ranks(spark):
    r = random.Random(5)
    rows = [(r.choice([7, 7, r.randint(0, 50)]), i) for i in range(500)]
    got = sorted((x["n"], x["v"], x["i"]) for x in numbered(spark.createDataFrame(rows, "v int, i int"), [F.col("v"), F.col("i")]).collect())
    assert got == [(n + 1, *p) for n, p in enumerate(sorted(rows))]
    pairs = [(r.randint(0, 9), r.randint(0, 9), i) for i in range(200)]
    d = sorted((abs(a - b), i, a - b) for a, b, i in pairs if a != b)
    want = (sum(k + 1 for k, x in enumerate(d) if x[2] > 0), sum(k + 1 for k, x in enumerate(d) if x[2] < 0), len(d))
    assert tuple(R.signed_rank(spark.createDataFrame(pairs, "a int, b int, i int"), "a", "b", ["i"]).first()) == want


def test_bounded_walk(spark):
    r = random.Random(3)
    for cap in (1, 5, 20):
        edges = [(f"n{r.randint(0, 14):02}", f"n{r.randint(0, 30):02}") for _ in range(60)]
        seen, queue, want = {"n00"}, ["n00"], []
        while queue and len(seen) < cap:
            at = queue.pop(0)
            for b in sorted({y for x, y in edges if x == at}):
                if b not in seen and len(seen) < cap:
                    seen.add(b)
                    queue.append(b)
                    want.append((at, b, len(want)))
        got = graph.walked_tree(spark.createDataFrame(edges, "src string, dst string"), "n00", cap)
        assert [tuple(x) for x in got.orderBy("ord").collect()] == want


def test_community_modularity(spark):
    r = random.Random(1)
    ids = list(range(12))
    home = {v: r.choice("abc") for v in ids}
    edges = [(r.choice(ids), r.choice(ids)) for _ in range(50)]
    kept = [(a, b) for a, b in edges if a != b]
    two_m = 2 * len(kept)
    q = sum(2 * sum(home[a] == home[b] == c for a, b in kept) / two_m - (sum((home[a] == c) + (home[b] == c) for a, b in kept) / two_m) ** 2 for c in "abc")
    members = spark.createDataFrame([("x", v, home[v]) for v in ids] + [("empty", 0, None)], "level string, id int, community string")
    got = {x["level"]: (x["modularity"], x["gap"]) for x in graph.community_modularity(members, spark.createDataFrame([("x", *e) for e in edges] + [("x", 0, 99)], "level string, src int, dst int")).collect()}
    assert got["empty"] == (0.0, 0.0) and abs(got["x"][0] - q) < 1e-12 and abs(got["x"][1] - (1 - min(1, max(0, q)))) < 1e-12
