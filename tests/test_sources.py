"""Sources, kernels, stores and small files."""

import json

import pytest
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import search as S
from strata.operators import store
from strata.sources import documents as D
from strata.sources import extract as E
from strata.sources import files

PY = '''
from .models import User, Item
import os
router = APIRouter(prefix="/v1")
LIMIT = 5
class User(Base):
    id = Column(Integer)
    org = Column(ForeignKey("orgs.id"))
class Colour(Enum):
    RED = 1
@router.get("/users/{id}")
async def read(id): return db.get(id)
@app.route("/x", methods=["PUT", "POST"])
def both(): pass
@celery.task
def job(): pass
def test_one():
    "says one"
'''
JS = '''import { a, b as c } from "./util";
export const handler = 1;
app.post("/items", createItem);
describe("suite", () => { it("does", () => { fetch("/api/x", { method: "PUT" }); api.get("/y"); }); });
const v = <Card title="x"/>;
'''


def kinds(rows, kind):
    return [(r[2], r[3], r[4]) for r in rows if r[1] == kind]


def test_python_and_javascript_facts():
    p = E.python_facts("a.py", PY)
    assert kinds(p, "endpoint") == [("GET /v1/users/{id}", "read", "router"), ("PUT /x", "both", "app"), ("POST /x", "both", "app")]
    assert kinds(p, "model") == [("User", "sqlalchemy", "")] and ("org", "orgs.id", "User") in kinds(p, "field")
    assert kinds(p, "import")[0] == (".models", "User", "") and ("os", "*", "") in kinds(p, "import")
    assert kinds(p, "enum") == [("Colour", "RED", "")] and kinds(p, "task") == [("job", "celery", "celery")]
    assert kinds(p, "test") == [("test_one", "says one", "")] and kinds(p, "constant") == [("LIMIT", "5", "")]
    assert E.python_facts("b.py", "def (") == []
    j = E.pattern_facts("a.tsx", JS)
    assert kinds(j, "import") == [("./util", "a", ""), ("./util", "b", "")] and kinds(j, "export") == [("handler", "", "")]
    assert kinds(j, "endpoint") == [("POST /items", "createItem", "app")] and kinds(j, "test") == [("does", "", "suite")]
    assert kinds(j, "call") == [("PUT /api/x", "", ""), ("GET /y", "", "")] and kinds(j, "component") == [("Card", "", "")]
    assert kinds(E.pattern_facts("A.java", '@GetMapping("/a")\npublic String list() {'), "endpoint") == [("GET /a", "list", "")]
    assert kinds(E.pattern_facts("a.go", 'r.GET("/a", h.List)'), "endpoint") == [("GET /a", "h.List", "")]
    assert kinds(E.pattern_facts("A.cs", '[HttpPost("/a")]\npublic async Task<X> Make(int a)'), "endpoint") == [("POST /a", "Make", "")]
    lean = E.pattern_facts("a.lean", "namespace A\ntheorem t : 1 = 1 := by sorry\nend A\ndef f := 1\n")
    assert kinds(lean, "theorem") == [("A.t", "sorry", "A")] and kinds(lean, "def") == [("f", "", "")]
    assert E.entrypoints(["src/main.py", "lib/x.py", "cmd/a/b.go"]) == ["src/main.py", "cmd/a/b.go"]
    assert len(E.embedding_text("f", "a/b.py", ["c"] * 20, ["x" * 200] * 9)) == 300


def test_fingerprints(spark):
    df = spark.createDataFrame([("a.py", "def f(a):\n    return g(a, 1)\ndef h(b):\n    return k(b, 'x')\ndef m(): pass\n"), ("b.py", "def (")], "path string, content string")
    got = {r["id"]: r for r in E.fingerprints(df).collect()}
    assert got["a.py#f"]["hash"] == got["a.py#h"]["hash"] != got["a.py#m"]["hash"] and got["a.py#f"]["kinds"] == ["Return", "Call", "Identifier", "Literal"]
    assert E.file_facts(df).count() == 0


def test_manifests_and_markdown(spark, tmp_path):
    rows = [("package.json", '{"scripts": {"dev": "vite"}, "dependencies": {"a": "1"}}'), ("x/Makefile", "all: b\n\techo\nV := 1\n"), ("docker-compose.yml", "services:\n  db:\n    image: pg\n  web:\n    build: .\n    depends_on: [db]\n"),
            ("pyproject.toml", '[project]\ndependencies = ["numpy>=1"]\n'), ("go.mod", "require a/b v1.2\n"), ("Dockerfile", "FROM x\nCMD run\n"), ("README.md", "# T\n## U\n"), ("bad/package.json", "{"), ("run.sh", "")]
    got = {(r["kind"], r["section"], r["name"], r["value"]) for r in D.manifests(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert {("npm", "scripts", "dev", "vite"), ("make", "targets", "all", "b"), ("compose", "services", "db", "pg"), ("compose", "depends_on", "web", "db"), ("python", "dependencies", "numpy", "numpy>=1"), ("go", "dependencies", "a/b", "v1.2"), ("docker", "docker", "CMD", "run"), ("markdown", "h2", "U", ""), ("shell", "scripts", "run.sh", "")} <= got
    assert D.section("# A\nx\n## B\ny\n### C\nz\n## D\n", "B") == "y\n### C\nz" and D.section("", "B") == ""
    assert D.description("intro\n# Name\n\nOne.\nTwo.\n## Rest\nno") == "Name One. Two."
    assert D.merged_config({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [1, 3]}, "d": None}) == {"a": {"b": 1, "c": [1, 3]}, "d": 2}
    text = D.with_block("# T\n", "one")
    assert D.with_block(D.with_block(text, "two"), "two") == D.with_block(text, "two") and "one" not in D.with_block(text, "two")
    (tmp_path / "s.yaml").write_text(D.yaml_text({"b": 1, "a": [2]}))
    assert json.loads(D.yaml_snapshots(spark, str(tmp_path)).first()["json"]) == {"a": [2], "b": 1}
    assert D.json_registry(spark, str(tmp_path / "none.json"), "a int").count() == 0
    paths = spark.createDataFrame([("api/manage.py",), ("api/package.json",), ("web/package.json",)], "path string")
    assert D.project_root(paths, D.BACKEND_SIGNS) == "api" and D.project_root(paths.filter("path like '%package.json'"), D.BACKEND_SIGNS) == ""
    two = spark.createDataFrame([(1, "x|y")], "a int, b string")
    assert D.report(two, "csv") == "a,b\n1,x|y\n" and "x\\|y" in D.report(two, "markdown") and json.loads(D.report(two, "json")) == [{"a": 1, "b": "x|y"}]
    with pytest.raises(ValueError):
        D.report(spark.range(5), "csv", most=3)


def test_lines_and_filters(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nbad\n[1]\n\n{"b": 2}\n')
    assert [r["a"] for r in files.json_lines(spark, str(tmp_path / "t.jsonl"), "a int").collect()] == [1, None]
    (tmp_path / "s.jsonl").write_text('// note\n{"a": 1}\n')
    assert files.json_lines(spark, str(tmp_path / "s.jsonl"), "a int", strict=True).collect()[0]["a"] == 1
    (tmp_path / "s2.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, str(tmp_path / "s2.jsonl"), "a int", strict=True).collect()
    p = spark.createDataFrame([(x,) for x in ("src/a.ts", "a/.lake/b.ts", "obj/x.cs", "skip/me/a.py", "test/a.py", "a.rb", "a.md")], "p string")
    assert [r["p"] for r in p.filter(~files.ignored(F.col("p"), prefixes=["skip/me"])).collect()] == ["src/a.ts", "test/a.py", "a.rb", "a.md"]
    assert [r["p"] for r in p.filter(files.source_file(F.col("p"))).collect()] == ["src/a.ts", "a/.lake/b.ts", "obj/x.cs", "skip/me/a.py", "a.rb"]


def test_store(spark, tmp_path):
    cache = spark.createDataFrame([("a", "1", "c"), ("b", "2", "c"), ("d", "3", "old")], "path string, hash string, config string")
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3")], "path string, hash string")
    assert sorted(r["path"] for r in store.changed_files(now, cache, "c").collect()) == ["b", "d"]
    assert [r["path"] for r in store.live_entries(cache, now, "c").collect()] == ["a"]
    store.full_refresh(cache, str(tmp_path / "t"))
    store.full_refresh(now.withColumn("config", F.lit("c")), str(tmp_path / "t"))
    t = store.current(spark, str(tmp_path / "t"))
    assert store.point(t, path="b").first()["hash"] == "9" and [r["path"] for r in store.listed(t, "path", config="c").collect()] == ["a", "b", "d"]
    assert store.backend_of(spark, "no_such_table", str(tmp_path / "x")) == "files" and store.backend_of(spark, "data", str(tmp_path / "t")) == "table"
    assert [r["hash"] for r in store.last_wins(cache, ["config"], "hash").orderBy("config").collect()] == ["2", "3"]


def test_query_words(spark):
    assert S.query_tokens("getUserById a_b # x.y") == ["get", "user", "by", "id", "xy"]
    assert S.glob_keywords("src/auth*/**/*.ts") == ["auth"] and S.glob_keywords("**/*.ts") == []
    assert T.search_types(None) == set(T.SEARCH_TYPES) and "functions" in T.search_types(["bogus"]) and T.search_types([" Files,functions"]) == {"files", "functions"}
    r = spark.range(1).select(T.path_pattern(F.lit("")).alias("a"), T.path_pattern(F.lit("/a/:123/?x=1")).alias("b"), T.split_identifiers(F.lit("a1B-c.d")).alias("c")).first()
    assert tuple(r) == ("/", "/a/:param", "a1b-c.d")


def test_write_each_keeps_rows_apart_in_one_folder(spark, tmp_path):
    where = tmp_path / "specs"
    files.write_each(spark.range(300).selectExpr("concat(id, '.yaml') as name", "concat('a: ', id, '\nb') as value"), "file://" + str(where))
    assert {p.name: p.read_text() for p in where.iterdir()} == {f"{i}.yaml": f"a: {i}\nb" for i in range(300)}
