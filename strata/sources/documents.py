"""Manifests, Markdown, settings and registries of a code base, and the small files written beside them."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def json_registry(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON registry; a missing file is an empty one."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def yaml_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(path, json) of YAML files; what doesn't parse fails the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for x in frames:
            yield pd.DataFrame({"path": x["path"], "json": [json.dumps(yaml.safe_load(t), sort_keys=True, default=str) for t in x["value"]]})

    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, "path string, json string")


def yaml_text(value: dict) -> str:
    import yaml

    return yaml.safe_dump(value, sort_keys=True, allow_unicode=True)


KINDS = [(r"package\.json$", "npm"), (r"Makefile$", "make"), (r"\.github/workflows/[^/]+\.ya?ml$", "github"), (r"pyproject\.toml$", "python"), (r"go\.mod$", "go"), (r"pom\.xml$|build\.gradle(\.kts)?$", "jvm"), (r"docker-compose[^/]*\.ya?ml$|(^|/)compose\.ya?ml$", "compose"), (r"Dockerfile$", "docker"), (r"\.sh$", "shell"), (r"\.md$", "markdown")]
ENTRY = "path string, kind string, section string, name string, value string"


def yaml_entries(path: str, kind: str, text: str) -> list[tuple]:
    """(path, kind, section, name, value) of the jobs or services of one YAML file; one that doesn't parse gives none."""
    import yaml

    section = "jobs" if kind == "github" else "services"
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError:
        return []
    found = found.get(section) if isinstance(found, dict) else None
    rows = []
    for k, v in (found if isinstance(found, dict) else {}).items():
        v = v if isinstance(v, dict) else {}
        rows.append((path, kind, section, str(k), str(v.get("image") or v.get("build") or v.get("runs-on") or "")))
        needs = v.get("depends_on") or v.get("needs") or []
        rows += [(path, kind, "depends_on", str(k), str(n)) for n in ([needs] if isinstance(needs, str) else needs)]
    return rows


def kind_of(path: Column) -> Column:
    """Which manifest a path is, or null."""
    return F.coalesce(*(F.when(path.rlike(p), F.lit(k)) for p, k in KINDS))


def manifests(files: DataFrame) -> DataFrame:
    """(path, kind, section, name, value): scripts, targets, dependencies and services of all manifests among files (path, content).

    Null or unreadable content gives no rows, and files that are no manifests none. All kinds but YAML
    are read by expressions in one pass; YAML files, which need a parser, in Arrow batches.
    """
    text = F.coalesce("content", F.lit(""))
    every = lambda pattern, group, of=text: F.regexp_extract_all(of, F.lit(pattern), F.lit(group))
    entry = lambda section, name, value: F.struct(F.coalesce(section, F.lit("")).alias("section"), F.coalesce(name, F.lit("")).alias("name"), F.coalesce(value, F.lit("")).alias("value"))
    zipped = lambda section, names, values: F.zip_with(names, values, lambda n, v: entry(F.lit(section), n, v))
    parts = ["scripts", "dependencies", "devDependencies"]
    npm = F.from_json(text, ", ".join(f"{c} map<string, string>" for c in parts))
    none = F.array().cast("array<struct<section:string,name:string,value:string>>")
    in_npm = F.concat(*(F.coalesce(zipped(c, F.map_keys(npm[c]), F.map_values(npm[c])), none) for c in parts))
    block = lambda head: F.regexp_extract(text, rf"(?ms)^\[{head}\]\s*$(.*?)(?=^\[[a-z]|\z)", 1)
    needs = F.regexp_extract(block("project"), r"""(?m)^dependencies\s*=\s*\[((?:[^\]"']|"[^"]*"|'[^']*')*)\]""", 1)
    quoted = F.transform(every(r"""["']([^"']+)["']""", 1, needs), lambda v: entry(F.lit("dependencies"), F.get(F.split(v, r"[\s<>=!~\[;]"), 0), v))
    script = r"""(?m)^["']?([\w.-]+)["']?\s*=\s*["']([^"']*)["']"""
    in_python = F.concat(zipped("scripts", every(script, 1, block("project\\.scripts")), every(script, 2, block("project\\.scripts"))), quoted)
    jar = r"""<artifactId>([^<]+)</artifactId>|(?:implementation|api)\s*\(?["']([^"']+)"""
    in_jvm = F.zip_with(every(jar, 1), every(jar, 2), lambda a, b: entry(F.lit("dependencies"), F.when(a != "", a).otherwise(b), F.lit("")))
    made, required = r"(?m)^([A-Za-z][\w.-]*)[ \t]*:(?!=)(.*)$", r"(?m)^(?:require\s+|\t)([\w./-]+)\s+(v[\w.+-]+)"
    step, heading = r"(?mi)^(FROM|CMD|ENTRYPOINT|EXPOSE)[ \t]+(.+)$", r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*$"
    kind = F.col("kind")
    found = (
        F.when(kind == "npm", in_npm).when(kind == "make", F.transform(zipped("targets", every(made, 1), every(made, 2)), lambda e: entry(e["section"], e["name"], F.trim(e["value"])))).when(kind == "python", in_python)
        .when(kind == "go", zipped("dependencies", every(required, 1), every(required, 2))).when(kind == "jvm", in_jvm).when(kind == "docker", F.transform(zipped("docker", every(step, 1), every(step, 2)), lambda e: entry(e["section"], F.upper(e["name"]), F.trim(e["value"]))))
        .when(kind == "shell", F.array(entry(F.lit("scripts"), F.regexp_extract("path", "[^/]*$", 0), F.lit("")))).when(kind == "markdown", F.zip_with(every(heading, 1), every(heading, 2), lambda h, t: entry(F.concat(F.lit("h"), F.length(h).cast("string")), t, F.lit(""))))
    )
    known = files.select("path", "content", kind_of(F.col("path")).alias("kind")).filter("kind is not null")
    by_parser = kind.isin("github", "compose")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = [r for p, k, t in zip(x["path"], x["kind"], x["content"], strict=True) for r in yaml_entries(p, k, t or "")]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ENTRY.split(", ")])

    read = known.filter(~by_parser).select("path", "kind", F.explode(found).alias("e")).select("path", "kind", "e.section", "e.name", "e.value")
    return read.unionByName(known.filter(by_parser).select("path", "kind", "content").mapInPandas(run, ENTRY))


def sections(files: DataFrame, title: str, text_col: str = "content") -> DataFrame:
    """``files`` with the column ``section``: what stands under a Markdown heading, up to the next one of its rank or above.

    Headings of every rank count; the first with that title is taken; '' without one, or for null text.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    x = files.withColumn("__lines", lines).withColumn("__ranks", F.transform("__lines", lambda s: F.length(F.regexp_extract(s, r"^(#+)\s", 1))))
    is_it = F.zip_with("__lines", "__ranks", lambda s, r: (r > 0) & (F.regexp_replace(F.regexp_replace(s, r"^#+\s+", ""), r"\s+$", "") == title))
    x = x.withColumn("__at", F.array_position(is_it, F.lit(True)))
    rank = F.get("__ranks", (F.col("__at") - 1).cast("int"))
    ends = F.transform("__ranks", lambda r, i: (i >= F.col("__at")) & (r > 0) & (r <= rank))
    end = F.coalesce(F.nullif(F.array_position(ends, F.lit(True)), F.lit(0)), F.size("__lines") + 1)
    body = F.array_join(F.slice("__lines", (F.col("__at") + 1).cast("int"), (end - F.col("__at") - 1).cast("int")), "\n")
    return x.withColumn("section", F.when(F.col("__at") > 0, F.regexp_replace(body, r"^\s+|\s+$", "")).otherwise("")).drop("__lines", "__ranks", "__at")


def section(text: str, title: str) -> str:
    """What stands under a Markdown heading, up to the next one of its rank or above."""
    m = re.search(rf"(?m)^(#+)\s+{re.escape(title)}\s*$", text)
    if not m:
        return ""
    end = re.search(rf"(?m)^#{{1,{len(m[1])}}}\s", text[m.end() :])
    return text[m.end() : m.end() + end.start() if end else len(text)].strip()


def description(readme: str) -> str:
    """The first H1 and the lines below it up to the next H2, four in all, 300 characters at most."""
    found: list[str] = []
    for line in readme.split("\n"):
        if line.startswith("# "):
            found.append(line[2:].strip())
            continue
        if not found:
            continue
        if line.startswith("## "):
            break
        if line.strip():
            found.append(line.strip())
        if len(found) >= 4:
            break
    return " ".join(found)[:300]


def described(readmes: DataFrame, text_col: str = "content") -> DataFrame:
    """``readmes`` with the column ``description``; null texts have an empty one."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(description)

    return readmes.withColumn("description", of(F.col(text_col)))


def merged_config(base: dict, over: dict) -> dict:
    """Settings with those of ``over`` in place; objects are merged, lists joined without repeats."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged_config(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = list(dict.fromkeys([*out[k], *v]))
        elif v is not None:
            out[k] = v
    return out


# Settings where none are given, and older names of settings.
DEFAULTS = {
    "project": {"root": "", "backendRoot": "", "frontendRoot": "", "roots": [], "discovery": {"enabled": True}},
    "python": {"absoluteImportRoots": []},
    "frontend": {"routeDirs": ["src/routes", "src/pages", "routes", "pages"], "aliases": {}, "tsconfigPath": ""},
    "drift": {
        "graphLevel": "module", "scales": ["module", "file", "function"], "weights": {"entropy": 0.4, "crossLayer": 0.3, "cycles": 0.2, "modularity": 0.1}, "layers": {}, "domains": {},
        "capacity": {"layers": {}, "total": 0, "warningRatio": 0.85, "criticalRatio": 1.0}, "growth": {"maxEdgesPerHour": 0, "maxEdgesPerDay": 0, "maxEdgeGrowthRatio": 0}, "baselinePath": "", "historyPath": "", "criticalDelta": 0.25,
    },
    "docs": {"mode": "lean", "internalDir": "internal"},
}
OLD_NAMES = {
    "project": {"backend_root": "backendRoot", "frontend_root": "frontendRoot"}, "project.discovery": {"auto_detect": "enabled"}, "python": {"absolute_import_roots": "absoluteImportRoots"}, "frontend": {"route_dirs": "routeDirs", "tsconfig_path": "tsconfigPath"},
    "drift": {"graph_level": "graphLevel", "scale_levels": "scales", "baseline_path": "baselinePath", "history_path": "historyPath", "domain_map": "domains"}, "drift.capacity": {"warning_ratio": "warningRatio", "critical_ratio": "criticalRatio", "total_edges": "total"},
}


def renamed(given: dict, at: str = "") -> dict:
    """``given`` with settings under today's names; where both names are given, today's counts."""
    old = OLD_NAMES.get(at, {})
    out = {k: v for k, v in given.items() if k not in old}
    for k, new in old.items():
        if k in given and not out.get(new):
            out[new] = given[k]
    return {k: renamed(v, f"{at}.{k}".lstrip(".")) if isinstance(v, dict) else v for k, v in out.items()}


def wrong_types(given: dict, known: dict, at: str = "") -> list[str]:
    """Settings whose values aren't of the kind of their defaults."""
    bad = []
    for k, v in given.items():
        name, want = f"{at}.{k}".lstrip("."), known.get(k)
        if want is None or v is None:
            continue
        number = isinstance(want, (int, float)) and not isinstance(want, bool)
        if number != (isinstance(v, (int, float)) and not isinstance(v, bool)) or (not number and not isinstance(v, type(want))):
            bad.append(name)
        elif isinstance(want, dict):
            bad += wrong_types(v, want, name)
    return bad


def settings(spark: SparkSession, path: str | None = None) -> dict:
    """The defaults, merged with a JSON file of settings; a file that isn't there changes nothing.

    A file that is no JSON object, or has a value of another kind than its default, is a ValueError that names it.
    """
    if path is None:
        return merged_config(DEFAULTS, {})
    try:
        texts = [r[0] for r in spark.read.text(path, wholetext=True).limit(2).collect()]  # one file of settings
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return merged_config(DEFAULTS, {})
    try:
        given = json.loads(texts[0]) if texts else {}
    except ValueError as e:
        raise ValueError(f"settings at {path} can't be read: {e}") from e
    if not isinstance(given, dict):
        raise ValueError(f"settings at {path} are no object")
    given = renamed(given)
    if bad := wrong_types(given, DEFAULTS):
        raise ValueError(f"settings at {path} have wrong values: {', '.join(bad)}")
    return merged_config(DEFAULTS, given)


# What a folder of back ends and of front ends usually holds, with its weight.
BACKEND_SIGNS = {"pyproject.toml": 3, "requirements.txt": 3, "go.mod": 3, "manage.py": 4, "main.py": 2, "server.ts": 2, "package.json": 1}
FRONTEND_SIGNS = {"next.config.js": 4, "vite.config.ts": 4, "app.json": 2, "index.html": 2, "package.json": 1}


def project_root(paths: DataFrame, signs: dict[str, int]) -> str:
    """The folder of the highest score among ``paths`` (path); '' without one or with a tie at the top."""
    name, folder = F.regexp_extract("path", "[^/]*$", 0), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    score = F.element_at(F.create_map(*(F.lit(v) for kv in signs.items() for v in kv)), name)
    top = paths.filter(name.isin(list(signs))).groupBy(folder.alias("folder")).agg(F.sum(score).alias("score")).orderBy(F.desc("score"), "folder").limit(2).collect()
    return "" if not top or (len(top) == 2 and top[0]["score"] == top[1]["score"]) else top[0]["folder"]


BEGIN, END = "<!-- strata:auto-context -->", "<!-- /strata:auto-context -->"


def with_block(text: str, block: str) -> str:
    """``text`` with ``block`` between its markers; without markers it is put at the end. Doing it again changes nothing."""
    inside = f"{BEGIN}\n{block.strip()}\n{END}"
    a, b = text.find(BEGIN), text.find(END)
    if a >= 0 and b > a:
        return text[:a] + inside + text[b + len(END) :]
    return f"{text.rstrip()}\n\n{inside}\n" if text.strip() else inside + "\n"


def report(rows: DataFrame, form: str, most: int = 10_000) -> str:
    """A small result as csv, markdown, json or text (columns padded to their widest cell); more than ``most`` rows are an error."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows; write a table instead")
    cols = rows.columns
    if form == "json":
        return json.dumps([r.asDict() for r in got], default=str, indent=2)
    if form == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(cols)
        w.writerows(got)
        return out.getvalue()
    if form == "text":
        cells = [list(map(str, r)) for r in [cols, *got]]
        width = [max(map(len, c)) for c in zip(*cells, strict=True)]
        return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in cells) + "\n"
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(cols), line(["---"] * len(cols)), *(line(r) for r in got)]) + "\n"
