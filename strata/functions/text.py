"""Scalar functions on columns: identifiers, paths, rounding, set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    f = 10.0**places
    return F.floor(x * f + 0.5) / f


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def split_identifiers(x: Column) -> Column:
    """camelCase and snake_case as lower-case words; digits, dots and slashes stay where they are."""
    spaced = F.regexp_replace(F.regexp_replace(x, "_", " "), r"([a-z])([A-Z])", "$1 $2")
    return F.lower(F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def path_suffixes(path: Column) -> Column:
    """All '/'-bounded suffixes of a path, longest first; joins on them replace ends-with joins."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "/"))


def path_pattern(path: Column) -> Column:
    """A route with its parameters as ':param', without query string, doubled and last slashes; '/' if nothing is left."""
    bare = F.regexp_replace(F.coalesce(path, F.lit("")), r"\?[\s\S]*$", "")
    marked = F.regexp_replace(bare, r"\$?\{[^}]+\}|<[^>]+>|:[A-Za-z0-9_]+", ":param")
    short = F.regexp_replace(F.regexp_replace(marked, r"/+", "/"), r"/$", "")
    return F.when(short == "", "/").otherwise(short)


def url_path(url: Column) -> Column:
    return F.regexp_replace(url, r"^[a-z]+://[^/]+", "")


def words(text: Column, separator: str = r"[^a-z0-9_]+", least: int = 1) -> Column:
    return F.filter(F.split(F.lower(text), separator), lambda t: F.length(t) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def token_estimate(x: Column) -> Column:
    return F.ceil(F.length(x) / 3.5)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(vec: Column, query: Column) -> Column:
    """Dot product with the normalised query; stored vectors count as unit. A zero query gives 0."""
    norm = F.sqrt(dot(query, query))
    return F.when(norm > 0, dot(vec, query) / norm).otherwise(0.0)


def extension(path: Column) -> Column:
    """The last extension of a path's basename with its dot; none for dot files."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def posix(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def relative_to(path: Column, root: str) -> Column:
    """``path`` below ``root``; other paths stay."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)


def normal_path(path: Column) -> Column:
    """Without './' at the start and without doubled slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"^\./", ""), "//", "/")


# Folders under which a repository keeps its sources; path segments that say nothing.
SOURCE_FOLDERS = "lib examples pkg packages apps internal cmd src".split()
NOISE = "src lib app pkg internal cmd api dist build test tests spec specs docs doc examples example scripts utils helpers common shared core main".split()


def repo_path(path: Column) -> Column:
    """A path without the repository's own folder: before src, if doubled, or before a known source folder."""
    p = F.regexp_replace(path, r"^[^/]+/src/", "src/")
    known = F.regexp_replace(p, rf"(?i)^[^/]+/(?=({'|'.join(SOURCE_FOLDERS)})/)", "")
    return F.when(p.rlike(r"^([^/]+)/\1/"), F.regexp_replace(p, r"^[^/]+/", "")).otherwise(known)


def bare_callee(call: Column) -> Column:
    """A call without its receiver, if what follows the last dot is an identifier."""
    last = F.regexp_extract(call, r"\.([A-Za-z_]\w*)$", 1)
    return F.when(last != "", last).otherwise(call)


def folder_words(path: Column) -> Column:
    """The telling folders of a path as words."""
    parts = F.split(path, "/")
    folders = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: (s != "") & ~F.lower(s).isin(NOISE))
    return F.array_join(F.transform(folders, split_identifiers), " ")


def format_list(items: Column, most: int = 3) -> Column:
    """'a, b, c +n more'."""
    more = F.size(items) - most
    shown = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(F.size(items) == 0, "none").when(more > 0, F.concat(shown, F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(shown)


def path_domain(path: Column) -> Column:
    """The first segment that isn't api, a version or a parameter; else the first segment."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    telling = F.filter(parts, lambda s: ~s.isin("api", "v1", "v2") & ~s.startswith("{"))
    return F.coalesce(F.get(telling, 0), F.get(parts, 0))


def file_group(path: Column) -> Column:
    """What follows 'app' in a path; without it the second segment, or the first."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    at = F.array_position(parts, "app").cast("int")
    return F.when(at > 0, F.coalesce(F.get(parts, at), F.lit("app"))).otherwise(F.coalesce(F.get(parts, 1), F.get(parts, 0), F.lit("other")))


def integration_domain(path: Column) -> Column:
    """The first segment of a route, or the first two behind api and v1."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    two = F.get(parts, 0).isin("api", "v1") & (F.size(parts) > 1)
    return F.when(F.size(parts) == 0, "/").when(two, F.concat(F.lit("/"), F.get(parts, 0), F.lit("/"), F.get(parts, 1))).otherwise(F.concat(F.lit("/"), F.get(parts, 0)))


def file_route(path: Column, app: str) -> Column:
    """The route of a page file below the folder ``app``: groups in parentheses dropped, index is its folder."""
    bare = F.regexp_replace(relative_to(path, app), r"\.[^./]*$", "")
    parts = F.filter(F.split(bare, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    n = F.size(parts)
    kept = F.when(F.get(parts, n - 1) == "index", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def joined_route(prefix: Column, route: Column) -> Column:
    """A router's prefix and a route as one path."""
    both = F.concat(F.lit("/"), F.regexp_replace(F.coalesce(prefix, F.lit("")), "^/+|/+$", ""), F.lit("/"), F.regexp_replace(route, "^/+", ""))
    return F.regexp_replace(F.regexp_replace(both, "/+", "/"), "(.)/$", "$1")


def stable_json(fields: dict[str, Column]) -> Column:
    """JSON of an object with its keys sorted."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


# The four ways in which the engine cuts text into tokens: search, literals, depth, blank.
TOKENISERS = {"search": (r"[^a-z0-9_/.{}-]+", 1), "literal": (r"[^a-z0-9_]+", 3), "depth": (r"[^a-z0-9_]+", 1), "blank": (r"\s+", 1)}


def tokens(text: Column, kind: str) -> Column:
    separator, least = TOKENISERS[kind]
    return words(text, separator, least)


# The same four ways as the tokens themselves, to count them without cutting the text.
RUNS = {"search": r"[a-z0-9_/.{}-]++", "literal": r"[a-z0-9_]{3,}+", "depth": r"[a-z0-9_]++", "blank": r"\S++"}


def token_count(text: Column, kind: str) -> Column:
    """How many ``tokens`` there are."""
    return F.regexp_count(F.lower(text), F.lit(RUNS[kind]))


# Calls that say nothing about a service, whole and by their beginning.
GENERIC = "str dict int len float max join getattr lower open params.append updates.append".split()
GENERIC_HEADS = "service. self. db. session. response. request. app. router. logger. config. os. json. re. datetime. uuid.".split()
ASSETS = ".svg .png .jpg .jpeg .gif .webp .ico .css .scss .less .lock .map".split()


def generic_call(call: Column) -> Column:
    heads = "|".join(h.replace(".", r"\.") for h in GENERIC_HEADS)
    return call.isin(GENERIC) | F.lower(call).rlike(f"^(?:{heads})")


def asset_or_migration(path: Column) -> Column:
    return F.lower(extension(path)).isin(ASSETS) | path.rlike(r"alembic/versions|migrations/\d")


def non_source(path: Column) -> Column:
    """Tests, benches, mocks and fixtures by name; anything in example, demo and sample folders."""
    return basename(path).rlike("(?i)test|spec|bench|mock|fixture") | path.rlike(r"(?i)(^|/)(examples?|demos?|samples?)(/|$)")


def test_node(name: Column) -> Column:
    return F.lower(name).rlike("test|spec|mock")


def paths_related(file: Column, other: Column) -> Column:
    """One path holds the other, or the other ends in the file's basename."""
    return (other != "") & (file.contains(other) | other.contains(file) | other.endswith(basename(file)))


SEARCH_TYPES = "models endpoints components modules tasks files".split()


def search_types(asked: list[str] | None) -> set[str]:
    """The entity types of a comma list; functions only if asked for, or if nothing asked for is known."""
    if not asked:
        return set(SEARCH_TYPES)
    parts = {p.strip().lower() for entry in asked for p in entry.split(",")}
    return parts & {*SEARCH_TYPES, "functions"} or {*SEARCH_TYPES, "functions"}
