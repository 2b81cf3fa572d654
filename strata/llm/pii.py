"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from patterns. Three labelers vote on each candidate (1 personal data,
-1 not, 0 abstain): the regex labeler checks its form (octets, Luhn sum, digit count), the
gazetteer labeler looks up parts of it (top-level domains, card issuers, reserved networks),
the context labeler looks for telling words just before it. The votes of all candidates are
counted by pattern, a table of at most ``PATTERNS`` rows at any corpus size; on it
expectation-maximisation estimates each labeler's reliability and each pattern's posterior, and
a logistic span classifier is trained on those posteriors. The classifier is applied as a
column expression.

Base spans (valid matches of the four base patterns) always stay; the classifier can only add
spans. Offsets are code points, ends exclusive.

Defined cases: a null or empty text has no spans; null ids and repeated rows are each returned; spans that
start together are ordered as email, ip, card, phone, secret; an empty table gives an empty
result; further columns are ignored by the finder and kept by the redactor. The patterns are
written without backtracking over repeated groups, so very long texts take linear time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, hex_of, id_and_text, staged

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = 4
#: 5 kinds x 3 votes of 3 labelers x 2 origins x 4 lengths x 2 borders.
PATTERNS = 5 * 27 * 16
#: Spans that are handled together in a text.
BLOCK = 256

# (kind, pattern, text that must occur, is it a base pattern)
FINDERS = [
    (0, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ["@"], True),
    (1, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None, True),
    (2, r"[0-9](?:[\x20-]?[0-9]){11,}+", None, True),
    (3, r"\+[0-9][\x20().0-9-]+[0-9]", ["+"], True),
    (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?| dot )[A-Za-z]{2,10}+", [" dot ", "(dot)", "[dot]"], False),
    (3, r"(?<![0-9+)-]|\+[0-9]{1,3}[ -]?)(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])", None, False),
    (4, r"(?:token|secret|password|api[_-]?key|access[_-]?key)[\"']?\s?[:=]\s?[\"']?[A-Za-z0-9+/_-]{12,}+", ["token", "secret", "password", "key"], False),
]
# Words that the gazetteer and context labelers know.
DOMAINS = "com org net edu gov io de fr es uk eu info biz co us ca".split()
CONTEXT = ["mail|contact|write|e-post", "ip|addr|host|server|node", "card|visa|credit|pay|konto|carte", "phone|call|tel|mobile|fax", "token|secret|password|key"]
AGAINST = ["version|build|isbn|sku|serial|order no|invoice"]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.length(d)

    def step(acc: Column, i: Column) -> Column:
        x = d.substr(i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def valid(kind: int, m: Column) -> Column:
    if kind == 1:
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(999)) <= 255))
    if kind == 2:
        d = digits(m)
        return (F.length(d) <= 19) & luhn(d)
    if kind == 3:
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def regex_vote(kind: int, m: Column, base: bool) -> Column:
    if base:
        return vote(valid(kind, m), ~valid(kind, m))
    if kind == 4:
        return vote(m.rlike("[0-9]") & m.rlike("[A-Za-z]"), F.length(m) < 20)
    return F.lit(1 if kind == 3 else 0)


def gazetteer_vote(kind: int, m: Column) -> Column:
    if kind == 0:
        return vote(F.lower(m).rlike(rf"(?:\.|dot[\])]? ?)(?:{'|'.join(DOMAINS)})$"), m.rlike(r"\.[0-9]+$"))
    if kind == 1:
        return vote(~m.rlike(r"^(?:0|127|255)\."), m.rlike(r"^(?:0\.|[0-9]\.[0-9]\.[0-9]\.[0-9]$)"))
    if kind == 2:
        return vote(m.rlike("^(?:4|5[1-5]|2[2-7]|3[4-7]|6)"), m.rlike("^0"))
    if kind == 3:
        return vote(digits(m).rlike("^(?:1?[2-9]|1)"), digits(m).rlike("^0{2}"))
    return vote(F.length(m) >= 32, F.lower(m).rlike("x{6}|example|changeme"))


def context_vote(kind: int, before: Column) -> Column:
    near = F.lower(F.right(before, F.lit(32)))
    return vote(near.rlike(rf"(?:^|[^a-z])(?:{CONTEXT[kind]})"), near.rlike("|".join(AGAINST)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a plain expression would be computed anew inside each lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running totals of a non-empty array of integers of 0 or more, by blocks, as arrays grow by copying."""
    last = lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(0))
    grown = lambda acc, v: F.concat(acc, F.array(merge(last(acc), v)))
    none = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), none, grown))
    totals = lambda bs: F.aggregate(bs, none, lambda acc, b: grown(acc, last(b)))
    moved = lambda bs, ts: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda v: merge(F.coalesce(F.get(ts, i - 1), F.lit(0)), v))))
    return let(blocks, lambda bs: let(totals(bs), lambda ts: moved(bs, ts)))


def spans_of(kind: int, base: bool, pairs: Column) -> Column:
    """The spans of consecutive (text before, match) pairs."""

    def span(x: Column, end: Column) -> Column:
        m, before = x["m"], x["p"]
        return F.struct(
            F.lit(kind).alias("kind"),
            (end - F.length(m)).alias("start"),
            end.alias("end"),
            (valid(kind, m) if base else F.lit(False)).alias("base"),
            regex_vote(kind, m, base).cast("int").alias("r"),
            gazetteer_vote(kind, m).cast("int").alias("g"),
            context_vote(kind, before).cast("int").alias("c"),
            F.lit(int(base)).alias("origin"),
            F.when(F.length(m) < 12, 0).when(F.length(m) < 20, 1).when(F.length(m) < 40, 2).otherwise(3).alias("size"),
            F.when(before.rlike(r"(?:^|\W)$"), 1).otherwise(0).alias("border"),
        )

    ends = lambda ps: running(F.transform(ps, lambda x: F.length(x["p"]) + F.length(x["m"])), lambda a, b: a + b)
    return let(pairs, lambda ps: let(ends(ps), lambda es: F.transform(ps, lambda x, i: span(x, F.get(es, i)))))


def with_candidates(docs: DataFrame, text_col: str = "text", to: str = "candidates") -> DataFrame:
    """Adds an array of (kind, start, end, base, votes r, g, c, origin, size, border)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs
    for k, (_, pattern, needs, _) in enumerate(FINDERS):
        could = F.lit(True)
        for i, x in enumerate(needs or []):
            could = text.contains(x) if i == 0 else could | text.contains(x)
        none = F.array().cast("array<string>")
        out = out.withColumn(f"__m{k}", F.when(could, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none))
    for k, (_, pattern, _, _) in enumerate(FINDERS):
        out = out.withColumn(f"__p{k}", F.when(F.size(f"__m{k}") > 0, F.split(text, pattern, -1)))
    found = []
    for k, (kind, _, _, base) in enumerate(FINDERS):
        kinds = "array<struct<kind:int,start:int,end:int,base:boolean,r:int,g:int,c:int,origin:int,size:int,border:int>>"
        empty = F.array().cast(kinds)
        pairs = F.zip_with(F.slice(f"__p{k}", F.lit(1), F.size(f"__m{k}")), F.col(f"__m{k}"), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        found.append(F.when(F.size(f"__m{k}") > 0, spans_of(kind, base, pairs)).otherwise(empty))
    return out.withColumn(to, F.concat(*found)).drop(*(f"__{x}{k}" for k in range(len(FINDERS)) for x in "mp"))


FEATURES = ["kind", "r", "g", "c", "origin", "size", "border"]


@dataclass
class SpanModel:
    """Reliabilities of the labelers and the weights of the span classifier."""

    reliability: list[tuple[float, float]]
    weights: list[float]

    @staticmethod
    def inputs(row: dict) -> list[float]:
        one = [float(row["kind"] == k) for k in range(len(KINDS))]
        return [1.0, *one, *(float(row[v]) for v in "rgc"), float(row["origin"]), float(row["size"]), float(row["border"])]

    def score(self, s: Column) -> Column:
        """The classifier's log odds of a candidate."""
        w = self.weights
        total = F.lit(w[0])
        for k in range(len(KINDS)):
            total = total + F.when(s["kind"] == k, w[1 + k]).otherwise(0.0)
        for i, name in enumerate(["r", "g", "c", "origin", "size", "border"]):
            total = total + s[name] * F.lit(w[1 + len(KINDS) + i])
        return total


def fit(counts: list[dict], rounds: int = 50) -> SpanModel:
    """EM over vote patterns, then a logistic classifier on the posteriors.

    counts: rows with FEATURES and ``n``, at most PATTERNS of them.
    """
    post = [min(0.95, max(0.05, 0.5 + 0.3 * (x["r"] + x["g"] + x["c"]))) for x in counts]
    theta: list[dict] = [{} for _ in range(3)]
    for _ in range(rounds):
        prior = {}
        for k in range(len(KINDS)):
            n = sum(x["n"] for x in counts if x["kind"] == k)
            prior[k] = (1 + sum(p * x["n"] for p, x in zip(post, counts, strict=True) if x["kind"] == k)) / (2 + n)
        for j, name in enumerate("rgc"):
            for y in (0, 1):
                mass = [(p if y else 1 - p) * x["n"] for p, x in zip(post, counts, strict=True)]
                total = sum(mass)
                for v in (-1, 0, 1):
                    # a labeler is taken to be right more often than wrong: 4 pseudo-votes
                    pull = 4.0 if v == (1 if y else -1) else 1.0
                    theta[j][y, v] = (pull + sum(m for m, x in zip(mass, counts, strict=True) if x[name] == v)) / (6 + total)
        post = []
        for x in counts:
            a, b = math.log(prior[x["kind"]]), math.log(1 - prior[x["kind"]])
            for j, name in enumerate("rgc"):
                a += math.log(theta[j][1, x[name]])
                b += math.log(theta[j][0, x[name]])
            post.append(1 / (1 + math.exp(max(-50, min(50, b - a)))))
    xs = [SpanModel.inputs(x) for x in counts]
    w = [0.0] * 12
    total = sum(x["n"] for x in counts) or 1
    for _ in range(300):
        grad = [0.002 * v for v in w]
        for x, row, p in zip(xs, counts, post, strict=True):
            q = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x, strict=True))))))
            g = (q - p) * row["n"] / total
            for i, v in enumerate(x):
                grad[i] += g * v
        w = [a - 1.0 * g for a, g in zip(w, grad, strict=True)]
    return SpanModel([(theta[j].get((1, 1), 0.0), theta[j].get((0, -1), 0.0)) for j in range(3)], w)


def trained(candidates: DataFrame) -> SpanModel:
    """The model of a staged table with a ``candidates`` column, from counts over all its rows."""
    flat = candidates.select(F.explode("candidates").alias("s")).select(*(F.col(f"s.{f}").alias(f) for f in FEATURES))
    return fit([r.asDict() for r in bounded_rows(flat.groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n")).orderBy(*FEATURES), PATTERNS)])


def accepted(candidates: Column, model: SpanModel) -> Column:
    """Base spans and those that the classifier adds, by start and kind."""
    clear = F.filter(candidates, lambda s: s["base"] | ((model.score(s) >= 0) & (s["r"] >= 0)))
    return F.array_sort(F.transform(clear, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))


def listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*(F.lit(x) for x in KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = staged(with_candidates(id_and_text(docs, id_col, text_col)).select("doc_id", "candidates"), "candidates")
    out = rows.withColumn("all", accepted(F.col("candidates"), trained(rows))).withColumn("base", F.filter("all", lambda s: s["base"]))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))
    count = [of_kind(k).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return out.select("doc_id", *count, hex_of(listed(F.col("base"))).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans (by start) replaced by its first kind in brackets.

    A substring is found by walking from the start of a text, so blocks of spans walk in their own part.
    """
    name = lambda k: F.element_at(F.array(*(F.lit(f"[{x.upper()}]") for x in KINDS)), k + 1)

    def block(sp: Column, ends: Column, b: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        first, last = b * BLOCK, F.least((b + 1) * BLOCK, F.size(sp)) - 1
        low = before(first)
        part = text.substr(low + 1, F.greatest(F.get(sp, last)["start"] - low, F.lit(0)))

        def shown(x: Column, seg: Column) -> Column:
            s, at = F.get(sp, x), before(x)
            return F.when(s["start"] >= at, F.concat(seg.substr(at - low + 1, s["start"] - at), name(s["kind"]))).otherwise("")

        return let(part, lambda seg: F.array_join(F.transform(F.sequence(first, last), lambda x: shown(x, seg)), ""))

    def whole(sp: Column, ends: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sp) - 1) / BLOCK).cast("int")), lambda b: block(sp, ends, b))
        return F.concat(F.array_join(blocks, ""), text.substr(F.get(ends, F.size(ends) - 1) + 1, F.length(text)))

    reach = lambda sp: running(F.transform(sp, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, let(spans, lambda sp: let(reach(sp), lambda ends: whole(sp, ends)))).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in the text; all columns stay, in order.

    Two passes over the texts: one counts vote patterns for the model, one rewrites. Nothing
    is shuffled. Null texts stay null; ``length_col`` follows the new text where it exists.
    """
    counted = staged(with_candidates(docs.select(F.col(text_col).alias("text")), "text").select("candidates"), "candidates")
    model = trained(counted)
    out = with_candidates(docs, text_col, "__candidates").withColumn("__spans", accepted(F.col("__candidates"), model))
    out = out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), redacted(F.col(text_col), F.col("__spans"))))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.size("__spans") > 0, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
