"""Personal data (operator 10): weak supervision with built-in functions only.

Base patterns and wider ones (spelled-out addresses, national phone numbers, cards with
other separators, IPv6) propose spans. Five labelers vote +1, 0 or -1 on each:
the base rule, a gazetteer (top-level domains, issuers, calling codes, address
ranges), words near the span, its boundaries, and its shape. Counts of vote patterns (at most
3**5 for each kind and form) feed an expectation-maximisation that estimates every
labeler's reliability; its soft labels train a logistic span classifier, which is
applied as a column expression. Base spans stay; a further span is added where the classifier
gives it a half or more and no base span overlaps it.

Positions are code points. They come from the lengths of the gaps between matches, so
a text is scanned by the pattern engine alone; patterns are possessive and anchored to
the start of a run, so long texts neither recurse nor cost squared time.
Null text counts as empty; every row gives a row, repeated rows and null ids too. An empty table gives
no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import common

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
#: (kind, form, pattern, a substring or pattern that must occur first)
PATTERNS = [
    ("email", "base", _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", "base", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", "base", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    ("phone", "base", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    ("email", "wide", _LOCAL + r" ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]++)++", r"[\[({]at[\])}]"),
    ("ip", "wide", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("card", "wide", r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])", r"[0-9]{4}[._/][0-9]{4}"),
    ("phone", "wide", r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", r"[0-9]{3}[ .-][0-9]{4}"),
]
LABELERS = ["rule", "gazetteer", "context", "boundary", "shape"]
CONTEXT = 32
NEAR = {
    "email": r"mail|contact|write|reach|correo|courriel|adresse|kontakt",
    "ip": r"\bip\b|host|server|client|login|logged|address|adresse",
    "card": r"card|visa|master|amex|credit|debit|payment|tarjeta|carte|karte",
    "phone": r"phone|tel|call|mobile|fax|cell|whatsapp|appel|anruf|llam",
}
AGAINST = r"version|release|isbn|issn|invoice|order|serial|sha|hash|token|commit|\bid\b|\bv$"


def pieces(text: Column, kind: str, form: str, pattern: str, first: str) -> Column:
    """An array of (kind, form, nth, gap, value, left, right) of a pattern's matches."""
    empty = F.array().cast("array<string>")
    there = text.contains(first) if first == "@" else text.rlike(first)
    found = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)
    gaps = F.when(there, F.split(text, pattern, -1)).otherwise(empty)
    zipped = F.arrays_zip(found.alias("value"), F.slice(gaps, 1, F.size(found)).alias("gap"), F.slice(gaps, 2, F.size(found)).alias("after"))
    return F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(form).alias("form"), i.alias("nth"), F.length(x["gap"]).alias("gap"), x["value"].alias("value"),
            F.lower(F.substring(x["gap"], F.greatest(F.length(x["gap"]) - (CONTEXT - 1), F.lit(1)), F.lit(CONTEXT))).alias("left"), F.lower(F.substring(x["after"], 1, CONTEXT)).alias("right"),
        ),
    )


def votes() -> dict[str, Column]:
    """A column of -1, 0 or 1 for each labeler."""
    value, kind, form = F.col("value"), F.col("kind"), F.col("form")
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    sign = lambda yes: F.when(yes, 1).otherwise(-1)
    by = lambda **c: F.coalesce(*[F.when(kind == k, v) for k, v in c.items()], F.lit(0))
    parts = F.split(value, r"\.")
    small = F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255))
    luhn = n.between(13, 19) & F.call_function("luhn_check", digits)
    rule = by(email=F.lit(1), ip=sign(small), card=sign(luhn), phone=sign(n.between(9, 15)))
    top = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    domains = "com|org|net|edu|gov|io|co|info|biz|de|fr|es|it|uk|eu|us|ca|ch|at|nl|be|mx|ar|br|au|jp|in"
    issuers = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
    gazetteer = by(
        email=sign(top.rlike(f"^({domains})$")), ip=F.when(form == "wide", 0).otherwise(sign(~value.rlike(r"^(0|127|22[4-9]|2[3-5][0-9])\."))),
        card=sign(digits.rlike(issuers)), phone=F.when(form == "wide", sign(digits.rlike("^[2-9][0-9]{2}[2-9]"))).otherwise(sign(digits.rlike("^(1[2-9]|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1-6]|9[0-58])"))),
    )
    near = by(**{k: F.when(F.col("left").rlike(p), 1).otherwise(0) for k, p in NEAR.items()})
    context = F.when(near == 1, 1).when(F.col("left").rlike(AGAINST), -1).otherwise(0)
    boundary = sign(~F.col("left").rlike(r"[\p{L}0-9_/=]$") & ~F.col("right").rlike(r"^[\p{L}0-9_=]"))
    shape = by(email=sign(F.length(value).between(6, 64)), ip=F.when(form == "wide", 1).otherwise(sign(~value.rlike(r"(^|\.)0[0-9]"))), card=sign(n.between(15, 16)), phone=sign(n.between(10, 13)))
    return {"rule": F.when(form == "base", rule).when(kind == "card", sign(luhn)).otherwise(0), "gazetteer": gazetteer, "context": context, "boundary": boundary, "shape": shape}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, key, kind, form, start, end, base, labelers' votes), written; a row with null kind where a text has none.

    ``key`` is a hash of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("uid", "doc_id", F.xxhash64("text").alias("key"), F.inline_outer(F.concat(*[pieces(F.col("text"), *p) for p in PATTERNS])))
    before = Window.partitionBy("uid", "kind", "form").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(before)).withColumn("start", F.col("end") - F.length("value"))
    voted = placed.withColumns({k: v.cast("int") for k, v in votes().items()})
    return common.materialize(voted.select("uid", "doc_id", "key", "kind", "form", "start", "end", (F.col("form").eqNullSafe("base") & (F.col("rule") == 1)).alias("base"), *LABELERS), "spans")


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """By expectation-maximisation: the share of true spans, and for each labeler P(vote | false), P(vote | true)."""
    weight = lambda votes: 1 / (1 + math.exp(-1.5 * sum(votes)))
    soft = [weight(v) for v, _ in patterns]
    prior, tables = 0.5, []
    for _ in range(rounds):
        true = sum(p * n for p, (_, n) in zip(soft, patterns, strict=True))
        total = sum(n for _, n in patterns)
        prior = min(max((true + 1) / (total + 2), 0.01), 0.99)
        tables = []
        for j in range(len(LABELERS)):
            counts = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for p, (votes, n) in zip(soft, patterns, strict=True):
                counts[votes[j]][0] += (1 - p) * n
                counts[votes[j]][1] += p * n
            whole = [sum(c[y] for c in counts.values()) for y in (0, 1)]
            tables.append({v: (c[0] / whole[0], c[1] / whole[1]) for v, c in counts.items()})
        soft = [posterior(prior, tables, v) for v, _ in patterns]
    return prior, tables


def posterior(prior: float, tables: list[dict[int, tuple[float, float]]], votes: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][1] / t[v][0]) for t, v in zip(tables, votes, strict=True))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))


def features(form: str, votes: tuple[int, ...]) -> list[float]:
    return [1.0, float(form == "wide"), *[float(v == 1) for v in votes], *[float(v == -1) for v in votes]]


def classifier(rows: list[tuple[str, tuple[int, ...], int, float]], steps: int = 400, rate: float = 1.0, l2: float = 1e-3) -> list[float]:
    """Weights of a logistic regression on (form, votes, count, soft label)."""
    x = [(features(f, v), n, y) for f, v, n, y in rows]
    total = sum(n for _, n, _ in x)
    w = [0.0] * len(x[0][0])
    for _ in range(steps):
        g = [l2 * a for a in w]
        for f, n, y in x:
            d = (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f, strict=True)))) - y) * n / total
            for i, b in enumerate(f):
                if b:
                    g[i] += d
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def train(found: DataFrame) -> dict[str, list[float]]:
    """Each kind's classifier, from the counts of vote patterns: 2 * 3**5 rows a kind at most."""
    rows = found.where("kind is not null").groupBy("kind", "form", *LABELERS).count().collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: [str(v) for v in r]):
        by[r["kind"]].append((r["form"], tuple(r[k] for k in LABELERS), r["count"]))
    out = {}
    for kind, patterns in by.items():
        merged = defaultdict(int)
        for _, v, n in patterns:
            merged[v] += n
        prior, tables = reliabilities(sorted(merged.items()))
        out[kind] = classifier([(f, v, n, posterior(prior, tables, v)) for f, v, n in patterns])
    return out


def accepted(weights: dict[str, list[float]]) -> Column:
    """Whether the classifier gives a candidate a half or more."""
    out = F.lit(False)
    for kind, w in weights.items():
        terms = [F.lit(w[0]), F.when(F.col("form") == "wide", w[1]).otherwise(0.0)]
        for i, name in enumerate(LABELERS):
            terms.append(F.when(F.col(name) == 1, w[2 + i]).when(F.col(name) == -1, w[2 + len(LABELERS) + i]).otherwise(0.0))
        out = F.when(F.col("kind") == kind, sum(terms[1:], terms[0]) >= 0).otherwise(out)
    return out


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, base, all): arrays of (rank of the kind, start, end) of every row, sorted."""
    found = candidates(docs, id_col, text_col)
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    span = F.struct(rank.alias("kind"), F.col("start").alias("start"), F.col("end").alias("end"))
    listed = found.withColumn("added", accepted(train(found))).groupBy("uid", "doc_id", "key").agg(F.collect_list(F.when(F.col("base"), span)).alias("base"), F.collect_list(F.when(~F.col("base") & F.col("added"), span)).alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return listed.select("doc_id", "key", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", free)).alias("all"))


def joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, each span of ``text_col`` replaced by its kind in angle brackets.

    Spans of overlapping kinds become one, named by the first.
    """
    found = spans(docs, id_col, text_col).where(F.size("all") > 0).select(F.col("doc_id").alias("id"), "key", "all").dropDuplicates(["id", "key"])
    flat = found.select("id", "key", F.explode("all").alias("s")).select("id", "key", "s.start", "s.end", "s.kind")
    by = Window.partitionBy("id", "key").orderBy("start", "end", "kind")
    ahead = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    flat = flat.withColumn("fresh", (F.coalesce(ahead, F.lit(-1)) <= F.col("start")).cast("int"))
    flat = flat.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = flat.groupBy("id", "key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    ident, key, named = common.unused(docs.columns, "id", "key", "spans")
    lists = merged.groupBy(F.col("id").alias(ident), F.col("key").alias(f"{key}_of")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(named))
    text, listed = F.col(text_col), F.col(named)
    tag = lambda s: F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(">"))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(listed, lambda s: s["end"]))
    part = F.transform(listed, lambda s, i: F.concat(F.substring(text, (F.element_at(ends, i + 1) + 1).cast("int"), (s["start"] - F.element_at(ends, i + 1)).cast("int")), tag(s)))
    tail = F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text))
    clean = F.when(listed.isNull(), text).otherwise(F.concat(F.array_join(part, ""), tail))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(text, F.lit(""))))
    out = keyed.join(lists, keyed[id_col].eqNullSafe(F.col(ident)) & (F.col(key) == F.col(f"{key}_of")), "left")
    return out.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op10_pii_weak(spark, sf_dir: str) -> DataFrame:
    found = spans(common.documents(spark, sf_dir))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("all").alias("spans"))


QUERIES = {"op10_pii_weak": op10_pii_weak}
ORACLES: dict[str, str] = {}
