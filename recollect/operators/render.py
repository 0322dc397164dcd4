"""Materialised text views: notes of an entity's neighbours, their manifest, and rows in tabular notation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(x: Column) -> Column:
    """A value of the tabular notation: quoted where it could be read as something else."""
    special = (x == "") | (x != F.trim(x)) | x.rlike(r'[,:"\\\n\t\[\]{}]') | x.rlike(r"^-?\d") | x.isin("true", "false", "null") | x.startswith("-")
    escaped = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(x.isNull(), "null").when(special, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(x)


def tabular(df: DataFrame, key: str, name: str, fields: list[str], order: list[str]) -> DataFrame:
    """(key, text): a group's rows as ``name[n]{fields}:`` and a line each."""
    cell = [quoted(F.col(f)) if t == "string" else F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields for t in [dict(df.dtypes)[f]]]
    line = F.concat(F.lit("  "), F.concat_ws(",", *cell))
    rows = df.select(key, F.struct(*order, line.alias("line")).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    head = F.concat(F.lit(f"{name}["), F.size("rows").cast("string"), F.lit("]{" + ",".join(fields) + "}:"))
    return rows.select(key, F.concat_ws("\n", head, F.array_join(F.col("rows.line"), "\n")).alias("text"))


def notes(entities: DataFrame, claims: DataFrame, min_claims: int = 1) -> DataFrame:
    """(entity, note, claims): a note of each entity with its live claims in order of time, label and id.

    ``claims`` (entity, kind, label, recorded_at, node) are the entity's own neighbours, so a note grows with its entity alone.
    """
    line = F.concat(F.lit("- "), "label", F.lit(" ("), F.date_format("recorded_at", "yyyy-MM-dd"), F.lit(") ^"), "node")
    by = claims.withColumn("line", line).groupBy("entity", "kind").agg(F.array_sort(F.collect_list(F.struct("recorded_at", F.lower("label").alias("l"), "node", "line"))).alias("rows"))
    sections = by.select("entity", F.concat(F.lit("## "), "kind", F.lit("\n"), F.array_join(F.col("rows.line"), "\n")).alias("section"), F.size("rows").alias("n"), "kind")
    whole = sections.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("kind", "section"))).alias("s"), F.sum("n").alias("claims"))
    return entities.join(whole, "entity").where(F.col("claims") >= min_claims).select("entity", F.concat(F.lit("# "), "name", F.lit("\n\n"), F.array_join(F.col("s.section"), "\n\n")).alias("note"), "claims")


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(anchor, change) between two renderings (anchor, content_hash): added, deleted or edited."""
    joined = before.select("anchor", F.col("content_hash").alias("a")).join(after.select("anchor", F.col("content_hash").alias("b")), "anchor", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "edited")
    return joined.select("anchor", change.alias("change")).where("change is not null")


def parse_tabular(df: DataFrame, key: str, text: str, fields: list[str]) -> DataFrame:
    """(key, i, fields): the rows of ``tabular`` read back as strings; ``null`` without quotes is null."""
    lines = df.select(key, F.posexplode(F.slice(F.split(text, "\n"), 2, F.size(F.split(text, "\n")))).alias("i", "line"))
    cells = F.regexp_extract_all(F.regexp_replace("line", "^  ", ""), F.lit(r'(?:^|,)("(?:[^"\\]|\\.)*"|[^,]*)'), F.lit(1))
    marked = lines.select(key, "i", cells.alias("c"))

    def value(c: Column) -> Column:
        inner = F.substring(c, F.lit(2), F.length(c) - 2)
        whole = F.replace(F.replace(F.replace(F.replace(inner, F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\u0001"), F.lit("\\"))
        return F.when(c.startswith('"'), whole).when(c == "null", None).otherwise(c)

    return marked.select(key, "i", *[value(F.element_at("c", n + 1)).alias(f) for n, f in enumerate(fields)])


def newest(df: DataFrame, keys: list[str], order: str, keep: int) -> DataFrame:
    """The ``keep`` newest rows of each key, as snapshots are pruned."""
    from pyspark.sql import Window

    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__n") <= keep).drop("__n")
