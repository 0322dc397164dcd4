"""Note vaults: front matter, claim lines with anchors, and edits taken back into the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.temporal import iso_time

# Names of front matter fields, and the sections under which a line is a claim (fixed values).
DATES = ["date", "created", "created_at"]
SECTIONS = {"Decisions": "decision", "Facts": "fact", "Preferences": "preference", "Events": "event"}
ANCHOR = r"\s*<!--\s*rv:([0-9a-zA-Z-]+)\s*-->\s*$"


def front_matter(notes: DataFrame, path: str, content: str, mark: str = "recollect") -> DataFrame:
    """(path, tags, date, derived, body): tags in a line or as a list below, the first date that can be read, and the rest of the note.

    ``derived`` notes say so in their field ``mark``: they were rendered from the graph and are no source.
    """
    head = F.regexp_extract(content, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    lines = F.transform(F.split(head, "\n"), lambda s: F.trim(s))
    field = lambda names: F.regexp_extract_all(F.concat(F.lit("\n"), head), F.lit(rf"(?i)\n[ \t]*(?:{names})[ \t]*:[ \t]*([^\n]*)"), F.lit(1))
    bare = lambda x: F.btrim(F.trim(x), F.lit("\"'#"))
    inline = F.flatten(F.transform(field("tags|tag"), lambda v: F.split(F.btrim(v, F.lit("[]")), r"[,\s]+")))
    block = F.flatten(F.transform(F.regexp_extract_all(F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n")), F.lit(r"(?i)\ntags?[ \t]*:[ \t]*((?:\n- [^\n]*)+)"), F.lit(1)), lambda v: F.regexp_extract_all(v, F.lit(r"\n- ([^\n]*)"), F.lit(1))))
    tags = F.filter(F.transform(F.concat(inline, block), bare), lambda t: t != "")
    dates = F.filter(F.transform(field("|".join(DATES)), lambda v: iso_time(v)), lambda v: v.isNotNull())
    body = F.regexp_replace(content, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "")
    derived = F.lower(bare(F.coalesce(F.try_element_at(field(mark), F.lit(-1)), F.lit("")))) == "derived"
    return notes.select(path, tags.alias("tags"), F.try_element_at(dates, F.lit(1)).alias("date"), derived.alias("derived"), body.alias("body"))


def claim_text(line: Column) -> Column:
    """struct(anchor, text) of a list line's body: the anchor at its end, and without it and its provenance the claim."""
    anchor = F.regexp_extract(line, ANCHOR, 1)
    bare = F.when(anchor == "", line).otherwise(F.regexp_replace(F.regexp_replace(line, ANCHOR, ""), r"\s*\*\([^)]*\)\*\s*$", ""))
    return F.struct(F.when(anchor != "", anchor).alias("anchor"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))


def claim_lines(notes: DataFrame, note: str, content: str) -> DataFrame:
    """(note, i, section, anchor, text) of the list lines of notes, each under the heading before it."""
    lines = notes.select(note, F.posexplode(F.split(content, "\n")).alias("i", "line"))
    heading = F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*$", 1)
    by = Window.partitionBy(note).orderBy("i")
    under = lines.withColumn("section", F.last(F.when(heading != "", heading), ignorenulls=True).over(by))
    claims = under.where(F.col("line").rlike(r"^\s*- ")).withColumn("c", claim_text(F.regexp_replace("line", r"^\s*- ", "")))
    return claims.select(note, "i", "section", "c.anchor", "c.text").where("text <> ''")


def reconcile(manifest: DataFrame, notes: DataFrame, note: str = "note", content: str = "content", marker: str = "recollect: derived") -> DataFrame:
    """(note, action, anchor, section, text) of what users did to rendered notes since ``manifest`` (note, anchor, content_hash).

    A line whose text has another hash is ``corrected``; one without an anchor under a claims' heading is ``added``; an anchor that is
    nowhere in a whole note, nor in the manifest of another, is ``forgotten``. A note that lost its marker is not judged.
    """
    intact = notes.where(F.col(content).contains(marker))
    lines = claim_lines(intact.join(manifest.select(note).distinct(), note, "left_semi"), note, content)
    first = lines.where("anchor is not null").groupBy(note, "anchor").agg(F.min_by(F.struct("section", "text"), "i").alias("l"))
    edited = first.join(manifest, [note, "anchor"]).where(F.sha2(F.col("l.text").cast("binary"), 256) != F.col("content_hash"))
    corrected = edited.select(note, F.lit("corrected").alias("action"), "anchor", "l.section", "l.text")
    added = lines.where("anchor is null").where(F.col("section").isin(list(SECTIONS))).select(note, F.lit("added").alias("action"), "anchor", "section", "text")
    present = intact.select(note, F.explode(F.regexp_extract_all(content, F.lit(r"<!--\s*rv:([0-9a-zA-Z-]+)\s*-->"), F.lit(1))).alias("anchor")).distinct()
    shown = manifest.groupBy("anchor").agg(F.countDistinct(note).alias("notes"))
    lost = manifest.join(intact.select(note).distinct(), note, "left_semi").join(present, [note, "anchor"], "left_anti").join(shown.where("notes = 1"), "anchor", "left_semi")
    none = F.lit(None).cast("string")
    return corrected.unionByName(added).unionByName(lost.select(note, F.lit("forgotten").alias("action"), "anchor", none.alias("section"), none.alias("text")))
