"""Replies of REST services and nested benchmark files, as text columns of JSON that any reader may have fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import strip

# Keys under which a reply may hold its items, and an item its text; the first that is not empty counts (fixed values).
LISTS = ["conversations", "data", "messages", "results"]
TEXTS = ["content", "text", "message"]


def _first(values: list[Column], size) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(size(v) > 0, v) for v in values])


def items(replies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, i, content, content_type, timestamp): items of replies that are a list or hold one; others give no row.

    ``i`` is the place in the list. Items are texts or objects; those without text are left out. Text that is no JSON
    gives no row.
    """
    doc = F.try_parse_json(body)
    paths = ["$", *[f"$.{name}" for name in LISTS]]
    listed = _first([F.try_variant_get(doc, path, "array<variant>") for path in paths], F.size)
    rows = replies.select(key, F.posexplode(listed).alias("i", "item"))
    of = lambda name: F.try_variant_get("item", f"$.{name}", "string")
    whole = F.when(F.schema_of_variant("item") == "STRING", F.try_variant_get("item", "$", "string"))
    content = F.coalesce(whole, _first([of(name) for name in TEXTS], F.length))
    kind, at = F.coalesce(of("content_type"), F.lit("conversation")), of("timestamp")
    return rows.select(key, "i", content.alias("content"), kind.alias("content_type"), at.alias("timestamp")).where("content <> ''")


def session_turns(samples: DataFrame, key: str, body: str) -> DataFrame:
    """(key, session, place, dia_id, speaker, text, session_date, has_image) of conversations with keys ``session_N``.

    A turn's place is (n, m) of its id ``Dn:m``, else (session, 0). Turns without a text or an id are left out.
    """
    fields = F.from_json(body, "map<string, string>")
    lists = F.map_filter(fields, lambda k, v: k.rlike(r"^session_\d+$"))
    rows = samples.select(key, fields.alias("fields"), F.explode(lists).alias("name", "turns"))
    turn = "array<struct<dia_id: string, speaker: string, text: string, img_url: string, blip_caption: string>>"
    rows = rows.select(key, F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("session"), F.element_at("fields", F.concat("name", F.lit("_date_time"))).alias("date"), F.explode(F.from_json("turns", turn)).alias("t"))
    part = lambda i: F.regexp_extract("t.dia_id", r"^D(\d+):(\d+)", i).cast("int")
    numbered = F.col("t.dia_id").rlike(r"^D\d+:\d+")
    place = F.when(numbered, F.struct(part(1).alias("n"), part(2).alias("m"))).otherwise(F.struct(F.col("session").alias("n"), F.lit(0).alias("m")))
    image = (F.coalesce("t.img_url", F.lit("")) != "") | (F.coalesce("t.blip_caption", F.lit("")) != "")
    out = rows.select(key, "session", place.alias("place"), "t.dia_id", F.coalesce("t.speaker", F.lit("")).alias("speaker"), strip(F.col("t.text")).alias("text"), F.coalesce("date", F.lit("")).alias("session_date"), image.alias("has_image"))
    return out.where("text <> '' and dia_id <> ''")


def questions(samples: DataFrame, key: str, qa: str) -> DataFrame:
    """(key, question, answer, category, evidence): an adversarial answer goes before the plain one.

    Category 5 without an answer expects "not mentioned"; no category is 0; evidence may be one id, a list, or lists.
    """
    shape = "array<struct<question: string, answer: string, adversarial_answer: string, category: string, evidence: string>>"
    rows = samples.select(key, F.explode(F.from_json(qa, shape)).alias("q"))
    category = F.coalesce(F.col("q.category").try_cast("int"), F.lit(0))
    answer = F.coalesce("q.adversarial_answer", "q.answer", F.when(category == 5, "not mentioned").otherwise(""))
    listed = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array(c))
    evidence = F.when(F.col("q.evidence").isNull(), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(listed(F.col("q.evidence")), listed)))
    return rows.select(key, strip(F.col("q.question")).alias("question"), answer.alias("answer"), category.alias("category"), evidence.alias("evidence")).where("question <> ''")
