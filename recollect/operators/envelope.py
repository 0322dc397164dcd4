"""What an input's envelope says about the nodes made from it: modality, time, curation, place in a benchmark; and tables of older shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stamp(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """``nodes`` (source_id, node_type, confidence, ...) with what ``inputs`` (a source_id once) say of their source.

    Every node gets source_modality, vision_processed and recorded_at, but only contexts whether the text can answer; nodes of
    curated inputs are sure (confidence 1) and flagged. Nodes of unknown sources have nulls there and are not curated.
    """
    told = inputs.select("source_id", "source_modality", "vision_processed", "recorded_at", F.col("answerable_by_text").alias("__answers"), F.col("curated").alias("__curated"))
    joined = nodes.drop("source_modality", "vision_processed", "recorded_at", "answerable_by_text", "curated").join(told, "source_id", "left")
    curated = F.coalesce("__curated", F.lit(False))
    return joined.withColumns({
        "answerable_by_text": F.when(F.col("node_type") == "context", F.col("__answers")),
        "confidence": F.when(curated, 1.0).otherwise(F.col("confidence")), "curated": curated,
    }).drop("__answers", "__curated")


def reconcilable(curated: Column, source: Column) -> Column:
    """Whether a distilled note may edit a claim: not those that people wrote elsewhere, but those that came from such an edit."""
    return ~F.coalesce(curated, F.lit(False)) | F.coalesce(source == "vault_reconcile", F.lit(False))


def turn_inputs(turns: DataFrame, captions: bool = False) -> DataFrame:
    """Inputs of benchmark turns (conv, dia_id, session, speaker, text, has_image, caption, recorded_at): source_id, content and envelope.

    A turn with an image is mixed; only where ``captions`` are taken into the text has the image been seen, and can the text answer.
    """
    seen = F.lit(captions) & F.col("has_image") & (F.coalesce("caption", F.lit("")) != "")
    content = F.concat("speaker", F.lit(": "), "text", F.when(seen, F.concat(F.lit(" [image: "), "caption", F.lit("]"))).otherwise(""))
    return turns.select(
        F.concat_ws(":", "conv", "dia_id").alias("source_id"), content.alias("content"), "recorded_at", F.when(F.col("has_image"), "mixed").otherwise("text").alias("source_modality"),
        seen.alias("vision_processed"), (~F.col("has_image") | seen).alias("answerable_by_text"), F.lit(False).alias("curated"),
    )


def tag(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with dia_id, session and conv of the turn that they came from; other nodes have nulls."""
    told = turns.select(F.concat_ws(":", "conv", "dia_id").alias("source_id"), "dia_id", "session", F.col("conv").alias("conv"))
    return nodes.join(told, "source_id", "left").select(*nodes.columns, "dia_id", "session", "conv")


def migrate(rows: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """``rows`` of an older shape in the present ``schema``: new columns get their default (null without one), known ones the present type.

    Migrations only add: a column of ``rows`` that the schema does not have is an error.
    """
    want, given = T.StructType.fromDDL(schema), {f.name: f for f in rows.schema}
    if unknown := sorted(given.keys() - set(want.names)):
        raise ValueError(f"columns that the present tables do not have: {unknown}")
    new = lambda f: F.lit((defaults or {}).get(f.name)).cast(f.dataType)
    return rows.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in given else new(f)).alias(f.name) for f in want])
