"""What a result card shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodefinder.functions.values import provenance_label, rounded


def subtitle() -> Column:
    """Year, genres and styles with dots between, or a placeholder; then country and label."""
    facts = F.concat_ws(" · ", F.nullif("year", F.lit(0)).cast("string"), "genres", "styles")
    return F.concat_ws(" — ", F.coalesce(F.nullif(facts, F.lit("")), F.lit("no data")), F.nullif(F.concat_ws(", ", "country", "label"), F.lit("")))


def first_video(sources: Column) -> Column:
    return F.try_element_at(F.filter(sources, lambda s: s["kind"] == "youtube"), F.lit(1))


def is_analyzed() -> Column:
    return F.coalesce(F.col("bpm.method") == "analyzed", F.lit(False)) | F.coalesce(F.col("key.method") == "analyzed", F.lit(False))


def readout() -> Column:
    """Rounded bpm or a dash, and where it comes from."""
    return F.concat_ws(" ", F.coalesce(rounded(F.col("bpm.value")).cast("string"), F.lit("—")), provenance_label(F.col("bpm")))
