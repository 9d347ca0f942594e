"""The explainable score: seven components from 0 to 1, their weighted total, and the reasons for it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefinder.functions import vocab
from lodefinder.functions.values import clamp, rounded


@dataclass(frozen=True)
class SearchQuery:
    """What is asked for. Filters are soft: they score, they never drop. mode, styles, feels, textures, energy are accepted and not read."""

    text: str = ""
    genres: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    year: tuple[int, int] | None = None
    bpm: tuple[float, float] | None = None
    key: str | None = None
    sources: tuple[str, ...] = ()
    mode: str | None = None
    styles: tuple[str, ...] = ()
    feels: tuple[str, ...] = ()
    textures: tuple[str, ...] = ()
    energy: tuple[int, int] | None = None

    def patched(self, **changes) -> SearchQuery:
        return replace(self, **changes)

    def remote_text(self) -> str:
        """Text, genres and instruments as one query."""
        return " ".join(x for x in [self.text, *self.genres, *self.instruments] if x)


def asked_instruments(q: SearchQuery) -> Column:
    """The asked instruments that the track has, as asked."""
    have = F.transform(F.coalesce(F.col("instruments.value"), F.array().cast("array<string>")), F.lower)
    return F.filter(F.array(*map(F.lit, q.instruments)) if q.instruments else F.array().cast("array<string>"), lambda i: F.array_contains(have, F.lower(i)))


def any_contains(tags: Column, part: str) -> Column:
    return F.exists(tags, lambda t: t.contains(part))


def filter_match(q: SearchQuery) -> Column:
    """Share of the applicable filters that the track meets; 0.6 if none applies."""
    checks: list[tuple[Column, Column]] = []  # applies, is met
    if q.genres:
        tags = F.transform(F.concat("genres", "styles"), F.lower)
        met = F.lit(False)
        for g in q.genres:
            met = met | any_contains(tags, g.lower())
        checks.append((F.lit(True), met))
    if q.instruments:
        checks.append((F.lit(True), F.size(asked_instruments(q)) > 0))
    if q.year:
        checks.append((F.lit(True), F.coalesce(F.nullif("year", F.lit(0)).between(*q.year), F.lit(False))))
    if q.bpm:
        checks.append((F.col("bpm").isNotNull(), F.coalesce(F.col("bpm.value").between(*q.bpm), F.lit(False))))
    if q.key:
        checks.append((F.col("key").isNotNull(), F.coalesce(F.lower("key.value").startswith(q.key.lower()), F.lit(False))))
    if not checks:
        return F.lit(0.6)
    count = sum((a.cast("int") for a, _ in checks), F.lit(0))
    hits = sum(((a & m).cast("int") for a, m in checks), F.lit(0))
    return F.coalesce(F.try_divide(hits.cast("double"), count.cast("double")), F.lit(0.6))


def rarity() -> Column:
    ratio = F.col("want") / F.greatest("have", F.lit(1))
    return F.when(F.col("want").isNull() | F.col("have").isNull(), F.lit(0.3)).otherwise(clamp(F.log10(1 + ratio) / 2))


def age_factor() -> Column:
    return clamp(F.coalesce("age_days", F.lit(3650)) / 365)


def obscurity() -> Column:
    raw = clamp(1 - F.log10(F.greatest("video_views", F.lit(10)).cast("double")) / 6)
    return F.when(F.col("video_views").isNull(), F.lit(0.4)).otherwise(clamp(raw * (0.5 + 0.5 * age_factor())))


def richness() -> Column:
    facts = [F.col("n_credits") > 0, F.coalesce("year", F.lit(0)) != 0, F.coalesce("label", F.lit("")) != "", F.size(F.concat("genres", "styles")) > 0, F.col("confirmed")]
    return sum((f.cast("int") for f in facts), F.lit(0)) / 5.0


def source_quality() -> Column:
    """Every track here has a source; short and very long ones count less."""
    d = F.coalesce("duration_sec", F.lit(0))
    q = F.when(F.col("confirmed"), F.lit(0.7)).otherwise(F.lit(0.45))
    return clamp(q - F.when((d > 0) & (d < 30), F.lit(0.2)).when(d > 1800, F.lit(0.3)).otherwise(F.lit(0.0)))


def golden_span() -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for a, b in vocab.GOLDEN_YEARS:
        chain = chain.when(F.col("year").between(a, b), f"{a}-{b}")
    return chain


def history() -> Column:
    return F.when(F.coalesce("year", F.lit(0)) == 0, F.lit(0.4)).when(golden_span().isNotNull(), F.lit(0.9)).otherwise(F.lit(0.5))


def gem_seed() -> Column:
    """Wanted per copy, by the order of magnitude of views."""
    return (F.col("want") / F.greatest("have", F.lit(1))) / F.log10(F.greatest("video_views", F.lit(10)).cast("double"))


def components(tracks: DataFrame, q: SearchQuery) -> DataFrame:
    """Tracks (with a column affinity, else 0.5 is taken) and the other six components."""
    base = tracks if "affinity" in tracks.columns else tracks.withColumn("affinity", F.lit(0.5))
    return base.withColumns({"filter_match": filter_match(q), "rarity": rarity(), "obscurity": obscurity(), "richness": richness(), "source_quality": source_quality(), "history": history()})


def total(weights: dict[str, float] | None = None) -> Column:
    weights = weights or vocab.WEIGHTS
    return rounded(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / sum(weights.values()) * 100)


def reasons(q: SearchQuery) -> Column:
    """Why a track ranks where it does: filters, rarity, obscurity, history, affinity, in this order."""
    asked = asked_instruments(q)
    return F.array_compact(
        F.array(
            F.when(F.size(asked) > 0, F.concat(F.lit("has "), F.array_join(asked, " + "))),
            F.when(F.col("want").isNotNull() & F.col("have").isNotNull() & (F.col("rarity") > 0.6), F.concat(F.col("want").cast("string"), F.lit(" want it, "), F.col("have").cast("string"), F.lit(" have it"))),
            F.when((F.col("video_views") < 1000) & (age_factor() > 0.5), F.concat(F.lit("only "), F.col("video_views").cast("string"), F.lit(" views"))),
            F.when(golden_span().isNotNull(), F.concat(F.lit("from "), golden_span())),
            F.when(F.col("affinity") > 0.6, F.concat(rounded(F.col("affinity") * 100).cast("string"), F.lit("% to your taste"))),
        )
    )


def tier(score: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for low, name in vocab.TIERS:
        chain = chain.when(score >= low, name)
    return chain.otherwise(vocab.LOWEST_TIER)


def scored(tracks: DataFrame, q: SearchQuery, weights: dict[str, float] | None = None) -> DataFrame:
    made = components(tracks, q)
    return made.withColumns({"dig_score": total(weights), "reasons": reasons(q)}).withColumn("tier", tier(F.col("dig_score")))
