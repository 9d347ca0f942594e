"""Numbers, dates, lists, hosts and provenance as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodefinder.functions import vocab
from lodefinder.functions.text import matched


def clamp(x: Column) -> Column:
    """x within 0..1; null stays null, which greatest and least alone would not give."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def rounded(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5).cast("int")


def duration_seconds(iso: Column) -> Column:
    """Seconds of PT[nH][nM][nS]; null for other forms, days too."""
    form = "^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(iso, form, i), F.lit("")).cast("long"), F.lit(0))
    return F.when(iso.rlike(form), part(1) * 3600 + part(2) * 60 + part(3))


def decade(year: Column) -> Column:
    y = F.nullif(year, F.lit(0))
    return F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s"))


def bpm_bucket(bpm: Column) -> Column:
    low = F.floor(bpm / 10) * 10
    return F.concat(low.cast("string"), F.lit("-"), (low + 10).cast("string"))


def days_since(moment: Column, as_of: Column) -> Column:
    """Whole days, rounded half up, never below 0."""
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(moment.cast("timestamp"))
    return F.when(moment.isNotNull(), F.greatest(F.lit(0), F.floor(seconds / 86_400_000_000 + 0.5))).cast("long")


def list_of(text: Column) -> Column:
    """Comma-separated items, trimmed, empty ones dropped; null where none is left."""
    items = F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


#: A decimal number, white space around it allowed; casts would also take NaN, Infinity and suffixes such as 80d.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def range_of(low: Column, high: Column) -> Column:
    """struct(lo, hi): blank, zero or no decimal number becomes 0 and 9999; null if both are blank."""
    plain = lambda x: F.when(x.rlike(NUMBER), F.trim(x).try_cast("double"))
    number = lambda x, other: F.coalesce(F.nullif(plain(x), F.lit(0.0)), F.lit(other))
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    return F.when(~(blank(low) & blank(high)), F.struct(number(low, 0.0).alias("lo"), number(high, 9999.0).alias("hi")))


def year_range_of(text: Column) -> Column:
    """range_of of what stands before and after the first hyphen of 'lo-hi'; what is missing counts as blank."""
    parts = F.split(F.coalesce(text, F.lit("")), "-")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return range_of(part(1), part(2))


def relayed(content_type: Column, body: Column) -> Column:
    """What a relay hands on: JSON as it is, any other text as an object with the text under 'raw', null too.

    A body that is said to be JSON and is not fails alone: it becomes null.
    """
    valid = F.when(F.try_parse_json(body).isNotNull(), body)
    return F.when(F.coalesce(content_type, F.lit("")).contains("json"), valid).otherwise(F.to_json(F.struct(body.alias("raw")), {"ignoreNullFields": "false"}))


def remote_text(text: Column, genres: Column, instruments: Column) -> Column:
    """What a search by text is asked for: text, genres and instruments with spaces between, without what is missing."""
    words = F.concat(F.array(text), F.coalesce(genres, F.array().cast("array<string>")), F.coalesce(instruments, F.array().cast("array<string>")))
    return F.array_join(F.filter(words, lambda w: w.isNotNull() & (w != "")), " ")


def host_of(url: Column) -> Column:
    return F.lower(matched(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"))


def host_allowed(host: Column, allowed: list[str] = vocab.ALLOWED_HOSTS) -> Column:
    """An allowed host or a subdomain of one."""
    low, found = F.lower(host), F.lit(False)
    for entry in allowed:
        found = found | (low == entry) | low.endswith("." + entry)
    return F.coalesce(found, F.lit(False))


def provenance(value: Column, source: Column | str, method: Column | str, confidence: Column | float, as_of: Column) -> Column:
    """struct(value, source, method, confidence, updated_at), null where the value is null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(value.alias("value"), lit(source).alias("source"), lit(method).alias("method"), clamp(lit(confidence).cast("double")).alias("confidence"), as_of.cast("timestamp").alias("updated_at"))
    return F.when(value.isNotNull(), made)


def confirmed(value: Column, source: Column | str, as_of: Column, confidence: Column | float = 1.0) -> Column:
    """Catalog sources have the method 'catalog', others 'parsed'."""
    s = source if isinstance(source, Column) else F.lit(source)
    return provenance(value, s, F.when(s.isin("discogs", "musicbrainz"), "catalog").otherwise("parsed"), confidence, as_of)


def analyzed(value: Column, confidence: Column | float, as_of: Column) -> Column:
    return provenance(value, "audio_analysis", "analyzed", confidence, as_of)


def inferred(value: Column, confidence: Column | float, as_of: Column) -> Column:
    return provenance(value, "inferred", "inferred", confidence, as_of)


def user_set(value: Column, as_of: Column) -> Column:
    return provenance(value, "user", "manual", vocab.CONFIDENCE["user"], as_of)


def provenance_label(p: Column) -> Column:
    """A short label for where a value comes from."""
    percent = F.concat(rounded(p["confidence"] * 100).cast("string"), F.lit("%"))
    return (
        F.when(p["method"] == "catalog", F.concat(F.lit("from "), F.when(p["source"] == "discogs", "Discogs").otherwise("MusicBrainz")))
        .when(p["method"] == "parsed", "from the title")
        .when(p["method"] == "analyzed", F.concat(F.lit("analyzed "), percent))
        .when(p["method"] == "inferred", F.concat(F.lit("inferred "), percent))
        .when(p["method"] == "manual", "yours")
    )
