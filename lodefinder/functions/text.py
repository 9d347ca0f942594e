"""Text functions as Column expressions: titles, years, keys, folding, similarity, tags."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodefinder.functions import vocab

#: Borders of words made of ASCII letters, digits and underscores; \b would also count letters such as é.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def squeezed(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, r"\s{2,}", " "))


def clean_title(raw: Column) -> Column:
    """Without bracketed parts, noise words and decoration; white space squeezed."""
    s = F.regexp_replace(raw, r"\[[^\]]*\]", " ")
    s = F.regexp_replace(s, r"\([^)]*\)", " ")
    s = F.regexp_replace(s, f"(?i){LEFT}(?:{vocab.NOISE}){RIGHT}", " ")
    return squeezed(F.regexp_replace(s, f"[{vocab.DECORATION}]+", " "))


def matched(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def year_of(raw: Column) -> Column:
    """The first year from 1920 to 2029."""
    return matched(raw, f"{LEFT}(19[2-9][0-9]|20[0-2][0-9]){RIGHT}").cast("int")


def artist_and_title(raw: Column) -> tuple[Column, Column]:
    """Artist (null without a separator) and title of a cleaned title."""
    cleaned = clean_title(raw)
    parts = F.split(cleaned, f"\\s+[{vocab.SEPARATORS}]\\s+", -1)
    several = F.size(parts) >= 2
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " - ")
    return F.when(several, trimmed(parts[0])), F.when(several, trimmed(rest)).otherwise(cleaned)


def bpm_of(raw: Column) -> Column:
    return matched(raw, f"(?i){LEFT}([0-9]{{2,3}})\\s?bpm{RIGHT}").cast("double")


def key_of(raw: Column) -> Column:
    """'<note> minor' or '<note> major'; else the note after 'key of', as written."""
    pattern = f"{LEFT}([A-G][#b]?)\\s?(minor|major|min|maj|m){RIGHT}"
    note, mode = matched(raw, pattern, 1), matched(raw, pattern, 2)
    named = F.concat(note, F.when(mode.startswith("maj"), " major").otherwise(" minor"))
    return F.coalesce(named, matched(raw, "(?i)key of ([A-G][#b]?)"))


def _folds() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII letter and combining marks, and those letters."""
    pairs = []
    for code in range(0x80, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base.isascii() and base.isalnum():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()


def folded(s: Column) -> Column:
    """Lower case, without accents; anything but a-z, 0-9 and white space becomes a space; white space squeezed."""
    plain = F.regexp_replace(F.translate(F.lower(s), ACCENTED, PLAIN), "[̀-ͯ]", "")
    return squeezed(F.regexp_replace(plain, r"[^a-z0-9\s]", " "))


def slug(s: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", "")


def folded_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two folded texts; 1 for two empty ones."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)


def similarity(a: Column, b: Column) -> Column:
    return folded_similarity(folded(a), folded(b))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once for each row, however often use names it."""
    return F.transform(F.array(value), use)[0]


def role_instrument(role: Column) -> Column:
    text, chain = F.lower(role), None
    for part, name in vocab.ROLES:
        chain = F.when(text.contains(part), name) if chain is None else chain.when(text.contains(part), name)
    return chain


def _hinted(text: Column, table: dict[str, list[str]]) -> Column:
    def any_of(hints: list[str]) -> Column:
        found = F.lit(False)
        for h in hints:
            found = found | text.contains(h)
        return found

    return F.array_compact(F.array(*(F.when(any_of(hints), name) for name, hints in table.items())))


def mood(text: Column, tags: Column) -> Column:
    """struct(energy, feels, textures) from hints in the text and its tags; energy is never set."""
    energy = F.lit(None).cast("int").alias("energy")
    return bound(F.lower(F.concat_ws(" ", text, tags)), lambda x: F.struct(energy, _hinted(x, vocab.FEELS).alias("feels"), _hinted(x, vocab.TEXTURES).alias("textures")))


def instruments_in(text: Column) -> Column:
    return bound(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(low.contains(i.lower()), i) for i in vocab.INSTRUMENTS))))
