"""Word lists, thresholds, weights and templates that results depend on."""

from __future__ import annotations

# Fixed values. Words that say nothing about a recording, as one pattern.
NOISE = r"hq|hd|4k|full\s*album|full\s*lp|vinyl\s*rip|vinyl|lp|ep|official|audio|video|music\s*video|lyrics?|remaster(ed)?|reissue|hi[- ]?fi|rare|classic"

# Fixed values. Decoration: pipe, slash, tilde, bullet, middle dot, stars, notes, arrows.
DECORATION = "|/~•·★☆♪♫➤▶"
# Fixed values. What separates artist and title between white space: hyphen, en dash, em dash, tilde.
SEPARATORS = "-–—~"

# Fixed values. Hints of a feeling, in order.
FEELS = {
    "laid-back": ["mellow", "smooth", "chill", "quiet storm", "lounge", "easy"],
    "groovy": ["funk", "boogie", "disco", "groove", "break"],
    "dreamy": ["dream", "ethereal", "ambient", "floating", "hazy"],
    "dark": ["dark", "noir", "sinister", "minor", "moody"],
    "melancholic": ["melanch", "sad", "bittersweet", "nostalg", "longing", "blue"],
    "uplifting": ["uplift", "joy", "sunny", "gospel", "bright"],
    "warm": ["warm", "soul", "tender", "sweet"],
    "tense": ["tense", "suspense", "urgent", "dramatic"],
}

# Fixed values. Hints of a texture, in order.
TEXTURES = {
    "dusty": ["dusty", "vinyl", "crackle", "old", "vintage"],
    "clean": ["clean", "hi-fi", "crisp", "pristine"],
    "lush": ["lush", "orchestr", "strings", "sweeping"],
    "raw": ["raw", "garage", "rough", "demo"],
    "lo-fi": ["lo-fi", "lofi", "tape", "cassette"],
    "psychedelic": ["psych", "acid", "trippy", "phaser"],
    "organic": ["acoustic", "live", "organic", "analog"],
}

# Fixed values. Instruments, in order.
INSTRUMENTS = [
    "Rhodes", "Wurlitzer", "piano", "organ", "clavinet", "synth", "guitar", "bass", "drums", "percussion", "strings", "flute",
    "saxophone", "trumpet", "trombone", "harp", "vibraphone", "vocals", "choir", "harpsichord",
]

# Fixed values. What a credited role says about the instrument: the first text that it contains decides.
ROLES = [
    ("electric piano", "Rhodes"), ("rhodes", "Rhodes"), ("wurlitzer", "Wurlitzer"), ("piano", "piano"), ("organ", "organ"),
    ("guitar", "guitar"), ("bass", "bass"), ("drums", "drums"), ("strings", "strings"), ("flute", "flute"),
    ("saxophone", "saxophone"), ("trumpet", "trumpet"), ("vibraphone", "vibraphone"), ("vocals", "vocals"),
]

# Fixed values. Similarity from which a catalog row matches, and from which it counts as confirmed.
MATCH, CONFIRMED = 0.72, 0.80

# Fixed values. Confidences by where a value comes from.
CONFIDENCE = {"split": 0.7, "unsplit": 0.4, "bpm": 0.6, "key": 0.5, "instruments": 0.5, "catalog": 1.0, "mood": 0.55, "user": 1.0}

# Fixed values. Weights of the score's components, in order.
WEIGHTS = {"filter_match": 0.24, "rarity": 0.16, "obscurity": 0.16, "richness": 0.10, "source_quality": 0.08, "history": 0.10, "affinity": 0.16}

# Fixed values. Years of most interest.
GOLDEN_YEARS = [(1968, 1979), (1980, 1986)]

# Fixed values. Lowest totals of the tiers.
TIERS = [(85, "🔥 Hidden Gem"), (70, "✦ Strong dig"), (55, "Worth a listen")]
LOWEST_TIER = "Deep cut"

# Fixed values. Hosts that may be fetched from.
ALLOWED_HOSTS = ["api.discogs.com", "musicbrainz.org", "archive.org"]

# Fixed values. Pitch classes and the published key profiles of Krumhansl and Kessler.
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
