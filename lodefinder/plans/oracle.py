"""The same inputs and results in SQL, written for DuckDB, to hold the Spark plans against."""

from __future__ import annotations

from lodefinder.functions import vocab
from lodefinder.sources import tables

AS_OF = f"TIMESTAMP '{tables.AS_OF} 00:00:00'"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def suffix() -> str:
    def value(s: str) -> str:
        left, mark, right = s.partition("%d")
        return f"{quoted(left)} || (60 + p_partkey % 90) || {quoted(right)}" if mark else quoted(s)

    return "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN {value(s)}" for i, s in enumerate(tables.SUFFIXES)) + " END"


VIDEOS = f"""SELECT 'youtube:' || p_partkey AS id, 'youtube' AS kind, p_partkey::VARCHAR AS native_id,
  p_brand || CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE ' - ' END || p_name || ' (' || (1950 + p_size) || ') [Vinyl Rip]' || {suffix()} AS title,
  NULL::VARCHAR AS uploader, (p_size * 45 - 30)::BIGINT AS duration_sec,
  CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 7919) % 5000 END::BIGINT AS views,
  {AS_OF} - to_days((p_partkey % 400)::INTEGER) AS published_at, p_partkey::BIGINT AS item_pos FROM part"""

PAGES = f"""SELECT 'archive:' || page_id AS id, 'archive' AS kind, page_id::VARCHAR AS native_id,
  coalesce(nullif(concat_ws(' - ', nullif(regexp_extract(url, '://([^/?#]*)', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')), ''), page_id::VARCHAR) AS title,
  nullif(regexp_extract(url, '://([^/?#]*)', 1), '') AS uploader, NULL::BIGINT AS duration_sec, nullif(page_id % 50, 0)::BIGINT AS views,
  CASE WHEN page_id % 3 = 0 THEN make_timestamp((1960 + page_id % 60)::BIGINT, 1, 1, 0, 0, 0.0) END AS published_at,
  ({tables.ARCHIVE_START} + page_id)::BIGINT AS item_pos FROM pages"""

SPACE = r"'\s{2,}'"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeezed(x: str) -> str:
    return trimmed(f"regexp_replace({x}, {SPACE}, ' ', 'g')")


def cleaned(x: str) -> str:
    x = rf"regexp_replace({x}, '\[[^\]]*\]', ' ', 'g')"
    x = rf"regexp_replace({x}, '\([^)]*\)', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)\b(?:{vocab.NOISE})\b', ' ', 'g')"
    return squeezed(f"regexp_replace({x}, '[{vocab.DECORATION}]+', ' ', 'g')")


def folded(x: str) -> str:
    return squeezed(rf"regexp_replace(strip_accents(lower({x})), '[^a-z0-9\s]', ' ', 'g')")


def matched(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"


SEP = rf"\s+[{vocab.SEPARATORS}]\s+"
KEY = r"\b([A-G][#b]?)\s?(minor|major|min|maj|m)\b"
SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"

BASE = rf"""items AS ({VIDEOS} UNION ALL {PAGES}),
split AS (SELECT *, {cleaned('title')} AS cleaned_title FROM items),
parts AS (SELECT *, regexp_split_to_array(cleaned_title, '{SEP}') AS p FROM split),
candidates AS (
  SELECT * EXCLUDE (p), CASE WHEN len(p) >= 2 THEN {trimmed('p[1]')} END AS c_artist,
    CASE WHEN len(p) >= 2 THEN {trimmed("array_to_string(p[2:], ' - ')")} ELSE cleaned_title END AS c_title,
    {matched('title', r'\b(19[2-9][0-9]|20[0-2][0-9])\b')}::INTEGER AS c_year,
    {matched('title', r'(?i)\b([0-9]{2,3})\s?bpm\b')}::DOUBLE AS c_bpm,
    coalesce({matched('title', KEY)} || CASE WHEN {matched('title', KEY, 2)} LIKE 'maj%' THEN ' major' ELSE ' minor' END, {matched('title', '(?i)key of ([A-G][#b]?)')}) AS c_key,
    CASE WHEN len(p) >= 2 AND p[1] <> '' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS parse_confidence
  FROM parts
),
firsts AS (SELECT min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_name HAVING min(p_partkey) % 3 <> 0),
lines AS (SELECT l_partkey, min(l_suppkey) AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS returns FROM lineitem GROUP BY l_partkey),
catalog AS (
  SELECT p_partkey AS catalog_id, p_brand AS artist, p_name AS title, (1950 + p_size)::INTEGER AS year, s_name AS label, n_name AS country,
    [p_type] AS genres, string_split(p_name, ' ') AS styles,
    CASE WHEN p_partkey % 4 = 0 THEN []::VARCHAR[] ELSE [[{', '.join(map(quoted, tables.CREDITS))}][(p_partkey % 5 + 1)::INTEGER]] END AS roles,
    CASE WHEN p_partkey % 11 <> 0 THEN coalesce(returns, 0) * (p_partkey % 5) END::BIGINT AS want, (p_partkey % 13)::BIGINT AS have
  FROM part JOIN firsts USING (p_partkey) LEFT JOIN lines ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = s LEFT JOIN nation ON n_nationkey = s_nationkey
),
named AS (SELECT item_pos, {folded("concat_ws(' ', c_artist, coalesce(c_title, cleaned_title))")} AS f FROM candidates),
releases AS (SELECT catalog_id, {folded("artist || ' ' || title")} AS g FROM catalog),
texts AS (SELECT DISTINCT f FROM named),
firsts_of AS (SELECT g, min(catalog_id) AS catalog_id FROM releases GROUP BY g),
alike AS (
  SELECT f, catalog_id, CASE WHEN greatest(len(f), len(g)) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(f, g)::DOUBLE / greatest(len(f), len(g)) END AS similarity
  FROM texts JOIN firsts_of ON len(g) BETWEEN 0.71 * len(f) AND len(f) / 0.71
),
best_of AS (
  SELECT f, catalog_id, similarity FROM alike WHERE similarity >= 0.72 QUALIFY row_number() OVER (PARTITION BY f ORDER BY similarity DESC, catalog_id) = 1
),
best AS (SELECT item_pos, catalog_id, similarity FROM named JOIN best_of USING (f)),
recs AS (SELECT p_brand AS i_artist, p_name AS i_title, 'rec-' || min(p_partkey) AS recording_id, 'rel-' || min(p_partkey) AS release_id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2)"""


def role_case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), {quoted(p)}) THEN {quoted(n)}" for p, n in vocab.ROLES) + " END"


def hint_list(x: str, table: dict[str, list[str]]) -> str:
    """Names joined by commas, as both engines show lists alike that way."""
    cases = [f"CASE WHEN {' OR '.join(f'contains({x}, {quoted(h)})' for h in hints)} THEN {quoted(n)} END" for n, hints in table.items()]
    return f"concat_ws(',', {', '.join(cases)})"


def instrument_list(x: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower({x}), {quoted(i.lower())}) THEN {quoted(i)} END" for i in vocab.INSTRUMENTS) + ")"


TRACKS = f"""{BASE}, tracks AS (
  SELECT c.*, b.catalog_id, b.similarity AS match_score, r.want, r.have, r.label, r.country, r.genres, r.styles, r.roles,
    CASE WHEN b.catalog_id IS NOT NULL THEN 'release:' || b.catalog_id
      ELSE 'guess:' || coalesce(nullif({SLUG.format(trimmed("concat_ws(' ', c_artist, coalesce(c_title, cleaned_title))"))}, ''), native_id) END AS entity_id,
    CASE WHEN b.catalog_id IS NOT NULL THEN r.artist ELSE coalesce(nullif(c_artist, ''), 'Unknown') END AS artist,
    CASE WHEN b.catalog_id IS NOT NULL THEN r.title ELSE coalesce(c_title, cleaned_title) END AS name,
    coalesce(nullif(r.year, 0), c_year) AS year, coalesce(b.similarity >= 0.8, false) AS confirmed,
    CASE WHEN kind = 'youtube' THEN views END AS video_views,
    CASE WHEN published_at IS NOT NULL THEN greatest(0, floor((epoch_us({AS_OF}) - epoch_us(published_at)) / 86400000000.0 + 0.5)) END::BIGINT AS age_days,
    nullif(array_to_string(list_distinct([x FOR x IN [{role_case('roles[1]')}] IF x IS NOT NULL]), ','), '') AS credited,
    nullif({instrument_list('c.title')}, '') AS mentioned
  FROM candidates c LEFT JOIN best b USING (item_pos) LEFT JOIN catalog r ON r.catalog_id = b.catalog_id
)"""


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


RARITY = f"CASE WHEN want IS NULL OR have IS NULL THEN 0.3::DOUBLE ELSE {clamp('log10(1 + want::DOUBLE / greatest(have, 1)) / 2')} END"
AGE = clamp("coalesce(age_days, 3650) / 365.0::DOUBLE")
OBSCURITY = f"CASE WHEN video_views IS NULL THEN 0.4::DOUBLE ELSE {clamp(f'{clamp("1 - log10(greatest(video_views, 10)::DOUBLE) / 6")} * (0.5 + 0.5 * {AGE})')} END"
RICHNESS = "((coalesce(len(roles), 0) > 0)::INTEGER + (coalesce(year, 0) <> 0)::INTEGER + (coalesce(label, '') <> '')::INTEGER + (coalesce(len(genres), 0) + coalesce(len(styles), 0) > 0)::INTEGER + confirmed::INTEGER) / 5.0::DOUBLE"
QUALITY = clamp("CASE WHEN confirmed THEN 0.7::DOUBLE ELSE 0.45::DOUBLE END - CASE WHEN coalesce(duration_sec, 0) > 0 AND duration_sec < 30 THEN 0.2::DOUBLE WHEN coalesce(duration_sec, 0) > 1800 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END")
SPAN = "CASE " + " ".join(f"WHEN year BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in vocab.GOLDEN_YEARS) + " END"
HISTORY = f"CASE WHEN coalesce(year, 0) = 0 THEN 0.4::DOUBLE WHEN {SPAN} IS NOT NULL THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END"

#: The query that the score queries ask: see plans.queries.ASKED.
INSTRUMENTS = "coalesce(credited, mentioned)"
ASKED_HAVE = f"concat_ws(' + ', CASE WHEN list_contains(string_split(lower({INSTRUMENTS}), ','), 'bass') THEN 'Bass' END, CASE WHEN list_contains(string_split(lower({INSTRUMENTS}), ','), 'rhodes') THEN 'rhodes' END)"
FILTER = f"""((coalesce(len([t FOR t IN list_concat(coalesce(genres, []), coalesce(styles, [])) IF contains(lower(t), 'steel')]), 0) > 0)::INTEGER
  + ({ASKED_HAVE} <> '')::INTEGER + coalesce(nullif(year, 0) BETWEEN 1970 AND 1990, false)::INTEGER
  + (c_bpm IS NOT NULL AND coalesce(c_bpm BETWEEN 80 AND 110, false))::INTEGER + (c_key IS NOT NULL AND coalesce(starts_with(lower(c_key), 'a'), false))::INTEGER)::DOUBLE
  / (3 + (c_bpm IS NOT NULL)::INTEGER + (c_key IS NOT NULL)::INTEGER)"""

COMPONENTS = f"""{TRACKS}, components AS (
  SELECT *, {FILTER} AS filter_match, {RARITY} AS rarity, {OBSCURITY} AS obscurity, {RICHNESS} AS richness, {QUALITY} AS source_quality, {HISTORY} AS history FROM tracks
)"""


def total(affinity: str) -> str:
    w = vocab.WEIGHTS
    parts = " + ".join(f"{affinity if c == 'affinity' else c} * {x}::DOUBLE" for c, x in w.items())
    return f"floor((0.0::DOUBLE + {parts}) / {sum(w.values())!r}::DOUBLE * 100 + 0.5)::INTEGER"


def reasons(affinity: str) -> str:
    return f"""concat_ws('; ', CASE WHEN {ASKED_HAVE} <> '' THEN 'has ' || {ASKED_HAVE} END,
  CASE WHEN want IS NOT NULL AND have IS NOT NULL AND rarity > 0.6 THEN want || ' want it, ' || have || ' have it' END,
  CASE WHEN video_views < 1000 AND {AGE} > 0.5 THEN 'only ' || video_views || ' views' END,
  CASE WHEN {SPAN} IS NOT NULL THEN 'from ' || {SPAN} END,
  CASE WHEN {affinity} > 0.6 THEN floor({affinity} * 100 + 0.5)::INTEGER || '% to your taste' END)"""


TIER = "CASE " + " ".join(f"WHEN dig_score >= {low} THEN {quoted(n)}" for low, n in vocab.TIERS) + f" ELSE {quoted(vocab.LOWEST_TIER)} END"

ACTIONS = "actions AS (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS entity_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tables.ACTIONS.items()) + f" END AS action, ts, event_id FROM events WHERE event_type IN ({', '.join(map(quoted, tables.ACTIONS))}))"

ATTRIBUTES = f"""makers AS (
  SELECT l_partkey, s_name, n_name FROM (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) LEFT JOIN supplier ON s_suppkey = s LEFT JOIN nation ON n_nationkey = s_nationkey
), tagged AS (
  SELECT p.*, v.title, s_name, n_name, lower(v.title || ' ' || p_type || ' ' || p_name) AS hints,
    CASE WHEN p_partkey % 4 <> 0 THEN {role_case(f"[{', '.join(map(quoted, tables.CREDITS))}][(p_partkey % 5 + 1)::INTEGER]")} END AS credited
  FROM part p JOIN ({VIDEOS}) v ON v.item_pos = p_partkey LEFT JOIN makers ON l_partkey = p_partkey
), attributes AS (
  SELECT * FROM (
    SELECT p_partkey AS entity_id, 'genres' AS dim, p_type AS key FROM tagged
    UNION ALL SELECT p_partkey, 'eras', ((1950 + p_size) // 10 * 10) || 's' FROM tagged
    UNION ALL SELECT p_partkey, 'artists', p_brand FROM tagged
    UNION ALL SELECT p_partkey, 'labels', s_name FROM tagged
    UNION ALL SELECT p_partkey, 'countries', n_name FROM tagged
    UNION ALL SELECT p_partkey, 'bpm_buckets', ((60 + p_partkey % 90) // 10 * 10) || '-' || ((60 + p_partkey % 90) // 10 * 10 + 10) FROM tagged
    UNION ALL SELECT p_partkey, 'styles', unnest(string_split(p_name, ' ')) FROM tagged
    UNION ALL SELECT p_partkey, 'instruments', unnest(string_split(coalesce(credited, {instrument_list('title')}), ',')) FROM tagged
    UNION ALL SELECT p_partkey, 'feels', unnest(string_split({hint_list('hints', vocab.FEELS)}, ',')) FROM tagged
    UNION ALL SELECT p_partkey, 'textures', unnest(string_split({hint_list('hints', vocab.TEXTURES)}, ',')) FROM tagged
  ) WHERE key <> ''
)"""

LEARNED = f"""{ACTIONS}, {ATTRIBUTES}, weighed AS (SELECT *, CASE action WHEN 'save' THEN 1 WHEN 'reject' THEN -1 END AS w FROM actions WHERE action IN ('save', 'reject')),
learned AS (SELECT user_id, dim, key, sum(w)::DOUBLE AS weight FROM weighed JOIN attributes USING (entity_id) GROUP BY ALL),
sums AS (SELECT user_id, sum(w)::DOUBLE AS total FROM weighed GROUP BY user_id),
tops AS (SELECT user_id, dim, greatest(1.0::DOUBLE, max(weight)) AS top FROM learned GROUP BY ALL)"""


def affinity_of(pairs: str) -> str:
    """CTE affinity (user_id, entity_id, affinity) for a CTE of distinct pairs."""
    return f"""means AS (
  SELECT p.user_id, p.entity_id, avg(coalesce(l.weight, 0.0::DOUBLE) / t.top) AS mean FROM {pairs} p JOIN attributes a ON a.entity_id = p.entity_id AND a.dim NOT IN ('feels', 'textures')
  JOIN tops t ON t.user_id = p.user_id AND t.dim = a.dim LEFT JOIN learned l ON l.user_id = p.user_id AND l.dim = a.dim AND l.key = a.key GROUP BY ALL
), affinity AS (
  SELECT p.user_id, p.entity_id, CASE WHEN coalesce(s.total, 0) <= 0 OR m.mean IS NULL THEN 0.5::DOUBLE ELSE {clamp('m.mean')} END AS affinity
  FROM {pairs} p LEFT JOIN means m USING (user_id, entity_id) LEFT JOIN sums s USING (user_id)
)"""


STATUS = f"""{ACTIONS}, hard AS (
  SELECT user_id, entity_id, arg_max(action, (ts, event_id)) AS action, max((ts, event_id)) AS at FROM actions WHERE action IN ('save', 'reject') GROUP BY ALL
), soft AS (SELECT user_id, entity_id, max((ts, event_id)) AS at FROM actions WHERE action = 'analyze' GROUP BY ALL),
keys AS (SELECT DISTINCT user_id, entity_id FROM actions),
statuses AS (
  SELECT k.user_id, k.entity_id, CASE WHEN h.action = 'save' THEN 'saved' WHEN s.at IS NOT NULL AND (h.at IS NULL OR s.at > h.at) THEN 'analyzed'
    WHEN h.action = 'reject' THEN 'rejected' ELSE 'seen' END AS status
  FROM keys k LEFT JOIN hard h USING (user_id, entity_id) LEFT JOIN soft s USING (user_id, entity_id)
)"""

#: The 24 keys from the two published profiles: each pitch major, then minor, centred and of unit length, all in SQL.
TEMPLATES = f"""(SELECT i, key, [x / sqrt(list_sum([y * y FOR y IN c])) FOR x IN c] AS v FROM (
  SELECT 2 * t + m AS i, {vocab.PITCHES}[t + 1] || CASE m WHEN 0 THEN ' major' ELSE ' minor' END AS key,
    [p[((j - t + 12) % 12 + 1)::INTEGER] - list_sum(p) / 12 FOR j IN range(0, 12)] AS c
  FROM unnest(range(0, 12)) AS a(t), (VALUES (0, {vocab.MAJOR}::DOUBLE[]), (1, {vocab.MINOR}::DOUBLE[])) AS b(m, p)
)) AS t"""
