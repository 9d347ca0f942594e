"""One query for each operator, over whole tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefinder.functions import text, values, vocab
from lodefinder.operators import audio, catalog_index, display, fragments, linkage, preference, scoring
from lodefinder.operators.preference_store import PreferenceStore
from lodefinder.operators.scoring import SearchQuery
from lodefinder.plans import oracle as sql
from lodefinder.plans import search as plan
from lodefinder.session import fresh_path
from lodefinder.sources import connectors, tables
from lodefinder.streaming.state import STREAMS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: What the score queries and the flagship ask for, and for whom.
ASKED = SearchQuery(text="steel", genres=("Steel",), instruments=("Bass", "rhodes"), year=(1970, 1990), bpm=(80, 110), key="A")
FLAGSHIP = ASKED.patched(text="brand")
USER = 1


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.items(spark, sf_dir)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.candidates(items_of(spark, sf_dir))


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(spark, sf_dir, name)


def joined(array) -> F.Column:
    return F.array_join(array, ",")


# sources


@query(f"WITH {sql.BASE} SELECT id, kind, title, views, item_pos FROM items QUALIFY row_number() OVER (PARTITION BY kind ORDER BY item_pos) <= 20")
def discover_union(spark, sf_dir):
    return plan.first_per_source(items_of(spark, sf_dir), plan.PER_SOURCE).select("id", "kind", "title", "views", "item_pos")


@query(f"WITH {sql.BASE} SELECT id, title FROM items WHERE kind = 'archive'")
def source_pruning(spark, sf_dir):
    return connectors.items(spark, sf_dir, ["archive", "no such kind"]).select("id", "title")


@query("WITH d AS (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT p_partkey AS id, n AS view_count, last::DATE::VARCHAR AS last FROM part LEFT JOIN d ON l_partkey = p_partkey")
def discover_lookup_left(spark, sf_dir):
    details = t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("view_count"), F.max("l_shipdate").cast("date").cast("string").alias("last"))
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(details, "id", "left").select("id", "view_count", "last")


@query(f"WITH {sql.BASE} SELECT id, title, uploader, views, published_at::DATE::VARCHAR AS published FROM items WHERE kind = 'archive'")
def page_title_items(spark, sf_dir):
    return tables.archive_items(tables.page_docs(t(spark, sf_dir, "pages"))).select("id", "title", "uploader", "views", F.col("published_at").cast("date").cast("string").alias("published"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_name ELSE '' END AS title, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 100 END AS views, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS channel FROM part")
def payload_flatten(spark, sf_dir):
    """Nested JSON payloads to columns: an absent title is '', absent views are null, "0" views are 0."""
    k = F.col("p_partkey")
    snippet = F.struct(F.when(k % 5 != 0, F.col("p_name")).alias("title"), F.when(k % 3 != 0, F.col("p_brand")).alias("channel"))
    statistics = F.struct(F.when(k % 7 != 0, (k % 100).cast("string")).alias("viewCount"))
    payload = t(spark, sf_dir, "part").select(k.alias("id"), F.to_json(F.struct(snippet.alias("snippet"), statistics.alias("statistics"))).alias("j"))
    read = F.from_json("j", "snippet struct<title:string,channel:string>, statistics struct<viewCount:string>")
    return payload.select("id", read.alias("p")).select("id", F.coalesce("p.snippet.title", F.lit("")).alias("title"), F.col("p.statistics.viewCount").try_cast("long").alias("views"), F.col("p.snippet.channel").alias("channel"))


#: Every fourth page is a text, not audio.
MEDIA = "CASE WHEN page_id % 4 = 0 THEN 'texts' ELSE 'audio' END AS mediatype"


@query(f"SELECT page_id::VARCHAR AS identifier, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM (SELECT *, {MEDIA} FROM pages) WHERE mediatype = 'audio' AND contains({sql.folded("concat_ws(' ', nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), nullif(regexp_extract(url, '://([^/?#]*)', 1), ''))")}, 'example') ORDER BY page_id LIMIT 20")
def archive_search(spark, sf_dir):
    pages = t(spark, sf_dir, "pages")
    docs = tables.page_docs(pages).join(pages.selectExpr("CAST(page_id AS STRING) AS identifier", MEDIA), "identifier")
    return connectors.archive_search(docs, F.lit("Éxample")).select("identifier", "title")


@query("SELECT 'youtube' AS kind, count(*) AS rows, false AS failed FROM part UNION ALL SELECT 'archive', count(*), false FROM pages UNION ALL SELECT 'broken', 0, true UNION ALL SELECT 'absent', 0, true")
def isolated_sources(spark, sf_dir):
    """Two more sources, one that fails while its rows are computed and one that has no table: the others' items are all there."""
    connectors.register("broken", lambda s, d: tables.video_items(t(s, d, "part")).withColumn("title", F.when(F.col("item_pos") % 2 == 1, F.raise_error(F.lit("a broken row"))).otherwise(F.col("title"))))
    connectors.register("absent", lambda s, d: t(s, d, "no_such_table"))
    try:
        made, report = connectors.landed(spark, sf_dir)
    finally:
        connectors.unregister("broken")
        connectors.unregister("absent")
    rows = made.groupBy("kind").agg(F.count("*").alias("rows"))
    return report.select("kind", F.col("error").isNotNull().alias("failed")).join(rows, "kind", "left").select("kind", F.coalesce("rows", F.lit(0)).alias("rows"), "failed")


@query("SELECT event_type, count(*) FILTER (WHERE event_id % 10 <> 0) AS kept, count(*) FILTER (WHERE event_id % 10 = 0) AS reported, coalesce(sum(json_extract_string(props, '$.k')::BIGINT) FILTER (WHERE event_id % 10 <> 0), 0)::BIGINT AS total FROM events GROUP BY event_type")
def isolated_payloads(spark, sf_dir):
    """Payloads of which every tenth has lost its last character: these are reported, the others read."""
    cut = F.when(F.col("event_id") % 10 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    read = connectors.parsed(t(spark, sf_dir, "events").select("event_type", cut.alias("payload")), "payload", "k long")
    bad = F.col("corrupt").isNotNull()
    return read.groupBy("event_type").agg(F.sum((~bad).cast("long")).alias("kept"), F.sum(bad.cast("long")).alias("reported"), F.coalesce(F.sum("k"), F.lit(0)).alias("total"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '(^|\\.)(example\\.com|example\\.org)$') AS allowed FROM pages")
def host_allowlist(spark, sf_dir):
    host = values.host_of(F.col("url"))
    return t(spark, sf_dir, "pages").select("page_id", host.alias("host"), values.host_allowed(host, ["example.com", "example.org"]).alias("allowed"))


@query("SELECT p_partkey AS id, nullif(array_to_string([x FOR x IN [trim(y) FOR y IN string_split(replace(p_name, ' ', ' , ') || ', ,', ',')] IF x <> ''], '|'), '') AS items FROM part")
def settings_list(spark, sf_dir):
    raw = F.concat(F.regexp_replace("p_name", " ", " , "), F.lit(", ,"))
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(values.list_of(raw), "|").alias("items"))


#: Values of a column in turn, so that every form of input meets every other.
def turns(of: str, forms: list[str | None]) -> str:
    return f"CASE {of} % {len(forms)} " + " ".join(f"WHEN {i} THEN {'NULL' if x is None else sql.quoted(x)}" for i, x in enumerate(forms)) + " END"


LOWS, HIGHS = turns("p_partkey", ["", "80", "x", "0", "NaN", "80d", " 1e2 ", "-5.5", None]), turns("p_size", ["", "120.5", "y", "Infinity", "9f", ".5", None])


def range_sql(lo: str, hi: str) -> str:
    """lo and hi columns of the parsed range."""
    number = lambda x, other: f"coalesce(nullif(CASE WHEN regexp_matches({x}, '{values.NUMBER}') THEN trim({x})::DOUBLE END, 0), {other})"
    there = f"trim(coalesce({lo}, '')) <> '' OR trim(coalesce({hi}, '')) <> ''"
    return f"CASE WHEN {there} THEN {number(lo, 0)} END AS lo, CASE WHEN {there} THEN {number(hi, 9999)} END AS hi"


@query(f"SELECT id, {range_sql('lo', 'hi')} FROM (SELECT p_partkey AS id, {LOWS} AS lo, {HIGHS} AS hi FROM part)")
def range_parse(spark, sf_dir):
    raw = t(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{LOWS} AS lo", f"{HIGHS} AS hi")
    r = values.range_of(F.col("lo"), F.col("hi"))
    return raw.select("id", r["lo"].alias("lo"), r["hi"].alias("hi"))


YEARS = turns("p_partkey", ["", "1970-1979", "1985", "-1990", "1960-x-1990", "NaN-1990", "1970-80d", None])


@query(f"SELECT id, {range_sql('lo', 'hi')} FROM (SELECT p_partkey AS id, split_part({YEARS}, '-', 1) AS lo, split_part({YEARS}, '-', 2) AS hi FROM part)")
def year_range(spark, sf_dir):
    r = values.year_range_of(F.col("years"))
    return t(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{YEARS} AS years").select("id", r["lo"].alias("lo"), r["hi"].alias("hi"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '{"name":"' || p_name || '"}' WHEN 1 THEN NULL WHEN 2 THEN '{"raw":null}' ELSE '{"raw":"' || p_name || '"}' END AS payload FROM part""")
def relay_payload(spark, sf_dir):
    """JSON, a body that is said to be JSON and is not, no body, other text with and without a type."""
    k = F.col("p_partkey") % 5
    kind = F.when(k <= 1, "application/json; charset=utf-8").when(k == 3, "text/html")
    body = F.when(k == 0, F.concat(F.lit('{"name":"'), "p_name", F.lit('"}'))).when(k == 1, F.concat(F.lit("{"), "p_name")).when(k >= 3, F.col("p_name"))
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), values.relayed(kind, body).alias("payload"))


# scalar functions


@query(f"WITH {sql.BASE} SELECT id, cleaned_title FROM candidates")
def clean_title(spark, sf_dir):
    return items_of(spark, sf_dir).select("id", text.clean_title(F.col("title")).alias("cleaned_title"))


@query(f"WITH {sql.BASE} SELECT id, c_year AS year FROM candidates")
def extract_year(spark, sf_dir):
    return items_of(spark, sf_dir).select("id", text.year_of(F.col("title")).alias("year"))


@query(f"WITH {sql.BASE} SELECT id, c_artist AS artist, c_title AS title FROM candidates")
def split_artist_title(spark, sf_dir):
    artist, title = text.artist_and_title(F.col("title"))
    return items_of(spark, sf_dir).select("id", artist.alias("artist"), title.alias("title"))


@query(f"WITH {sql.BASE} SELECT id, c_bpm AS bpm FROM candidates")
def parse_bpm(spark, sf_dir):
    return items_of(spark, sf_dir).select("id", text.bpm_of(F.col("title")).alias("bpm"))


@query(f"WITH {sql.BASE} SELECT id, c_key AS key FROM candidates")
def parse_key(spark, sf_dir):
    return items_of(spark, sf_dir).select("id", text.key_of(F.col("title")).alias("key"))


@query(f"WITH {sql.BASE} SELECT id, cleaned_title, c_artist, c_title, c_year, c_bpm, c_key, parse_confidence FROM candidates")
def candidates(spark, sf_dir):
    return found(spark, sf_dir).select("id", "cleaned_title", "c_artist", "c_title", "c_year", "c_bpm", "c_key", "parse_confidence")


@query(f"SELECT doc_id, {sql.folded('text')} AS folded FROM documents")
def normalize_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.folded(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, {sql.SLUG.format('text')} AS slug FROM documents")
def slug(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


ISO = "CASE p_size % 5 WHEN 0 THEN concat('PT', p_size, 'M', p_partkey % 60, 'S') WHEN 1 THEN concat('PT', p_partkey % 3, 'H') WHEN 2 THEN 'PT' WHEN 3 THEN concat('P1DT', p_size, 'H') ELSE concat('PT1H', p_size, 'M2S') END"


@query(f"SELECT id, CASE WHEN regexp_matches(iso, '^PT([0-9]+H)?([0-9]+M)?([0-9]+S)?$') THEN coalesce(try_cast(regexp_extract(iso, '([0-9]+)H', 1) AS BIGINT), 0) * 3600 + coalesce(try_cast(regexp_extract(iso, '([0-9]+)M', 1) AS BIGINT), 0) * 60 + coalesce(try_cast(regexp_extract(iso, '([0-9]+)S', 1) AS BIGINT), 0) END AS seconds FROM (SELECT p_partkey AS id, {ISO} AS iso FROM part)")
def iso_duration(spark, sf_dir):
    return t(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{ISO} AS iso").select("id", values.duration_seconds(F.col("iso")).alias("seconds"))


@query(f"SELECT s_suppkey, n_name, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(a, b)::DOUBLE / greatest(len(a), len(b)) END, 6) AS similarity FROM (SELECT s_suppkey, n_name, {sql.folded('s_name')} AS a, {sql.folded('n_name')} AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def similarity_pairs(spark, sf_dir):
    pairs = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return pairs.select("s_suppkey", "n_name", F.round(text.similarity(F.col("s_name"), F.col("n_name")), 6).alias("similarity"))


@query(f"SELECT p_partkey AS id, role, {sql.role_case('role')} AS instrument FROM (SELECT p_partkey, [{', '.join(map(sql.quoted, tables.CREDITS))}][(p_partkey % 5 + 1)::INTEGER] AS role FROM part)")
def role_instrument(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, tables.CREDITS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), role.alias("role"), text.role_instrument(role).alias("instrument"))


@query(f"SELECT doc_id, {sql.hint_list('lower(text)', vocab.FEELS)} AS feels, {sql.hint_list('lower(text)', vocab.TEXTURES)} AS textures FROM documents")
def mood_tags(spark, sf_dir):
    made = t(spark, sf_dir, "documents").select("doc_id", text.mood(F.col("text"), F.array().cast("array<string>")).alias("m"))
    return made.select("doc_id", joined("m.feels").alias("feels"), joined("m.textures").alias("textures"))


@query(f"SELECT doc_id, {sql.instrument_list('text')} AS instruments FROM documents")
def text_instruments(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", joined(text.instruments_in(F.col("text"))).alias("instruments"))


@query(f"SELECT p_partkey AS id, (1950 + p_size) // 10 * 10 || 's' AS decade, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 200) // 10 * 10 || '-' || ((p_partkey % 200) // 10 * 10 + 10) END AS bucket, (p_partkey % 400)::BIGINT AS age FROM part")
def buckets_and_ages(spark, sf_dir):
    k = F.col("p_partkey")
    return t(spark, sf_dir, "part").select(
        k.alias("id"),
        values.decade(F.lit(1950) + F.col("p_size")).alias("decade"),
        values.bpm_bucket(F.when(k % 4 != 0, (k % 200).cast("double"))).alias("bucket"),
        values.days_since(F.timestamp_micros(F.unix_micros(tables.as_of()) - (k % 400) * 86_400_000_000), tables.as_of()).alias("age"),
    )


# linkage


@query(f"WITH {sql.BASE} SELECT item_pos, catalog_id, round(similarity, 6) AS similarity FROM best")
def best_match(spark, sf_dir):
    return linkage.best_matches(found(spark, sf_dir), tables.catalog(spark, sf_dir)).select("item_pos", "catalog_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {sql.BASE} SELECT item_pos, catalog_id, row_number() OVER (PARTITION BY item_pos ORDER BY abs(len(f) - len(g)), catalog_id)::INTEGER AS rank FROM named JOIN releases ON array_to_string(string_split(f, ' ')[1:2], ' ') = array_to_string(string_split(g, ' ')[1:2], ' ') QUALIFY rank <= 10")
def catalog_top10(spark, sf_dir):
    return linkage.nearest_by_length(found(spark, sf_dir), tables.catalog(spark, sf_dir))


def remote_title() -> F.Column:
    """A release's title as a remote search shows it; every fifth has a second hyphen."""
    return F.concat("artist", F.lit(" - "), "title", F.when(F.col("catalog_id") % 5 == 0, " - reissue").otherwise(""))


def bm25(docs: str, asked: str, n: int) -> str:
    """CTEs up to ranked (q, doc, rank, score) for selections of docs (doc, shown) and of asked texts (q), folded."""
    return f"""docs AS ({docs}),
words AS (SELECT doc, [w FOR w IN regexp_split_to_array({sql.folded('shown')}, '\\s+') IF w <> ''] AS w FROM docs), full_words AS (SELECT * FROM words WHERE len(w) > 0),
sizes AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM full_words),
postings AS (SELECT term, doc, size, count(*) AS tf FROM (SELECT doc, len(w) AS size, unnest(w) AS term FROM full_words) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
asked AS (SELECT DISTINCT q, unnest(regexp_split_to_array({sql.folded('q')}, '\\s+')) AS term FROM ({asked})),
scores AS (SELECT q, doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)))), 9) AS score
  FROM asked JOIN terms USING (term) JOIN postings USING (term), sizes GROUP BY q, doc),
ranked AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc)::INTEGER AS rank, score FROM scores QUALIFY rank <= {n})"""


SHOWN = "SELECT catalog_id AS doc, artist || ' - ' || title || CASE WHEN catalog_id % 5 = 0 THEN ' - reissue' ELSE '' END AS shown FROM catalog"


@query(f"""WITH {sql.BASE}, {bm25(SHOWN, "SELECT DISTINCT f AS q FROM named", 10)}
SELECT item_pos, doc AS catalog_id, rank, round(score, 6) AS score, string_split(shown, ' - ')[1] AS artist, string_split(shown, ' - ')[2] AS title FROM named JOIN ranked ON q = f JOIN docs USING (doc)""")
def catalog_search(spark, sf_dir):
    """The ten most relevant releases for each item's artist and title, as a search shows them."""
    named = found(spark, sf_dir).select("item_pos", text.folded(linkage.search_text()).alias("q"))
    docs = tables.catalog(spark, sf_dir).select(F.col("catalog_id").alias("doc"), remote_title().alias("shown"))
    best = catalog_index.best_documents(named.select("q").distinct(), catalog_index.index_of(docs, "doc", F.col("shown")))
    artist, title = catalog_index.release_names(F.col("shown"))
    return named.join(best, "q").join(docs, "doc").select("item_pos", F.col("doc").alias("catalog_id"), "rank", F.round("score", 6).alias("score"), artist.alias("artist"), title.alias("title"))


#: What each type of part is searched by: its words, and an instrument for two thirds of them.
WANTED = "SELECT DISTINCT p_type AS kind, CASE len(p_type) % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Bass' ELSE 'Rhodes' END AS instrument FROM part"


@query(f"""WITH {sql.BASE}, wanted AS (SELECT kind, concat_ws(' ', 'brand', kind, instrument) AS asked FROM ({WANTED})),
{bm25("SELECT item_pos AS doc, title AS shown FROM items", "SELECT DISTINCT asked AS q FROM wanted", 20)}
SELECT kind, asked, doc AS item_pos, rank, round(score, 6) AS score FROM wanted JOIN ranked ON q = asked""")
def remote_search(spark, sf_dir):
    """The twenty most relevant items for text, genre and instrument as one query, for each type of part."""
    t(spark, sf_dir, "part").createOrReplaceTempView("part")
    asked = values.remote_text(F.lit("brand"), F.array("kind"), F.array_compact(F.array("instrument")))
    wanted = spark.sql(WANTED.replace("len(", "length(")).select("kind", asked.alias("asked"))
    titles = items_of(spark, sf_dir).select(F.col("item_pos").alias("doc"), "title")
    best = catalog_index.best_documents(wanted.select(F.col("asked").alias("q")).distinct(), catalog_index.index_of(titles, "doc", F.col("title")), 20)
    return wanted.join(best, F.col("asked") == F.col("q")).select("kind", "asked", F.col("doc").alias("item_pos"), "rank", F.round("score", 6).alias("score"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'Unknown' WHEN p_partkey % 3 = 0 THEN p_brand || ', The ' || p_type ELSE p_brand END AS artist, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS title,
CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 THEN 1950 + p_size END::INTEGER AS year, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 4 <> 0 THEN p_mfgr END AS label, CASE WHEN p_partkey % 11 <> 0 THEN p_size END::BIGINT AS want,
CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 3 = 0 THEN 'Drums' END AS credit, p_partkey % 11 = 0 AS broken FROM (SELECT *, p_brand || ' Records' AS p_mfgr FROM part)""")
def catalog_payload(spark, sf_dir):
    """Release payloads to catalog rows: several artists, none, several labels, year 0, credits, and payloads cut short."""
    k = F.col("p_partkey")
    name = lambda c: F.struct(c.alias("name"))
    artists = F.when(k % 7 == 0, F.array().cast("array<struct<name:string>>")).when(k % 3 == 0, F.array(name(F.col("p_brand")), name(F.concat(F.lit("The "), "p_type")))).otherwise(F.array(name(F.col("p_brand"))))
    labels = F.when(k % 4 != 0, F.array(name(F.concat("p_brand", F.lit(" Records"))), name(F.lit("Second"))))
    credits = F.when(k % 3 == 0, F.array(F.struct(F.col("p_brand").alias("name"), F.lit("Drums").alias("role"))))
    whole = F.to_json(F.struct(k.alias("id"), F.col("p_name").alias("title"), F.when(k % 5 == 0, 0).otherwise(F.lit(1950) + F.col("p_size")).alias("year"), artists.alias("artists"), labels.alias("labels"), credits.alias("extraartists"), F.struct(F.col("p_size").alias("want")).alias("community")))
    payload = t(spark, sf_dir, "part").select(k.alias("pos"), whole.alias("j")).select("pos", F.when(F.col("pos") % 11 == 0, F.expr("left(j, length(j) - 3)")).otherwise(F.col("j")).alias("j"))
    got = connectors.releases(payload, "j")
    return got.select(F.col("pos").alias("id"), "artist", F.when(F.col("corrupt").isNull(), F.col("title")).alias("title"), F.when(F.col("corrupt").isNull(), F.col("year")).alias("year"), F.when(F.col("corrupt").isNull(), F.col("label")).alias("label"), F.when(F.col("corrupt").isNull(), F.col("want")).alias("want"), F.when(F.col("corrupt").isNull(), F.try_element_at("credits", F.lit(1))["role"]).alias("credit"), F.col("corrupt").isNotNull().alias("broken"))


@query(f"WITH {sql.BASE} SELECT b.item_pos, r.artist, r.title, r.year, r.label, r.country, r.want, r.have, r.genres[1] AS genre FROM best b JOIN catalog r USING (catalog_id)")
def catalog_lookup(spark, sf_dir):
    cat = tables.catalog(spark, sf_dir)
    return linkage.best_matches(found(spark, sf_dir), cat).join(cat, "catalog_id").select("item_pos", "artist", "title", "year", "label", "country", "want", "have", F.try_element_at("genres", F.lit(1)).alias("genre"))


@query(f"WITH {sql.TRACKS} SELECT item_pos, entity_id, confirmed, recording_id, release_id FROM tracks LEFT JOIN recs ON confirmed AND artist = i_artist AND name = i_title")
def confirmed_ids(spark, sf_dir):
    return plan.all_tracks(spark, sf_dir).select("item_pos", "entity_id", "confirmed", "recording_id", "release_id")


@query(f"WITH {sql.TRACKS} SELECT item_pos, entity_id, artist, name, year FROM tracks WHERE catalog_id IS NULL")
def fallback_entities(spark, sf_dir):
    return plan.all_tracks(spark, sf_dir).filter("catalog_id IS NULL").select("item_pos", "entity_id", "artist", "name", "year")


@query(f"WITH {sql.TRACKS} SELECT item_pos, coalesce(credited, mentioned) AS instruments, CASE WHEN credited IS NOT NULL THEN 'discogs' WHEN mentioned IS NOT NULL THEN 'youtube_title' END AS source, CASE WHEN credited IS NOT NULL THEN 'catalog' WHEN mentioned IS NOT NULL THEN 'parsed' END AS method, CASE WHEN credited IS NOT NULL THEN 'from Discogs' WHEN mentioned IS NOT NULL THEN 'from the title' END AS label FROM tracks")
def instrument_choice(spark, sf_dir):
    i = F.col("instruments")
    return plan.all_tracks(spark, sf_dir).select("item_pos", joined(i["value"]).alias("instruments"), i["source"].alias("source"), i["method"].alias("method"), values.provenance_label(i).alias("label"))


@query(f"""WITH {sql.TRACKS}, h AS (SELECT *, lower(concat_ws(' ', title, array_to_string(coalesce(genres, []), ' '), array_to_string(coalesce(styles, []), ' '))) AS hints FROM tracks)
SELECT item_pos, c_bpm AS bpm, CASE WHEN c_bpm IS NOT NULL THEN 'youtube_title parsed 0.6' END AS bpm_from, c_key AS key, CASE WHEN c_key IS NOT NULL THEN 'youtube_title parsed 0.5' END AS key_from,
  {sql.hint_list('hints', vocab.FEELS)} AS feels, {sql.hint_list('hints', vocab.TEXTURES)} AS textures, 'inferred inferred 0.55' AS mood_from FROM h""")
def track_provenance(spark, sf_dir):
    """Where each track's tempo, key and mood come from; a mood is always there."""
    origin = lambda p: F.when(p.isNotNull(), F.concat_ws(" ", p["source"], p["method"], p["confidence"].cast("string")))
    made = plan.all_tracks(spark, sf_dir)
    return made.select("item_pos", F.col("bpm.value").alias("bpm"), origin(F.col("bpm")).alias("bpm_from"), F.col("key.value").alias("key"), origin(F.col("key")).alias("key_from"), joined("mood.value.feels").alias("feels"), joined("mood.value.textures").alias("textures"), origin(F.col("mood")).alias("mood_from"))


LABELS = "CASE p_partkey % 5 WHEN 0 THEN 'catalog' WHEN 1 THEN 'parsed' WHEN 2 THEN 'analyzed' WHEN 3 THEN 'inferred' ELSE 'manual' END"


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'from Discogs' WHEN 1 THEN 'from the title' WHEN 2 THEN 'analyzed ' || floor(least(1.0, p_size / 40.0) * 100 + 0.5)::INTEGER || '%' WHEN 3 THEN 'inferred ' || floor(least(1.0, p_size / 40.0) * 100 + 0.5)::INTEGER || '%' ELSE 'yours' END AS label, CASE p_partkey % 5 WHEN 0 THEN 'discogs' WHEN 1 THEN 'web' WHEN 2 THEN 'audio_analysis' WHEN 3 THEN 'inferred' ELSE 'user' END AS source FROM part")
def provenance_label(spark, sf_dir):
    k, c, now = F.col("p_partkey") % 5, F.col("p_size") / 40.0, tables.as_of()
    v = F.col("p_name")
    made = F.when(k == 0, values.confirmed(v, "discogs", now)).when(k == 1, values.confirmed(v, "web", now)).when(k == 2, values.analyzed(v, c, now)).when(k == 3, values.inferred(v, c, now)).otherwise(values.user_set(v, now))
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), values.provenance_label(made).alias("label"), made["source"].alias("source"))


# scores


def component(name: str, column: Callable[[], F.Column], expression: str) -> None:
    def run(spark, sf_dir):
        return scoring.components(plan.all_tracks(spark, sf_dir), ASKED).select("item_pos", F.round(column(), 6).alias("value"))

    run.__name__ = name
    query(f"WITH {sql.COMPONENTS} SELECT item_pos, round({expression}, 6) AS value FROM components")(run)


for _name in ("filter_match", "rarity", "obscurity", "richness", "source_quality", "history"):
    component(_name, lambda name=_name: F.col(name), _name)
component("gem_seed", scoring.gem_seed, "want::DOUBLE / greatest(have, 1) / log10(greatest(video_views, 10)::DOUBLE)")


@query(f"WITH {sql.COMPONENTS}, t AS (SELECT *, {sql.total('0.5')} AS dig_score FROM components) SELECT item_pos, dig_score, {sql.TIER} AS tier, {sql.reasons('0.5')} AS reasons FROM t")
def dig_score(spark, sf_dir):
    return scoring.scored(plan.all_tracks(spark, sf_dir), ASKED).select("item_pos", "dig_score", "tier", F.array_join("reasons", "; ").alias("reasons"))


@query(f"WITH {sql.COMPONENTS}, t AS (SELECT *, {sql.total('0.5')} AS dig_score FROM components) SELECT item_pos, entity_id, dig_score FROM t ORDER BY dig_score DESC, item_pos LIMIT 24")
def top_results(spark, sf_dir):
    return scoring.scored(plan.all_tracks(spark, sf_dir), ASKED).orderBy(F.desc("dig_score"), "item_pos").limit(24).select("item_pos", "entity_id", "dig_score")


@query(
    f"""WITH {sql.COMPONENTS.replace('items AS (', 'all_items AS (', 1).replace('split AS (', f'items AS (SELECT * FROM (SELECT * FROM all_items WHERE contains({sql.folded("title")}, {sql.quoted("brand")}) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY item_pos) <= {plan.PER_SOURCE}) ORDER BY item_pos LIMIT {plan.ENRICHED}), split AS (', 1)},
{sql.LEARNED}, asked AS (SELECT DISTINCT {USER}::BIGINT AS user_id, catalog_id AS entity_id FROM components WHERE catalog_id IS NOT NULL), {sql.affinity_of('asked')},
joined AS (SELECT c.*, coalesce(a.affinity, 0.5) AS affinity FROM components c LEFT JOIN affinity a ON a.entity_id = c.catalog_id),
t AS (SELECT *, {sql.total('affinity')} AS dig_score FROM joined WHERE entity_id NOT IN (SELECT 'release:' || entity_id FROM actions WHERE user_id = {USER}))
SELECT entity_id, item_pos, artist, name, year, dig_score, {sql.TIER} AS tier, {sql.reasons('affinity')} AS reasons FROM t"""
)
def search(spark, sf_dir):
    return plan.search(spark, sf_dir, FLAGSHIP, USER)


@query(f"WITH {sql.TRACKS} SELECT item_pos, concat_ws(' — ', coalesce(nullif(concat_ws(' · ', nullif(year, 0), genres[1], array_to_string(styles, ' · ')), ''), 'no data'), nullif(concat_ws(', ', country, label), '')) AS subtitle FROM tracks")
def subtitle(spark, sf_dir):
    return plan.all_tracks(spark, sf_dir).select("item_pos", display.subtitle().alias("subtitle"))


@query(f"WITH {sql.BASE} SELECT item_pos, CASE WHEN kind = 'youtube' THEN id END AS first_video FROM items")
def first_source(spark, sf_dir):
    return items_of(spark, sf_dir).select("item_pos", display.first_video(F.array(F.struct("kind", "id")))["id"].alias("first_video"))


@query(f"WITH {sql.BASE} SELECT item_pos, coalesce(c_bpm IS NOT NULL AND item_pos % 2 = 0, false) AS analyzed, CASE WHEN c_bpm IS NULL THEN '—' WHEN item_pos % 2 = 0 THEN floor(c_bpm + 0.5)::INTEGER || ' analyzed 90%' ELSE floor(c_bpm + 0.5)::INTEGER || ' from the title' END AS readout FROM candidates")
def is_analyzed(spark, sf_dir):
    now = tables.as_of()
    even = F.col("item_pos") % 2 == 0
    bpm = F.when(even, values.analyzed(F.col("c_bpm"), 0.9, now)).otherwise(values.provenance(F.col("c_bpm"), "youtube_title", "parsed", 0.6, now))
    made = found(spark, sf_dir).select("item_pos", bpm.alias("bpm"), values.provenance(F.col("c_key"), "youtube_title", "parsed", 0.5, now).alias("key"))
    return made.select("item_pos", display.is_analyzed().alias("analyzed"), display.readout().alias("readout"))


# preferences and state


def acts(spark, sf_dir):
    return tables.actions(t(spark, sf_dir, "events"))


def attrs(spark, sf_dir):
    return tables.attributes(spark, sf_dir)


@query(f"WITH {sql.LEARNED} SELECT * FROM learned")
def affinity_counters(spark, sf_dir):
    return preference.counters(acts(spark, sf_dir), attrs(spark, sf_dir))


@query(f"WITH {sql.LEARNED} SELECT * FROM sums")
def affinity_totals(spark, sf_dir):
    return preference.totals(acts(spark, sf_dir))


@query(f"WITH {sql.LEARNED}, asked AS (SELECT DISTINCT user_id, entity_id FROM actions), {sql.affinity_of('asked')} SELECT user_id, entity_id, round(affinity, 6) AS affinity FROM affinity")
def affinity_score(spark, sf_dir):
    a, b = acts(spark, sf_dir), attrs(spark, sf_dir)
    made = preference.affinity(a.select("user_id", "entity_id").distinct(), b, preference.counters(a, b), preference.totals(a))
    return made.select("user_id", "entity_id", F.round("affinity", 6).alias("affinity"))


def kept_preferences(spark, sf_dir) -> PreferenceStore:
    store = PreferenceStore(spark, fresh_path(spark, "preferences"))
    store.describe(attrs(spark, sf_dir))
    store.add(acts(spark, sf_dir))
    store.learn()
    return store


@query(ORACLE["affinity_counters"])
def kept_counters(spark, sf_dir):
    return kept_preferences(spark, sf_dir).counters()


@query(ORACLE["affinity_score"])
def kept_affinity(spark, sf_dir):
    return kept_preferences(spark, sf_dir).affinity().withColumn("affinity", F.round("affinity", 6))


@query(f"WITH {sql.STATUS} SELECT * FROM statuses")
def status_fold(spark, sf_dir):
    return preference.statuses(acts(spark, sf_dir))


@query(f"WITH {sql.STATUS} SELECT * FROM statuses WHERE status IN ('saved', 'analyzed')")
def collection(spark, sf_dir):
    return preference.collection(preference.statuses(acts(spark, sf_dir)))


@query(f"WITH {sql.ACTIONS} SELECT DISTINCT entity_id FROM actions")
def seen_ids(spark, sf_dir):
    return acts(spark, sf_dir).select("entity_id").distinct()


@query(f"WITH {sql.ACTIONS} SELECT p_partkey AS entity_id, p_name FROM part WHERE p_partkey NOT IN (SELECT entity_id FROM actions WHERE user_id = {USER})")
def hide_seen(spark, sf_dir):
    results = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), "p_name")
    return preference.hidden(results, acts(spark, sf_dir).filter(F.col("user_id") == USER))


@query(f"WITH {sql.ACTIONS} SELECT p_partkey AS entity_id, p_name FROM part WHERE p_partkey NOT IN (SELECT entity_id FROM actions WHERE user_id = {USER} AND action = 'reject')")
def drop_rejected(spark, sf_dir):
    results = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), "p_name")
    return preference.dropped(results, acts(spark, sf_dir).filter(F.col("user_id") == USER))


STORED = "SELECT p_partkey AS entity_id, p_partkey AS item_pos, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'saved' ELSE 'seen' END AS status FROM part WHERE p_partkey % 2 = 0"


@query(f"WITH stored AS ({STORED}), new AS (SELECT p_partkey % 300 AS entity_id, p_partkey AS item_pos, p_name AS name FROM part) SELECT * FROM stored UNION ALL SELECT entity_id, item_pos, name, 'seen' FROM new WHERE entity_id NOT IN (SELECT entity_id FROM stored) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY item_pos) = 1")
def mark_seen(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    part.createOrReplaceTempView("part")
    new = part.select((F.col("p_partkey") % 300).alias("entity_id"), F.col("p_partkey").alias("item_pos"), F.col("p_name").alias("name"))
    return preference.mark_seen(spark.sql(STORED), new)


@query(f"WITH stored AS (SELECT entity_id, name, status FROM ({STORED})), {sql.ACTIONS}, last AS (SELECT entity_id, 'user ' || user_id AS name, CASE action WHEN 'save' THEN 'saved' ELSE 'rejected' END AS status FROM actions WHERE action IN ('save', 'reject') QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1) SELECT * FROM stored WHERE entity_id NOT IN (SELECT entity_id FROM last) UNION ALL SELECT * FROM last")
def save_upsert(spark, sf_dir):
    t(spark, sf_dir, "part").createOrReplaceTempView("part")
    stored = spark.sql(STORED).select("entity_id", "name", "status")
    changes = acts(spark, sf_dir).filter("action IN ('save', 'reject')").select("entity_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), F.when(F.col("action") == "save", "saved").otherwise("rejected").alias("status"), "ts", "event_id")
    return preference.upsert(stored, changes)


@query("SELECT p_partkey AS entity_id, coalesce(CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN p_size * 1.5::DOUBLE END, p_size::DOUBLE) AS bpm, coalesce(CASE WHEN p_partkey % 2 = 0 THEN 'C major' END, 'A minor') AS key, NULL::VARCHAR AS instruments, CASE WHEN p_partkey % 5 = 0 THEN 'saved' WHEN p_partkey % 2 = 0 THEN 'analyzed' ELSE 'seen' END AS status FROM part")
def merge_analysis(spark, sf_dir):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string").alias("instruments")
    stored = t(spark, sf_dir, "part").select(k.alias("entity_id"), F.col("p_size").cast("double").alias("bpm"), F.lit("A minor").alias("key"), none, F.when(k % 5 == 0, "saved").otherwise("seen").alias("status"))
    analysis = t(spark, sf_dir, "part").filter(k % 2 == 0).select(k.alias("entity_id"), F.when(k % 3 != 0, F.col("p_size") * 1.5).alias("bpm"), F.lit("C major").alias("key"), none)
    return preference.merge_analysis(stored, analysis)


# audio


@query(f"""WITH p AS (SELECT vec_id, [abs(x::DOUBLE) FOR x IN embedding[1:12]] AS v FROM embeddings),
c AS (SELECT vec_id, [x - list_sum(v) / 12 FOR x IN v] AS v FROM p), n AS (SELECT vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS norm FROM c),
r AS (SELECT vec_id, i, key, round(list_sum([n.v[j] * t.v[j] FOR j IN range(1, 13)]) / norm, 9) AS r FROM n, {sql.TEMPLATES})
SELECT vec_id, key, round(greatest(0, least(1, (r + 1) / 2)), 2) AS confidence FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, i) = 1""")
def key_estimate(spark, sf_dir):
    profile = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double")))
    return t(spark, sf_dir, "embeddings").select("vec_id", audio.key_estimate(profile).alias("k")).select("vec_id", "k.key", "k.confidence")


#: Rate, samples, frame and octaves of the fragments that stand in for audio; every tenth is cut short.
RATE, SAMPLES, WINDOW, HEARD = 4000, 1024, 512, (3, 4, 5)


@query(f"""WITH amps AS (SELECT vec_id, [abs(x::DOUBLE) FOR x IN embedding[1:12]] AS a FROM embeddings WHERE vec_id % 10 <> 3),
samples AS (SELECT vec_id, t, floor(32767 * list_sum([a[i] * sin(2 * pi() * 440 * pow(2, (i - 10) / 12.0::DOUBLE) * t / {RATE}) FOR i IN range(1, 13)]) / list_sum(a) + 0.5) / 32768 AS x FROM amps, unnest(range(0, {SAMPLES})) AS r(t)),
basis AS (SELECT n, m, h * cos(w * n) AS c, h * sin(w * n) AS s FROM (
  SELECT n, m, 0.5 - 0.5 * cos(2 * pi() * n / {WINDOW}) AS h, 2 * pi() * 440 * pow(2, (m - 21) / 12.0::DOUBLE) / {RATE} AS w FROM unnest(range(0, {WINDOW})) AS a(n), unnest(range(0, 36)) AS b(m))),
spectrum AS (SELECT vec_id, t // {WINDOW} AS frame, m, sqrt(pow(sum(x * c), 2) + pow(sum(x * s), 2)) AS g FROM samples JOIN basis ON n = t % {WINDOW} GROUP BY ALL),
chroma AS (SELECT vec_id, m % 12 AS pitch, sum(g) / {SAMPLES // WINDOW} AS g FROM spectrum GROUP BY ALL),
p AS (SELECT vec_id, list(g / total ORDER BY pitch) AS v FROM (SELECT *, sum(g) OVER (PARTITION BY vec_id) AS total FROM chroma) GROUP BY vec_id),
c AS (SELECT vec_id, [x - list_sum(v) / 12 FOR x IN v] AS v FROM p), n AS (SELECT vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS norm FROM c),
r AS (SELECT vec_id, i, key, round(list_sum([n.v[j] * t.v[j] FOR j IN range(1, 13)]) / norm, 6) AS r FROM n, {sql.TEMPLATES}),
best AS (SELECT vec_id, key, round(greatest(0, least(1, (r + 1) / 2)), 2) AS confidence FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, i) = 1)
SELECT vec_id, key, confidence, vec_id % 10 = 3 AS failed FROM embeddings LEFT JOIN best USING (vec_id)""")
def fragment_keys(spark, sf_dir):
    """Keys of fragments that are made of the vectors: samples, windowed transform, pitch classes, correlation; broken ones are reported."""
    made = fragments.tones(t(spark, sf_dir, "embeddings"), "vec_id", "embedding", RATE, SAMPLES)
    cut = made.withColumn("data", F.when(F.col("vec_id") % 10 == 3, F.expr("substring(data, 1, 20)")).otherwise(F.col("data")))
    found = fragments.analyzed(cut, "vec_id", "data", frame=WINDOW, hop=WINDOW, octaves=HEARD)
    return found.select("vec_id", "key", F.col("key_confidence").alias("confidence"), F.col("error").isNotNull().alias("failed"))


@query("""WITH m AS (SELECT vec_id, [list_sum([abs(embedding[12 * k + i]::DOUBLE) FOR k IN range(0, 5)]) / 5 FOR i IN range(1, 13)] AS p FROM embeddings)
SELECT vec_id, unnest(range(0, 12))::INTEGER AS pitch, round(unnest(CASE WHEN list_sum(p) > 0 THEN [x / list_sum(p) FOR x IN p] ELSE p END), 9) AS share FROM m""")
def chroma_mean(spark, sf_dir):
    """Five frames of twelve pitch classes to one profile."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.transform(F.slice("embedding", k * 12 + 1, 12), lambda x: F.abs(x.cast("double"))))
    made = t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(audio.chroma_profile(frames)).alias("pitch", "share"))
    return made.select("vec_id", "pitch", F.round("share", 9).alias("share"))


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
every AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY event_type),
s AS (SELECT event_type, coalesce(n, 0.0::DOUBLE) AS n, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i FROM every LEFT JOIN h USING (event_type, hour)),
ac AS (SELECT a.event_type, b.i - a.i AS lag, sum(a.n * b.n) AS v FROM s a JOIN s b ON a.event_type = b.event_type AND b.i >= a.i GROUP BY ALL)
SELECT event_type, round(0.5 + 0.5 * coalesce(least(1.0, greatest(0.0, max(v) FILTER (WHERE lag > 0) / (max(v) FILTER (WHERE lag = 0) + 1e-9))), 0.6), 2) AS confidence FROM ac GROUP BY event_type""")
def autocorr_confidence(spark, sf_dir):
    hourly = t(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").cast("double").alias("n"))
    return audio.periodicities(audio.gapless(hourly, "event_type", "hour", "n", "1 hour"), "event_type", "hour", "n")


# streams: they end where the batch plans do

for _name, _stream in STREAMS.items():
    QUERIES[_name] = _stream
ORACLE["stream_affinity"] = ORACLE["affinity_counters"]
ORACLE["stream_status"] = ORACLE["status_fold"]
ORACLE["stream_activity"] = f"WITH {sql.ACTIONS} SELECT ts::DATE::VARCHAR AS day, action, count(*) AS n FROM actions GROUP BY ALL"
