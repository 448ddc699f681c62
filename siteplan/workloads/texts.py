"""Names, redaction, keys, budgets, instants and provider responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteplan.functions import text
from siteplan.operators import cases as case_ops
from siteplan.sources import parsers, writers
from siteplan.workloads import query
from siteplan.workloads.base import DEMAND, SITE, demand, site, table, with_sql


@query("normalized_texts")
def normalized_texts(spark, sf):
    """Whole documents under the name normalisation; Unicode folding has no SQL form, tests recompute it."""
    folded = text.normalize_name("text")
    return table(spark, sf, "documents").select("doc_id", folded.alias("t")).select("doc_id", F.length("t").alias("length"), F.sha2("t", 256).alias("digest"))


@query(
    "place_slugs",
    """SELECT p_partkey, lower(replace(p_brand, '#', '-')) || ':' || replace(p_name, ' ', '-') AS location_id FROM part""",
)
def place_slugs(spark, sf):
    accented = F.translate(F.initcap("p_name"), "aeiou", "àéîöü")
    return table(spark, sf, "part").select("p_partkey", text.location_id(F.col("p_brand"), F.concat(F.lit("  "), accented, F.lit("!"))).alias("location_id"))


URL_SQL = """u AS (SELECT page_id, split_part(url, '#', 1) AS b, contains(url, '?') AS q FROM pages)"""


@query(
    "redacted_urls",
    with_sql(
        URL_SQL,
        body="""SELECT page_id, b || CASE WHEN q THEN '&' ELSE '?' END || CASE WHEN page_id % 3 = 0 THEN 'api_key=%5BREDACTED%5D&' ELSE '' END || 'n=' || CAST(page_id AS VARCHAR) || '&sigma=%5BREDACTED%5D&note=a+b%2A~' AS url FROM u""",
    ),
)
def redacted_urls(spark, sf):
    """Page links with user info, secrets, an empty parameter and a fragment added, then redacted."""
    base = F.substring_index("url", "#", 1)
    extra = F.concat(
        F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("api_key=k"), F.col("page_id").cast("string"), F.lit("&"))).otherwise(""),
        F.lit("n="), F.col("page_id").cast("string"), F.lit("&empty=&sigma=1&note=a%20b*~#frag"),
    )
    with_user = F.regexp_replace(base, "^(https?://)", "$1me:pw@")
    return table(spark, sf, "pages").select("page_id", text.redact_url(F.concat(with_user, extra)).alias("url"))


@query(
    "redacted_headers",
    "SELECT page_id, '[REDACTED]' AS auth, url AS link, '[REDACTED]' AS token FROM pages",
)
def redacted_headers(spark, sf):
    headers = F.create_map(F.lit("Authorization"), F.col("html"), F.lit("link"), F.col("url"), F.lit("x-access-token"), F.lit("t"))
    rows = table(spark, sf, "pages").select("page_id", headers.alias("h")).withColumn("h", text.redact_mapping("h"))
    return rows.select("page_id", F.col("h")["Authorization"].alias("auth"), F.col("h")["link"].alias("link"), F.col("h")["x-access-token"].alias("token"))


@query(
    "sensitive_keys",
    "SELECT doc_id, contains(lower(source), '1') AS sensitive FROM documents",
)
def sensitive_keys(spark, sf):
    """Sensitive key test on nested JSON keys."""
    key = F.when(F.contains("source", F.lit("1")), F.lit("Session_Cookie")).otherwise(F.lit("plain"))
    inner = F.concat(F.lit('{"a":[{"'), key, F.lit('":1}],"text":"the token here"}'))
    return table(spark, sf, "documents").select("doc_id", text.has_sensitive_json_key(inner).alias("sensitive"))


@query(
    "run_key_hashes",
    """WITH p AS (SELECT o_orderkey, sha256('d:' || CAST(o_custkey AS VARCHAR) || ':' || o_orderstatus || ':' || CAST(o_orderkey % 5 AS VARCHAR)) AS pair_id, o_orderpriority FROM orders)
SELECT o_orderkey, pair_id, sha256(pair_id || ':' || o_orderpriority) AS run_key FROM p""",
)
def run_key_hashes(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("d").alias("digest"), F.col("o_custkey").cast("string").alias("instance"), F.col("o_orderstatus").alias("budget"), (F.col("o_orderkey") % 5).alias("seed"), F.col("o_orderpriority").alias("comparison")
    )
    return text.run_keys(rows, "digest", "instance", "budget", "seed", "comparison").select("o_orderkey", "pair_id", "run_key")


@query(
    "canonical_hashes",
    """SELECT o_orderkey, sha256('{"o_custkey":' || CAST(o_custkey AS VARCHAR) || ',"o_orderstatus":"' || o_orderstatus || '","x":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE CAST(o_orderkey % 3 AS VARCHAR) END || '}') AS hash FROM orders""",
)
def canonical_hashes(spark, sf):
    """Order-independent row hashes; nulls are part of the text."""
    rows = table(spark, sf, "orders").withColumn("x", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3))
    return rows.select("o_orderkey", text.canonical_hash(["x", "o_orderstatus", "o_custkey"]).alias("hash"))


@query(
    "selection_digests",
    """SELECT o_custkey, count(*) AS records, sha256('[' || string_agg('"' || CAST(o_orderkey AS VARCHAR) || '"', ',' ORDER BY o_orderdate, o_orderkey) || ']') AS selection_digest FROM orders GROUP BY 1""",
)
def selection_digests(spark, sf):
    """Digest of each customer's ordered order ids."""
    rows = table(spark, sf, "orders").withColumns({"at": F.struct("o_orderdate", "o_orderkey")})
    found = case_ops.selection_digest(rows, ["o_custkey"], "o_orderkey", "at")
    return found.select("o_custkey", "records", "selection_digest")


@query(
    "budget_lists",
    """SELECT o_orderkey, CAST(o_orderkey % 90 + 1 AS DOUBLE) AS t1, round((o_custkey % 900 + 100) * 0.001::DOUBLE, 9) AS t2, (o_custkey % 9 + 2) * 3600.0::DOUBLE AS t3, 4 AS n_times, CAST((o_orderkey % 64 + 1) * 1000 AS BIGINT) AS k1, CAST(o_custkey * 1000 + 1234567 AS BIGINT) AS k2, 3 AS n_tokens FROM orders""",
)
def budget_lists(spark, sf):
    """Time and token budget lists in their written forms; repeats fall away."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda v: v.cast("string")
    times = F.concat(s(k % 90 + 1), F.lit("s, "), s(c % 900 + 100), F.lit("MS,"), s(c % 9 + 2), F.lit("h,unlimited,none,"), s(k % 90 + 1))
    million = F.concat(F.lit("1_"), F.lpad(s(F.floor((c * 1000 + 234567) / 1000) % 1000), 3, "0"), F.lit("_"), F.lpad(s((c * 1000 + 234567) % 1000), 3, "0"))
    plain = F.when(c * 1000 + 234567 < 1000000, million).otherwise(s(c * 1000 + 1234567))
    tokens = F.concat(s(k % 64 + 1), F.lit("k,"), plain, F.lit(", INF"))
    rows = table(spark, sf, "orders").select("o_orderkey", text.parse_time_budget(times).alias("t"), text.parse_token_budget(tokens).alias("n"))
    at = lambda name, i: F.get(name, F.lit(i))
    return rows.select(
        "o_orderkey", at("t", 0).alias("t1"), F.round(at("t", 1), 9).alias("t2"), at("t", 2).alias("t3"), F.size("t").alias("n_times"), at("n", 0).alias("k1"), at("n", 1).alias("k2"), F.size("n").alias("n_tokens")
    )


@query(
    "snapshot_freshness",
    """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN greatest(epoch(TIMESTAMP '2001-06-01') - epoch(o_orderdate), 0) END AS age, o_custkey % 3 = 0 AS ok FROM orders)
SELECT o_orderkey, CASE WHEN coalesce(age <= 86400 * 300, false) THEN 'hit' WHEN ok THEN 'miss' WHEN coalesce(age <= 86400 * 900, false) THEN 'stale_fallback' ELSE 'failed' END AS status FROM a""",
)
def snapshot_freshness(spark, sf):
    """Cache outcome of each order's snapshot at a fixed instant."""
    written = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    age = F.unix_seconds(text.parse_utc(F.lit("2001-06-01T00:00:00+00:00"))) - F.unix_seconds(text.parse_utc(written))
    known = F.when(F.col("o_orderkey") % 7 != 0, age.cast("double"))
    status = text.freshness(known, F.col("o_custkey") % 3 == 0, 86400 * 300, 86400 * 900)
    return table(spark, sf, "orders").select("o_orderkey", status.alias("status"))


@query("json_values", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events")
def json_values(spark, sf):
    return table(spark, sf, "events").select("event_id", text.json_path("props", ["k"]).alias("k"))


@query(
    "routing_response_cells",
    with_sql(
        SITE,
        body="""SELECT a.site_id // 8 AS block, CAST(a.site_id AS VARCHAR) AS origin_id, CAST(b.site_id AS VARCHAR) AS destination_id, CASE WHEN (a.site_id + b.site_id) % 4 = 3 THEN -1.0 ELSE (a.site_id * 3 + b.site_id)::DOUBLE END AS travel, 'meters' AS units
FROM site a JOIN site b ON a.site_id // 8 = b.site_id // 8""",
    ),
)
def routing_response_cells(spark, sf):
    """Routing-table responses for blocks of eight suppliers; unreachable cells (shown as -1) are Infinity."""
    packed = site(spark, sf).groupBy(F.floor(F.col("site_id") / 8).alias("block")).agg(F.array_sort(F.collect_list("site_id")).alias("ids"))
    cell = lambda a, b: F.when((a + b) % 4 != 3, (a * 3 + b).cast("double"))
    values = F.transform("ids", lambda a: F.transform("ids", lambda b: cell(a, b)))
    body = F.to_json(F.struct(F.lit("Ok").alias("code"), values.alias("distances")))
    responses = packed.select("block", F.transform("ids", lambda v: v.cast("string")).alias("s"), F.transform("ids", lambda v: v.cast("string")).alias("d"), body.alias("json"))
    found = parsers.parse_route_table(responses, "json", "s", "d", "distance")
    return found.withColumn("travel", F.when(F.col("travel") == float("inf"), -1.0).otherwise(F.col("travel")))


@query(
    "geocoder_answers",
    with_sql(
        DEMAND,
        "r AS (SELECT *, row_number() OVER (PARTITION BY demand_id // 40 ORDER BY demand_id % 5 = 0, CASE WHEN demand_id % 5 <> 0 THEN need END DESC, demand_id) AS rank FROM demand)",
        body="SELECT CAST(demand_id // 40 AS VARCHAR) AS query, rank, 'node:' || CAST(demand_id AS VARCHAR) AS provider_id, lon AS longitude, lat - 1 AS south, lon + 1 AS east FROM r WHERE rank <= 10",
    ),
)
def geocoder_answers(spark, sf):
    """Geocoder answers ranked by importance, unknown importance last."""
    place = F.struct(
        F.lit("node").alias("osm_type"), F.col("demand_id").alias("osm_id"), F.lit("x").alias("display_name"), F.col("lon").cast("string").alias("lon"), F.col("lat").cast("string").alias("lat"),
        F.array((F.col("lat") - 1).cast("string"), (F.col("lat") + 1).cast("string"), (F.col("lon") - 1).cast("string"), (F.col("lon") + 1).cast("string")).alias("boundingbox"),
        F.when(F.col("demand_id") % 5 != 0, F.col("need")).alias("importance"),
    )
    # One response per block of 40 places, in id order.
    pages = demand(spark, sf).groupBy(F.floor(F.col("demand_id") / 40).cast("string").alias("query")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("demand_id", place.alias("p")))), lambda e: e["p"])).alias("json"))
    found = parsers.parse_geocoder(pages, "query", "json", 10)
    return found.select("query", "rank", "provider_id", "longitude", "south", "east")


@query(
    "catalog_items",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS search, n AS item_number, 'item-' || CAST(o_orderkey AS VARCHAR) AS id, 1.0::DOUBLE AS west, 3.0::DOUBLE AS east, o_orderdate AS observed_at, 'a=http://h/x?token=%5BREDACTED%5D|b=http://h/' || CAST(o_orderkey AS VARCHAR) AS assets, c > 8 AS truncated FROM r WHERE n <= 8""",
)
def catalog_items(spark, sf):
    """Catalog pages, one item per page, limited per search."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.col("o_orderkey").cast("string")
    body = F.concat(
        F.lit('{"features":[{"id":"item-'), k, F.lit('","bbox":[1,2,0,3,4,9],"properties":{"datetime":"'), day,
        F.lit('"},"assets":{"b":{"href":"http://h/'), k, F.lit('"},"a":{"href":"http://u:p@h/x?token=1#f"}}}]}'),
    )
    pages = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("search"), F.col("o_orderkey").alias("page"), body.alias("json"))
    found = parsers.parse_catalog(pages, "search", "page", "json", 8)
    shown = F.array_join(F.transform("assets", lambda a: F.concat_ws("=", a["key"], a["href"])), "|")
    return found.select("search", "item_number", "id", "west", "east", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), shown.alias("assets"), "truncated")


@query(
    "published_documents",
    """WITH g AS (SELECT text, count(DISTINCT lang || '|' || source) AS n, any_value(lang) AS lang FROM documents GROUP BY 1)
SELECT 'sha256-' || sha256(text) AS artifact_id, n = 1 AS published FROM g""",
)
def published_documents(spark, sf):
    """Content-addressed publish of all documents: equal bytes under other metadata are conflicts."""
    docs = table(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("content"), "lang", "source")
    known = docs.select(F.lit("none").alias("artifact_id"), "lang", "source").limit(0)
    fresh, clash = writers.publish(docs, known, ["lang", "source"])
    return fresh.select("artifact_id", F.lit(True).alias("published")).unionByName(clash.select("artifact_id", F.lit(False).alias("published")))


@query(
    "published_into_catalog",
    """WITH g AS (SELECT text, count(DISTINCT lang || '|' || source) AS n, min(doc_id) AS m FROM documents GROUP BY 1)
SELECT 'sha256-' || sha256(text) AS artifact_id, n = 1 AND m % 3 <> 0 AS published FROM g WHERE n > 1 OR m % 3 <> 0 OR m % 6 = 0""",
)
def published_into_catalog(spark, sf):
    """Publish of all documents into a catalog that knows a third of the texts, half of them under another language."""
    docs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), "lang", "source")
    firsts = docs.groupBy("content").agg(F.min("doc_id").alias("_m"), F.min_by(F.struct("lang", "source"), "doc_id").alias("_d")).filter("_m % 3 = 0")
    lang = F.when(F.col("_m") % 6 == 0, "zz").otherwise(F.col("_d.lang"))
    known = firsts.select(writers.content_id().alias("artifact_id"), lang.alias("lang"), F.col("_d.source").alias("source"))
    fresh, clash = writers.publish(docs.drop("doc_id"), known, ["lang", "source"])
    return fresh.select("artifact_id", F.lit(True).alias("published")).unionByName(clash.select("artifact_id", F.lit(False).alias("published")))


@query(
    "damaged_documents",
    "SELECT CAST(doc_id AS VARCHAR) AS doc, 'sha256-' || sha256(text) AS found_id FROM documents WHERE doc_id % 10 = 0",
)
def damaged_documents(spark, sf):
    """Artifacts whose stored id does not match their bytes."""
    wrong = F.when(F.col("doc_id") % 10 == 0, F.lit("sha256-0")).otherwise(writers.content_id(F.encode("text", "UTF-8")))
    rows = table(spark, sf, "documents").select(
        F.col("doc_id"), F.encode("text", "UTF-8").alias("content"), wrong.alias("given")
    ).withColumn("byte_size", F.length("content").cast("bigint"))
    keyed = rows.select(F.when(F.col("given") == "sha256-0", F.concat(F.lit("bad-"), F.col("doc_id").cast("string"))).otherwise(F.col("given")).alias("artifact_id"), "byte_size", "content")
    found = writers.verify_content(keyed)
    return found.select(F.substring_index("artifact_id", "-", -1).alias("doc"), "found_id")


@query(
    "site_features",
    with_sql(
        SITE,
        body="""SELECT site_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) || ']},"properties":{"site_id":"' || CAST(site_id AS VARCHAR) || '","selected":' || CASE WHEN existing THEN 'true' ELSE 'false' END || '}}' AS value FROM site""",
    ),
)
def site_features(spark, sf):
    """GeoJSON features of all suppliers, existing ones selected."""
    sites = site(spark, sf).withColumnsRenamed({"lon": "x", "lat": "y"})
    return writers.site_features(sites, sites.filter("existing"))


@query(
    "materialized_places",
    with_sql(
        SITE,
        "o AS (SELECT max(site_id) AS a, min(site_id) AS b FROM site)",
        body="SELECT CAST(CASE WHEN site_id = o.a THEN 0 ELSE 1 END AS INT) AS ord, CAST(site_id AS VARCHAR) AS id, lat AS latitude, lon AS longitude, 2.5::DOUBLE AS opening_cost, CAST(nation AS VARCHAR) AS nation FROM site, o WHERE site_id IN (o.a, o.b)",
    ),
)
def materialized_places(spark, sf):
    """Chosen candidates in caller order with a metadata field as a column."""
    rows = site(spark, sf)
    ends = rows.agg(F.max("site_id"), F.min("site_id")).first()
    candidates = rows.select(
        F.col("site_id").cast("string").alias("provider_id"), F.lit("n").alias("display_name"), F.col("lon").alias("longitude"), F.col("lat").alias("latitude"),
        F.create_map(F.lit("nation"), F.col("nation").cast("string")).alias("metadata"),
    )
    found = parsers.materialize_locations(candidates, [str(v) for v in ends], ["nation"], 2.5)
    return found.select("ord", "id", "latitude", "longitude", "opening_cost", "nation")
