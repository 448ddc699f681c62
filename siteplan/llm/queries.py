"""The operators' queries over the benchmark tables, and the SQL each must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan.llm.common import shared_path, with_crc32
from siteplan.llm.decontamination import find_leaks
from siteplan.llm.language import identify_languages, language_prototypes
from siteplan.llm.lines import drop_recurring_lines
from siteplan.llm.mixing import mix_datasets, word_count
from siteplan.llm.near_duplicates import near_duplicates
from siteplan.llm.packing import pack_prompts
from siteplan.llm.quality import kept_by, rule_ledger
from siteplan.llm.sharding import shard_records
from siteplan.llm.source_urls import judge_sources
from siteplan.llm.spellings import count_words, drop_one_letter, spelling_variants
from siteplan.llm.token_files import read_token_table, write_token_table
from siteplan.llm.toxicity import fit_toxicity, score_toxicity
from siteplan.llm.transcripts import repair_transcripts, transcript_digests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 40
#: Bound on the labelled rows that the toxicity model is fitted to; they are chosen by a hash of their ids.
MAX_LABELLED = 200_000
MIX_WEIGHTS = (3, 1, 2)
MIX_SHARE = 1.5
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


# Windows of item size laid where a document shares a five-word shingle with an item of five words or more.
ORACLES["op1_benchmark_decontamination"] = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
ds AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM dw)),
bs AS (SELECT item_id, n, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT item_id, ws, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS i FROM bw)),
k AS (SELECT DISTINCT doc_id, item_id, n, ds.i - bs.i AS pos FROM ds JOIN bs USING (s)),
wc AS (SELECT k.doc_id, k.item_id, k.pos, k.n, ds.s, count(*) AS c FROM k JOIN ds ON ds.doc_id = k.doc_id AND ds.i BETWEEN k.pos + 1 AND k.pos + k.n - 4 GROUP BY ALL),
bc AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY ALL),
m AS (SELECT wc.doc_id, wc.item_id, wc.pos, wc.n, sum(least(wc.c, coalesce(bc.c, 0))) AS shared, sum(wc.c) AS have FROM wc LEFT JOIN bc ON bc.item_id = wc.item_id AND bc.s = wc.s GROUP BY ALL),
r AS (SELECT doc_id, item_id, greatest(pos, 0) AS start, n, shared / (have + (n - 4) - shared) AS sim FROM m)
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(n AS INT) AS n_words, round(sim, 6) AS similarity FROM r WHERE sim >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) = 1
"""

ORACLES["op2_quality_rules"] = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS caps,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]') OR regexp_matches(x, '[^\x00-\x7F]'))) AS letters, len(list_distinct(ws)) AS kinds
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT *, CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
    + 8 * CAST(word_chars < 2 * n_words OR word_chars > 14 * n_words AS BIGINT) + 16 * CAST(2 * n_dup_lines > n_lines AS BIGINT) + 32 * CAST(2 * caps > n_words AS BIGINT)
    + 64 * CAST(2 * letters < n_words AS BIGINT) + 128 * CAST(n_words >= 50 AND 10 * kinds < n_words AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 > 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""


def _url_sql(bands: int = 5, alpha: float = 0.05, weight: float = 5.0, reject_at: float = 0.7) -> str:
    """The verdicts of ``judge_sources`` in SQL, the levels of the tree as one recursion."""
    name = said = "NULL"
    for verdict, rule in sorted(URL_RULES, key=lambda r: len(r[1])):
        domain, _, start = rule.partition("/")
        fits = f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{start}')"
        name, said = f"CASE WHEN {fits} THEN '{rule}' ELSE {name} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {said} END"
    return f"""
WITH RECURSIVE a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
p AS (SELECT *, {name} AS rule, {said} AS said, list_filter(string_split(regexp_replace(path, '[0-9]+', '<n>', 'g'), '/'), lambda x: x <> '') AS parts FROM b),
t AS (SELECT host, parts, count(said)::BIGINT AS labels, (count(*) FILTER (WHERE said = 'block'))::BIGINT AS blocked FROM p GROUP BY host, parts),
o AS (SELECT *, (sum(labels) OVER w)::BIGINT AS n_all, (sum(blocked) OVER w)::BIGINT AS b_all FROM t WINDOW w AS (PARTITION BY parts)),
pr AS (SELECT (coalesce(sum(blocked), 0) + 1)::DOUBLE / (coalesce(sum(labels), 0) + 2) AS prior FROM t),
l AS (
  SELECT host, parts, labels, blocked, n_all, b_all, CASE WHEN labels > 0 THEN labels ELSE n_all END AS n, CASE WHEN labels > 0 THEN blocked ELSE b_all END AS b,
    ''::VARCHAR AS prefix, 0::INT AS level, NULL::VARCHAR AS template FROM o
  UNION ALL
  SELECT host, parts, labels, blocked, n_all, b_all, n, b, CASE WHEN part IS NULL THEN prefix ELSE prefix || '/' || CASE WHEN branch_n = 0 THEN '*' WHEN near AND members > 1
      THEN '{{' || first_part || CASE WHEN members > 2 THEN '|..|' ELSE '|' END || last_part || '}}' ELSE part END END, (level + 1)::INT,
    CASE WHEN part IS NULL THEN coalesce(nullif(prefix || CASE WHEN NOT mixed AND len(parts) > level THEN '/**' ELSE '' END, ''), '/') END
  FROM (SELECT *, count(DISTINCT part) FILTER (WHERE near) OVER g AS members, min(part) FILTER (WHERE near) OVER g AS first_part, max(part) FILTER (WHERE near) OVER g AS last_part
    FROM (SELECT *, abs(branch_b / branch_n - sum(b) OVER g / sum(n) OVER g) <= sqrt(ln({2 / alpha}::DOUBLE) / (branch_n * 2)) AS near
      FROM (SELECT *, CASE WHEN branch_n > 0 THEN least(floor((branch_b + {weight}::DOUBLE * prior) / (branch_n + {weight}::DOUBLE) * {bands}), {bands - 1}) END AS band
        FROM (SELECT *, (sum(n) OVER k)::DOUBLE AS branch_n, (sum(b) OVER k)::DOUBLE AS branch_b
          FROM (SELECT *, CASE WHEN mixed THEN parts[level + 1] END AS part
            FROM (SELECT *, count(*) OVER q > 1 AND sum(n) OVER q > 0 AND (count(*) FILTER (WHERE n > 0) OVER q < count(*) OVER q OR (sum(b) OVER q > 0 AND sum(b) OVER q < sum(n) OVER q)) AS mixed
              FROM l WHERE template IS NULL WINDOW q AS (PARTITION BY host, prefix)))
          WINDOW k AS (PARTITION BY host, prefix, part)), pr)
      WINDOW g AS (PARTITION BY host, prefix, part IS NULL, band))
    WINDOW g AS (PARTITION BY host, prefix, part IS NULL, band))),
e AS (SELECT * FROM l WHERE template IS NOT NULL),
te AS (SELECT host, template, sum(labels)::DOUBLE AS labels, sum(blocked)::DOUBLE AS blocked, sum(n_all)::DOUBLE AS n_all, sum(b_all)::DOUBLE AS b_all FROM e GROUP BY host, template),
pu AS (SELECT host, template, CASE WHEN n_all > 0 THEN (blocked + {weight}::DOUBLE * ((b_all + {weight}::DOUBLE * prior) / (n_all + {weight}::DOUBLE))) / (labels + {weight}::DOUBLE) END AS purity FROM te, pr)
SELECT page_id, p.host, path, rule, CASE WHEN said IS NOT NULL THEN said WHEN purity >= {reject_at} THEN 'block' ELSE 'allow' END AS verdict, e.template, round(purity, 6) AS purity
FROM p JOIN e ON e.host = p.host AND e.parts = p.parts JOIN pu ON pu.host = e.host AND pu.template = e.template"""


ORACLES["op7_url_filter"] = _url_sql()

ORACLES["op11_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source),
t AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM s),
c AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(turn - 1) % 3 + 1] AS weight, 2.0::DOUBLE * words AS cap FROM t),
b AS (SELECT *, coalesce(sum(cap) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS weights FROM c WINDOW w AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(((SELECT 1.5::DOUBLE * sum(words) FROM c) - caps) / ((SELECT sum(weight) FROM c) - weights)) AS level FROM b),
g AS (SELECT source, words, least(cap, level * weight) AS target,
    (('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 12))::BIGINT % 1000000000000)::HUGEINT AS shift FROM c, l),
e AS (SELECT *, CASE WHEN words > 0 THEN floor(target * 1000000000000::DOUBLE / words)::HUGEINT ELSE 0::HUGEINT END AS each FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5('mix:' || coalesce(doc_id::VARCHAR, ''))) AS place FROM d),
k AS (SELECT r.doc_id, r.size, e.words, e.target, (place * each + shift) // 1000000000000 - ((place - 1) * each + shift) // 1000000000000 AS copies
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, words AS source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INT) AS copies FROM k
"""


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_prompts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("record_id"), F.col("text").alias("prompt"))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def as_cases(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("case_id"), F.col("text").alias("prompt"))


def language_model(documents: DataFrame):
    learn = documents.where(~held_out("doc_id", 4, 2)).select(F.col("text").alias("prompt"), F.col("lang").alias("language"))
    return language_prototypes(learn)


@_query
def op1_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    leaks = find_leaks(as_prompts(_table(spark, sf, "documents")), as_cases(_table(spark, sf, "benchmark")))
    return leaks.select(F.col("record_id").alias("doc_id"), F.col("case_id").alias("item_id"), "start", "n_words", F.round("similarity", 6).alias("similarity"))


@_query
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    ledger = rule_ledger(as_prompts(_table(spark, sf, "documents")))
    return ledger.select(
        F.col("record_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~kept_by("base")).alias("base_failed"), kept_by("v2").alias("kept"), "failures",
    )


@_query
def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = drop_recurring_lines(as_prompts(_table(spark, sf, "documents")))
    return kept.select(F.col("record_id").alias("doc_id"), F.size("dropped_lines").alias("n_dropped"), F.crc32(F.col("prompt").cast("binary")).alias("text_crc32"))


@_query
def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    write_token_table(as_prompts(_table(spark, sf, "documents")), folder, tokenizer_path("word_bpe_49k.json"), end_id=2)
    table = read_token_table(spark, folder).withColumnRenamed("record_id", "doc_id")
    return with_crc32(table, "token_ids", "ids_crc32", ["doc_id", "start", "n_tokens"])


@_query
def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    documents = _table(spark, sf, "documents")
    named = identify_languages(as_prompts(documents), language_model(documents))
    return named.select(F.col("record_id").alias("doc_id"), held_out("record_id", 4, 2).alias("held_out"), F.col("language").alias("lang_pred"), "score")


@_query
def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = shard_records(as_prompts(_table(spark, sf, "documents")), SHARDS)
    text = F.col("record.prompt")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    return placed.select(
        F.col("record.record_id").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    sources = _table(spark, sf, "pages").select(F.col("page_id").alias("artifact_id"), "url")
    judged = judge_sources(sources, URL_RULES)
    return judged.select(F.col("artifact_id").alias("page_id"), "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


@_query
def op8_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    groups = near_duplicates(as_prompts(_table(spark, sf, "documents")))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return groups.select(F.col("record_id").alias("doc_id"), digits.alias("fingerprint"), F.col("group_id").alias("component_id"))


def packed_documents(documents: DataFrame) -> DataFrame:
    packing = pack_prompts(as_prompts(documents), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    keys = ["bucket", "row"]
    digests = with_crc32(packing.pieces, "token_ids", "ids_crc32", [*keys, "record_id", "piece", "start", "length"])
    return digests.join(packing.placements, keys).select(
        F.col("record_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@_query
def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(_table(spark, sf, "documents"))


@_query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    documents = _table(spark, sf, "documents")
    labels = _table(spark, sf, "labels").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    labelled = documents.join(F.broadcast(labels), "doc_id").select(F.col("text").alias("prompt"), "toxic")
    scored = score_toxicity(as_prompts(documents), fit_toxicity(labelled))
    return scored.select(
        F.col("record_id").alias("doc_id"), held_out("record_id", 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


@_query
def op11_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    records = _table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("dataset"), word_count("text").alias("n_words"))
    mixed = mix_datasets(records, MIX_WEIGHTS, MIX_SHARE)
    return mixed.select(F.col("record_id").alias("doc_id"), F.col("n_words").alias("size"), F.col("dataset_words").alias("source_size"), "target", "taken", "copies")


def damaged_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as transcripts with the faults that the contract asks for: a digest of id and turn decides."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, fault = F.coalesce("text", space), F.crc32(key.cast("binary")) % 20
    hit = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), fault.alias("fault")).where(F.col("fault") != 0)
    content = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return hit.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("sequence"), role.alias("role"), content.alias("content"), copies.alias("copy")).drop("copy")


@_query
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    conversations = _table(spark, sf, "conversations")
    report, repaired = repair_transcripts(damaged_messages(conversations))
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    known = report.select(F.col("run_id").alias("_run"), *figures, "audit")
    digests = transcript_digests(repaired).select(F.col("run_id").alias("_digested"), "sha256")
    rows = conversations.select("conv_id").distinct()
    rows = rows.join(known, F.col("conv_id").eqNullSafe(F.col("_run")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_digested")), "left")
    return rows.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in figures], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@_query
def op13_spelling_groups(spark: SparkSession, sf: str) -> DataFrame:
    words = count_words(as_prompts(_table(spark, sf, "documents")), min_letters=6, min_count=5, fault=drop_one_letter(199))
    return spelling_variants(words, times=5).select("word", "form", "root", "n", "n_near", "form_n")
