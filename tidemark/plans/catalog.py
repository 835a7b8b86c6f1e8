"""Named queries over the driver tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import redaction, rules, text
from tidemark.operators import audit, classify, mirror, state
from tidemark.operators.quantiles import exact_quantiles
from tidemark.streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_text(pattern: str) -> str:
    return pattern.replace("(?i)", "").replace("'", "''")


_ENV = rules.PATTERNS[-1][1]
_ENTROPY = "(SELECT sum(-(n / t) * log2(n / t)) FROM (SELECT count(*) AS n, length({0}) AS t FROM (SELECT unnest(string_split({0}, '')) AS c) GROUP BY c))"
#: Every rule in DuckDB's dialect; it has no look-behind, which the short forms of IPv6 need and no table's texts hold.
_PLAIN = [(e, p) for e, p, _ in (*rules.PATTERNS, *rules.PERSONAL) if e not in rules.VALIDATED and p != rules.IPV6_SHORT]
_FOUND = (
    " UNION ALL ".join(f"SELECT doc_id, source, lang, '{e}' AS entity_type, unnest(regexp_extract_all(text, '(?ims){_sql_text(p)}')) AS m FROM documents" for e, p in _PLAIN)
    + f""" UNION ALL SELECT doc_id, source, lang, 'ENV_ASSIGNMENT_SECRET', m FROM (
    SELECT doc_id, source, lang, unnest(regexp_extract_all(text, '(?ims){_sql_text(_ENV)}')) AS m FROM documents
  ) WHERE NOT regexp_matches(m, '(?i){rules.PLACEHOLDER}') AND {_ENTROPY.format("m")} >= 3.0
"""
)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, entity_type): the detections of every rule, in one pass over the texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    found = redaction.with_redaction(docs, "text", "narrow").drop("text", "redacted")
    return found.select("doc_id", "source", "lang", F.explode("findings.entity_type").alias("entity_type"))


@query(f"SELECT source, entity_type, count(*) AS n FROM ({_FOUND}) GROUP BY ALL")
def secret_counts_by_source(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("source", "entity_type").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, entity_type, count(*) AS n FROM ({_FOUND}) GROUP BY ALL")
def secret_counts_by_document(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))


@query(f"SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({_FOUND}) GROUP BY ALL ORDER BY n DESC, entity_type")
def secret_totals(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents")).orderBy(F.desc("n"), "entity_type")


@query(f"""SELECT doc_id, entity_type, count(*) AS n FROM ({_FOUND}) WHERE entity_type <> 'PHONE_NUMBER' GROUP BY ALL""")
def detected_by_engine(spark, sf_dir):
    """The same counts from the rule engine (profile broad_pii) behind its pre-filter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = redaction.with_redaction(docs, "text", "broad_pii").select("doc_id", F.explode("findings").alias("f"))
    return found.groupBy("doc_id", F.col("f.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


_EMAIL_SQL, _IPV4_SQL = (f"(?ims){_sql_text(p)}" for p in (rules.EMAIL, rules.IPV4))


@query(f"""WITH found AS (
  SELECT doc_id, string_agg(entity_type, ',' ORDER BY entity_type) AS entity_types,
    list(m ORDER BY length(m) DESC, m) FILTER (WHERE entity_type = 'ENV_ASSIGNMENT_SECRET' AND NOT regexp_matches(m, '{_EMAIL_SQL}') AND NOT regexp_matches(m, '{_IPV4_SQL}')) AS assigned
  FROM ({_FOUND}) WHERE entity_type <> 'PHONE_NUMBER' GROUP BY doc_id
), first AS (
  SELECT doc_id, entity_types, list_reduce(list_prepend(text, coalesce(assigned, [])), lambda t, m: replace(t, m, '[ENV_ASSIGNMENT_SECRET]')) AS t FROM documents JOIN found USING (doc_id)
)
SELECT doc_id, regexp_replace(regexp_replace(t, '{_EMAIL_SQL}', '[EMAIL_ADDRESS]', 'g'), '{_IPV4_SQL}', '[IP_ADDRESS]', 'g') AS redacted, entity_types FROM first""")
def redacted_documents(spark, sf_dir):
    """Masked texts and the sorted types of all their detections. The SQL knows the types that occur in the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = redaction.with_redaction(docs, "text", "broad_pii").where(F.size("findings") > 0)
    types = F.array_sort(F.transform("findings", lambda f: f["entity_type"]))
    return out.select("doc_id", "redacted", F.array_join(types, ",").alias("entity_types"))


_KINDS = [(e, p) for e, p, _ in rules.PERSONAL]
_MASKED = "text"
for _e, _p in _KINDS:
    if _p != rules.IPV6_SHORT:
        _MASKED = f"regexp_replace({_MASKED}, '(?ims){_sql_text(_p)}', '[{_e}]', 'g')"


@query(f"SELECT * FROM (SELECT doc_id, text, {_MASKED} AS masked FROM documents) SELECT doc_id, masked WHERE masked <> text".replace("SELECT * FROM (", "FROM ("))
def masked_personal_data(spark, sf_dir):
    """Addresses, numbers of networks and telephones masked by built-in functions alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tests = [rules.suspect(docs.text, e, p) for e, p in _KINDS]
    any_of = tests[0]
    for test in tests[1:]:
        any_of = any_of | test
    masked = F.col("text")
    for e, p in _KINDS:
        masked = F.regexp_replace(masked, rules.spark_pattern(p), f"[{e}]")
    return docs.where(any_of).select("doc_id", masked.alias("masked"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i){rules.PLACEHOLDER}')")
def placeholder_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(f"(?i){rules.PLACEHOLDER}")).select("doc_id")


@query("SELECT doc_id, round((SELECT sum(-(n / t) * log2(n / t)) FROM (SELECT count(*) AS n, length(text) AS t FROM (SELECT unnest(string_split(text, '')) AS c) GROUP BY c)), 6) AS bits FROM documents")
def text_entropy(spark, sf_dir):
    docs = rules.text_entropy(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "bits")
    return docs.select("doc_id", F.round("bits", 6).alias("bits"))


@query("""SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS lf,
  CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS lines,
  list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x)))::BIGINT AS longest FROM documents""")
def line_counts(spark, sf_dir):
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda x: F.octet_length(x)))
    return table(spark, sf_dir, "documents").select("doc_id", text.lf_count(F.col("text")).alias("lf"), text.splitlines_count(F.col("text")).alias("lines"), longest.cast("long").alias("longest"))


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def content_hash_duplicates(spark, sf_dir):
    by = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash")).groupBy("hash")
    return by.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def _ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    decision = F.when(F.col("event_type").isin("purchase", "error"), "deny").otherwise("allow")
    return e.select(F.col("user_id").cast("string").alias("content_hash"), F.date_format("ts", "yyyy-MM-dd'T'HH").alias("at"), decision.alias("decision"))


@query("""SELECT user_id::VARCHAR AS content_hash, max(strftime(ts, '%Y-%m-%dT%H')) AS at,
  max(strftime(ts, '%Y-%m-%dT%H') || ' ' || CASE WHEN event_type IN ('purchase', 'error') THEN 'deny' ELSE 'allow' END)[15:] AS decision FROM events GROUP BY user_id""")
def ledger_winners(spark, sf_dir):
    return state.current_decisions(_ledger(spark, sf_dir)).select("content_hash", "at", "decision")


@query("SELECT user_id::VARCHAR AS line_hash, arg_max(event_type, event_id) AS verdict FROM events GROUP BY user_id")
def latest_verdicts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("line_hash"), F.col("event_type").alias("verdict"), F.col("event_id").alias("seq"))
    return state.latest_verdicts(e)


@query("""SELECT source, count(*) FILTER (WHERE h NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))) AS misses,
  count(*) FILTER (WHERE h IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))) AS hits FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source""")
def cache_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text.content_hash(F.col("text")).alias("line_hash"))
    cache = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("line_hash", F.lit("CLEARED").alias("verdict"), F.col("doc_id").alias("seq"))
    misses, hits = state.split_by_cache(docs.select("source", "line_hash"), cache)
    both = misses.select("source", F.lit(1).alias("m"), F.lit(0).alias("h")).union(hits.select("source", F.lit(0), F.lit(1)))
    return both.groupBy("source").agg(F.sum("m").alias("misses"), F.sum("h").alias("hits"))


@query("""WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, strlen(text) AS b FROM conversations WHERE strlen(text) BETWEEN 1 AND 1000
), r AS (
  SELECT conv_id, k, 0 AS chunk_no, b AS size FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.k, CASE WHEN r.size + 1 + t.b > 1000 THEN r.chunk_no + 1 ELSE r.chunk_no END, CASE WHEN r.size + 1 + t.b > 1000 THEN t.b ELSE r.size + 1 + t.b END
  FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1
) SELECT conv_id::VARCHAR AS relpath, chunk_no::INTEGER AS chunk_no, count(*) AS chunk_lines, max(size)::BIGINT AS chunk_bytes FROM r GROUP BY ALL""")
def chunked_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("relpath"), F.col("turn").alias("line_no"), F.col("text").cast("binary").alias("line"))
    chunks = classify.chunk_files(turns.where(F.length("line") > 0), 1000).where("not oversize")
    return chunks.select("relpath", "chunk_no", F.size("lines").cast("long").alias("chunk_lines"), "chunk_bytes")


@query("SELECT role, sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text)) / sum(sum(strlen(text))) OVER (), 6) AS share FROM conversations GROUP BY role")
def byte_share_by_role(spark, sf_dir):
    return audit.byte_share(table(spark, sf_dir, "conversations"), "role", "text").select("role", "bytes", F.round("share", 6).alias("share"))


@query("SELECT event_type, min(value) AS lo, round(median(value), 6) AS mid, max(value) AS hi FROM events GROUP BY event_type")
def value_stats(spark, sf_dir):
    out = exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"mid": 0.5})
    return out.select("event_type", F.col("least").alias("lo"), F.round("mid", 6).alias("mid"), F.col("most").alias("hi"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def top_event_types(spark, sf_dir):
    return audit.top_identifiers(table(spark, sf_dir, "events"), "event_type")


@query("SELECT count(*) AS entries, 10.0::DOUBLE AS size_mb, count(*) > 100 AS flagged FROM events WHERE ts > (SELECT min(ts) + INTERVAL 1 DAY FROM events)")
def growth_check(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return audit.growth_check(e, e.select(F.min("ts") + F.expr("INTERVAL 1 DAY")).scalar(), 10.0, most_entries=100)


@query("""WITH r AS (SELECT event_type AS k, quantile_disc(value, 0.25) AS lo, quantile_disc(value, 0.5) AS hi FROM events GROUP BY 1)
SELECT x.k AS a, y.k AS b, x.lo <= y.hi AND y.lo <= x.hi AS overlap FROM r x JOIN r y ON x.k < y.k""")
def range_overlap(spark, sf_dir):
    r = exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"lo": 0.25, "hi": 0.5}, discrete=True)
    return audit.range_overlaps(r, "event_type", "lo", "hi")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_turns(spark, sf_dir):
    by = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return by.agg(F.max_by(F.struct("turn", "role"), "turn").alias("t")).select("conv_id", "t.turn", "t.role")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, max(value) AS peak FROM events GROUP BY 1")
def daily_peak(spark, sf_dir):
    return watch.daily_peak(table(spark, sf_dir, "events"), "value").select(F.col("day").cast("timestamp_ntz").alias("day"), "peak")


@query("""SELECT user_id, round(epoch(ts) - epoch(since), 3) AS gap_s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events)
WHERE epoch(ts) - epoch(since) > 1.5 * 86400""")
def heartbeat_gaps(spark, sf_dir):
    return watch.gaps(table(spark, sf_dir, "events"), "user_id", 86_400.0).select("user_id", F.round("gap_s", 3).alias("gap_s"))


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_counts(spark, sf_dir):
    out = watch.rolling_counts(table(spark, sf_dir, "events"), "1 hour", "1 hour", by=("event_type",))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts)::TIMESTAMP, date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s""")
def rolling_two_hour_counts(spark, sf_dir):
    out = watch.rolling_counts(table(spark, sf_dir, "events"), "2 hours", "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT doc_id::VARCHAR AS name, 'undocumented' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT page_id::VARCHAR, 'stale' FROM (SELECT page_id FROM pages EXCEPT SELECT doc_id FROM documents)""")
def name_drift(spark, sf_dir):
    docs, labels, pages = (table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    left = audit.drift(docs.select(F.col("doc_id").alias("name")), labels.select(F.col("doc_id").alias("name"))).where("side = 'undocumented'")
    right = audit.drift(docs.select(F.col("doc_id").alias("name")), pages.select(F.col("page_id").alias("name"))).where("side = 'stale'")
    return left.union(right).select(F.col("name").cast("string").alias("name"), "side")


@query("SELECT count(*) FILTER (WHERE l) AS in_both, count(*) AS in_any FROM (SELECT id, count(*) = 2 AS l FROM (SELECT DISTINCT doc_id AS id, 1 AS t FROM documents UNION ALL SELECT DISTINCT doc_id, 2 FROM labels) GROUP BY id)")
def set_sizes(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    both = a.intersect(b).select("doc_id", F.lit(1).alias("both"))
    return a.union(b).distinct().join(both, "doc_id", "left").agg(F.count("both").alias("in_both"), F.count("*").alias("in_any"))


_TAGS = [("ECONOMY", "BASIC"), ("PROMO", "BASIC"), ("SMALL", "COMPACT"), ("LARGE", "BULKY")]


@query(f"""WITH m(variant, canonical) AS (VALUES {", ".join(map(str, _TAGS))})
SELECT DISTINCT p_partkey AS item, coalesce(canonical, split_part(p_type, ' ', 1)) AS tag FROM part LEFT JOIN m ON variant = split_part(p_type, ' ', 1)""")
def mapped_tags(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.split("p_type", " ")[0].alias("tag"))
    return audit.map_tags(tags, spark.createDataFrame(_TAGS, "variant string, canonical string"))


@query("""WITH t AS (SELECT DISTINCT user_id AS item, event_type AS tag FROM events)
SELECT item, tag FROM t WHERE NOT (tag = 'click' AND item IN (SELECT item FROM t WHERE tag = 'view'))""")
def folded_tags(spark, sf_dir):
    tags = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("tag")).distinct()
    return audit.fold_tags(tags, spark.createDataFrame([("click", "view")], "narrow string, parent string"))


@query("SELECT count(DISTINCT p_type) AS before, count(DISTINCT split_part(p_type, ' ', 1)) AS after FROM part")
def distinct_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count_distinct("p_type").alias("before"), F.count_distinct(F.split("p_type", " ")[0]).alias("after"))


@query("SELECT c_name AS title, c_nationkey AS year FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unseen_titles(spark, sf_dir):
    """Customers without an urgent order."""
    c = table(spark, sf_dir, "customer")
    seen = c.join(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), c.c_custkey == F.col("o_custkey"), "left_semi").select(F.col("c_name").alias("title"), F.col("c_nationkey").alias("year"), F.lit(True).alias("seen"))
    return audit.unseen(c.select(F.col("c_name").alias("title"), F.col("c_nationkey").alias("year")), seen)


@query("SELECT n_name AS name, r_name AS slug FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def resolved_aliases(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    registry = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("slug")).agg(F.collect_set("n_name").alias("aliases"))
    names = n.select(F.col("n_name").alias("name")).union(registry.select("slug"))
    return audit.resolve_aliases(names, registry)


@query("""SELECT s_suppkey AS item, s_acctbal AS value, CASE WHEN s_acctbal > 8000 THEN 'fail' WHEN s_acctbal > 5000 THEN 'warn' ELSE 'ok' END AS state FROM supplier""")
def threshold_bands(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    values = s.select(F.col("s_suppkey").alias("item"), F.col("s_acctbal").alias("value"))
    return audit.banded(values, s.select(F.col("s_suppkey").alias("item"), F.lit(5000.0).alias("warn"), F.lit(8000.0).alias("fail")))


_RECALL = "SELECT source AS arm, lang AS rep, sum(quality)::BIGINT AS recall FROM documents JOIN labels USING (doc_id) GROUP BY ALL"


@query(f"SELECT arm, round(avg(recall), 6) AS mean_recall, min(recall) AS min_recall, max(recall) AS max_recall, count(*) AS reps, avg(recall) >= 0.3 * 13 AS above_floor FROM ({_RECALL}) GROUP BY arm")
def recall_by_arm(spark, sf_dir):
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    scores = met.groupBy(F.col("source").alias("arm"), F.col("lang").alias("rep")).agg(F.sum("quality").alias("recall"))
    return audit.recall_by_arm(scores, 13).withColumn("mean_recall", F.round("mean_recall", 6))


@query("""SELECT conv_id AS arm, count(*) FILTER (WHERE role = 'user')::BIGINT AS recall, count(*) = 13 AS complete, count(*) FILTER (WHERE role = 'user') <> max(turn) AS mismatch FROM conversations GROUP BY conv_id""")
def recomputed_recall(spark, sf_dir):
    items = F.collect_list(F.struct(F.col("turn").cast("string").alias("item_id"), (F.col("role") == "user").alias("found")))
    judged = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("arm")).agg(items.alias("key_items"), F.max("turn").alias("recall_count")).withColumn("rep", F.lit(1))
    return audit.recall(judged, 13).drop("rep")


@query("SELECT coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS n FROM labels GROUP BY CUBE (labels.quality, labels.toxic)")
def label_crosstab(spark, sf_dir):
    by = table(spark, sf_dir, "labels").cube("quality", "toxic").agg(F.count("*").alias("n"))
    return by.select(F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), "n")


@query("""WITH once AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL), u AS (SELECT e.user_id, e.event_type, e.ts, max(event_id) AS event_id FROM events e JOIN once USING (user_id, event_type, ts) GROUP BY ALL)
SELECT user_id AS agent, arg_max(event_id, ts)::BIGINT * 3 AS context_tokens, arg_max(event_id, ts)::BIGINT AS output_tokens FROM u GROUP BY user_id""")
def token_accounting(spark, sf_dir):
    i = F.col("event_id")
    turns = table(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), F.col("event_type").alias("request_id"), "ts", i.alias("input_tokens"), i.alias("cache_creation_tokens"), i.alias("cache_read_tokens"), i.alias("output_tokens"))
    return audit.token_totals(turns)


@query("SELECT user_id AS agent, round(epoch(max(ts)) - epoch(min(ts)), 3) AS wall_seconds FROM events GROUP BY user_id")
def agent_wall_seconds(spark, sf_dir):
    return audit.wall_seconds(table(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), "ts")).withColumn("wall_seconds", F.round("wall_seconds", 3))


def _calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ok = F.col("event_id") % 7 != 0
    return e.select(F.col("user_id").cast("string").alias("relpath"), F.when(ok, "ok").otherwise("deferred").alias("status"), F.when(ok, F.col("event_type") == "purchase").alias("flagged"), F.col("value").alias("elapsed_seconds"), (F.col("event_id") % 1000).alias("chunk_bytes"))


@query("""SELECT count(*) AS dispatched, count(*) FILTER (WHERE event_id % 7 <> 0) AS ok, count(*) FILTER (WHERE event_id % 7 = 0) AS deferred,
  count(*) FILTER (WHERE event_id % 7 <> 0 AND event_type = 'purchase') AS chunks_flagged,
  round(count(*) FILTER (WHERE event_id % 7 <> 0 AND event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_id % 7 <> 0), 0), 6) AS fraction,
  round(median(value) FILTER (WHERE event_id % 7 <> 0), 6) AS ok_median, max(value) AS all_max, sum(event_id % 1000)::BIGINT AS total_bytes_dispatched FROM events""")
def call_metrics(spark, sf_dir):
    m = classify.call_metrics(_calls(spark, sf_dir))
    return m.select("dispatched", "ok", "deferred", "chunks_flagged", F.round("fraction", 6).alias("fraction"), F.round("ok_median", 6).alias("ok_median"), "all_max", "total_bytes_dispatched")


@query("""SELECT user_id::VARCHAR AS relpath, count(*) AS chunks, coalesce(bool_or(event_type = 'purchase') FILTER (WHERE event_id % 7 <> 0), false) AS file_flagged,
  count(*) FILTER (WHERE event_id % 7 = 0) AS deferred_chunks FROM events GROUP BY user_id""")
def file_verdicts(spark, sf_dir):
    return classify.file_verdicts(_calls(spark, sf_dir))


@query("SELECT relpath FROM (SELECT source || '/' || doc_id AS relpath FROM documents) ORDER BY sha256('0:' || relpath), relpath LIMIT 10")
def seeded_sample(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relpath"))
    return classify.seeded_sample(paths, 10, seed=0)


@query("""SELECT count(*) FILTER (WHERE k = 'jsonl') AS jsonl, count(*) FILTER (WHERE k = 'txt') AS txt, count(*) FILTER (WHERE k = 'txt' AND e = 'OversizeTextError') AS oversize,
  count(*) FILTER (WHERE k = 'txt' AND e = 'PermissionError') AS os_error, count(*) FILTER (WHERE k = 'txt' AND e IS NOT NULL) > 3 OR count(*) FILTER (WHERE k = 'jsonl' AND e IS NOT NULL) > 0 AS failed
FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'jsonl' ELSE 'txt' END AS k, CASE WHEN doc_id % 3 <> 0 AND n_chars > 20000 THEN 'OversizeTextError' WHEN doc_id % 3 <> 0 AND n_chars < 10 THEN 'PermissionError' END AS e FROM documents)""")
def run_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    txt = F.col("doc_id") % 3 != 0
    error = F.when(txt & (F.col("n_chars") > 20000), "OversizeTextError: too long").when(txt & (F.col("n_chars") < 10), "PermissionError: no")
    rows = d.select(F.col("doc_id").cast("string").alias("relpath"), F.when(txt, ".txt").otherwise(".jsonl").alias("suffix"), error.alias("error"), F.lit(False).alias("collapsed"))
    s = mirror.summarize(rows, rows.select("relpath"))
    return s.select(F.col("files_in_snapshot_jsonl").alias("jsonl"), F.col("files_in_snapshot_txt").alias("txt"), F.col("files_skipped_oversize").alias("oversize"), F.col("files_skipped_os_error_txt").alias("os_error"), "failed")


@query("SELECT doc_id::VARCHAR AS relpath FROM documents SEMI JOIN labels USING (doc_id)")
def unchanged_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    snap = lambda x: x.select(F.col("doc_id").cast("string").alias("relpath"), F.lit(0).alias("mtime_ns"), F.col("doc_id").alias("size"))
    return mirror.unchanged_files(snap(d), snap(table(spark, sf_dir, "labels").select("doc_id").distinct()))


@query("SELECT doc_id::VARCHAR AS relpath FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_files(spark, sf_dir):
    name = F.col("doc_id").cast("string").alias("relpath")
    return mirror.stale_files(table(spark, sf_dir, "documents").select(name), table(spark, sf_dir, "labels").select(name))


@query("SELECT doc_id::VARCHAR AS relpath FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0")
def published_mismatches(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ours = d.select(F.col("doc_id").cast("string").alias("relpath"), F.col("text").alias("content"))
    theirs = d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.concat(F.lit("projects/"), "doc_id").alias("relpath"), F.when(F.col("quality") == 1, F.col("text")).otherwise(F.lit("changed")).alias("content"))
    return mirror.hash_mismatches(ours, theirs)


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT regexp_matches(event_type, 'view|scroll') GROUP BY event_type")
def noise_filtered(spark, sf_dir):
    return table(spark, sf_dir, "events").where(~F.col("event_type").rlike("view|scroll")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, ts::TIMESTAMP AS ts FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 500")
def retained_log(spark, sf_dir):
    from tidemark.sources.corpus import retain

    return retain(table(spark, sf_dir, "events"), 500, "event_id").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 5000 ORDER BY n_chars DESC, doc_id LIMIT 15")
def largest_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars > 5000").orderBy(F.desc("n_chars"), "doc_id").limit(15).select("doc_id", "n_chars")


@query("SELECT p_partkey, format('{} Book {} - {}', p_brand, p_size, p_name) AS title FROM part")
def series_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.series_title(F.col("p_brand"), F.col("p_size"), F.col("p_name")).alias("title"))


@query("SELECT event_id, TRY_CAST(regexp_extract(props, '\\{.*\\}') AS JSON) IS NOT NULL AS is_json FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("is_json"))


@query("""SELECT * FROM (SELECT o_orderkey, o_orderstatus, 'before' AS side FROM orders WHERE o_orderkey % 10 <> 0 EXCEPT ALL SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'X' ELSE o_orderstatus END, 'before' FROM orders)
UNION ALL SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'X' ELSE o_orderstatus END, 'after' FROM orders EXCEPT ALL SELECT o_orderkey, o_orderstatus, 'after' FROM orders WHERE o_orderkey % 10 <> 0)""")
def library_differences(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    after = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 101 == 0, "X").otherwise(F.col("o_orderstatus")))
    return audit.differences(o.where("o_orderkey % 10 <> 0"), after)


@query("SELECT event_type, count(*) AS n, sum(count(*)) OVER (ORDER BY count(*) DESC, event_type ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events GROUP BY event_type")
def running_totals(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))  # a few rows
    return by.select("event_type", "n", F.sum("n").over(W.orderBy(F.desc("n"), "event_type").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("running"))
