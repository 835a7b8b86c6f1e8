"""Named queries over logs and reports that are written and read again, guards of single files and retried calls, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions import redaction, rules
from tidemark.operators import audit, classify, mirror, state
from tidemark.plans.catalog import _FOUND, _found, query, table
from tidemark.plans.files import _PLANTED_SQL, _credential_sql, _file, _planted
from tidemark.sources import corpus, scratch


@query("SELECT user_id::VARCHAR AS line_hash, arg_max(CASE WHEN event_id % 3 = 0 THEN 'FLAGGED' ELSE 'CLEARED' END, event_id) AS verdict FROM events GROUP BY user_id")
def cache_log_verdicts(spark, sf_dir):
    """The verdict log written in order with blank lines, read again: the last entry of each line wins."""
    said = F.when(F.col("event_id") % 3 == 0, "FLAGGED").otherwise("CLEARED")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("line_hash"), said.alias("verdict")))
    blank = F.when(F.col("event_id") % 5 == 0, F.concat(line, F.lit("\n"))).otherwise(line)
    path = scratch.written_lines(table(spark, sf_dir, "events").orderBy("event_id").select(blank.alias("value")), "cache")
    return state.latest_verdicts(corpus.read_cache(spark, path))


@query("""SELECT user_id::VARCHAR AS content_hash, max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS at, 'unknown' AS operator, '' AS path_hint FROM events WHERE event_id % 2 = 0 GROUP BY user_id
UNION ALL SELECT 'o' || user_id, max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')), 'ann', 'a.txt' FROM events WHERE event_id % 2 = 1 GROUP BY user_id""")
def ledger_log_winners(spark, sf_dir):
    """The override log written and read again; half of the entries lack operator and path_hint."""
    odd = F.col("event_id") % 2 == 1
    entry = F.struct(
        F.lit(1).alias("v"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), F.concat(F.when(odd, "o").otherwise(""), "user_id").alias("content_hash"),
        F.lit("deny").alias("decision"), F.lit("r").alias("reason"), F.when(odd, "a.txt").alias("path_hint"), F.when(odd, "ann").alias("operator"),
    )
    path = scratch.written_lines(table(spark, sf_dir, "events").select(F.to_json(entry).alias("value")), "ledger")
    return state.current_decisions(corpus.read_ledger(spark, path)).select("content_hash", "at", "operator", "path_hint")


@query("SELECT n_name AS profile, n_regionkey::BIGINT AS region, n_nationkey::BIGINT AS key FROM nation")
def config_profiles(spark, sf_dir):
    """A configuration of nested JSON over several lines, one file, read again."""
    nations = table(spark, sf_dir, "nation")  # 25 rows
    one = F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region"), F.array("n_nationkey").alias("keys")).alias("settings"))
    whole = nations.agg(F.to_json(F.struct(F.collect_list(one).alias("profiles")), {"pretty": "true"}).alias("value"))
    config = corpus.read_config(spark, scratch.written_lines(whole, "config"))
    p = config.select(F.explode("profiles").alias("p"))
    return p.select(F.col("p.name").alias("profile"), F.col("p.settings.region").alias("region"), F.col("p.settings.keys")[0].alias("key"))


@query("""SELECT event_id::VARCHAR AS timestamp, CASE WHEN event_id % 4 <> 0 THEN value END AS disk_pct, event_id % 7 + 0.5::DOUBLE AS load1, NULL::DOUBLE AS dimm2_temp FROM events""")
def metric_rows(spark, sf_dir):
    """The metric log written and read again: "unknown" is null, and old rows lack the last column."""
    e = table(spark, sf_dir, "events")
    got = [F.when(F.col("event_id") % 4 != 0, F.col("value").cast("string")).otherwise("unknown").alias("disk_pct")]
    got += [F.lit("1").alias(c) for c in ("dimm1_temp", "zombies", "failed_units", "gpu_pm", "journal_size_mb", "cpu_tctl", "gpu_temp")]
    rows = e.select(F.col("event_id").cast("string").alias("timestamp"), *got, (F.col("event_id") % 7 + 0.5).alias("load1"))
    path = scratch.scratch_folder(spark, "metrics")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return corpus.read_metrics(spark, path).select("timestamp", "disk_pct", "load1", "dimm2_temp")


@query("SELECT event_type AS rule, 'a/' || user_id || '.txt' AS file, count(*) AS n FROM events GROUP BY ALL")
def findings_file(spark, sf_dir):
    """A scanner's report (an array of objects over several lines in each file) read again."""
    report = F.to_json(F.struct(F.col("event_type").alias("RuleID"), F.concat(F.lit("a/"), "user_id", F.lit(".txt")).alias("File")))
    e = table(spark, sf_dir, "events").select("event_type", F.expr("event_id div 10000").alias("part"), report.alias("j"))
    # at most ten thousand reports make an array
    parts = e.groupBy("event_type", "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    path = scratch.scratch_folder(spark, "findings")
    parts.select("value", F.concat_ws("-", "event_type", "part").alias("of")).write.partitionBy("of").text(path)
    found = corpus.read_findings(spark, path)
    return found.groupBy(F.col("RuleID").alias("rule"), F.col("File").alias("file")).agg(F.count("*").alias("n"))


_MOST = mirror.MOST_TEXT_BYTES


@query("""SELECT c_custkey::VARCHAR AS relpath, CASE c_custkey % 100 WHEN 1 THEN 'AnomalousRedactionSpanError' WHEN 2 THEN 'UnicodeDecodeError' ELSE 'none' END AS kind,
  CASE WHEN c_custkey % 100 NOT IN (1, 2) THEN c_custkey % 2 = 0 END AS collapsed, CASE WHEN c_custkey % 100 IN (1, 2) THEN -1 WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS mirror_lines FROM customer
UNION ALL SELECT 'oversize', 'OversizeTextError', NULL, -1""")
def text_guards(spark, sf_dir):
    """Text files against the guards: spans over 64 KiB, bytes that are not UTF-8, files over 8 MiB, merged lines."""
    key = F.col("c_custkey")
    block = lambda body: F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), body, F.lit("-----END RSA PRIVATE KEY-----\n"))
    long = block(F.repeat(F.lit("MIIEMIIEMIIE\n"), mirror.MOST_SPAN // 13 + 1))
    content = (
        F.when(key % 100 == 1, long.cast("binary")).when(key % 100 == 2, F.unhex(F.lit("41ff0a")))
        .when(key % 2 == 0, block(F.repeat(F.lit("MIIEMIIEMIIE\n"), 8)).cast("binary")).otherwise(F.lit("one\ntwo\n").cast("binary"))
    )
    files = table(spark, sf_dir, "customer").select(*_file(key, ".txt", content))
    big = spark.range(1).select(*_file(F.lit("oversize"), ".txt", F.repeat(F.lit("a"), _MOST + 1)))
    out = mirror.redact_files(files.union(big))
    return out.select("relpath", F.coalesce(F.split("error", ":")[0], F.lit("none")).alias("kind"), "collapsed", F.coalesce("mirror_lines", F.lit(-1)).cast("long").alias("mirror_lines"))


@query(f"SELECT c_custkey::VARCHAR AS relpath, entity_type, count(*) AS n FROM ({_credential_sql()}) WHERE c_custkey % 2 = 1 GROUP BY ALL")
def residue_of_mirror(spark, sf_dir):
    """A scan of a mirror in which every second file was left unmasked: only those have findings."""
    notes = redaction.with_redaction(_planted(spark, sf_dir), "text", "broad")
    content = F.when(F.col("c_custkey") % 2 == 1, F.col("text")).otherwise(F.col("redacted"))
    found = mirror.residue(notes.select(*_file(F.col("c_custkey"), ".txt", content)))
    return found.where(F.col("entity_type").isin(*rules.CREDENTIALS))


_EMAIL = rules.EMAIL.replace("'", "''")


@query(f"SELECT doc_id::VARCHAR AS relpath, n FROM (SELECT doc_id, len(regexp_extract_all(text, '(?ims){_EMAIL}'))::BIGINT AS n FROM documents) WHERE n > 0")
def dry_run_addresses(spark, sf_dir):
    """The dry run over damaged files (a byte that is not UTF-8 at the end): e-mail addresses of each file that has any."""
    content = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("20ff")))
    found = mirror.check_files(table(spark, sf_dir, "documents").select(*_file(F.col("doc_id"), ".txt", content)))
    return mirror.counts_by_file(found).where("entity_type = 'EMAIL_ADDRESS'").select("relpath", "n")


class FailingCaller:
    """Fails as often as its chunk says: a timeout, then malformed answers."""

    def __init__(self) -> None:
        self.calls: dict[bytes, int] = {}

    def run(self, chunk: bytes, timeout: float) -> bytes:
        n = self.calls[chunk] = self.calls.get(chunk, 0) + 1
        fails = int(chunk.split()[1])
        if n <= fails:
            if n == 1:
                raise TimeoutError
            return b"no verdict"
        return json.dumps({"flagged": fails == 1}).encode()


@query("""SELECT relpath, least(k + 1, 3)::INTEGER AS attempts, CASE WHEN k < 3 THEN 'ok' ELSE 'deferred' END AS status, CASE WHEN k < 3 THEN k = 1 END AS flagged,
  CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'timeout,ok' WHEN 2 THEN 'timeout,malformed,ok' ELSE 'timeout,malformed,malformed' END AS outcomes
FROM (SELECT event_id::VARCHAR AS relpath, event_id % 4 AS k FROM events)""")
def retried_calls(spark, sf_dir):
    """Calls that fail up to three times: attempts, their outcomes, and what is deferred."""
    line = F.concat_ws(" ", "event_id", F.col("event_id") % 4).cast("binary")
    e = table(spark, sf_dir, "events")
    chunks = e.select(F.col("event_id").cast("string").alias("relpath"), F.lit(0).alias("chunk_no"), F.array(line).alias("lines"), F.length(line).cast("long").alias("chunk_bytes"), F.lit(False).alias("oversize"))
    out = classify.dispatch(chunks, FailingCaller, sleep=lambda seconds: None)
    return out.select("relpath", "attempts", "status", "flagged", F.array_join("events.outcome", ",").alias("outcomes"))


@query("""SELECT event_id, ts::TIMESTAMP AS ts FROM events WHERE event_type = 'purchase' AND event_id % 8 <= 4 AND ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events)
AND regexp_matches(props, '[13579]') ORDER BY ts DESC, event_id DESC LIMIT 100""")
def selected_log(spark, sf_dir):
    """The newest hundred entries of a unit, from a day on, of a priority or more urgent, with an odd digit."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    start = e.select(F.min("ts") + F.expr("INTERVAL 1 DAY")).scalar()
    entries = e.select("ts", F.col("event_type").alias("unit"), (F.col("event_id") % 8).alias("priority"), F.col("props").alias("message"), F.col("event_id").alias("seq"))
    out = audit.select_log(entries, start, unit="purchase", priority=4, matching="[13579]", last=100)
    return out.select(F.col("seq").alias("event_id"), "ts")


@query("""SELECT source AS arm, round(avg(novel), 6) AS mean_genuine_novel, round(avg(spurious), 6) AS mean_spurious, count(*) AS reps
FROM (SELECT source, lang, sum(1 - quality) AS novel, sum(toxic) AS spurious, sum(quality) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY source""")
def novel_and_spurious_by_arm(spark, sf_dir):
    met = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("arm"), "lang")
    scores = met.agg(F.sum("quality").alias("recall"), F.sum(1 - F.col("quality")).alias("genuine_novel"), F.sum("toxic").alias("spurious"))
    out = audit.recall_by_arm(scores, 13)
    return out.select("arm", F.round("mean_genuine_novel", 6).alias("mean_genuine_novel"), F.round("mean_spurious", 6).alias("mean_spurious"), "reps")


_RULES = ", ".join(f"('{e}', {s})" for e, _, s in (*rules.PATTERNS, *rules.PERSONAL))


@query(f"""SELECT entity, count(*) AS patterns, max(score)::DOUBLE AS best, entity = 'ENV_ASSIGNMENT_SECRET' AS checked, any_value(coalesce(n, 0))::BIGINT AS detections, any_value(coalesce(d, 0))::BIGINT AS documents
FROM (VALUES {_RULES}) t(entity, score) LEFT JOIN (SELECT entity_type AS entity, count(*) AS n, count(DISTINCT doc_id) AS d FROM ({_FOUND}) GROUP BY ALL) USING (entity) GROUP BY entity""")
def rule_registry(spark, sf_dir):
    """The rules as built, by entity, with what they find in the documents."""
    made = spark.createDataFrame([(r.entity, r.score, r.accepts is not None) for r in rules.build_rules()], "entity string, score double, checked boolean")
    built = made.groupBy("entity").agg(F.count("*").alias("patterns"), F.max("score").alias("best"), F.bool_or("checked").alias("checked"))
    counts = _found(spark, sf_dir).groupBy(F.col("entity_type").alias("entity")).agg(F.count("*").alias("detections"), F.count_distinct("doc_id").alias("documents"))
    return built.join(counts, "entity", "left").fillna(0, ["detections", "documents"])
