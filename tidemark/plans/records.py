"""Named queries over JSON lines: their leaves and the findings in them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.jsonwalk import KEEP_KEYS
from tidemark.operators import audit, chunking, classify, leaves, mirror
from tidemark.plans.catalog import query, table
from tidemark.plans.files import _DIGEST_STAYS, _N, _PLACE, _PLANTED_SQL, _planted, _quoted
from tidemark.sources import tree
from tidemark.sources.scratch import scratch_folder

_KEPT = "|".join(sorted(KEEP_KEYS))
_NARROW = r"^\$\.(message\.content\[[0-9]+\]\.text|content|summary|title)$"
#: Leaves of a table r(relpath, line_no, raw) in DuckDB.
_LEAVES = rf"""SELECT relpath, line_no, fullkey AS leaf_path, CASE WHEN regexp_matches(fullkey, '{_NARROW}') THEN 'narrow' ELSE 'broad' END AS profile, atom->>'$' AS value
FROM r, json_tree(raw) WHERE type = 'VARCHAR' AND NOT regexp_matches(fullkey, '\.({_KEPT})(\.|\[|$)')"""


@query(f"""WITH r AS (
  SELECT 'conversation/' || conv_id AS relpath, turn AS line_no, to_json({{'type': role, 'uuid': text, 'message': {{'role': role, 'content': [{{'kind': role, 'text': text}}]}},
    'summary': role, 'other': json_array([role, text], [{{'usage': {{'deep': [text]}}, 'content': [text]}}])}}) AS raw FROM conversations
  UNION ALL SELECT 'event', event_id, to_json({{'title': event_type, 'props': props::JSON, 'n': ['none', NULL], 'flat': event_type}}) FROM events
) {_LEAVES}""")
def json_leaves(spark, sf_dir):
    """The string leaves of conversations and events as JSON lines, with their paths and profiles."""
    c, e = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "events")
    block = F.array(F.struct(F.col("role").alias("kind"), "text"))
    deep = F.to_json(F.struct(F.struct(F.array("text").alias("deep")).alias("usage"), F.array("text").alias("content")))
    other = F.concat(F.lit("[["), F.to_json(F.array("role", "text")).substr(F.lit(2), F.lit(1 << 30)), F.lit(",["), deep, F.lit("]]"))
    head = F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("uuid"), F.struct("role", block.alias("content")).alias("message"), F.col("role").alias("summary")))
    talk = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"other":'), other, F.lit("}"))
    said = c.select(F.concat(F.lit("conversation/"), "conv_id").alias("relpath"), F.col("turn").alias("line_no"), talk.alias("raw"))
    happened = F.format_string('{"title":"%s","props":%s,"n":["none",null],"flat":"%s"}', "event_type", "props", "event_type")
    lines = said.unionByName(e.select(F.lit("event").alias("relpath"), F.col("event_id").alias("line_no"), happened.alias("raw")))
    return leaves.string_leaves(lines)


_RULES = " UNION ALL ".join(
    f"SELECT relpath, leaf_path, '{e}' AS entity_type, value, unnest(regexp_extract_all(value, '(?ims){p.replace('(?i)', '').replace(chr(39), chr(39) * 2)}')) AS m, {s}::DOUBLE AS score FROM leaves"
    for e, p, s in (*[x for x in rules.PATTERNS if x[0] not in rules.VALIDATED], rules.PERSONAL[0])
)


@query(f"""WITH leaves AS (
  SELECT c_custkey::VARCHAR AS relpath, '$.message.content[0].text' AS leaf_path, text || ' a' || c_custkey || '@host.org' AS value FROM {_PLANTED_SQL}
  UNION ALL SELECT c_custkey::VARCHAR, '$.result[1].note', text || ' a' || c_custkey || '@host.org' FROM {_PLANTED_SQL}
) SELECT relpath, leaf_path, entity_type, (strpos(value, m) - 1)::INTEGER AS "start", (strpos(value, m) - 1 + length(m))::INTEGER AS "end", max(score) AS score
FROM ({_RULES}) WHERE entity_type <> 'EMAIL_ADDRESS' OR leaf_path <> '$.result[1].note' GROUP BY ALL""")
def json_findings(spark, sf_dir):
    """A secret and an address in a message's text, in a tool's result (where addresses stay) and under a kept key, with their places."""
    note = F.to_json(F.struct(F.concat("text", F.lit(" a"), "c_custkey", F.lit("@host.org")).alias("note")))
    text = F.regexp_replace(note, '^.{7}', '{"text"')
    raw = F.concat(F.lit('{"message":{"content":['), text, F.lit(']},"usage":'), note, F.lit(',"result":["none",'), note, F.lit("]}"))
    lines = _planted(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("relpath"), F.lit(0).cast("long").alias("line_no"), raw.alias("raw"))
    return leaves.leaf_findings(leaves.string_leaves(lines)).drop("line_no")


@query("""WITH RECURSIVE t AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, strlen(text) AS b FROM documents WHERE strlen(text) BETWEEN 1 AND 20000
), r AS (
  SELECT source, k, 0 AS chunk_no, b AS size FROM t WHERE k = 1
  UNION ALL SELECT t.source, t.k, CASE WHEN r.size + 1 + t.b > 20000 THEN r.chunk_no + 1 ELSE r.chunk_no END, CASE WHEN r.size + 1 + t.b > 20000 THEN t.b ELSE r.size + 1 + t.b END
  FROM r JOIN t ON t.source = r.source AND t.k = r.k + 1
) SELECT source AS relpath, chunk_no::INTEGER AS chunk_no, false AS oversize, count(*) AS lines, max(size)::BIGINT AS chunk_bytes FROM r GROUP BY ALL
UNION ALL SELECT source, -1, true, count(*), sum(strlen(text))::BIGINT FROM documents WHERE strlen(text) > 20000 GROUP BY source""")
def chunked_sources(spark, sf_dir):
    """The documents of a source as the lines of one file, a third of all lines in one; longer ones are told apart."""
    docs = table(spark, sf_dir, "documents").where("source is not null and octet_length(text) > 0")
    lines = docs.select(F.col("source").alias("relpath"), F.col("doc_id").alias("line_no"), F.col("text").cast("binary").alias("line"))
    chunks = chunking.chunk_files(lines, 20_000).select("relpath", "chunk_no", "oversize", F.size("lines").alias("n"), "chunk_bytes")
    return chunks.groupBy("relpath", "chunk_no", "oversize").agg(F.sum("n").alias("lines"), F.sum("chunk_bytes").alias("chunk_bytes"))


@query("""WITH RECURSIVE l AS (SELECT 'c' || conv_id AS relpath, turn AS line_no, text, strlen(text) AS b FROM conversations WHERE trim(text, ' ') <> '' AND NOT contains(text, chr(10))),
new AS (SELECT * FROM l WHERE text NOT IN (SELECT text FROM l WHERE line_no = 5)),
sent AS (SELECT relpath, b, row_number() OVER (PARTITION BY relpath ORDER BY line_no) AS k FROM new JOIN (SELECT text, min(relpath) AS f FROM new GROUP BY text) USING (text) WHERE f = relpath AND b <= 600),
r AS (
  SELECT relpath, k, 1 AS chunks, b AS size FROM sent WHERE k = 1
  UNION ALL SELECT sent.relpath, sent.k, CASE WHEN r.size + 1 + sent.b > 600 THEN r.chunks + 1 ELSE r.chunks END, CASE WHEN r.size + 1 + sent.b > 600 THEN sent.b ELSE r.size + 1 + sent.b END
  FROM r JOIN sent ON sent.relpath = r.relpath AND sent.k = r.k + 1
)
SELECT l.relpath, count(*) AS total_lines, coalesce(any_value(s.n), 0) + coalesce(any_value(o.n), 0) AS cache_miss_lines, count(*) - coalesce(any_value(s.n), 0) - coalesce(any_value(o.n), 0) AS cache_hit_lines,
  coalesce(any_value(s.chunks), 0)::BIGINT AS chunks, coalesce(any_value(o.n), 0) AS oversized_lines, false AS file_flagged, 0::BIGINT AS deferred_chunks
FROM l LEFT JOIN (SELECT relpath, count(*) AS n, max(chunks) AS chunks FROM r GROUP BY relpath) s USING (relpath)
LEFT JOIN (SELECT relpath, count(*) AS n FROM new WHERE b > 600 GROUP BY relpath) o USING (relpath) GROUP BY l.relpath""")
def classified_files(spark, sf_dir):
    """Conversations as files: lines known from the fifth turns are not sent, others once, in the first file that has them."""
    turns = table(spark, sf_dir, "conversations").where("trim(text) <> '' and not contains(text, '\n')")
    lines = turns.select(F.concat(F.lit("c"), "conv_id").alias("relpath"), F.col("turn").alias("line_no"), F.col("text").cast("binary").alias("line"))
    cached = lines.where("line_no = 5").select(F.sha2("line", 256).alias("line_hash"))
    return classify.classify_lines(lines, cached, most=600).files


#: Bytes of disk that a part of the tree of notes takes with its mirror, about.
_PART_BYTES = 3_000_000_000
_MASKED = " ".join(f"WHEN {i} THEN {_quoted(p)}" + (" || md5(c_custkey::VARCHAR)" if i in _DIGEST_STAYS else "") for i, p in enumerate(_PLACE))


@query(f"""SELECT 'd' || c_custkey % 7 || '/' || c_custkey || '.txt' AS relpath, CASE WHEN c_custkey % 500 = 0 THEN 'OversizeTextError' ELSE 'none' END AS error,
  CASE WHEN c_custkey % 500 <> 0 THEN strlen('note ' || CASE c_custkey % {_N} {_MASKED} END || ' end') ELSE -1 END::BIGINT AS size,
  CASE WHEN c_custkey % 500 <> 0 THEN sha256('note ' || CASE c_custkey % {_N} {_MASKED} END || ' end') ELSE 'none' END AS hash FROM customer""")
def mirrored_files(spark, sf_dir):
    """A tree of notes, written, listed and mirrored; every five-hundredth is over the size limit. The mirror is listed and read again.

    The tree is made in parts of about ``_PART_BYTES``, each deleted with its mirror before the next, so the disk holds one of them."""
    large, block = F.col("c_custkey") % 500 == 0, 4096
    notes = _planted(spark, sf_dir)
    total = notes.agg(F.sum(F.when(large, mirror.MOST_TEXT_BYTES + block).otherwise(2 * block))).first()[0] or 0
    parts = max(1, -(-total // _PART_BYTES))
    name = F.concat(F.lit("d"), F.col("c_custkey") % 7, F.lit("/"), "c_custkey", F.lit(".txt"))
    text = F.when(large, F.rpad("text", mirror.MOST_TEXT_BYTES + 1, " ")).otherwise(F.col("text"))
    table_of_all = scratch_folder(spark, "mirrored")
    for part in range(parts):
        root = scratch_folder(spark, "tree").removeprefix("file://")
        mine = notes.where(F.pmod(F.xxhash64("c_custkey"), F.lit(parts)) == part).repartition(max(1, -(-total // parts // tree.TASK_BYTES)))
        tree.write_tree(mine.select(name.alias("relpath"), text.cast("binary").alias("output")), f"{root}/source")
        results, _, _ = mirror.build_mirror(spark, f"{root}/source", f"{root}/mirror")
        there = tree.read_files(tree.list_tree(spark, f"{root}/mirror"), f"{root}/mirror").select("relpath", "size", F.sha2("content", 256).alias("hash"))
        met = results.select("relpath", F.coalesce(F.split("error", ":")[0], F.lit("none")).alias("error")).join(there, "relpath", "left").fillna({"size": -1, "hash": "none"})
        met.write.mode("append").parquet(table_of_all)
        for side in ("source", "mirror"):
            tree.delete_files(tree.list_tree(spark, f"{root}/{side}", None), f"{root}/{side}")
    return spark.read.schema(met.schema).parquet(table_of_all)


@query("""SELECT c_custkey, s_suppkey, CASE WHEN c_acctbal > s_acctbal THEN 'fail' ELSE 'warn' END AS state
FROM customer JOIN supplier ON s_nationkey = c_nationkey AND c_acctbal BETWEEN s_acctbal - 1000 * (s_suppkey % 4) AND s_acctbal + 500""")
def overlapping_bands(spark, sf_dir):
    """Customers' balances in all the bands of their nation's suppliers; bands differ in length and overlap."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    values = c.select("c_custkey", F.col("c_nationkey").alias("item"), F.col("c_acctbal").alias("at"))
    bands = s.select("s_suppkey", F.col("s_nationkey").alias("item"), "s_acctbal", (F.col("s_acctbal") - 1000 * (F.col("s_suppkey") % 4)).alias("low"), (F.col("s_acctbal") + 500).alias("high"))
    met = audit.containing(values, bands, ["item"])
    return met.select("c_custkey", "s_suppkey", F.when(F.col("at") > F.col("s_acctbal"), "fail").otherwise("warn").alias("state"))


@query("""WITH r AS (SELECT c_custkey AS k, c_acctbal AS lo, c_acctbal + 3 * (c_custkey % 5) AS hi FROM customer)
SELECT x.k AS a, y.k AS b FROM r x JOIN r y ON x.k < y.k AND x.lo <= y.hi AND y.lo <= x.hi""")
def overlapping_ranges(spark, sf_dir):
    """The pairs of customers whose ranges overlap, every fifth range being a point."""
    r = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 3 * (F.col("c_custkey") % 5)).alias("hi"))
    return audit.overlapping_pairs(r, "c_custkey", "lo", "hi")
