"""Queries over the record table: filters, pages, duplicates, maintenance, exports, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordworks.operators import keyed, quality, query, records, sinks
from recordworks.plans import reports
from recordworks.templates import Field, template

from . import tables as T

COLUMNS = ["doc_id", "lang", "n_chars", "text"]


def record_page(spark, sf):
    return query.query(T.records(spark, sf), columns=COLUMNS, fields=["doc_id", "lang", "n_chars"], order_by="n_chars", limit=200, offset=10,
                       filters={"n_chars": {"gte": 200, "lt": 9000}, "lang": {"in": ["en", "fr"]}, "text": {"contains": "The"}}).rows


def record_page_distinct(spark, sf):
    return query.query(T.records(spark, sf), columns=COLUMNS, fields=["doc_id", "lang"], order_by="last_seen", desc=False, limit=None,
                       filters={"lang": {"ne": "de"}, "n_chars": {"gt": 50}}, distinct=True).rows


def record_total(spark, sf):
    return query.query(T.records(spark, sf), columns=COLUMNS, filters={"lang": "en"}, source="src3", distinct=True).total


def typed_filters(spark, sf):
    orders = T.table(spark, sf, "orders")
    where = query.conditions(orders, {"o_totalprice": {"gt": 100000, "lte": 300000}, "o_orderstatus": {"ne": "F"},
                                      "o_orderpriority": {"contains": "NOT", "exists": True}, "o_custkey": {"in": list(range(0, 900))}},
                             orders.columns)
    for condition in where:
        orders = orders.filter(condition)
    return orders.select("o_orderkey", "o_totalprice", "o_orderpriority")


def field_exists(spark, sf):
    sources = T.registry(spark, sf)
    return sources.filter(query.predicate("status", "exists", False)).select("source", "lane")


def output_columns(spark, sf):
    shape = template("generic").with_fields({"sku": "string"}).output_columns()
    parts = T.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("source_id"), F.col("p_name").alias("title"),
                                              F.col("p_retailprice").alias("price"), F.col("p_brand").alias("sku"))
    return parts.select(*[c for c in shape if c in parts.columns])


def latest_runs(spark, sf):
    return query.list_latest(T.runs(spark, sf), [F.col("started_at").desc(), F.col("run_id").desc()], status="ok").select("run_id", "source")


def registry_by_status(spark, sf):
    return query.list_latest(T.registry(spark, sf), [F.col("source")], status="enabled", enabled=True).select("source", "site")


def distinct_latest(spark, sf):
    return keyed.distinct_latest(T.records(spark, sf)).select("uid", "source", "fingerprint", "last_seen")


def cross_source_duplicates(spark, sf):
    return quality.cross_source_duplicates(T.records(spark, sf))


def status_counts(spark, sf):
    registry = T.registry(spark, sf)
    return quality.status_counts(registry, "status", "?").select(F.col("status").alias("label"), "n").unionByName(
        quality.status_counts(registry, "lane", "undetected").select(F.col("lane").alias("label"), "n"))


def project_status(spark, sf):
    rejected = T.table(spark, sf, "labels").filter("quality = 0")
    return reports.project_status(T.registry(spark, sf), T.records(spark, sf), rejected)


def csv_cells(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, ["=", "", "-", "@"])), (F.col("doc_id") % 4 + 1).cast("int")),
                                                                     F.col("text")).alias("cell"), (-F.col("n_chars")).alias("n"),
                                                  F.array("lang", "source").alias("nested"))
    return sinks.csv_cells(docs)


def column_kinds(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", (F.col("o_custkey") % 2 == 0).alias("even"),
                                                 F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct("o_custkey"))).otherwise("x").alias("mixed"))
    return sinks.infer_kinds(orders.select(F.parse_json(F.to_json(F.struct("*"))).alias("v")),
                             ["o_orderkey", "o_totalprice", "o_orderpriority", "even", "mixed"])


def upsert(spark, sf):
    target = T.records(spark, sf).select("project", "uid", "source", "lang", "first_seen", "last_seen", "run_id")
    labels = T.table(spark, sf, "labels")
    changed = labels.select(F.lit("p").alias("project"), (F.col("doc_id") * 3).cast("string").alias("uid"), F.lit("src_new").alias("source"),
                            F.concat(F.lit("q"), F.col("quality")).alias("lang"), F.lit("r9").alias("run_id"), F.col("quality").alias("seq"))
    again = changed.withColumns({"lang": F.concat(F.col("lang"), F.lit("+")), "seq": F.lit(5)})
    return records.upsert(target, changed.unionByName(again), F.lit("2024-03-01 00:00:00"))


UPSERT_SQL = f"""
WITH old AS (SELECT project, uid, source, lang, first_seen, last_seen, run_id FROM {T.RECORDS_SQL}),
new AS (SELECT 'p' AS project, CAST(doc_id * 3 AS VARCHAR) AS uid, 'src_new' AS source, 'q' || quality || '+' AS lang FROM labels)
SELECT COALESCE(new.project, old.project) AS project, COALESCE(new.uid, old.uid) AS uid, COALESCE(new.source, old.source) AS source,
  COALESCE(new.lang, old.lang) AS lang, COALESCE(old.first_seen, '2024-03-01 00:00:00') AS first_seen,
  CASE WHEN new.uid IS NULL THEN old.last_seen ELSE '2024-03-01 00:00:00' END AS last_seen,
  CASE WHEN new.uid IS NULL THEN old.run_id ELSE 'r9' END AS run_id
FROM old FULL OUTER JOIN new ON old.uid = new.uid"""


def _finished(spark, sf):
    return T.records(spark, sf).select("source").distinct().select(
        "source", F.lit("r1").alias("run_id"), F.lit("2024-01-01 08:00:00").alias("started_at"),
        (F.length("source") == 4).alias("complete"), F.lit(20).cast("bigint").alias("stored"),
        F.when(F.col("source") == "src7", 100).when(F.col("source") == "src15", 34).cast("bigint").alias("baseline"))


FINISHED_SQL = f"""(SELECT source, 'r1' AS run_id, TIMESTAMP '2024-01-01 08:00:00' AS started_at, length(source) = 4 AS complete,
  20 AS stored, CASE source WHEN 'src7' THEN 100 WHEN 'src15' THEN 34 END AS baseline FROM (SELECT DISTINCT source FROM documents))"""
_JUDGED_SQL = f"""
WITH rec AS (SELECT *, CAST(last_seen AS TIMESTAMP) AS seen FROM {T.RECORDS_SQL}), fin AS (SELECT * FROM {FINISHED_SQL}),
base AS (SELECT fin.source, complete, stored, started_at, COALESCE(baseline, others) AS b FROM fin JOIN
  (SELECT source, count(*) FILTER (run_id <> 'r1') AS others FROM rec GROUP BY source) o USING (source)),
verdict AS (SELECT *, complete AND stored > 0 AND stored >= 0.6 * b AS rep FROM base),
judged AS (SELECT rec.*, rep, b, stored AS st, CASE WHEN rep THEN rec.run_id <> 'r1' AND seen < started_at
  ELSE seen < TIMESTAMP '2024-01-01 04:00:00' END AS gone FROM rec JOIN verdict USING (source))"""


def finalize(spark, sf):
    return records.finalize(T.records(spark, sf), _finished(spark, sf), F.lit("2024-01-02 04:00:00").cast("timestamp"), 1).records.select("uid", "source", "run_id")


def finalize_summary(spark, sf):
    return records.finalize(T.records(spark, sf), _finished(spark, sf), F.lit("2024-01-02 04:00:00").cast("timestamp"), 1).summary


def prune(spark, sf):
    return records.prune(T.records(spark, sf), F.lit("2024-01-01 05:00:00")).select("uid", "last_seen")


def _rejected(spark, sf, run, flag):
    return T.table(spark, sf, "documents").join(T.table(spark, sf, "labels").filter(F.col(flag) == 0), "doc_id").select(
        F.lit("p").alias("project"), "source", F.lit(run).alias("run_id"), F.array(F.lit("bad"), F.col("lang")).alias("reasons"), F.col("text").alias("raw"))


def quarantine(spark, sf):
    day = lambda d: F.lit(f"2024-02-{d} 00:00:00")
    first = records.quarantine_rows(_rejected(spark, sf, "r1", "quality"), day("01"))
    empty = first.filter(F.lit(False))
    once = records.upsert_quarantine(empty, first)
    both = records.upsert_quarantine(once, records.quarantine_rows(_rejected(spark, sf, "r2", "toxic"), day("02")))
    return both.select("qid", "run_id", "created_at", F.array_join("reasons", ",").alias("reasons"))


QUARANTINE_SQL = """
WITH rej AS (
  SELECT d.*, 'r1' AS run_id, '2024-02-01 00:00:00' AS created_at FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0
  UNION ALL
  SELECT d.*, 'r2' AS run_id, '2024-02-02 00:00:00' AS created_at FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 0),
keyed AS (SELECT 'q' || substr(sha256('p' || chr(31) || source || chr(31) || '["bad","' || lang || '"]' || chr(31) ||
    text), 1, 24) AS qid,
  run_id, created_at, 'bad,' || lang AS reasons FROM rej)
SELECT qid, max(run_id) AS run_id, max(created_at) AS created_at, any_value(reasons) AS reasons FROM keyed GROUP BY qid"""


def merge_counters(spark, sf):
    events = T.table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    rows = events.groupBy(day, "event_type").agg(F.count("*").alias("requests"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("bytes"))
    return records.merge_counters(rows, events.select(day, "event_type", F.lit(1).cast("bigint").alias("requests"), F.lit(100).cast("bigint").alias("bytes")),
                                  ["day", "event_type"], ["requests", "bytes"])


def retention(spark, sf):
    return records.retain(T.running(spark, sf), "started_at", F.lit("2024-01-15 00:00:00").cast("timestamp"), ["running"]).select("run_id", "status")


def union_sources(spark, sf):
    customers = T.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = T.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return records.union_sources(customers, suppliers)


def merge_evidence(spark, sf):
    proof = T.table(spark, sf, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("seq"),
                                                F.concat("event_type", F.lit("/"), F.floor("value")).alias("url"), F.col("props").alias("observation"))
    return records.merge_evidence(proof).select("site", F.array_join(F.transform("evidence", lambda e: e["url"]), "|").alias("urls"))


EVIDENCE_SQL = """
WITH one AS (SELECT user_id AS site, event_type || '/' || CAST(floor(value) AS BIGINT) AS url, min(event_id) AS seq FROM events GROUP BY ALL),
tail AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY seq DESC) AS n FROM one)
SELECT site, string_agg(url, '|' ORDER BY seq) AS urls FROM tail GROUP BY site"""


def _checked(spark, sf):
    docs = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id")
    return docs.withColumn("reasons", quality.reasons([F.when(F.col("quality") == 0, "low quality"), F.when(F.col("toxic") == 1, "toxic"),
                                                       F.when(F.col("n_chars") > 5000, "too long")]))


_CHECKED_SQL = """(SELECT d.*, quality, toxic, list_filter([CASE WHEN quality = 0 THEN 'low quality' END, CASE WHEN toxic = 1 THEN 'toxic' END,
  CASE WHEN n_chars > 5000 THEN 'too long' END], lambda x: x IS NOT NULL) AS reasons FROM documents d JOIN labels l USING (doc_id))"""


def acceptance(spark, sf):
    return quality.acceptance(_checked(spark, sf))


def reason_histogram(spark, sf):
    return quality.reason_histogram(_checked(spark, sf))


def warning_histogram(spark, sf):
    warned = T.table(spark, sf, "events").withColumn("warnings", F.array(F.concat("event_type", F.lit(": could not parse "), "props"), F.lit("ts: old")))
    return quality.warning_histogram(warned)


def field_coverage(spark, sf):
    docs = T.table(spark, sf, "documents").select(F.when(F.col("lang") != "de", F.col("lang")).alias("lang"),
                                                  F.when(F.col("n_chars") > 500, F.lit("")).otherwise("x").alias("short"), "n_chars")
    return quality.field_coverage(docs, ["lang", "short", "n_chars"])


def split_by_rules(spark, sf):
    rules = {"poor": F.col("c_acctbal") < 0, "machines": F.col("c_mktsegment") == "MACHINERY"}
    good, bad = quality.split_by_rules(T.table(spark, sf, "customer"), rules)
    return bad.select("c_custkey", F.array_join("reasons", ",").alias("reasons")).unionByName(good.select("c_custkey", F.lit("").alias("reasons")))


def check_bounds(spark, sf):
    shape = template("generic").with_fields({"discount": Field("discount", "number", maximum=0.05), "quantity": Field(
        "quantity", "number", minimum=2, exclusive_minimum=True, maximum=40, conditional_bounds=((("flag", "R"), {"maximum": 10.0}),))})
    items = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
                                                  F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("price"))
    return items.select("l_orderkey", "l_linenumber", F.array_join(quality.reasons(quality.check_bounds(shape)), "; ").alias("reasons"))


BOUNDS_SQL = """
SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_extendedprice < 0 THEN 'x' END,
  CASE WHEN l_discount > 0.05 THEN 'discount=' || CAST(l_discount AS VARCHAR) || ' above the sanity bound 0.05' END,
  CASE WHEN l_quantity <= 2 THEN 'quantity=' || CAST(l_quantity AS VARCHAR) || ' below the sanity bound 2' END,
  CASE WHEN l_quantity > (CASE WHEN l_returnflag = 'R' THEN 10 ELSE 40 END) THEN 'quantity=' || CAST(l_quantity AS VARCHAR) ||
    ' above the sanity bound ' || (CASE WHEN l_returnflag = 'R' THEN '10' ELSE '40' END) END) AS reasons
FROM lineitem"""


def check_required(spark, sf):
    shape = template("products")
    parts = T.table(spark, sf, "part")
    rows = parts.select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_partkey").cast("string")).alias("source_id"), F.lit("u").alias("url"),
                        F.when(F.col("p_type") != "PROMO", F.col("p_name")).otherwise("").alias("title"),
                        F.when(F.col("p_size") != 7, F.col("p_retailprice")).alias("price"))
    return rows.select("p_partkey", F.array_join(quality.reasons(quality.check_required(shape)), "; ").alias("reasons"))


def check_expiry(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("starts_at"),
                                                 F.when(F.col("o_orderstatus") == "O", F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")).alias("ends_at"))
    reason = quality.check_expiry(template("events").expires, F.lit("1998-01-01 00:00:00").cast("timestamp"))
    return orders.select("o_orderkey", reason.alias("reason")).filter("reason IS NOT NULL")


def find_conflicts(spark, sf):
    words = F.element_at(F.array(*map(F.lit, ["for rent", "for sale", "flat for rent or for sale", "rent-to-own house", "nice"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    parts = T.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), words).alias("title"))
    return parts.select("p_partkey", F.array_join(quality.reasons(quality.find_conflicts(template("real_estate_sale").conflicts)), "; ").alias("reasons"))


QUERIES = {
    "record_page": (record_page, f"""SELECT doc_id, lang, n_chars, source, first_seen, last_seen, fingerprint FROM {T.RECORDS_SQL}
        WHERE n_chars >= 200 AND n_chars < 9000 AND lang IN ('en', 'fr') AND lower(text) LIKE '%the%'
        ORDER BY n_chars DESC NULLS LAST, uid LIMIT 200 OFFSET 10"""),
    "record_page_distinct": (record_page_distinct, f"""SELECT doc_id, lang, source, first_seen, last_seen, fingerprint FROM (
        SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY last_seen DESC, uid) AS n FROM {T.RECORDS_SQL})
        WHERE n = 1 AND lang <> 'de' AND n_chars > 50 ORDER BY last_seen, uid"""),
    "record_total": (record_total, f"""SELECT count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint
        ORDER BY last_seen DESC, uid) AS n FROM {T.RECORDS_SQL}) WHERE n = 1 AND lang = 'en' AND source = 'src3'"""),
    "typed_filters": (typed_filters, """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 100000
        AND o_totalprice <= 300000 AND o_orderstatus <> 'F' AND lower(o_orderpriority) LIKE '%not%' AND o_orderpriority IS NOT NULL
        AND o_custkey BETWEEN 0 AND 899"""),
    "field_exists": (field_exists, f"SELECT source, lane FROM {T.REGISTRY_SQL} WHERE status IS NULL"),
    "output_columns": (output_columns, """SELECT CAST(p_partkey AS VARCHAR) AS source_id, p_name AS title, p_retailprice AS price,
        p_brand AS sku FROM part"""),
    "latest_runs": (latest_runs, f"""SELECT run_id, source FROM {T.RUNS_SQL} WHERE status = 'ok'
        ORDER BY started_at DESC, run_id DESC"""),
    "registry_by_status": (registry_by_status, f"SELECT source, site FROM {T.REGISTRY_SQL} WHERE status = 'enabled' AND enabled ORDER BY source"),
    "distinct_latest": (distinct_latest, f"""SELECT uid, source, fingerprint, last_seen FROM (SELECT *, row_number() OVER
        (PARTITION BY fingerprint ORDER BY last_seen DESC, uid) AS n FROM {T.RECORDS_SQL}) WHERE n = 1"""),
    "cross_source_duplicates": (cross_source_duplicates, f"""SELECT fingerprint, count(*) AS rows FROM {T.RECORDS_SQL}
        GROUP BY fingerprint HAVING count(DISTINCT source) > 1"""),
    "status_counts": (status_counts, f"""SELECT COALESCE(status, '?') AS label, count(*) AS n FROM {T.REGISTRY_SQL} GROUP BY 1
        UNION ALL SELECT COALESCE(lane, 'undetected') AS label, count(*) AS n FROM {T.REGISTRY_SQL} GROUP BY 1"""),
    "project_status": (project_status, f"""
        WITH s AS (SELECT * FROM {T.REGISTRY_SQL}), r AS (SELECT * FROM {T.RECORDS_SQL})
        SELECT 'sources' AS metric, '' AS label, count(*) AS value FROM s
        UNION ALL SELECT 'by_status', COALESCE(status, '?'), count(*) FROM s GROUP BY 2
        UNION ALL SELECT 'by_lane', COALESCE(lane, 'undetected'), count(*) FROM s GROUP BY 2
        UNION ALL SELECT 'enabled', '', count(*) FROM s WHERE enabled
        UNION ALL SELECT 'records', '', count(*) FROM r
        UNION ALL SELECT 'records_by_source', source, count(*) FROM r GROUP BY 2
        UNION ALL SELECT 'cross_source_duplicates', '', count(*) FROM (SELECT fingerprint FROM r GROUP BY 1 HAVING count(DISTINCT source) > 1)
        UNION ALL SELECT 'quarantined', '', count(*) FROM labels WHERE quality = 0"""),
    "csv_cells": (csv_cells, """SELECT doc_id, CASE WHEN regexp_matches(c, '^[=+\\-@\\t\\r]') THEN '''' || c ELSE c END AS cell, n, nested FROM
        (SELECT doc_id, ['=', '', '-', '@'][CAST(doc_id % 4 + 1 AS INT)] || text AS c, -n_chars AS n,
         '["' || lang || '","' || source || '"]' AS nested FROM documents)"""),
    "column_kinds": (column_kinds, """SELECT 'o_orderkey' AS field, typeof(any_value(o_orderkey)) AS kind FROM orders
        UNION ALL SELECT 'o_totalprice', typeof(any_value(o_totalprice)) FROM orders
        UNION ALL SELECT 'o_orderpriority', CASE typeof(any_value(o_orderpriority)) WHEN 'VARCHAR' THEN 'STRING' END FROM orders
        UNION ALL SELECT 'even', typeof(any_value(o_custkey % 2 = 0)) FROM orders
        UNION ALL SELECT 'mixed', CASE WHEN count(*) > 0 THEN 'STRING' END FROM orders"""),
    "upsert": (upsert, UPSERT_SQL),
    "finalize": (finalize, _JUDGED_SQL + " SELECT uid, source, run_id FROM judged WHERE NOT gone"),
    "finalize_summary": (finalize_summary, _JUDGED_SQL + """ SELECT source, CASE WHEN any_value(rep) THEN 'replace' ELSE 'upsert' END AS write_mode,
        count(*) FILTER (gone) AS pruned, CAST(CASE WHEN any_value(rep) THEN any_value(st) ELSE NULLIF(any_value(b), 0) END AS BIGINT) AS baseline
        FROM judged GROUP BY source"""),
    "prune": (prune, f"SELECT uid, last_seen FROM {T.RECORDS_SQL} WHERE last_seen >= '2024-01-01 05:00:00'"),
    "quarantine": (quarantine, QUARANTINE_SQL),
    "merge_counters": (merge_counters, """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(2 * count(*) AS BIGINT) AS requests,
        CAST(sum(CAST(round(value * 100) AS BIGINT) + 100) AS BIGINT) AS bytes FROM events GROUP BY 1, 2"""),
    "retention": (retention, f"""SELECT run_id, status FROM {T.RUNNING_SQL} WHERE started_at >= TIMESTAMP '2024-01-15 00:00:00' OR status = 'running'"""),
    "union_sources": (union_sources, """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
        UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier"""),
    "merge_evidence": (merge_evidence, EVIDENCE_SQL),
    "acceptance": (acceptance, f"""SELECT count(*) AS rows, count(*) FILTER (len(reasons) = 0) AS valid,
        round(count(*) FILTER (len(reasons) = 0) / count(*), 3) AS valid_fraction,
        count(*) FILTER (len(reasons) = 0) / count(*) >= 0.8 AS ok FROM {_CHECKED_SQL}"""),
    "reason_histogram": (reason_histogram, f"SELECT reason, count(*) AS rows FROM (SELECT unnest(reasons) AS reason FROM {_CHECKED_SQL}) GROUP BY 1"),
    "warning_histogram": (warning_histogram, """SELECT event_type AS field, count(*) AS rows FROM events GROUP BY 1
        UNION ALL SELECT 'ts', count(*) FROM events"""),
    "field_coverage": (field_coverage, """SELECT 'lang' AS field, round(avg(CASE WHEN lang <> 'de' THEN 1.0 ELSE 0.0 END), 2) AS coverage FROM documents
        UNION ALL SELECT 'short', round(avg(CASE WHEN n_chars > 500 THEN 0.0 ELSE 1.0 END), 2) FROM documents
        UNION ALL SELECT 'n_chars', round(avg(CASE WHEN n_chars IS NULL THEN 0.0 ELSE 1.0 END), 2) FROM documents"""),
    "split_by_rules": (split_by_rules, """SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'poor' END,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machines' END) AS reasons FROM customer"""),
    "check_bounds": (check_bounds, BOUNDS_SQL),
    "check_required": (check_required, """SELECT p_partkey, concat_ws('; ', CASE WHEN p_size <= 5 THEN 'missing required field source_id' END,
        CASE WHEN p_type = 'PROMO' THEN 'missing required field title' END,
        CASE WHEN p_size = 7 THEN 'missing required field price' END) AS reasons FROM part"""),
    "check_expiry": (check_expiry, """SELECT o_orderkey, 'event already ended (' || d || ')' AS reason FROM (SELECT o_orderkey,
        strftime(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) + 30 ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS d FROM orders)
        WHERE d < '1997-12-31'"""),
    "find_conflicts": (find_conflicts, """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'rent listing in a sale category'
        WHEN 3 THEN 'rent-to-own listing in a sale category; rent listing in a sale category' ELSE '' END AS reasons FROM part"""),
}
