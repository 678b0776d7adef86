"""Joins, matching and terminology over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import dictionary as dic, matching as mt, projects, reviews, scoring, terms as tm
from ..session import cut_lineage
from .registry import query, table
from .timeline import RUNS, captions, whole_micros


def truth_and_predictions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Runs as truth; the same runs moved by (length of text + start) mod 5 tenths of an hour."""
    runs = captions(spark, d).select("user_id", whole_micros("start_seconds").alias("s"), whole_micros("end_seconds").alias("e"))
    runs = cut_lineage(runs)  # read many times below
    move = (F.col("s") % 5) * 3600
    seconds = lambda c: F.col(c) / 1e6
    idx = F.col("s").alias("idx")
    truth = runs.select("user_id", idx, seconds("s").alias("start_seconds"), seconds("e").alias("end_seconds"))
    predicted = runs.select("user_id", idx, (seconds("s") + move).alias("start_seconds"), (seconds("e") + move).alias("end_seconds"))
    return truth, predicted


TRUTH = RUNS + """
, t AS (SELECT user_id, start_us AS idx, start_us / 1e6::DOUBLE AS s, end_us / 1e6::DOUBLE AS e FROM runs),
p AS (SELECT user_id, start_us AS idx, start_us / 1e6::DOUBLE + (start_us % 5) * 3600 AS s, end_us / 1e6::DOUBLE + (start_us % 5) * 3600 AS e FROM runs),
o AS (SELECT t.user_id, t.idx AS ti, p.idx AS pi, greatest(0.0, least(t.e, p.e) - greatest(t.s, p.s)) AS shared, t.s AS ts, t.e AS te, p.s AS ps, p.e AS pe
      FROM t JOIN p ON t.user_id = p.user_id AND t.s < p.e AND p.s < t.e),
c0 AS (SELECT *, shared / ((te - ts) + (pe - ps) - shared) AS iou FROM o WHERE shared / ((te - ts) + (pe - ps) - shared) >= 0.5)
"""


# Candidates of a user one after the other, best first: taken if neither side is.
GREEDY = TRUTH.replace("WITH", "WITH RECURSIVE", 1) + """
, cand AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY iou DESC, ti DESC, pi DESC) AS rn FROM c0),
walk(user_id, rn, ut, up, taken) AS (
  SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], []::BIGINT[], false FROM cand
  UNION ALL SELECT w.user_id, c.rn, CASE WHEN list_contains(ut, ti) OR list_contains(up, pi) THEN ut ELSE list_append(ut, ti) END,
    CASE WHEN list_contains(ut, ti) OR list_contains(up, pi) THEN up ELSE list_append(up, pi) END, NOT (list_contains(ut, ti) OR list_contains(up, pi))
  FROM walk w JOIN cand c ON c.user_id = w.user_id AND c.rn = w.rn + 1),
g AS (SELECT c.user_id, ti, pi, iou, ts, te, ps, pe FROM walk w JOIN cand c ON c.user_id = w.user_id AND c.rn = w.rn WHERE taken)
"""


@query("greedy_match", GREEDY + "SELECT user_id, ti AS t_idx, pi AS p_idx, round(iou, 6) AS iou FROM g")
def greedy_match(spark, d):
    truth, predicted = truth_and_predictions(spark, d)
    out = mt.greedy_match(truth, predicted, ["user_id"])
    return out.select("user_id", "t_idx", "p_idx", F.round("iou", 6).alias("iou"))


FRAGMENTS = """
, ot AS (SELECT user_id, count(*) - 1 AS x FROM o GROUP BY user_id, ti), op AS (SELECT user_id, count(*) - 1 AS x FROM o GROUP BY user_id, pi),
f AS (SELECT u.user_id, coalesce((SELECT sum(x) FROM ot WHERE ot.user_id = u.user_id), 0)::BIGINT AS over_n,
             coalesce((SELECT sum(x) FROM op WHERE op.user_id = u.user_id), 0)::BIGINT AS merged_n FROM (SELECT DISTINCT user_id FROM t) u)
"""


@query("fragmentation_counts", TRUTH + FRAGMENTS + """
SELECT user_id, over_n AS oversegmentation_extra_count, merged_n AS merged_truth_extra_count FROM f
""")
def fragmentation_counts(spark, d):
    truth, predicted = truth_and_predictions(spark, d)
    return mt.fragmentation(truth, predicted, ["user_id"], ["user_id"])


@query("interval_report", GREEDY + FRAGMENTS + """
, q AS (SELECT user_id, count(*) AS n, quantile_cont(abs(ts - ps), 0.5) AS sm, quantile_disc(abs(ts - ps), 0.95) AS sp,
        quantile_cont(abs(te - pe), 0.5) AS em, quantile_disc(abs(te - pe), 0.95) AS ep FROM g GROUP BY user_id),
k AS (SELECT user_id, count(*) AS n FROM t GROUP BY user_id)
SELECT k.user_id, k.n::BIGINT AS truth_count, k.n::BIGINT AS prediction_count, coalesce(q.n, 0)::BIGINT AS matched_count,
  round(coalesce(q.n, 0) / k.n::DOUBLE, 6) AS precision, round(coalesce(q.n, 0) / k.n::DOUBLE, 6) AS recall,
  over_n AS oversegmentation_extra_count, merged_n AS merged_truth_extra_count, round(sm, 3) AS start_median, round(sp, 3) AS start_p95,
  round(em, 3) AS end_median, round(ep, 3) AS end_p95
FROM k LEFT JOIN q ON k.user_id = q.user_id JOIN f ON f.user_id = k.user_id
""")
def interval_report(spark, d):
    truth, predicted = truth_and_predictions(spark, d)
    r = mt.interval_report(truth, predicted, ["user_id"], ["user_id"])
    return r.select(
        "user_id", "truth_count", "prediction_count", "matched_count", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
        "oversegmentation_extra_count", "merged_truth_extra_count",
        F.round("start_error_median_seconds", 3).alias("start_median"), F.round("start_error_p95_seconds", 3).alias("start_p95"),
        F.round("end_error_median_seconds", 3).alias("end_median"), F.round("end_error_p95_seconds", 3).alias("end_p95"),
    )


@query("interval_report_overall", GREEDY + FRAGMENTS + """
, n AS (SELECT count(*) AS n FROM t)
SELECT n::BIGINT AS truth_count, n::BIGINT AS prediction_count, (SELECT count(*) FROM g)::BIGINT AS matched_count,
  (SELECT sum(over_n) FROM f)::BIGINT AS oversegmentation_extra_count, (SELECT sum(merged_n) FROM f)::BIGINT AS merged_truth_extra_count,
  (SELECT round(quantile_cont(abs(ts - ps), 0.5), 3) FROM g) AS start_median, (SELECT round(quantile_disc(abs(te - pe), 0.95), 3) FROM g) AS end_p95 FROM n
""")
def interval_report_overall(spark, d):
    truth, predicted = truth_and_predictions(spark, d)
    r = mt.interval_report(truth, predicted, ["user_id"], [])
    return r.select(
        "truth_count", "prediction_count", "matched_count", "oversegmentation_extra_count", "merged_truth_extra_count",
        F.round("start_error_median_seconds", 3).alias("start_median"), F.round("end_error_p95_seconds", 3).alias("end_p95"),
    )


@query("partition_report", TRUTH.replace("WITH", "WITH RECURSIVE", 1) + """
, m AS (SELECT * FROM (VALUES ('image', 4), ('legacy', 2)) v(method, below)), b AS (SELECT * FROM (VALUES ('all'), ('primary')) v(block)),
tb AS (SELECT t.*, method, block FROM t JOIN m ON user_id % 4 < below JOIN b ON block = 'all' OR e - s + 1e-9 >= 7200),
pb AS (SELECT p.*, 'image' AS method, block FROM p, b UNION ALL
       SELECT user_id, idx, s + (idx % 3) * 3600, e + (idx % 3) * 3600, 'legacy', block FROM t, b WHERE user_id % 4 < 2),
x AS (SELECT tb.user_id, tb.method, tb.block, tb.idx AS ti, pb.idx AS pi, tb.s AS ts, tb.e AS te, pb.s AS ps, pb.e AS pe, least(tb.e, pb.e) - greatest(tb.s, pb.s) AS shared
      FROM tb JOIN pb ON tb.user_id = pb.user_id AND tb.method = pb.method AND tb.block = pb.block AND tb.s < pb.e AND pb.s < tb.e),
cand AS (SELECT *, row_number() OVER (PARTITION BY user_id, method, block ORDER BY shared / ((te - ts) + (pe - ps) - shared) DESC, ti DESC, pi DESC) AS rn
         FROM x WHERE shared / ((te - ts) + (pe - ps) - shared) >= 0.5),
walk(user_id, method, block, rn, ut, up, taken) AS (
  SELECT DISTINCT user_id, method, block, 0::BIGINT, []::BIGINT[], []::BIGINT[], false FROM cand
  UNION ALL SELECT w.user_id, w.method, w.block, c.rn, CASE WHEN list_contains(ut, ti) OR list_contains(up, pi) THEN ut ELSE list_append(ut, ti) END,
    CASE WHEN list_contains(ut, ti) OR list_contains(up, pi) THEN up ELSE list_append(up, pi) END, NOT (list_contains(ut, ti) OR list_contains(up, pi))
  FROM walk w JOIN cand c ON c.user_id = w.user_id AND c.method = w.method AND c.block = w.block AND c.rn = w.rn + 1),
g AS (SELECT c.* FROM walk w JOIN cand c ON c.user_id = w.user_id AND c.method = w.method AND c.block = w.block AND c.rn = w.rn WHERE taken),
cells AS (SELECT DISTINCT (user_id % 4)::BIGINT AS partition_id, method, block FROM pb),
nt AS (SELECT user_id % 4 AS u, method, block, count(*) AS n FROM tb GROUP BY ALL), np AS (SELECT user_id % 4 AS u, method, block, count(*) AS n FROM pb GROUP BY ALL),
ng AS (SELECT user_id % 4 AS u, method, block, count(*) AS n, quantile_cont(abs(ts - ps), 0.5) AS sm FROM g GROUP BY ALL),
ot AS (SELECT u, method, block, sum(n - 1) AS n FROM (SELECT user_id % 4 AS u, user_id, method, block, ti, count(*) AS n FROM x GROUP BY ALL) GROUP BY ALL)
SELECT c.partition_id, c.method, c.block, coalesce(nt.n, 0)::BIGINT AS truth_count, np.n::BIGINT AS prediction_count, coalesce(ng.n, 0)::BIGINT AS matched_count,
  round(coalesce(ng.n, 0) / np.n::DOUBLE, 6) AS precision, coalesce(ot.n, 0)::BIGINT AS oversegmentation_extra_count, round(sm, 3) AS start_median
FROM cells c JOIN np ON np.u = partition_id AND np.method = c.method AND np.block = c.block
LEFT JOIN nt ON nt.u = partition_id AND nt.method = c.method AND nt.block = c.block
LEFT JOIN ng ON ng.u = partition_id AND ng.method = c.method AND ng.block = c.block
LEFT JOIN ot ON ot.u = partition_id AND ot.method = c.method AND ot.block = c.block
""")
def partition_report(spark, d):
    """Users dealt to four partitions; one method has results everywhere, another in two partitions only."""
    truth, predicted = truth_and_predictions(spark, d)
    part = (F.col("user_id") % 4).cast("long").alias("partition_id")
    move = (F.col("idx") % 3) * 3600
    moved = {c: F.col(c) + move for c in ("start_seconds", "end_seconds")}
    claims = predicted.select("*", part, F.lit("image").alias("method")).unionByName(
        truth.withColumns(moved).select("*", part, F.lit("legacy").alias("method")).filter("partition_id < 2")
    )
    methods = claims.select("partition_id", "method").distinct()
    r = mt.partition_report(truth.select("*", part), claims, methods, ["user_id"], minimum=7200.0)
    return r.select(
        "partition_id", "method", "block", "truth_count", "prediction_count", "matched_count", F.round("precision", 6).alias("precision"),
        "oversegmentation_extra_count", F.round("start_error_median_seconds", 3).alias("start_median"),
    )


@query("primary_subset", RUNS + """
SELECT user_id, start_us, end_us FROM runs WHERE (end_us - start_us) / 1e6 + 1e-9 >= 1.2
""")
def primary_subset(spark, d):
    return mt.primary_subset(captions(spark, d)).select("user_id", whole_micros("start_seconds").alias("start_us"), whole_micros("end_seconds").alias("end_us"))


@query("runtime_defaults", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_orderkey END AS detected_interval_count,
  CASE WHEN o_orderstatus = 'O' THEN o_custkey ELSE 2 * (o_custkey + 1) END AS ocr_call_count, o_orderkey AS translation_call_count,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS error_count FROM orders
""")
def runtime_defaults(spark, d):
    o = F.col("o_orderstatus")
    errors = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("late")))
    made = table(spark, d, "orders").select("o_orderkey", F.struct(
        (F.col("o_custkey") + 1).alias("sample_count"), F.when(o == "F", F.col("o_custkey")).alias("detection_count"),
        F.col("o_orderkey").alias("subtitle_count"), F.when(o == "O", F.col("o_custkey")).alias("ocr_call_count"),
        F.lit(None).cast("long").alias("translation_call_count"), errors.alias("errors"),
    ).alias("processing"))
    out = mt.runtime_report(made, 2)
    return out.select("o_orderkey", "detected_interval_count", "ocr_call_count", "translation_call_count", F.col("error_count").cast("int").alias("error_count"))


# --- keyed joins ---------------------------------------------------------------------------


@query("strict_one_to_one", """
WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS top FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(o_orderkey, l_orderkey) AS key, CASE WHEN l_orderkey IS NULL THEN 'pair.absent' WHEN o_orderkey IS NULL THEN 'pair.extra'
  WHEN n <> top THEN 'mismatch' END AS problem, ends_with(o_orderpriority, 'HIGH') AS "primary"
FROM orders o FULL OUTER JOIN l ON o_orderkey = l_orderkey
""")
def strict_one_to_one(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("top"))
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    out = scoring.strict_pairs(left, lines.withColumnRenamed("l_orderkey", "key"), ["key"], F.col("n") == F.col("top"))
    return out.select("key", "problem", F.endswith("o_orderpriority", F.lit("HIGH")).alias("primary"))


@query("attach_labels", """
SELECT d.doc_id, d.source, l.quality, l.toxic, l.doc_id IS NOT NULL AS reviewed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def attach_labels(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("result_id"), "source")
    scoring = table(spark, d, "labels").withColumnRenamed("doc_id", "blind_id")
    mapping = scoring.select("blind_id", F.col("blind_id").alias("result_id"))
    out = reviews.attach_reviews(rows, mapping, scoring)
    return out.select(F.col("result_id").alias("doc_id"), "source", "review.quality", "review.toxic", F.col("review").isNotNull().alias("reviewed"))


@query("two_level_lookup", """
WITH e AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY ALL),
g AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < 2000 GROUP BY ALL)
SELECT c_custkey, CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN g.n IS NOT NULL THEN 'group' END AS matched, coalesce(e.n, g.n)::BIGINT AS n
FROM customer c LEFT JOIN e ON c.c_nationkey = e.c_nationkey AND c.c_mktsegment = e.c_mktsegment LEFT JOIN g ON c.c_nationkey = g.c_nationkey
""")
def two_level_lookup(spark, d):
    customers = table(spark, d, "customer")
    exact = customers.filter("c_acctbal > 5000").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    grouped = customers.filter("c_acctbal < 2000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    out = reviews.two_level_lookup(customers, exact, grouped, ["c_nationkey", "c_mktsegment"], ["c_nationkey"], ["n"])
    return out.select("c_custkey", "matched", F.col("found.n").alias("n"))


@query("pair_ids", """
SELECT coalesce(c_custkey, o_custkey) AS id, CASE WHEN c_custkey IS NULL THEN 'missing_ko' WHEN o_custkey IS NULL THEN 'missing_ja' END AS problem
FROM customer FULL OUTER JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey
""")
def pair_ids(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("ko").alias("locale"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("x").alias("name"), F.lit("ja").alias("locale")).distinct()
    return dic.pair_locales(left, right, ["id"]).select("id", "problem")


@query("version_diff", """
WITH a AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size > 3),
b AS (SELECT p_partkey AS id, CASE WHEN p_size > 45 THEN upper(p_name) ELSE p_name END AS name FROM part WHERE p_size < 48)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'renamed' END AS change,
  a.name AS before, b.name AS after FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.name IS DISTINCT FROM b.name
""")
def version_diff(spark, d):
    parts = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    before = parts.filter("p_size > 3").select("id", F.col("p_name").alias("name"))
    after = parts.filter("p_size < 48").select("id", F.when(F.col("p_size") > 45, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    out = dic.version_diff(before, after, "id", ["name"])
    return out.select("id", "change", F.col("before.name").alias("before"), F.col("after.name").alias("after"))


@query("ledger_mismatch", """
SELECT l.doc_id, 'missing_confirmed' AS problem FROM labels l WHERE quality = 1 AND l.doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)
UNION ALL SELECT l.doc_id, 'forbidden_active' FROM labels l WHERE quality = 0 AND l.doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 1000)
""")
def ledger_mismatch(spark, d):
    active = table(spark, d, "documents").filter("n_chars > 1000").select("doc_id")
    out = dic.ledger_mismatch(table(spark, d, "labels"), active, ["doc_id"], F.col("quality") == 1, F.col("quality") == 0)
    return out.select("doc_id", "problem")


@query("expand_jobs", """
SELECT o_orderkey, condition, CASE WHEN condition IN ('A', 'C') THEN o_orderpriority ELSE o_orderstatus END AS text, condition IN ('C', 'D') AS with_glossary
FROM orders, (VALUES ('A'), ('B'), ('C'), ('D')) v(condition) WHERE condition IN ('B', 'D') OR o_orderstatus = 'F'
""")
def expand_jobs(spark, d):
    records = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("primary"), F.col("o_orderpriority").alias("source_ko"), F.col("o_orderstatus").alias("ocr_ko")
    )
    return reviews.expand_jobs(records).select("o_orderkey", "condition", "text", "with_glossary")


@query("upsert_by_id", """
SELECT p.p_partkey, CASE WHEN l.k IS NULL THEN p_name ELSE 'replaced' END AS name, CASE WHEN l.k IS NULL THEN p_size ELSE 0 END AS size
FROM part p LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity = 50) l ON p.p_partkey = l.k
""")
def upsert_by_id(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    changed = table(spark, d, "lineitem").filter("l_quantity = 50").select(
        F.col("l_partkey").alias("p_partkey"), F.lit("replaced").alias("name"), F.lit(0).alias("size")
    ).distinct()
    return projects.upsert_by_id(rows, changed, ["p_partkey"])


@query("append_new", """
SELECT doc_id, 'scored' AS status FROM labels UNION ALL SELECT doc_id, 'unreviewed' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def append_new(spark, d):
    packet = table(spark, d, "documents").select("doc_id", F.lit("unreviewed").alias("status"))
    scoring = table(spark, d, "labels").select("doc_id", F.lit("scored").alias("status"))
    return reviews.append_new_reviews(packet, scoring, "doc_id")


@query("review_rows", """
SELECT n_nationkey, c_custkey, CASE WHEN n_nationkey < 5 THEN 'exact' ELSE 'group' END AS matched,
  CASE WHEN n_nationkey < 5 THEN n_name ELSE r_name END AS meaning
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_name <> 'NATION_7'
""")
def review_rows(spark, d):
    nations = table(spark, d, "nation")
    records = nations.select(F.col("n_nationkey").alias("sample_id"), F.col("n_regionkey").alias("group_id"), (F.col("n_name") != "NATION_7").alias("primary"))
    exact = nations.filter("n_nationkey < 5").select(F.col("n_nationkey").alias("sample_id"), F.col("n_name").alias("meaning"))
    grouped = table(spark, d, "region").select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("meaning"))
    outputs = table(spark, d, "customer").select(F.col("c_nationkey").alias("sample_id"), "c_custkey")
    out = reviews.review_rows(records, outputs, exact, grouped, ["meaning"])
    return out.select(F.col("sample_id").alias("n_nationkey"), "c_custkey", "matched", F.col("found.meaning").alias("meaning"))


# --- terminology ---------------------------------------------------------------------------


def documents(spark, d) -> DataFrame:
    return tm.normalized_texts(table(spark, d, "documents"), "doc_id", "text")


def benchmark_terms(spark, d) -> DataFrame:
    """Every word of the benchmark, and every two of its words that one blank parts."""
    items = table(spark, d, "benchmark").select(F.lower("text").alias("t"))
    words = items.select(F.split("t", r"[^\p{L}\p{N}]+").alias("w"), F.regexp_extract_all("t", F.lit(r"[^\p{L}\p{N}]+"), F.lit(0)).alias("s"))
    one = words.select(F.explode("w").alias("term"))
    places = words.filter("size(w) > 1").select("w", "s", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    pair = lambda k: F.element_at("w", F.col("i") + k)
    two = places.filter((F.element_at("s", F.col("i")) == " ") & (pair(0) != "") & (pair(1) != "")).select(F.concat_ws(" ", pair(0), pair(1)).alias("term"))
    return one.union(two).filter("term <> ''").distinct().select(F.col("term").alias("source_id"), "term")


WORDS = r"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM benchmark),
terms AS (SELECT term, replace(term, 'ß', 'ss') AS folded FROM w WHERE term <> ''),
docs AS (SELECT doc_id, lower(text) AS t FROM documents),
tok AS (SELECT doc_id, unnest(regexp_split_to_array(replace(t, 'ß', 'ss'), '[^\p{L}\p{N}]+')) AS word FROM docs)
"""


@query("term_match", WORDS + """
SELECT doc_id, term, count(*)::BIGINT AS hits FROM tok JOIN terms ON word = folded GROUP BY ALL
""")
def term_match(spark, d):
    terms = benchmark_terms(spark, d).filter(~F.col("term").contains(" "))
    found = tm.bounded_matches(documents(spark, d), tm.prepared_terms(terms))
    return found.groupBy(F.col("text_id").alias("doc_id"), F.col("source_id").alias("term")).agg(F.count(F.lit(1)).alias("hits"))


@query("phrase_match", r"""
WITH b AS (SELECT regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w, regexp_extract_all(lower(text), '[^\p{L}\p{N}]+') AS s FROM benchmark),
q AS (SELECT w, s, unnest(range(1, len(w))) AS i FROM b),
terms AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term, replace(w[i] || ' ' || w[i + 1], 'ß', 'ss') AS folded FROM q WHERE w[i] <> '' AND w[i + 1] <> '' AND s[i] = ' '),
docs AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w, regexp_extract_all(lower(text), '[^\p{L}\p{N}]+') AS s, regexp_matches(lower(text), '^[^\p{L}\p{N}]') AS lead FROM documents),
pos AS (SELECT doc_id, w, s, lead, unnest(range(1, len(w))) AS i FROM docs),
two AS (SELECT doc_id, replace(w[i] || ' ' || w[i + 1], 'ß', 'ss') AS phrase FROM pos WHERE w[i] <> '' AND w[i + 1] <> '' AND s[i] = ' ')
SELECT doc_id, term, count(*)::BIGINT AS hits FROM two JOIN terms ON phrase = folded GROUP BY ALL
""")
def phrase_match(spark, d):
    terms = benchmark_terms(spark, d).filter(F.col("term").contains(" "))
    found = tm.bounded_matches(documents(spark, d), tm.prepared_terms(terms))
    return found.groupBy(F.col("text_id").alias("doc_id"), F.col("source_id").alias("term")).agg(F.count(F.lit(1)).alias("hits"))


@query("item_match", r"""
WITH b AS (SELECT DISTINCT replace(lower(trim(text)), 'ß', 'ss') AS item FROM benchmark), d AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents)
SELECT doc_id, length(item)::BIGINT AS size, count(*)::BIGINT AS items FROM (
  SELECT doc_id, item, string_split(t, item) AS p FROM d JOIN b ON contains(t, item)
) WHERE len(list_filter(range(1, len(p)), lambda i: NOT regexp_matches(p[i], '[\p{L}\p{N}]$') AND NOT regexp_matches(p[i + 1], '^[\p{L}\p{N}]'))) > 0 GROUP BY ALL
""")
def item_match(spark, d):
    """Whole benchmark items as phrases, however long."""
    items = table(spark, d, "benchmark").select(tx.dictionary_key("text").alias("source_id"), F.col("text").alias("term"))
    terms = tm.prepared_terms(items.distinct())
    found = tm.bounded_matches(documents(spark, d), terms).select("text_id", "source_id").distinct()
    return found.groupBy(F.col("text_id").alias("doc_id"), F.length("source_id").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("items"))


@query("term_match_prefix", WORDS + """
, hit AS (SELECT doc_id, term, count(*) AS hits FROM tok JOIN terms ON word = 're' || folded GROUP BY ALL)
SELECT doc_id, term, hits::BIGINT AS hits FROM hit h WHERE NOT EXISTS (SELECT 1 FROM tok WHERE tok.doc_id = h.doc_id AND tok.word = replace(h.term, 'ß', 'ss'))
""")
def term_match_prefix(spark, d):
    texts = documents(spark, d)
    terms = benchmark_terms(spark, d).filter(~F.col("term").contains(" "))
    of = tm.matches_by_role(texts, {"exact": terms, "longer": terms.withColumn("term", F.concat(F.lit("re"), "term"))})
    fresh = tm.without_exact(of("longer"), of("exact"))
    return fresh.groupBy(F.col("text_id").alias("doc_id"), F.col("source_id").alias("term")).agg(F.count(F.lit(1)).alias("hits"))


@query("compact_match", r"""
WITH n AS (SELECT DISTINCT p_name AS term, replace(p_name, ' ', '') AS compact FROM part WHERE contains(p_name, ' ') AND length(replace(p_name, ' ', '')) >= 4),
t AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN replace(p_name, ' ', '') ELSE 'x' || p_name END || ' ' || lower(p_type) AS text FROM part)
SELECT p_partkey, term FROM t JOIN n ON starts_with(replace(text, ' ', ''), compact)
WHERE substr(text, 1, length(term) + 1) = term || ' ' OR substr(text, 1, length(compact) + 1) = compact || ' '
""")
def compact_match(spark, d):
    name, bare = F.col("p_name"), F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    third = F.col("p_size") % 3
    text = F.concat(F.when(third == 0, name).when(third == 1, bare).otherwise(F.concat(F.lit("x"), name)), F.lit(" "), F.lower("p_type"))
    parts = table(spark, d, "part").withColumn("text", text)
    terms = parts.filter(name.contains(" ")).select(name.alias("source_id"), name.alias("term")).distinct()
    found = tm.space_free_matches(tm.normalized_texts(parts, "p_partkey", "text"), tm.prepared_terms(terms))
    return found.select(F.col("text_id").alias("p_partkey"), F.col("source_id").alias("term"))


@query("compound_match", r"""
WITH s AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS piece FROM part), t AS (SELECT p_partkey, replace(p_name, ' ', '') AS token FROM part)
SELECT p_partkey, p.pos::INTEGER AS pos, CASE p.pos WHEN 0 THEN a.piece ELSE b.piece END AS piece
FROM t JOIN s a ON starts_with(token, a.piece) JOIN s b ON token = a.piece || b.piece, (VALUES (0), (1)) p(pos)
""")
def compound_match(spark, d):
    """Part names written as one word, cut into the words that part names are made of."""
    parts = table(spark, d, "part")
    texts = tm.normalized_texts(parts.withColumn("text", F.replace("p_name", F.lit(" "), F.lit(""))), "p_partkey", "text")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("term")).distinct().withColumn("source_id", F.col("term"))
    found = tm.compound_matches(texts, tm.prepared_terms(words))
    return found.select(F.col("text_id").alias("p_partkey"), F.when(F.col("start") == 0, 0).otherwise(1).alias("pos"), F.col("source_id").alias("piece"))


@query("guarded_match", WORDS + """
SELECT doc_id, term, count(*)::BIGINT AS hits FROM tok JOIN terms ON word = folded
WHERE doc_id IN (SELECT doc_id FROM tok WHERE word = 'with') GROUP BY ALL
""")
def guarded_match(spark, d):
    texts = documents(spark, d)
    terms = benchmark_terms(spark, d).filter(~F.col("term").contains(" "))
    cue = spark.createDataFrame([("cue:with", "with")], "source_id string, term string")
    of = tm.matches_by_role(texts, {"term": terms, "cue": cue})
    hits = of("cue").select("text_id", F.col("source_id").alias("cue"))
    guarded = of("term").withColumn("guard_owner", F.lit("cue:with")).withColumn("guard_slot", F.lit(None).cast("string"))
    kept = tm.context_guard(guarded, hits)
    return kept.groupBy(F.col("text_id").alias("doc_id"), F.col("source_id").alias("term")).agg(F.count(F.lit(1)).alias("hits"))


@query("negative_cue", WORDS + """
SELECT doc_id, term, count(*)::BIGINT AS hits FROM tok JOIN terms ON word = folded
WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE contains(t, 'hed')) GROUP BY ALL
""")
def negative_cue(spark, d):
    texts = documents(spark, d)
    terms = benchmark_terms(spark, d).filter(~F.col("term").contains(" "))
    found = cut_lineage(tm.bounded_matches(texts, tm.prepared_terms(terms)))
    kept = tm.negative_cue_filter(found, texts, terms.select("source_id", F.lit("HED").alias("cue")))
    return kept.groupBy(F.col("text_id").alias("doc_id"), F.col("source_id").alias("term")).agg(F.count(F.lit(1)).alias("hits"))


@query("glossary_filter", WORDS + """
SELECT DISTINCT doc_id, length(term)::BIGINT AS entry_id FROM tok JOIN terms ON word = folded WHERE length(term) < 14
""")
def glossary_filter(spark, d):
    terms = benchmark_terms(spark, d).filter(~F.col("term").contains(" "))
    size = F.length("term").cast("long")
    status = F.when(size < 14, "source_checked:x").otherwise("unconfirmed")
    glossary = terms.select(size.alias("entry_id"), status.alias("status"), F.col("term").alias("ko"), F.lit(None).cast("array<string>").alias("aliases"))
    hits = tm.glossary_hits(table(spark, d, "documents"), glossary, "doc_id", "text")
    return hits.select(F.col("text_id").alias("doc_id"), "entry_id")


@query("budgeted_select", """
WITH m AS (SELECT p_brand, p_partkey, p_name, p_type, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM m WHERE n = 1),
k AS (SELECT *, length(p_name || p_type) AS len FROM r WHERE rank <= 8),
u AS (SELECT *, coalesce(sum(len + 1) OVER (PARTITION BY p_brand ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k),
o AS (SELECT *, max(CASE WHEN used + len > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY rank) AS over_budget FROM u)
SELECT p_brand, rank::INTEGER AS rank, p_name FROM o WHERE over_budget = 0
""")
def budgeted_select(spark, d):
    """Part names per brand as matches; the first of each name is found by a partial aggregate."""
    first = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.min_by(F.struct("p_partkey", "p_type"), "p_partkey").alias("f"))
    matches = first.select(
        F.col("p_brand").alias("text_id"), "p_name", F.col("f.p_partkey").alias("start"), (F.col("f.p_partkey") + 1).alias("end"),
        F.array("p_name").alias("target_ids"), F.lit("official_name").alias("source_type"), F.col("p_name").alias("source_id"), "f.p_type",
    )
    chosen = tm.distinct_targets(matches, F.lit(8))
    kept = tm.within_budget(chosen, F.length(F.concat("p_name", "p_type")), 100)
    return kept.select(F.col("text_id").alias("p_brand"), "rank", "p_name")


@query("select_overlapping_lists", """
WITH RECURSIVE l AS (SELECT l_orderkey AS o, (l_partkey * 100000 + l_suppkey) * 10 + l_linenumber AS i, l_linenumber % 4 AS s, l_linenumber % 4 + 1 + (l_quantity::BIGINT % 5) AS e,
  CASE l_returnflag WHEN 'A' THEN ['x', 'y'] WHEN 'N' THEN ['y', 'x'] ELSE ['z'] END AS t FROM lineitem),
m AS (SELECT *, list_sort(t) AS g, row_number() OVER (PARTITION BY o ORDER BY s, s - e, i) AS n FROM l),
w(o, n, kept, taken) AS (
  SELECT o, n, [{'s': s, 'e': e, 't': t, 'g': g}], true FROM m WHERE n = 1
  UNION ALL SELECT m.o, m.n, CASE WHEN hit THEN kept ELSE list_append(kept, {'s': m.s, 'e': m.e, 't': m.t, 'g': m.g}) END, NOT hit
  FROM (SELECT m.*, w.kept, len(list_filter(w.kept, lambda x: x.g = m.g AND (x.t = m.t OR (m.s >= x.s AND m.e <= x.e)))) > 0 AS hit FROM w JOIN m ON m.o = w.o AND m.n = w.n + 1) m)
SELECT w.o AS l_orderkey, m.i::BIGINT AS line, row_number() OVER (PARTITION BY w.o ORDER BY w.n)::INTEGER AS rank FROM w JOIN m ON m.o = w.o AND m.n = w.n WHERE taken
""")
def select_overlapping_lists(spark, d):
    """Lines of an order as matches whose lists of targets repeat, in either order."""
    lists = {"A": ["x", "y"], "N": ["y", "x"]}
    targets = F.when(F.col("l_returnflag").isin(*lists), F.when(F.col("l_returnflag") == "A", F.array(*map(F.lit, lists["A"]))).otherwise(F.array(*map(F.lit, lists["N"]))))
    start = F.col("l_linenumber") % 4
    matches = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("text_id"), ((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).cast("long").alias("source_id"), start.alias("start"),
        (start + 1 + F.col("l_quantity").cast("long") % 5).alias("end"), F.coalesce(targets, F.array(F.lit("z"))).alias("target_ids"), F.lit("official_name").alias("source_type"),
    )
    chosen = tm.distinct_targets(matches, F.lit(8))
    return chosen.select(F.col("text_id").alias("l_orderkey"), F.col("source_id").alias("line"), "rank")


@query("collisions", """
SELECT p_name AS term, string_agg(p_brand, ',' ORDER BY p_brand) AS targets FROM (SELECT DISTINCT p_name, p_brand FROM part) GROUP BY p_name HAVING count(*) > 1
""")
def collisions(spark, d):
    records = table(spark, d, "part").select(F.col("p_name").alias("term"), F.array("p_brand").alias("target_ids"), F.col("p_partkey").alias("source_id"))
    return dic.collision_report(records).select("term", F.array_join("target_ids", ",").alias("targets"))
