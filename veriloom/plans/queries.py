"""Operators applied to the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions import text
from veriloom.operators import hashing, integrity, logs, stats
from veriloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

OPEN_KINDS = {"error": 0, "click": 1, "view": 2}
REQUIRED = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""
SELECT event_id, event_type, user_id, row_number() OVER (ORDER BY rank, event_id) AS pos FROM (
  SELECT *, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS rank FROM events) WHERE rank IS NOT NULL""")
def queue_view(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return integrity.queue_view(rows, "event_type", OPEN_KINDS, ["event_id"]).select("event_id", "event_type", "user_id", "pos")


@query("""SELECT o_orderkey, o_custkey FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c_mktsegment = 'BUILDING')""")
def ri_missing(spark, d):
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return integrity.missing_refs(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", some, "c_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT doc_id, word FROM (SELECT DISTINCT doc_id, unnest([source, lang]) AS word FROM documents) t
WHERE word IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (VALUES ('en'), ('de'), ('src1'), ('src2')) v(w) WHERE w = word)""")
def ri_missing_list(spark, d):
    known = spark.createDataFrame([("en",), ("de",), ("src1",), ("src2",)], "w string")
    docs = table(spark, d, "documents").select("doc_id", F.array("source", "lang").alias("words"))
    return integrity.missing_refs(docs, "words", known, "w", is_list=True).select("doc_id", F.col("ref").alias("word")).distinct()


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_key(spark, d):
    return integrity.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT doc_id, first_holder FROM (SELECT doc_id, first_value(doc_id) OVER w AS first_holder, row_number() OVER w AS r
  FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)) WHERE r > 1""")
def first_holder(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return integrity.later_holders(docs, ["digest"], ["doc_id"], "doc_id").select("doc_id", "first_holder")


@query("""SELECT o_orderkey, first_holder FROM (SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_holder, row_number() OVER w AS r
  FROM orders WHERE o_orderstatus = 'O' WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey)) WHERE r > 1""")
def one_open(spark, d):
    orders = table(spark, d, "orders")
    return integrity.second_open(orders, ["o_custkey", "o_orderpriority"], ["o_orderkey"], "o_orderkey", F.col("o_orderstatus") == "O").select("o_orderkey", "first_holder")


@query("SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def no_child(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return integrity.without_child(orders, "o_orderkey", table(spark, d, "lineitem"), "l_orderkey")


@query("""SELECT event_id, user_id, last_order FROM events e JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1) o
  ON o.o_custkey = e.user_id WHERE event_type = 'error' AND event_id < last_order""")
def theta_bar(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id")
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderkey").alias("last_order"))
    return integrity.barred(errors, last, ["user_id"], F.col("event_id") < F.col("last_order"))


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS up FROM conversations),
r AS (SELECT id, up, id - id % 1000 AS c FROM t)
SELECT id, min(id) OVER (PARTITION BY c) AS root, row_number() OVER (PARTITION BY c ORDER BY id) - 1 AS depth, false AS cycle FROM r""")
def chain_depth(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("up"))
    return integrity.chains(turns, "id", "up")


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS k FROM (
  SELECT *, count(*) FILTER (event_type IN ('purchase', 'signup')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
WHERE event_type = 'error'""")
def fail_streak(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    return logs.streaks(log, ["user_id"], ["ts", "event_id"], kind == "error", kind.isin("purchase", "signup")).select("event_id", "user_id", "k")


@query("""SELECT event_id, next FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
WHERE event_type = 'error' AND next IS NOT NULL AND next <> 'click'""")
def adjacency(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return logs.not_followed(log, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", "event_type", ["click"]).select("event_id", "next")


@query("SELECT user_id, count(*) AS n, sha256(string_agg(event_type, chr(10) ORDER BY ts, event_id)) AS path_sha256 FROM events GROUP BY 1")
def path_hash(spark, d):
    return logs.path_hash(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT user_id, arg_max(CAST(props->>'k' AS BIGINT), event_id) AS k FROM events WHERE props->>'k' IS NOT NULL GROUP BY 1")
def lww_fold(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return logs.fold_last(log, ["user_id"], ["event_id"], "k")


@query("""WITH p AS (SELECT l_suppkey AS f, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem),
q AS (SELECT l_suppkey AS f, lead(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS t FROM lineitem)
SELECT DISTINCT f AS from_step, t AS to_step FROM p WHERE t IS NOT NULL EXCEPT SELECT f, t FROM q WHERE t IS NOT NULL""")
def new_pairs(spark, d):
    lines = table(spark, d, "lineitem")
    suite = logs.transition_pairs(lines, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"], "l_suppkey")
    return hashing.new_pairs(logs.transition_pairs(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_suppkey"), suite)


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' ELSE 'diverged' END AS status
FROM (SELECT doc_id, quality AS v FROM labels) a FULL JOIN (SELECT doc_id, CAST(n_chars % 2 AS INT) AS v FROM documents) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.v IS DISTINCT FROM b.v""")
def drift(spark, d):
    have = table(spark, d, "labels").select("doc_id", F.col("quality").alias("v"))
    want = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("v"))
    return hashing.drift(have, want, "doc_id", "v")


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'unknown' WHEN p_brand = p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '!' END THEN 'delete' ELSE 'mutated' END AS verdict
FROM part p WHERE p_partkey % 2 = 0""")
def converge_triage(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    shipped = part.where("p_size <= 25").withColumn("p_brand", F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, "").otherwise("!")))
    return hashing.triage(part, part.where("p_partkey % 2 = 1"), shipped, "p_partkey", "p_brand")


@query("""SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stddev,
  round(min(value), 4) AS min, round(max(value), 4) AS max FROM events GROUP BY 1""")
def summary_stats(spark, d):
    return stats.summary(table(spark, d, "events"), ["event_type"], "value")


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS citers
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def citer_count(spark, d):
    return integrity.citer_counts(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey", "o_orderkey").withColumn("citers", F.array_join("citers", ","))


@query("""SELECT user_id, day, array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT event_type) AS have FROM events GROUP BY ALL)
WHERE len(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(have, x))) > 0""")
def set_required(spark, d):
    log = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return integrity.lacking(log, ["user_id", "day"], "event_type", REQUIRED).withColumn("missing", F.array_join("missing", ","))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL")
def closed_set(spark, d):
    return integrity.outside_set(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_discount = 0 GROUP BY ALL HAVING count(*) > 1")
def ambiguous(spark, d):
    return integrity.ambiguous(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], F.col("l_discount") == 0)


@query("""SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) AS pos FROM events
WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'X')""")
def orphan_queue(spark, d):
    queue = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id")
    return integrity.unattended_rows(queue, table(spark, d, "orders").where("o_orderstatus = 'X'"), ["user_id", "event_id"]).select("event_id", "pos")


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_totalprice > 400000 THEN 'large' END,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'urgent and unfinished' END, CASE WHEN o_custkey % 10 = 0 THEN 'watched' END], lambda x: x IS NOT NULL)) AS finding FROM orders""")
def modes(spark, d):
    tests = [
        ("pending", F.col("o_orderstatus") == "P"), ("large", F.col("o_totalprice") > 400000),
        ("urgent and unfinished", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F")), ("watched", F.col("o_custkey") % 10 == 0),
    ]
    return integrity.findings(table(spark, d, "orders"), ["o_orderkey"], tests)


@query("""SELECT user_id, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id) THEN 'supplier'
  WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_mktsegment = 'BUILDING') THEN 'customer' ELSE 'missing' END AS found_in FROM (SELECT DISTINCT user_id FROM events)""")
def premise_resolve(spark, d):
    ids = table(spark, d, "events").select("user_id").distinct()
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return integrity.resolve_first(ids, "user_id", [("supplier", table(spark, d, "supplier"), "s_suppkey"), ("customer", some, "c_custkey")])


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unknown customer' WHEN c_acctbal < 0 THEN 'no credit' WHEN n = 0 THEN 'empty' WHEN o_orderstatus <> 'F' THEN 'not finished' ELSE 'ok' END AS reason
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT o_orderkey AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) ON k = o_orderkey""")
def promote_decide(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(lines, "o_orderkey", "left")
    tests = [("unknown customer", F.col("c_custkey").isNull()), ("no credit", F.col("c_acctbal") < 0), ("empty", F.col("n").isNull()), ("not finished", F.col("o_orderstatus") != "F")]
    return joined.select("o_orderkey", integrity.first_reason(tests).alias("reason"))


_PICK = """WITH t(transition_id, from_state, trig, guarded, lo, hi) AS (VALUES ('t1', 'view', 0, true, 0, 50), ('t2', 'view', 0, true, 40, 100), ('t3', 'view', 0, false, 0, 0),
  ('t4', 'click', 1, false, 0, 0), ('t5', 'click', 1, false, 0, 0), ('t6', 'error', 2, true, 0, 20), ('t7', 'error', 2, false, 0, 0)),
e AS (SELECT event_id, event_type AS from_state, event_id % 3 AS trig, value AS v FROM events),
g AS (SELECT e.event_id, count(*) FILTER (guarded AND v >= lo AND v < hi) AS t, count(*) FILTER (NOT guarded) AS o,
  min(transition_id) FILTER (guarded AND v >= lo AND v < hi) AS won, min(transition_id) FILTER (NOT guarded) AS def
  FROM e LEFT JOIN t ON t.from_state = e.from_state AND t.trig = e.trig GROUP BY 1)
"""


def _picked(spark, d, dialect):
    rows = [("t1", "view", 0, True, 0, 50), ("t2", "view", 0, True, 40, 100), ("t3", "view", 0, False, 0, 0), ("t4", "click", 1, False, 0, 0), ("t5", "click", 1, False, 0, 0), ("t6", "error", 2, True, 0, 20), ("t7", "error", 2, False, 0, 0)]
    table_ = spark.createDataFrame(rows, "transition_id string, from_state string, trigger bigint, guarded boolean, lo int, hi int")
    events = table(spark, d, "events").select("event_id", F.col("event_type").alias("from_state"), (F.col("event_id") % 3).alias("trigger"), "value")
    holds = (F.col("value") >= F.col("lo")) & (F.col("value") < F.col("hi"))
    return logs.pick_transition(events, table_, event_id="event_id", dialect=dialect, holds=holds)


@query(_PICK + """SELECT event_id, CASE WHEN t = 1 OR (t = 0 AND o = 1) THEN 'taken' WHEN t > 1 OR o > 1 THEN 'ambiguous' ELSE 'unhandled' END AS outcome,
  CASE WHEN t = 1 THEN won WHEN t = 0 AND o = 1 THEN def END AS transition_id FROM g""")
def transition_pick_fallback(spark, d):
    return _picked(spark, d, "fallback")


@query(_PICK + """SELECT event_id, CASE WHEN t + o = 1 THEN 'taken' WHEN t + o > 1 THEN 'ambiguous' ELSE 'unhandled' END AS outcome,
  CASE WHEN t + o = 1 THEN coalesce(won, def) END AS transition_id FROM g""")
def transition_pick_always(spark, d):
    return _picked(spark, d, "always")


@query("""SELECT event_id, expected FROM (SELECT event_id, CAST(props->>'k' AS BIGINT) % 3 AS s, lag(user_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM events)
WHERE expected IS NOT NULL AND s IS DISTINCT FROM expected""")
def replay_check(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", (F.get_json_object("props", "$.k").cast("bigint") % 3).alias("start"), (F.col("user_id") % 3).alias("end"))
    return logs.discontinuities(log, ["user_id"], ["event_id"], "start", "end").select("event_id", "expected")


@query("""SELECT l_orderkey, l_linenumber, expected FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS expected FROM lineitem)
WHERE l_linenumber <> expected""")
def seq_gaps(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return logs.gaps(lines, ["l_orderkey"], "l_linenumber", first=1).select("l_orderkey", "l_linenumber", F.col("expected").cast("bigint").alias("expected"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bought_before FROM events""")
def prefix_fold(spark, d):
    log = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("bought"))
    return logs.prefix_last(log, ["user_id"], ["ts", "event_id"], ["bought"]).select("event_id", "bought_before")


@query("""WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
c AS (SELECT user_id, max(seq) AS mark FROM l WHERE seq < user_id % 20 GROUP BY 1)
SELECT user_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, min(seq) = max(coalesce(mark, -1)) + 1 AND max(seq) - min(seq) + 1 = count(*) AS gapless
FROM l LEFT JOIN c USING (user_id) WHERE seq > coalesce(mark, -1) GROUP BY 1""")
def commit_frontier(spark, d):
    from pyspark.sql import Window as W

    log = table(spark, d, "events").select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("seq"))
    return logs.uncommitted(log, log.where("seq < user_id % 20").withColumnRenamed("seq", "last_seq"), ["user_id"], "seq", "last_seq")


@query("""SELECT l_orderkey, first_day, previous_last FROM (SELECT l_orderkey, lo AS first_day, max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_last FROM (
  SELECT l_orderkey, epoch(l_shipdate)::BIGINT // 86400 AS lo, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS hi FROM lineitem)) WHERE previous_last >= first_day""")
def range_overlap(spark, d):
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400)
    ranges = table(spark, d, "lineitem").select("l_orderkey", day.alias("first_day"), (day + F.col("l_quantity").cast("bigint")).alias("last_day"))
    return logs.overlaps(ranges, ["l_orderkey"], "first_day", "last_day").select("l_orderkey", "first_day", "previous_last")


@query("""SELECT 'customer:' || c_custkey AS id, 'party' AS kind, lower(c_mktsegment) AS label FROM customer UNION ALL
SELECT 'supplier:' || s_suppkey, 'party', regexp_replace(lower(s_name), '[^a-z0-9.-]+', '-', 'g') FROM supplier UNION ALL
SELECT 'order:' || o_orderkey, 'act', CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'undecided' ELSE 'draft' END FROM orders""")
def project_union(spark, d):
    ident = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string")).alias("id")
    state = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "undecided").otherwise("draft")
    parties = table(spark, d, "customer").select(ident("customer", "c_custkey"), F.lit("party").alias("kind"), text.slug(F.col("c_mktsegment")).alias("label"))
    more = table(spark, d, "supplier").select(ident("supplier", "s_suppkey"), F.lit("party").alias("kind"), text.slug(F.col("s_name")).alias("label"))
    return parties.unionByName(more).unionByName(table(spark, d, "orders").select(ident("order", "o_orderkey"), F.lit("act").alias("kind"), state.alias("label")))


@query("""SELECT event_id, CASE WHEN props->>'k' IS NULL THEN '/k: required' WHEN TRY_CAST(props->>'k' AS BIGINT) IS NULL THEN '/k: not an integer' WHEN CAST(props->>'k' AS BIGINT) < 10 THEN '/k: under the minimum' END AS error
FROM events WHERE props->>'k' IS NULL OR TRY_CAST(props->>'k' AS BIGINT) IS NULL OR CAST(props->>'k' AS BIGINT) < 10""")
def schema_check(spark, d):
    k = F.get_json_object("props", "$.k")
    number = F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)")
    error = integrity.first_reason([("/k: required", k.isNull()), ("/k: not an integer", number.isNull()), ("/k: under the minimum", number < 10)])
    return table(spark, d, "events").select("event_id", error.alias("error")).where("error <> 'ok'")


@query("SELECT s_name, row_number() OVER (ORDER BY regexp_extract(s_name, '^\\D*'), CAST(regexp_extract(s_name, '\\d+') AS BIGINT)) AS pos FROM supplier")
def natural_sort(spark, d):
    names = table(spark, d, "supplier").select("s_name", text.natural_key(F.col("s_name")).alias("key"), F.lit("name").alias("kind"))
    return integrity.queue_view(names, "kind", {"name": 0}, ["key"]).select("s_name", "pos")


@query("""SELECT p_partkey, CASE WHEN a1 <> b1 THEN 'major' WHEN a2 <> b2 THEN 'minor' ELSE 'patch' END AS bump FROM (
  SELECT p_partkey, p_partkey % 3 AS a1, p_size % 4 AS a2, p_size % 3 AS b1, p_partkey % 4 AS b2 FROM part)""")
def version_bump(spark, d):
    size = lambda n: (F.col("p_size") % n).cast("string")
    key = lambda n: (F.col("p_partkey") % n).cast("string")
    old, new = F.concat_ws(".", key(3), size(4)), F.concat_ws(".", size(3), key(4), F.concat(key(2), F.lit("rc1")))
    return table(spark, d, "part").select("p_partkey", text.version_bump(old, new).alias("bump"))


@query("SELECT lang, count(*) AS n, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id || ':' || sha256(text))) AS listing_sha256 FROM documents GROUP BY 1")
def listing_hash(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("digest"))
    return hashing.listing_hash(docs, ["lang"], "doc_id", "digest")


@query("""SELECT source, count(*) AS n, sum((quality = 1)::INT)::BIGINT AS hits, round(avg((quality = 1)::INT), 6) AS rate,
  CASE WHEN source < 'src2' THEN avg((quality = 1)::INT) >= 0.85 ELSE avg((quality = 1)::INT) < 0.85 END AS passed FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def trigger_rate(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return stats.trigger_rate(rows, ["source"], F.col("quality") == 1, F.col("source") < "src2", 0.85)


@query("""WITH c AS (SELECT lang, count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 1 AND toxic = 0) AS tn
  FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END, 6)::DOUBLE AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END, 6)::DOUBLE AS recall, round((tp + tn) / (tp + fp + fn + tn), 6)::DOUBLE AS accuracy FROM c""")
def confusion(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return stats.confusion(rows, ["lang"], F.col("quality") == 0, F.col("toxic") == 1)


@query("""SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256('42:' || doc_id)) <= greatest(1, floor(count(*) OVER (PARTITION BY quality, toxic) * 0.2)) THEN 'test' ELSE 'train' END AS part FROM labels""")
def strat_split(spark, d):
    return stats.holdout(table(spark, d, "labels"), ["quality", "toxic"], "doc_id", 0.2).select("doc_id", "part")


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY left(o_orderpriority, 1) DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def best_iter(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.substring("o_orderpriority", 1, 1).alias("score"))
    return stats.best(rows, ["o_custkey"], "score", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in REQUIRED) + " FROM events GROUP BY 1")
def pivot_matrix(spark, d):
    return stats.matrix(table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type"), ["day"], "event_type", REQUIRED)


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "conversations", "documents", "embeddings", "pages", "benchmark")


@query(" UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS n FROM {t}" for t in _TABLES))
def counts(spark, d):
    return stats.counts({t: table(spark, d, t) for t in _TABLES})


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.feedback, b.previous FROM (SELECT doc_id, CASE WHEN trim(lang) <> '' THEN lang END AS feedback FROM documents) a
FULL JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' END AS previous FROM labels) b ON a.doc_id = b.doc_id WHERE a.feedback IS NOT NULL OR b.previous IS NOT NULL""")
def feedback_merge(spark, d):
    runs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("note"))
    before = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise(" ").alias("note"))
    return stats.merge_feedback(runs, before, "doc_id", "note")


@query("""SELECT event_id, coalesce(CAST(props->>'k' AS BIGINT) = 5, false) OR (coalesce(CAST(props->>'k' AS BIGINT), 0) <> 0 AND CAST(props->>'k' AS BIGINT) <> 7) AS holds FROM events""")
def guard_eval(spark, d):
    from veriloom.functions.guards import compile_guard

    guard = compile_guard("payload.k == 5 or (payload.k and not payload.none and payload.k != 7)", {"payload": F.col("props")})
    return table(spark, d, "events").select("event_id", guard.alias("holds"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM e)
SELECT user_id, seq, before AS from_step, event_type AS to_step, CASE WHEN before = event_type THEN 'stay' WHEN before < event_type THEN 'up' ELSE 'down' END AS transition_id FROM p WHERE before IS NOT NULL AND before <> event_type OR (before = event_type AND event_type = 'view')""")
def event_pairs(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    log = table(spark, d, "events").select("user_id", F.row_number().over(w).cast("bigint").alias("seq"), F.lag("event_type").over(w).alias("from_step"), F.col("event_type").alias("to_step")).where("from_step IS NOT NULL")
    names = sorted(REQUIRED)
    rows = [(a, b, "stay" if a == b else "up" if a < b else "down") for a in names for b in names if a != b or a == "view"]
    known = spark.createDataFrame(rows, "from_step string, to_step string, transition_id string")
    return log.join(known, ["from_step", "to_step"]).select("user_id", "seq", "from_step", "to_step", "transition_id")


@query("""WITH l AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS place FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, count(*) AS n_lines, sum((place <= 2)::INT)::BIGINT AS n_within FROM l GROUP BY 1""")
def within_budget(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumn("place", F.row_number().over(w))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.count_if(F.col("place") <= 2).alias("n_within"))


def _book():
    from veriloom.streaming.machine import RunBook

    tools = {"note": lambda ctx: {"ok": True, "result": ctx.get("k"), "ctx_delta": {"noted": ctx.get("k")}}, "fail": lambda ctx: {"ok": ctx.get("k", 0) % 2 == 0, "error": "odd"}}
    return RunBook(((0, "note", "ctx.k"), (1, "fail", "ctx.noted"), (2, "note", "ctx.k == 7")), "retry:3"), tools


def _inputs(events):
    return events.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))


@query()
def advance_fsm(spark, d):
    """Every user's events drive one run of a run-book (stateful: no SQL)."""
    from veriloom.streaming.machine import advance_batch

    return advance_batch(_inputs(table(spark, d, "events")), *_book())


@query()
def advance_stream(spark, d):
    """The same by a stream over the table's files, with each run's state kept."""
    import uuid

    from veriloom.sources.tables import shared_folder
    from veriloom.streaming.machine import EVENTS, advance_stream as stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # A table may be one file, which a stream finds by its folder, or a folder of part files.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    parts = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = spark.readStream.schema(table(spark, d, "events").schema)
    source = source.parquet(f"{d}/events.parquet") if parts else source.option("pathGlobFilter", "events.parquet").parquet(d)
    run = stream(_inputs(source), *_book()).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(EVENTS).parquet(f"{place}/out")


@query("""SELECT p_partkey, CASE WHEN trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9.-]+', '-', 'g'), '-') = '' THEN 'x' ELSE trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9.-]+', '-', 'g'), '-') END AS slug,
  left(sha256(p_name || '|' || p_brand), 16) AS key FROM part""")
def slug_and_key(spark, d):
    both = F.concat_ws(" / ", "p_name", "p_brand")
    return table(spark, d, "part").select("p_partkey", text.slug(both).alias("slug"), F.substring(F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256), 1, 16).alias("key"))


@query("""SELECT page_id, p LIKE '/en/%' OR p = '/en' AS inside FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '(.)/$', '\\1') AS p FROM pages)""")
def path_within(spark, d):
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", text.within(path, F.lit("/en")).alias("inside"))


@query("""SELECT o_custkey, sum((o_orderstatus = 'F')::INT)::BIGINT AS correct, count(*) AS total,
  CASE WHEN avg((o_orderstatus = 'F')::INT) >= 0.8 THEN 'good' WHEN avg((o_orderstatus = 'F')::INT) >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM orders GROUP BY 1""")
def retry_score(spark, d):
    return stats.retry_score(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F")


@query("""SELECT event_type, user_id, sha256(string_agg('{"event_id":' || event_id || ',"k":' || (props->>'k') || ',"user_id":' || user_id || '}', chr(10) ORDER BY event_id)) AS sha256 FROM events GROUP BY ALL""")
def canonical_rows(spark, d):
    from veriloom.operators.derive import canonical_json
    from veriloom.operators.digests import ordered_digest

    k = F.get_json_object("props", "$.k").cast("bigint")
    line = canonical_json({"user_id": F.col("user_id"), "k": k, "event_id": F.col("event_id")})
    return ordered_digest(table(spark, d, "events"), ["event_type", "user_id"], ["event_id"], line).drop("n")


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN o_custkey % 3 <> 0 THEN 'I-26: initiator is not the operator principal' END,
  CASE WHEN o_orderstatus = 'P' THEN 'I-26: ambient-originated initiation' END, CASE WHEN o_orderstatus = 'O' THEN 'I-26: unknown initiation origin' END,
  CASE WHEN o_orderpriority > '3' THEN 'I-26: principal is not dyad-or-human (agents excluded)' END, CASE WHEN o_orderkey % 2 = 0 THEN 'I-26: drive not invoked through a strapped Harness' END], lambda x: x IS NOT NULL)) AS finding FROM orders""")
def record_findings(spark, d):
    from veriloom.operators.records import initiation

    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "operator").alias("initiator"),
        F.when(F.col("o_orderstatus") == "P", "ambient").when(F.col("o_orderstatus") == "O", "odd").otherwise("operator-direct").alias("origin"),
        F.when(F.col("o_orderpriority") > "3", "agent").otherwise("dyad-or-human").alias("principal"), (F.col("o_orderkey") % 2 == 1).alias("harness_strapped"),
    )
    return initiation(rows, ["o_orderkey"])
