"""Replays, causal orders and digests over logs made from the driver's tables.

``QUERIES`` and ``SQL`` are those of ``queries`` with the ones below added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.operators import gates, logs, sync
from veriloom.plans.queries import QUERIES, SQL, query
from veriloom.sources.tables import table

__all__ = ["QUERIES", "SQL"]

TRIGGERS = ("click", "error", "purchase", "signup", "view")
#: From a state on any trigger: a guard over what the run's payloads come to, and where it leads.
MOVES = (
    ("calm", "1", "payload.error == 0 and payload.click != 2", "busy"),
    ("calm", "2", "payload.error != 0", "calm"),
    ("busy", "1", "payload.view == 1 or payload.purchase == 2", "calm"),
    ("busy", "2", "payload.purchase != 2", "busy"),
)


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    events = table(spark, d, "events").select(
        "event_id", "user_id", F.col("event_type").alias("trigger"),
        F.when(k % 2 == 0, "calm").otherwise("busy").alias("from_state"), F.when(F.col("value") < 20, "busy").otherwise("calm").alias("to_state"),
        F.to_json(F.create_map("event_type", k % 3)).alias("payload"),
    )
    known = spark.createDataFrame([(f"{a}-{t}-{n}", a, t, guard, b) for a, n, guard, b in MOVES for t in TRIGGERS], "transition_id string, from_state string, trigger string, guard string, to_state string")
    return logs.replay(events, known, ["user_id"], "event_id", initial="calm", guards=[m[2] for m in MOVES])


def _last(kind: str) -> str:
    return f"last_value(CASE WHEN event_type = '{kind}' THEN k % 3 END IGNORE NULLS) OVER w AS {kind}"


_REPLAY = f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
m AS (SELECT event_id, user_id, event_type, CASE WHEN k % 2 = 0 THEN 'calm' ELSE 'busy' END AS from_state, CASE WHEN value < 20 THEN 'busy' ELSE 'calm' END AS to_state,
  coalesce(lag(CASE WHEN value < 20 THEN 'busy' ELSE 'calm' END) OVER w, 'calm') AS expected_state, {', '.join(map(_last, ('error', 'click', 'view', 'purchase')))}
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT *, CASE WHEN expected_state = 'calm' THEN coalesce(error = 0, FALSE) AND click IS DISTINCT FROM 2 ELSE coalesce(view = 1, FALSE) OR coalesce(purchase = 2, FALSE) END AS one,
  CASE WHEN expected_state = 'calm' THEN error IS DISTINCT FROM 0 ELSE purchase IS DISTINCT FROM 2 END AS two FROM m),
r AS (SELECT *, concat(expected_state, '-', event_type, '-') AS stem, CASE WHEN one <> two THEN CASE WHEN one = (expected_state = 'calm') THEN 'busy' ELSE 'calm' END END AS leads FROM t),
f AS (SELECT event_id, user_id, expected_state, CASE WHEN one AND NOT two THEN stem || '1' WHEN two AND NOT one THEN stem || '2' END AS transition_id,
  CASE WHEN from_state <> expected_state THEN 'replay: event ' || event_id || ' starts at ' || from_state || ', expected ' || expected_state
    WHEN leads IS DISTINCT FROM to_state THEN 'replay: event ' || event_id || ' does not re-derive (winners=['
      || concat_ws(', ', CASE WHEN one THEN '''' || stem || '1''' END, CASE WHEN two THEN '''' || stem || '2''' END) || '])' END AS fault FROM r)
"""


@query(_REPLAY + "SELECT event_id, user_id, expected_state, transition_id, fault FROM f")
def replay_transitions(spark, d):
    return _replayed(spark, d).select("event_id", "user_id", "expected_state", "transition_id", "fault")


@query(_REPLAY + "SELECT user_id, min(event_id) AS event_id, min_by(fault, event_id) AS fault FROM f WHERE fault IS NOT NULL GROUP BY 1")
def replay_faults(spark, d):
    return logs.first_faults(_replayed(spark, d), ["user_id"], "event_id").select("user_id", "event_id", "fault")


def _written(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as entries of their kind's log; views and purchases observe an earlier event."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    entries = events.select(F.col("event_type").alias("writer_id"), F.col("event_id").alias("seq"), name(F.col("event_id")).alias("entry_hash"), F.col("user_id").cast("string").alias("entity_ref"))
    edges = events.where("event_type IN ('view', 'purchase')").select(name(F.col("event_id") - 1 - F.col("k")).alias("before"), name(F.col("event_id")).alias("after"))
    return entries, edges


@query()
def causal_order(spark, d):
    """Each event's place in the converged order, and how many of its user's events it diverges from."""
    entries, edges = _written(spark, d)
    clock = sync.clocks(entries, edges)
    placed = sync.converged(entries, edges, clock=clock)
    torn = sync.conflicts(entries, edges, clock=clock)
    return placed.join(torn, ["entity_ref", "writer_id", "seq"], "left").select("entry_hash", "writer_id", "pos", "past", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_diverging"))


@query("""SELECT e.event_id, p.event_id AS purchase_id, p.value AS paid FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id""")
def last_purchase(spark, d):
    """Each error with its user's last purchase before it."""
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("value").alias("paid"), F.col("event_id").alias("since"))
    errors = events.where("event_type = 'error'").select("event_id", "user_id")
    return gates.as_of(errors, bought, ["user_id"], "event_id", ["purchase_id", "paid"], since="since").drop("user_id")


@query("""WITH l AS (SELECT user_id, event_type AS t, CAST(props->>'k' AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
p AS (SELECT *, k % 3 AS step, last_value(CASE WHEN t IN ('error', 'click') THEN k % 4 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq) AS held, count(*) FILTER (t = 'error') OVER (PARTITION BY user_id ORDER BY seq) AS epoch FROM l),
c AS (SELECT *, last_value(CASE WHEN t = 'purchase' THEN k % 8 END IGNORE NULLS) OVER (PARTITION BY user_id, epoch ORDER BY seq) AS done FROM p),
b AS (SELECT user_id, step, min(seq) FILTER (t = 'signup') AS begun, min(seq) FILTER (t = 'purchase') AS finished FROM p GROUP BY ALL),
d AS (SELECT user_id, min(finished) FILTER (step = 0) AS d0, min(finished) FILTER (step = 1) AS d1 FROM b GROUP BY 1)
SELECT user_id, seq, 'start' AS rule, CASE WHEN step = 2 THEN 'step_started for unknown step 2 at seq ' || seq ELSE 'step ' || step || ' started with guard false at seq ' || seq END AS message FROM c
  WHERE t = 'signup' AND (step = 2 OR (step = 0 AND coalesce(held, 0) = 0) OR (step = 1 AND coalesce(done = 7, false)))
UNION ALL SELECT user_id, seq, 'complete', 'step_completed for step ' || step || ' with no step_started at seq ' || seq FROM p JOIN b USING (user_id, step) WHERE t = 'purchase' AND NOT coalesce(begun < seq, false)
UNION ALL SELECT user_id, seq, 'complete', 'run_completed at seq ' || seq || ' with steps pending: [' || concat_ws(', ', CASE WHEN NOT coalesce(d0 < seq, false) THEN '0' END, CASE WHEN NOT coalesce(d1 < seq, false) THEN '1' END) || ']'
  FROM p JOIN d USING (user_id) WHERE t = 'view' AND NOT coalesce(d0 < seq AND d1 < seq, false)""")
def transcript_findings(spark, d):
    """Users' events as transcripts: starts against the context of their prefix, completions against what began."""
    from pyspark.sql import Window as W

    from veriloom.operators import transcripts

    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.create_map(*(F.lit(x) for pair in (("signup", "step_started"), ("purchase", "step_completed"), ("click", "event_injected"), ("view", "run_completed"), ("error", "run_created")) for x in pair))
    payload = F.to_json(F.struct((k % 3).alias("step_seq"), F.struct((k % 4).alias("k")).alias("ctx"), F.struct((k % 4).alias("k")).alias("payload"), F.struct((k % 8).alias("done")).alias("ctx_delta")))
    log = table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint").alias("seq"), kind[F.col("event_type")].alias("kind"), payload.alias("payload"))
    found = transcripts.starts(log, {0: "ctx.k", 1: "ctx.done != 7"}).unionByName(transcripts.completions(log, [0, 1]))
    return found.select(F.col("run_id").alias("user_id"), "seq", "rule", "message")
