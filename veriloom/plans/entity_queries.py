"""The rules and decisions themselves, run over collections made from the driver's tables.

``QUERIES`` and ``SQL`` are those of ``queries`` with the ones below added.  A
collection takes its fields from a table's columns; fields that a query doesn't
name have their defaults, and collections that it doesn't name are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.plans import decisions, project, rules
from veriloom.plans.queries import QUERIES, SQL, query
from veriloom.sources import entities
from veriloom.sources.tables import table

__all__ = ["QUERIES", "SQL"]


def made(df: DataFrame, collection: str, key: str, order: str, **fields: str) -> DataFrame:
    """A collection: its key, its order and some fields as SQL expressions over ``df``."""
    cols: list[Column] = []
    for name, kind, default in entities.fields(collection):
        value = F.expr(fields[name]) if name in fields else F.lit(default)
        cols.append(value.cast(kind).alias(name))
    return df.select(F.expr(key).cast("string").alias("_key"), F.expr(order).cast("bigint").alias("_ord"), F.expr(key).cast("string").alias("id"), *cols)


def world(spark: SparkSession, **given: DataFrame) -> dict[str, DataFrame]:
    """All collections, empty where not given."""
    return {name: given[name] if name in given else made(spark.range(0), name, "id", "id") for name in entities.COLLECTIONS}


def broken(tables: dict[str, DataFrame], rule: str) -> DataFrame:
    return rules.validate(tables, [rule]).select("subject", "message")


@query("""SELECT 'c' || c_custkey AS subject, 'RI: dyads.c' || c_custkey || '.human_id -> humans ''h' || c_nationkey % 7 || ''' missing' AS message FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 7 > 4
UNION ALL SELECT 'o' || o_orderkey, 'RI: claims.o' || o_orderkey || '.dyad_id -> dyads ''c' || o_custkey || ''' missing' FROM orders o
  WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey AND c_mktsegment = 'BUILDING')
UNION ALL SELECT 'p' || p_partkey, 'RI: knowledge_units.p' || p_partkey || '.evidence_ids -> evidence ''e' || e || ''' missing' FROM (SELECT p_partkey, unnest([p_size, p_size * 3]) AS e FROM part)
  WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = e)""")
def rule_references(spark, d):
    """References and members of lists of references that name nothing."""
    return broken(world(
        spark,
        humans=made(table(spark, d, "region"), "humans", "concat('h', r_regionkey)", "r_regionkey"),
        dyads=made(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "dyads", "concat('c', c_custkey)", "c_custkey", human_id="concat('h', c_nationkey % 7)"),
        claims=made(table(spark, d, "orders"), "claims", "concat('o', o_orderkey)", "o_orderkey", dyad_id="concat('c', o_custkey)"),
        evidence=made(table(spark, d, "supplier"), "evidence", "concat('e', s_suppkey)", "s_suppkey"),
        knowledge_units=made(table(spark, d, "part"), "knowledge_units", "concat('p', p_partkey)", "p_partkey", evidence_ids="array(concat('e', p_size), concat('e', p_size * 3))"),
    ), "RI")


_RECORDED = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber % 2 = 0 AND l_quantity > 25"


def _claims(spark, d):
    records = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return {
        "claims": made(table(spark, d, "orders"), "claims", "concat('o', o_orderkey)", "o_orderkey", state="if(o_orderstatus = 'F', 'survived', 'draft')"),
        "falsification_records": made(
            records, "falsification_records", "concat('f', l_orderkey, '-', l_linenumber)", "l_orderkey", claim_id="concat('o', l_orderkey)",
            outcome="if(l_linenumber % 2 = 0, 'survived', 'refuted')", external_separator="if(l_quantity > 25, 'other', ' ')"),
    }


@query(f"""WITH r AS ({_RECORDED}), m AS (SELECT o.*, 'I-1: materialization m' || o_orderkey || ': ' AS head, 'm' || o_orderkey AS subject, r.l_orderkey AS recorded FROM orders o LEFT JOIN r ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0)
SELECT subject, head || 'claim not in survived state' AS message FROM m WHERE NOT coalesce(o_orderstatus = 'F', false)
UNION ALL SELECT subject, head || 'no surviving record with external separator (IFF1/IFF2)' FROM m WHERE recorded IS NULL
UNION ALL SELECT subject, head || 'covenant gate failed' FROM m WHERE o_orderpriority >= '4'""")
def rule_materialization(spark, d):
    """Materialized claims without a surviving record, in another state or past a failed gate."""
    done = made(table(spark, d, "orders"), "materializations", "concat('m', o_orderkey)", "o_orderkey", claim_id="concat('o', o_orderkey)",
                verdict="if(o_orderkey % 3 = 0, 'rejected', 'materialized')", gate_results="map('g', true, 'b', o_orderpriority < '4')")
    return broken(world(spark, materializations=done, **_claims(spark, d)), "I-1")


@query("""WITH x AS (SELECT o.*, c_nationkey, 'o' || o_orderkey AS subject, 'I-2: disposition o' || o_orderkey || ': ' AS head, c_custkey FROM orders o LEFT JOIN customer ON c_custkey = o_custkey)
SELECT subject, head || 'proposer == disposer (no-self-ratify)' AS message FROM x WHERE o_orderkey % 25 = o_orderkey % 5
UNION ALL SELECT subject, head || 'disposer is not the dyad human (terminal authority)' FROM x WHERE c_custkey IS NOT NULL AND o_orderkey % 5 <> c_nationkey
UNION ALL SELECT subject, head || 'more than one CTA per turn (DFD)' FROM x WHERE o_orderstatus = 'O'""")
def rule_no_self_ratify(spark, d):
    """Who proposed doesn't decide; the pair's human does."""
    return broken(world(
        spark, dyads=made(table(spark, d, "customer"), "dyads", "concat('c', c_custkey)", "c_custkey", human_id="concat('h', c_nationkey)"),
        dispositions=made(table(spark, d, "orders"), "dispositions", "concat('o', o_orderkey)", "o_orderkey", dyad_id="concat('c', o_custkey)", proposer_id="concat('h', o_orderkey % 25)",
                          disposer_id="concat('h', o_orderkey % 5)", cta="CASE o_orderstatus WHEN 'F' THEN 'Y/N' WHEN 'O' THEN 'A/B' END"),
    ), "I-2 ratify")


@query("""WITH x AS (SELECT 'o' || o_orderkey AS subject, CASE o_orderkey % 5 WHEN 0 THEN 'authorize' WHEN 1 THEN 'set_standing' WHEN 2 THEN 'overrule' WHEN 3 THEN 'triage' ELSE 'ratify' END AS mode,
  CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'proposed' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'counter' ELSE '' END AS response,
  o_custkey % 2 = 0 AS even, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 50 END AS veto, o_orderkey % 7 = 0 AS unbound, o_custkey % 5 = 0 AS told, o_orderkey % 11 = 0 AS absorbed FROM orders WHERE o_custkey IS NOT NULL)
SELECT subject, 'I-2: disposition ' || subject || ': ' || unnest(list_filter([
  CASE WHEN mode = 'authorize' AND NOT even THEN 'authorize mode without named action_ref (explicit authorization names its action)' END,
  CASE WHEN mode = 'set_standing' AND NOT even THEN 'set_standing mode without standing_domain' END,
  CASE WHEN mode = 'overrule' AND veto IS NULL THEN 'overrule mode without veto_id' END,
  CASE WHEN mode = 'overrule' AND veto IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = veto) THEN 'overrule cites unknown veto v' || veto END,
  CASE WHEN mode = 'triage' AND even THEN 'triage mode without disclosure_ref' END,
  CASE WHEN mode = 'authorize' AND status = 'approved' AND unbound THEN 'authorize without state binding (E2)' END,
  CASE WHEN response = 'counter' AND NOT told THEN 'counter response without counter text (E3)' END,
  CASE WHEN response = 'counter' AND status = 'approved' THEN 'counter-proposed disposition cannot be approved (E3)' END,
  CASE WHEN response = 'yes' AND status = 'proposed' THEN 'affirmed disposition left proposed (E3)' END,
  CASE WHEN absorbed AND mode <> 'overrule' THEN 'absorption is an overrule pattern (E7)' END,
  CASE WHEN absorbed AND mode = 'overrule' AND status = 'proposed' THEN 'absorption without approved overrule disposition (E7)' END], lambda m: m IS NOT NULL)) AS message FROM x""")
def rule_modes(spark, d):
    """What each mode of a disposition must name."""
    some = table(spark, d, "orders").where("o_custkey IS NOT NULL")
    return broken(world(
        spark, local_vetoes=made(table(spark, d, "supplier"), "local_vetoes", "concat('v', s_suppkey)", "s_suppkey"),
        dispositions=made(
            some, "dispositions", "concat('o', o_orderkey)", "o_orderkey", mode="element_at(array('authorize', 'set_standing', 'overrule', 'triage', 'ratify'), cast(o_orderkey % 5 + 1 as int))",
            status="if(o_orderstatus = 'F', 'approved', 'proposed')", response="CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'counter' END", action_ref="if(o_custkey % 2 = 0, 'a', '')",
            standing_domain="if(o_custkey % 2 = 0, 'a', ' ')", veto_id="if(o_custkey % 3 = 0, concat('v', o_custkey % 50), null)", disclosure_ref="if(o_custkey % 2 = 0, null, 'q')",
            state_ref="if(o_orderkey % 7 = 0, null, 's')", counter_text="if(o_custkey % 5 = 0, 't', null)", absorbed_into_directive_id="if(o_orderkey % 11 = 0, 'd', null)"),
    ), "I-2 modes")


@query("""WITH c AS (SELECT c_custkey % 1000 AS q, count(*) AS n, string_agg('x' || c_custkey, ', ' ORDER BY c_custkey) AS citers FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1),
x AS (SELECT 'q' || p_partkey AS subject, coalesce(n, 0) AS n, citers, CASE WHEN p_size % 2 = 0 THEN 'open' ELSE 'shut' END AS status FROM part LEFT JOIN c ON q = p_partkey)
SELECT subject, 'I-2: disclosure ' || subject || ': cited by more than one triage disposition (' || citers || ') — exactly one outcome' AS message FROM x WHERE n > 1
UNION ALL SELECT subject, 'I-2: disclosure ' || subject || ': status ' || status || ' without its triage disposition' FROM x WHERE n = 0 AND status <> 'open'""")
def rule_triage(spark, d):
    """A disclosure has one triage disposition, and none while it is open."""
    return broken(world(
        spark, disclosures=made(table(spark, d, "part"), "disclosures", "concat('q', p_partkey)", "p_partkey", status="if(p_size % 2 = 0, 'open', 'shut')"),
        dispositions=made(table(spark, d, "customer"), "dispositions", "concat('x', c_custkey)", "c_custkey", mode="if(c_custkey % 2 = 0, 'triage', 'ratify')", disclosure_ref="concat('q', c_custkey % 1000)"),
    ), "I-2 triage")


@query("""SELECT 'e' || event_id AS subject, 'I-10: automaton run u' || user_id || ': duplicate event seq ' || seq AS message FROM (
  SELECT event_id, user_id, event_id % 3 AS seq, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS r FROM events) WHERE r > 1""")
def rule_ordering(spark, d):
    """A run's later events of one number."""
    rows = made(table(spark, d, "events"), "automaton_events", "concat('e', event_id)", "event_id", run_id="concat('u', user_id)", seq="event_id % 3")
    return broken(world(spark, automaton_events=rows), "I-10")


@query("""SELECT 's' || l_partkey AS subject, 'I-15: state s' || l_partkey || ' trigger ''' || t || ''': ' || count(*) || ' guardless transitions — statically ambiguous' AS message FROM (
  SELECT l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'timer' ELSE 'external' END AS t FROM lineitem WHERE l_quantity > 40) GROUP BY l_partkey, t HAVING count(*) > 1""")
def rule_determinism(spark, d):
    """States with more than one guardless transition for a trigger."""
    moves = made(table(spark, d, "lineitem"), "flow_transitions", "concat(l_orderkey, '-', l_linenumber)", "l_orderkey", from_state_id="concat('s', l_partkey)",
                 trigger="if(l_linenumber % 2 = 0, 'timer', 'external')", guard="if(l_quantity > 40, null, 'payload.ok')")
    return broken(world(spark, flow_transitions=moves), "I-15")


@query("""WITH x AS (SELECT 'c' || c_custkey AS subject, 's' || s_suppkey AS s, s_suppkey % 5 <> c_custkey % 4 AS other, s_suppkey % 3 <> 2 AS inside, CASE c_nationkey % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'aborted' ELSE 'running' END AS state
  FROM customer JOIN supplier ON s_suppkey = c_custkey % 150)
SELECT subject, 'I-16: flow run ' || subject || ': current state ' || s || ' belongs to another flow' AS message FROM x WHERE other
UNION ALL SELECT subject, 'I-16: flow run ' || subject || ': closed as ' || state || ' outside an end state (in ' || s || ')' FROM x WHERE inside AND state <> 'running'""")
def rule_flow_closure(spark, d):
    """Runs in a state of another flow, or closed outside an end state."""
    return broken(world(
        spark, flow_states=made(table(spark, d, "supplier"), "flow_states", "concat('s', s_suppkey)", "s_suppkey", flow_id="concat('f', s_suppkey % 5)", kind="element_at(array('task', 'wait', 'end'), cast(s_suppkey % 3 + 1 as int))"),
        flow_runs=made(table(spark, d, "customer"), "flow_runs", "concat('c', c_custkey)", "c_custkey", flow_id="concat('f', c_custkey % 4)", current_state_id="concat('s', c_custkey % 150)",
                       state="element_at(array('done', 'aborted', 'running'), cast(c_nationkey % 3 + 1 as int))"),
    ), "I-16")


@query("""WITH x AS (SELECT 'p' || p_partkey AS subject, CASE p_size % 3 WHEN 0 THEN 'task' WHEN 1 THEN 'wait' ELSE 'end' END AS kind,
  CASE p_partkey % 6 WHEN 1 THEN 'abort' WHEN 2 THEN 'skip' WHEN 3 THEN 'retry:2' WHEN 4 THEN 'retry:0' WHEN 5 THEN 'later' END AS policy FROM part)
SELECT subject, CASE WHEN kind <> 'task' THEN 'STEP-POLICY: ' || kind || ' state ' || subject || ': step_policy must be None' WHEN policy IS NULL THEN 'STEP-POLICY: task state ' || subject || ': step_policy required (abort | skip | retry:<n>)'
  ELSE 'STEP-POLICY: task state ' || subject || ': malformed step_policy ''' || policy || '''' END AS message FROM x
WHERE CASE WHEN kind = 'task' THEN policy IS NULL OR policy IN ('retry:0', 'later') ELSE policy IS NOT NULL END""")
def rule_step_policy(spark, d):
    """Task states have a policy of known form, others none."""
    states = made(table(spark, d, "part"), "flow_states", "concat('p', p_partkey)", "p_partkey", kind="element_at(array('task', 'wait', 'end'), cast(p_size % 3 + 1 as int))",
                  step_policy="element_at(array(null, 'abort', 'skip', 'retry:2', 'retry:0', 'later'), cast(p_partkey % 6 + 1 as int))")
    return broken(world(spark, flow_states=states), "STEP-POLICY")


@query("""WITH g AS (SELECT user_id, max_by(value > 50, event_id) AS passed FROM events GROUP BY 1)
SELECT *, reason = 'ok' AS ok FROM (SELECT 'u' || c_custkey AS id, CASE WHEN NOT coalesce(passed, false) THEN 'no passed gate check — directive rejected, never converted'
  WHEN s_suppkey % 2 = 0 THEN 'local veto v' || s_suppkey || ' upheld — directive rejected' ELSE 'ok' END AS reason FROM customer LEFT JOIN g ON user_id = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey)""")
def decide_apply(spark, d):
    """May each directive be applied: the last gate check and upheld vetoes decide."""
    return decisions.apply_directives(world(
        spark, directives=made(table(spark, d, "customer"), "directives", "concat('u', c_custkey)", "c_custkey"),
        gate_checks=made(table(spark, d, "events"), "gate_checks", "concat('e', event_id)", "event_id", directive_id="concat('u', user_id)", verdict="if(value > 50, 'passed', 'rejected')"),
        authority_policies=made(table(spark, d, "region"), "authority_policies", "concat('p', r_regionkey)", "r_regionkey", on_conflict="if(r_regionkey = 0, 'local_wins', 'fleet_wins')"),
        local_vetoes=made(table(spark, d, "supplier"), "local_vetoes", "concat('v', s_suppkey)", "s_suppkey", directive_id="concat('u', s_suppkey)", status="if(s_suppkey % 2 = 0, 'upheld', 'overruled')"),
    ))


@query("""WITH b AS (SELECT o_custkey, string_agg('''o' || o_orderkey || '''', ', ' ORDER BY o_orderkey) AS bad FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0 GROUP BY 1)
SELECT 'u' || c_custkey AS id, bad IS NULL AS ok, CASE WHEN bad IS NULL THEN 'ok' ELSE 'required conditions unsatisfied: [' || bad || ']' END AS reason FROM customer LEFT JOIN b ON o_custkey = c_custkey""")
def decide_close(spark, d):
    """May each run close: its required conditions are satisfied."""
    return decisions.close_runs(world(
        spark, harness_runs=made(table(spark, d, "customer"), "harness_runs", "concat('u', c_custkey)", "c_custkey"),
        conditions=made(table(spark, d, "orders"), "conditions", "concat('o', o_orderkey)", "o_orderkey", run_id="concat('u', o_custkey)", required="o_orderstatus = 'F'", satisfied="o_orderkey % 3 <> 0"),
    ))


@query("""SELECT *, reason = 'ok' AS ok FROM (SELECT 'o' || o_orderkey AS id, CASE WHEN s_suppkey IS NOT NULL THEN 'release version 1.' || o_orderkey % 40 || ' already exists' WHEN p_partkey IS NULL THEN 'artifact missing'
  WHEN p_size % 10 > 4 THEN 'domain ''d' || p_size % 10 || ''' has no dyad playbook (playbook before automation)' WHEN c_custkey IS NULL OR c_nationkey % 4 = c_custkey % 3 THEN 'irreversible publish needs an Operator disposition (N6)'
  WHEN c_custkey % 5 = 0 THEN 'irreversible publish needs an AUTHORIZE-mode disposition (N6)' WHEN c_mktsegment = 'BUILDING' THEN 'irreversible publish needs an approved AUTHORIZE-mode disposition (N6)'
  WHEN c_custkey % 7 = 0 OR c_custkey % 3 <> p_size % 3 THEN 'authorization is stale: artifact changed since disposition (N6)' ELSE 'ok' END AS reason
FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 40 AND s_suppkey < 20 LEFT JOIN part ON p_partkey = o_orderkey % 3000 LEFT JOIN customer ON c_custkey = o_custkey)""")
def decide_promote(spark, d):
    """May each artifact be promoted: the first test that fails gives the reason."""
    asked = table(spark, d, "orders").selectExpr("concat('o', o_orderkey) AS id", "concat('p', o_orderkey % 3000) AS artifact_id", "concat('1.', o_orderkey % 40) AS version", "concat('c', o_custkey) AS disposition_id")
    return decisions.promote(world(
        spark, releases=made(table(spark, d, "supplier").where("s_suppkey < 20"), "releases", "concat('r', s_suppkey)", "s_suppkey", version="concat('1.', s_suppkey)"),
        artifacts=made(table(spark, d, "part"), "artifacts", "concat('p', p_partkey)", "p_partkey", domain="concat('d', p_size % 10)", content_hash="concat('h', p_size % 3)"),
        playbooks=made(table(spark, d, "region"), "playbooks", "concat('b', r_regionkey)", "r_regionkey", domain="concat('d', r_regionkey)"),
        dispositions=made(table(spark, d, "customer"), "dispositions", "concat('c', c_custkey)", "c_custkey", proposer_id="concat('x', c_nationkey % 4)", disposer_id="concat('x', c_custkey % 3)",
                          mode="if(c_custkey % 5 = 0, 'ratify', 'authorize')", status="if(c_mktsegment = 'BUILDING', 'proposed', 'approved')", state_ref="if(c_custkey % 7 = 0, null, concat('h', c_custkey % 3))"),
    ), asked)


@query(f"""SELECT 'o' || o_orderkey AS id, l_orderkey IS NOT NULL AS ok, CASE WHEN l_orderkey IS NULL THEN 'no surviving falsification record with external separator (IFF1/IFF2)' ELSE 'ok' END AS reason
FROM orders LEFT JOIN ({_RECORDED}) ON l_orderkey = o_orderkey""")
def decide_materialize(spark, d):
    """May each claim be materialized."""
    return decisions.materialize(world(spark, **_claims(spark, d)))


_ANSWERED = "CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'counter' WHEN 3 THEN 'later' END"


@query(f"""SELECT id, CASE WHEN r IS NULL THEN by_status ELSE CASE r WHEN 'yes' THEN 'yes' WHEN 'no' THEN 'no' WHEN 'counter' THEN 'amend' END END AS answer,
  CASE WHEN r IS NOT NULL THEN 'response' WHEN by_status IS NOT NULL THEN 'status' END AS answer_source, CASE o_orderkey % 6 WHEN 0 THEN 'no_decision' WHEN 1 THEN 'no_action' WHEN 2 THEN 'outcome_refused' WHEN 5 THEN NULL ELSE 'sustain_must_be_recorded' END AS silence
FROM (SELECT o_orderkey, 'o' || o_orderkey AS id, {_ANSWERED} AS r, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS by_status FROM orders)""")
def disposition_answers(spark, d):
    """What each disposition answers, from where, and what its mode's silence means."""
    rows = made(table(spark, d, "orders"), "dispositions", "concat('o', o_orderkey)", "o_orderkey", response=_ANSWERED, status="CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' ELSE 'proposed' END",
                mode="element_at(array('ratify', 'authorize', 'triage', 'set_standing', 'overrule', 'odd'), cast(o_orderkey % 6 + 1 as int))")
    return project.answers(world(spark, dispositions=rows)).select("id", "answer", "answer_source", decisions.silence(F.col("mode")).alias("silence"))


@query("""WITH v AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'notify' WHEN 2 THEN 'off' ELSE 'odd' END AS mode,
  CASE WHEN p_partkey % 3 <> p_size % 3 THEN 'major' WHEN p_partkey % 4 <> p_size % 5 THEN 'minor' ELSE 'patch' END AS bump FROM part)
SELECT p_partkey, CASE WHEN mode = 'auto' AND bump <> 'major' THEN 'drive' WHEN mode = 'odd' THEN 'abort' ELSE 'defer' END AS decision,
  CASE mode WHEN 'auto' THEN CASE bump WHEN 'major' THEN 'policy=auto but bump=major exceeds minor' ELSE 'policy=auto, bump=' || bump || ' within minor' END
    WHEN 'notify' THEN 'policy=notify: surfaced, not driven' WHEN 'off' THEN 'policy=off: recorded only' ELSE 'unknown updater policy: ''odd''' END AS reason,
  mode = 'notify' OR (mode = 'auto' AND bump = 'major') AS surfaced FROM v""")
def update_policy(spark, d):
    """Whether an update is driven, by policy and kind of bump."""
    from veriloom.functions import text

    number = lambda c, n: (F.col(c) % n).cast("string")
    mode = F.element_at(F.array(*map(F.lit, ("auto", "notify", "off", "odd"))), (F.col("p_size") % 4 + 1).cast("int"))
    old, new = (F.concat_ws(".", number(c, 3), number(c, n)) for c, n in (("p_partkey", 4), ("p_size", 5)))
    return table(spark, d, "part").select("p_partkey", text.update_policy(mode, old, new, F.lit("minor")).alias("u")).select("p_partkey", "u.*")
