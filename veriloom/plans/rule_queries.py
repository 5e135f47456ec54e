"""More rules, checks and derivations themselves, run over collections made from the driver's tables.

``QUERIES`` and ``SQL`` are those of ``queries`` with the ones below added.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.functions import documents
from veriloom.operators import derive, hashing, records
from veriloom.plans import flows, project
from veriloom.plans.entity_queries import broken, made, world
from veriloom.plans.queries import QUERIES, SQL, query
from veriloom.sources.tables import table

__all__ = ["QUERIES", "SQL"]


def _pick(*values: str, by: str) -> str:
    """SQL for one of the values by the remainder of a number."""
    return f"element_at(array({', '.join(values)}), cast({by} % {len(values)} + 1 as int))"


@query("""WITH m AS (SELECT o_orderkey AS k, o_orderkey // 8 AS g, o_orderkey % 8 AS i, (o_orderkey // 8) % 5 = 0 AS ring FROM orders WHERE o_orderstatus = 'F'),
u AS (SELECT *, CASE WHEN i > 0 THEN k - 1 WHEN ring THEN k + 1 END AS up, k - row_number() OVER (PARTITION BY g ORDER BY k) AS island FROM m),
x AS (SELECT *, EXISTS (SELECT 1 FROM m WHERE m.k = u.up AND m.g = u.g) AS inside, ring AND bool_or(i = 0) OVER w AND bool_or(i = 1) OVER w AS cycle, min(k) OVER w AS first FROM u WINDOW w AS (PARTITION BY g, island)),
d AS (SELECT g, count(*) AS n, count(*) FILTER (up IS NULL) AS roots, min(k) FILTER (up IS NULL) AS root FROM x GROUP BY 1)
SELECT 'o' || k AS subject, 'I-2: disposition o' || k || ': set_standing supersedes outside its domain ''d' || g || '''' AS message FROM x WHERE up IS NOT NULL AND NOT inside
UNION ALL SELECT 'd' || g, 'I-2: domain ''d' || g || ''': ' || roots || ' supersession roots — standing policy must form one chain' FROM d WHERE n > 1 AND roots <> 1
UNION ALL SELECT 'o' || k, 'I-2: disposition o' || k || ': supersession cycle at o' || CASE WHEN i < 2 THEN k ELSE first + 1 END FROM x WHERE cycle
UNION ALL SELECT 'o' || k, 'I-2: disposition o' || k || ': supersession chain does not resolve to the domain root' FROM x JOIN d USING (g) WHERE roots = 1 AND NOT cycle AND first <> root""")
def rule_supersession(spark, d):
    """Standing policy forms one chain in each domain; walks into a cycle name where it closes."""
    rows = made(table(spark, d, "orders"), "dispositions", "concat('o', o_orderkey)", "o_orderkey", mode="'set_standing'", status="if(o_orderstatus = 'F', 'approved', 'proposed')", standing_domain="concat('d', o_orderkey div 8)",
                supersedes_disposition_id="CASE WHEN o_orderkey % 8 > 0 THEN concat('o', o_orderkey - 1) WHEN (o_orderkey div 8) % 5 = 0 THEN concat('o', o_orderkey + 1) END")
    return broken(world(spark, dispositions=rows), "I-2 supersession")


@query("""SELECT 'v' || s_suppkey AS subject, 'I-2: veto v' || s_suppkey || ': status overruled without a backing overrule disposition' AS message FROM supplier
WHERE s_suppkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey % 2 = 0 AND c_custkey % 80 = s_suppkey)""")
def rule_overrule(spark, d):
    return broken(world(
        spark, local_vetoes=made(table(spark, d, "supplier"), "local_vetoes", "concat('v', s_suppkey)", "s_suppkey", status="if(s_suppkey % 2 = 0, 'overruled', 'upheld')"),
        dispositions=made(table(spark, d, "customer"), "dispositions", "concat('c', c_custkey)", "c_custkey", mode="if(c_custkey % 3 = 0, 'overrule', 'ratify')", status="if(c_nationkey % 2 = 0, 'acted', 'proposed')", veto_id="concat('v', c_custkey % 80)"),
    ), "I-2 overrule")


@query("""WITH r AS (SELECT p_partkey, p_size % 5 = 0 AS rehearsal, CASE p_size % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'adopted' ELSE '' END AS verdict FROM part),
c AS (SELECT 'p' || p_partkey AS subject, unnest(['p' || p_partkey % 300, 'c' || p_partkey % 170, 'z' || p_partkey % 3]) AS pid FROM r WHERE NOT rehearsal),
j AS (SELECT subject, pid, rehearsal, verdict, c_custkey, c_nationkey FROM c LEFT JOIN r ON pid = 'p' || r.p_partkey LEFT JOIN customer ON pid = 'c' || c_custkey)
SELECT subject, 'I-11: record ' || subject || ': premise cites ' || what || ' ' || pid AS message FROM (SELECT *, CASE WHEN rehearsal THEN 'quarantined rehearsal record' WHEN verdict IN ('draft', '') THEN 'undecided record'
  WHEN verdict IS NULL AND c_nationkey % 2 = 1 THEN 'undecided disposition' WHEN verdict IS NULL AND c_custkey IS NULL THEN 'missing record' END AS what FROM j) WHERE what IS NOT NULL""")
def rule_citations(spark, d):
    return broken(world(
        spark, decision_records=made(table(spark, d, "part"), "decision_records", "concat('p', p_partkey)", "p_partkey", rehearsal="p_size % 5 = 0", verdict=_pick("'draft'", "'adopted'", "''", by="p_size"),
                                     premises="array(concat('p', p_partkey % 300), concat('c', p_partkey % 170), concat('z', p_partkey % 3))"),
        dispositions=made(table(spark, d, "customer"), "dispositions", "concat('c', c_custkey)", "c_custkey", status="if(c_nationkey % 2 = 0, 'approved', 'proposed')"),
    ), "I-11")


@query("""WITH x AS (SELECT 'p' || p_partkey AS subject, CASE p_size % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'a' ELSE 'b' END AS separator, CASE p_partkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS proposer, p_partkey % 5 = 0 AS rehearsal FROM part WHERE p_size % 2 = 0)
SELECT subject, 'I-12: record ' || subject || CASE WHEN separator = ' ' THEN ': dialectic without designated separator' ELSE ': self-separation must be labeled rehearsal' END AS message FROM x
WHERE separator = ' ' OR (separator = proposer AND NOT rehearsal)""")
def rule_separators(spark, d):
    rows = made(table(spark, d, "part"), "decision_records", "concat('p', p_partkey)", "p_partkey", dialectic="p_size % 2 = 0", separator_id=_pick("' '", "'a'", "'b'", by="p_size"), proposer_id=_pick("'a'", "'b'", by="p_partkey"), rehearsal="p_partkey % 5 = 0")
    return broken(world(spark, decision_records=rows), "I-12")


@query("""SELECT 'p' || p_partkey AS subject, 'I-2: record p' || p_partkey || ': triage mode selected ''decide nothing'' — silence is not an outcome (E5)' AS message FROM part JOIN customer ON c_custkey = p_partkey % 1700
WHERE p_size % 2 = 0 AND p_size % 3 <> 0 AND c_custkey % 2 = 0""")
def rule_null_option(spark, d):
    return broken(world(
        spark, decision_records=made(table(spark, d, "part"), "decision_records", "concat('p', p_partkey)", "p_partkey", selected="if(p_size % 2 = 0, 'decide nothing', 'x')", options="if(p_size % 3 = 0, array('x'), array('x', 'decide nothing'))", disposition_id="concat('c', p_partkey % 1700)"),
        dispositions=made(table(spark, d, "customer"), "dispositions", "concat('c', c_custkey)", "c_custkey", mode="if(c_custkey % 2 = 0, 'triage', 'ratify')"),
    ), "I-2 null option")


@query("""WITH x AS (SELECT p_partkey, p_partkey % 700 AS home, first_value(p_partkey) OVER w AS holder, row_number() OVER w AS r, p_size FROM part WINDOW w AS (PARTITION BY p_partkey % 700 ORDER BY p_partkey))
SELECT 'p' || p_partkey AS subject, 'I-3: knowledge unit p' || p_partkey || ': canonical_home ''h' || home || ''' already held by p' || holder || ' (single-home)' AS message FROM x WHERE r > 1
UNION ALL SELECT 'p' || p_partkey, 'I-3: knowledge unit p' || p_partkey || ': kb stage without survived claim (kb-graduation)' FROM x LEFT JOIN orders ON o_orderkey = p_partkey WHERE p_size % 2 = 0 AND NOT coalesce(o_orderstatus = 'F', false)""")
def rule_knowledge(spark, d):
    return broken(world(
        spark, knowledge_units=made(table(spark, d, "part"), "knowledge_units", "concat('p', p_partkey)", "p_partkey", canonical_home="concat('h', p_partkey % 700)", stage="if(p_size % 2 = 0, 'kb', 'dialectic')", claim_id="concat('o', p_partkey)"),
        claims=made(table(spark, d, "orders"), "claims", "concat('o', o_orderkey)", "o_orderkey", state="if(o_orderstatus = 'F', 'survived', 'draft')"),
    ), "I-3")


@query("""SELECT 'p' || p_partkey AS subject, 'I-4: playbook p' || p_partkey || ': must hold exactly three plays (start/stop/keep)' AS message FROM part WHERE p_size % 3 = 0 OR p_size % 4 = 0 OR p_size % 7 = 0""")
def rule_playbooks(spark, d):
    rows = made(table(spark, d, "part"), "playbooks", "concat('p', p_partkey)", "p_partkey", play_start="if(p_size % 3 = 0, ' ', 'x')", play_stop="if(p_size % 4 = 0, null, 'x')", play_keep="if(p_size % 7 = 0, '', 'x')")
    return broken(world(spark, playbooks=rows), "I-4")


@query("""SELECT 'c' || c_custkey AS subject, 'I-5: briefing c' || c_custkey || ': no checkable artifact (conversation, not work)' AS message FROM customer WHERE c_nationkey % 4 = 0
UNION ALL SELECT 'o' || o_orderkey, 'I-5: ratification o' || o_orderkey || ': returned to draft without its failure attached' FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 0""")
def rule_briefings(spark, d):
    return broken(world(
        spark, briefings=made(table(spark, d, "customer"), "briefings", "concat('c', c_custkey)", "c_custkey", artifact_ref="if(c_nationkey % 4 = 0, '', 'a')"),
        ratifications=made(table(spark, d, "orders"), "ratifications", "concat('o', o_orderkey)", "o_orderkey", verdict="if(o_orderstatus = 'O', 'returned_to_draft', 'ratified')", failure="if(o_orderkey % 3 = 0, null, 'f')"),
    ), "I-5")


@query("""WITH k AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS done, bool_or(l_returnflag = 'A') AS dropped FROM lineitem GROUP BY 1)
SELECT 'c' || c_custkey AS subject, 'I-6: session c' || c_custkey || ': no owner (one session, one owner)' AS message FROM customer WHERE c_nationkey % 4 = 0
UNION ALL SELECT 'c' || c_custkey, 'I-6: session c' || c_custkey || ': no falsifiable claim' FROM customer WHERE c_nationkey % 3 = 0
UNION ALL SELECT 'o' || o_orderkey, 'I-6: transaction o' || o_orderkey || ': committed without an atomic ledger commit entry' FROM orders LEFT JOIN k ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND NOT coalesce(done, false)
UNION ALL SELECT 'o' || o_orderkey, 'I-6: transaction o' || o_orderkey || ': aborted without recording the attempt' FROM orders LEFT JOIN k ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND NOT coalesce(dropped, false)""")
def rule_sessions(spark, d):
    return broken(world(
        spark, sessions=made(table(spark, d, "customer"), "sessions", "concat('c', c_custkey)", "c_custkey", owner_id="if(c_nationkey % 4 = 0, ' ', 'h')", falsifiable_claim="if(c_nationkey % 3 = 0, null, 'c')"),
        transactions=made(table(spark, d, "orders"), "transactions", "concat('o', o_orderkey)", "o_orderkey", state="CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'O' THEN 'aborted' ELSE 'begun' END"),
        ledger_entries=made(table(spark, d, "lineitem"), "ledger_entries", "concat(l_orderkey, '-', l_linenumber)", "l_orderkey", txn_id="concat('o', l_orderkey)", kind="CASE l_returnflag WHEN 'R' THEN 'commit' WHEN 'A' THEN 'abort' ELSE 'note' END"),
    ), "I-6")


@query("""WITH g AS (SELECT event_id, user_id, value > 50 AS passed, CAST(props->>'k' AS BIGINT) AS k FROM events)
SELECT 'o' || o_orderkey AS subject, 'I-7: application o' || o_orderkey || ': gate check ' || unnest(list_filter([CASE WHEN event_id IS NULL THEN 'missing' END, CASE WHEN user_id <> coalesce(o_custkey, -1) THEN 'is for another directive' END,
  CASE WHEN NOT passed THEN 'not passed (no bypass)' END], lambda x: x IS NOT NULL)) AS message FROM orders LEFT JOIN g ON event_id = o_orderkey
UNION ALL SELECT 'e' || event_id, 'I-7: gate check e' || event_id || ': close_completed passed with unsatisfied required conditions' FROM g JOIN customer ON c_custkey = user_id JOIN supplier ON s_suppkey = event_id % 50
  WHERE passed AND c_nationkey % 2 = 0 AND s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0
UNION ALL SELECT 'e' || event_id, 'I-7: gate check e' || event_id || ': passed with a failing per-gate result' FROM g JOIN customer ON c_custkey = user_id WHERE passed AND k % 7 = 0""")
def rule_application(spark, d):
    k = "cast(get_json_object(props, '$.k') as bigint)"
    return broken(world(
        spark, applications=made(table(spark, d, "orders"), "applications", "concat('o', o_orderkey)", "o_orderkey", gate_check_id="concat('e', o_orderkey)", directive_id="concat('d', coalesce(o_custkey, -1))"),
        gate_checks=made(table(spark, d, "events"), "gate_checks", "concat('e', event_id)", "event_id", directive_id="concat('d', user_id)", verdict="if(value > 50, 'passed', 'rejected')", per_gate=f"map('g', {k} % 7 <> 0, 'h', true)", target_run_id="concat('r', event_id % 50)"),
        directives=made(table(spark, d, "customer"), "directives", "concat('d', c_custkey)", "c_custkey", action="if(c_nationkey % 2 = 0, 'close_completed', 'steer')"),
        conditions=made(table(spark, d, "supplier"), "conditions", "concat('s', s_suppkey)", "s_suppkey", run_id="concat('r', s_suppkey)", required="s_suppkey % 2 = 0", satisfied="s_suppkey % 3 = 0"),
    ), "I-7")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderkey % 2 AS s, first_value(o_orderkey) OVER w AS first, row_number() OVER w AS n FROM orders WHERE o_orderstatus <> 'F' WINDOW w AS (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey))
SELECT 'o' || o_orderkey AS subject, 'I-9: principal c' || coalesce(o_custkey::VARCHAR, '?') || ': more than one non-closed ' || CASE s WHEN 0 THEN 'governance' ELSE 'execution' END || ' run (o' || first || ', o' || o_orderkey || ')' AS message FROM r WHERE n > 1
UNION ALL SELECT 'v' || s_suppkey, 'I-9: veto v' || s_suppkey || ': unresolved status (dissent must be logged)' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'p' || n_nationkey, 'I-9: authority policy p' || n_nationkey || ': unknown on_conflict' FROM nation WHERE n_nationkey % 3 = 2""")
def rule_lifecycle(spark, d):
    return broken(world(
        spark, harness_runs=made(table(spark, d, "orders"), "harness_runs", "concat('o', o_orderkey)", "o_orderkey", principal_id="concat('c', coalesce(cast(o_custkey as string), '?'))", authority_scope="if(o_orderkey % 2 = 0, 'governance', 'execution')", state="if(o_orderstatus = 'F', 'closed', 'open')"),
        local_vetoes=made(table(spark, d, "supplier"), "local_vetoes", "concat('v', s_suppkey)", "s_suppkey", status=_pick("'open'", "'upheld'", "'overruled'", by="s_suppkey")),
        authority_policies=made(table(spark, d, "nation"), "authority_policies", "concat('p', n_nationkey)", "n_nationkey", on_conflict=_pick("'fleet_wins'", "'local_wins'", "'odd'", by="n_nationkey")),
    ), "I-9")


@query("""WITH s AS (SELECT p_partkey AS k, p_partkey % 4 AS flow, CASE p_size % 4 WHEN 0 THEN 'task' WHEN 1 THEN 'wait' WHEN 2 THEN 'end' ELSE 'odd' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'rb' END AS rb, CASE p_size % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'aborted' WHEN 2 THEN 'lost' END AS outcome FROM part),
m AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS id, l_partkey AS f, l_suppkey AS t, l_orderkey % 4 AS flow, CASE l_linenumber % 5 WHEN 0 THEN 'timer' WHEN 1 THEN 'run_completed' WHEN 2 THEN 'run_aborted' WHEN 3 THEN 'external' ELSE 'odd' END AS trig FROM lineitem),
g AS (SELECT s.*, coalesce(list(DISTINCT trig) FILTER (trig IS NOT NULL), []) AS trigs FROM s LEFT JOIN m ON f = k GROUP BY ALL)
SELECT id AS subject, 'I-14: transition ' || id || ': unknown trigger ''odd''' AS message FROM m WHERE trig = 'odd'
UNION ALL SELECT id, 'I-14: transition ' || id || ': from_state p' || f || ' belongs to another flow' FROM m JOIN s ON k = f WHERE s.flow <> m.flow
UNION ALL SELECT id, 'I-14: transition ' || id || ': to_state p' || t || ' belongs to another flow' FROM m JOIN s ON k = t WHERE s.flow <> m.flow
UNION ALL SELECT 'p' || k, 'I-14: ' || unnest(list_filter([
  CASE WHEN kind = 'odd' THEN 'state p' || k || ': unknown kind ''odd''' END, CASE WHEN kind = 'task' AND rb IS NULL THEN 'task state p' || k || ': runbook_id required' END,
  CASE WHEN kind = 'task' AND NOT list_contains(trigs, 'run_completed') THEN 'task state p' || k || ': no run_completed transition' END,
  CASE WHEN kind = 'task' AND NOT list_contains(trigs, 'run_aborted') THEN 'task state p' || k || ': no run_aborted transition (failure must land somewhere)' END,
  CASE WHEN kind IN ('wait', 'end') AND rb IS NOT NULL THEN kind || ' state p' || k || ': runbook_id must be None' END,
  CASE WHEN kind = 'wait' AND NOT list_contains(trigs, 'timer') AND NOT list_contains(trigs, 'external') THEN 'wait state p' || k || ': no timer/external transition' END,
  CASE WHEN kind = 'end' AND NOT coalesce(outcome IN ('completed', 'aborted'), false) THEN 'end state p' || k || ': outcome must be completed|aborted, got ''' || coalesce(outcome, 'None') || '''' END,
  CASE WHEN kind = 'end' AND len(trigs) > 0 THEN 'end state p' || k || ': no outgoing transitions allowed' END], lambda x: x IS NOT NULL)) FROM g""")
def rule_totality(spark, d):
    return broken(world(
        spark, flow_states=made(table(spark, d, "part"), "flow_states", "concat('p', p_partkey)", "p_partkey", flow_id="concat('f', p_partkey % 4)", kind=_pick("'task'", "'wait'", "'end'", "'odd'", by="p_size"), runbook_id="if(p_size % 3 = 0, 'rb', null)",
                                outcome=_pick("'completed'", "'aborted'", "'lost'", "null", "null", by="p_size")),
        flow_transitions=made(table(spark, d, "lineitem"), "flow_transitions", "concat(l_orderkey, '-', l_linenumber, '-', l_suppkey)", "l_orderkey", flow_id="concat('f', l_orderkey % 4)", from_state_id="concat('p', l_partkey)", to_state_id="concat('p', l_suppkey)",
                              trigger=_pick("'timer'", "'run_completed'", "'run_aborted'", "'external'", "'odd'", by="l_linenumber")),
    ), "I-14")


@query("""WITH x AS (SELECT 'p' || p_partkey AS subject, CASE p_size % 4 WHEN 0 THEN 'fork' WHEN 1 THEN 'odd' WHEN 2 THEN 'wrap' END AS rung, CASE p_size % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'later' END AS status, p_partkey % 2 = 0 AS adopted,
  p_size % 5 = 0 AS touches, p_partkey % 3 = 0 AS voided, p_partkey % 5 <> 0 AS reason FROM part WHERE p_partkey % 7 <> 0)
SELECT subject, 'I-17: mutation record ' || subject || ': ' || unnest(list_filter([CASE WHEN rung = 'odd' THEN 'unknown rung ''odd'' (expected one of configure, role, scenario, wrap, patch, fork)' END,
  CASE WHEN status = 'later' THEN 'unknown reason_status ''later'' (expected accepted|pending)' END, CASE WHEN adopted AND rung IS NULL THEN 'adopted with no rung selected' END,
  CASE WHEN adopted AND touches AND NOT voided THEN 'touches trust boundary with no voided_guarantees declared' END,
  CASE WHEN adopted AND NOT reason THEN 'adopted with no reason stated (mutation without reason is not allowed)' END], lambda m: m IS NOT NULL)) AS message FROM x""")
def rule_mutations(spark, d):
    rows = made(table(spark, d, "part"), "decision_records", "concat('p', p_partkey)", "p_partkey", playbook="if(p_partkey % 7 = 0, 'other', 'mutation-playbook')", rung=_pick("'fork'", "'odd'", "'wrap'", "null", by="p_size"), reason_status=_pick("'pending'", "'later'", "null", by="p_size"),
                verdict="if(p_partkey % 2 = 0, 'adopted', 'draft')", touches_trust_boundary="p_size % 5 = 0", voided_guarantees="if(p_partkey % 3 = 0, array('g'), array())", reason="if(p_partkey % 5 = 0, ' ', 'r')")
    return broken(world(spark, decision_records=rows), "I-17")


@query("""SELECT 'r' || r_regionkey AS subject, 'I-13: governance run r' || r_regionkey || ' closed with undisposed backlog disclosure e' || event_id || ' (seq ' || event_id || ' < open_seq ' || r_regionkey * 400 || ')' AS message
FROM region JOIN events ON event_id < r_regionkey * 400 WHERE event_type = 'error' AND r_regionkey % 2 = 0""")
def rule_closure_bar(spark, d):
    return broken(world(
        spark, harness_runs=made(table(spark, d, "region"), "harness_runs", "concat('r', r_regionkey)", "r_regionkey", authority_scope="'governance'", state="if(r_regionkey % 2 = 0, 'closed', 'open')", open_seq="r_regionkey * 400"),
        disclosures=made(table(spark, d, "events").where("event_type IN ('error', 'view')"), "disclosures", "concat('e', event_id)", "event_id", kind="'error'", status="if(event_type = 'error', 'open', 'triaged')", seq="event_id"),
    ), "I-13 bar")


@query("""SELECT 'act-dr-o' || o_orderkey AS id, 'explicit' AS mode, CASE o_orderstatus WHEN 'F' THEN 'adopted' ELSE 'draft' END AS state, CASE WHEN s_suppkey IS NULL THEN 'party-unresolved-s' || o_custkey % 150 ELSE 'party-s' || s_suppkey END AS processor, 'order ' || o_orderkey AS title
  FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 150 WHERE o_custkey IS NOT NULL
UNION ALL SELECT 'act-ar-p' || p_partkey, 'automatic', CASE p_size % 2 WHEN 0 THEN 'open' ELSE 'completed' END, 'party-executor', 'automaton run p' || p_partkey FROM part
UNION ALL SELECT 'act-proposal-c' || c_custkey, 'explicit', coalesce(verdict, 'draft'), CASE WHEN s_suppkey IS NULL THEN 'party-unresolved-s' || c_nationkey * 7 ELSE 'party-s' || s_suppkey END, c_name
  FROM customer LEFT JOIN supplier ON s_suppkey = c_nationkey * 7 LEFT JOIN (SELECT o_custkey, max_by(CASE o_orderstatus WHEN 'F' THEN 'ratified' ELSE 'returned_to_draft' END, o_orderkey) AS verdict FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def project_acts(spark, d):
    """The acts of records, automaton runs and proposals, with the parties that process them."""
    t = world(
        spark, agents=made(table(spark, d, "supplier"), "agents", "concat('s', s_suppkey)", "s_suppkey"),
        dyads=made(table(spark, d, "nation"), "dyads", "concat('n', n_nationkey)", "n_nationkey", agent_id="concat('s', n_nationkey * 7)"),
        decision_records=made(table(spark, d, "orders").where("o_custkey IS NOT NULL"), "decision_records", "concat('o', o_orderkey)", "o_orderkey", matter="concat('order ', o_orderkey)", proposer_id="concat('s', o_custkey % 150)", verdict="if(o_orderstatus = 'F', 'adopted', 'draft')"),
        automaton_runs=made(table(spark, d, "part"), "automaton_runs", "concat('p', p_partkey)", "p_partkey", state="if(p_size % 2 = 0, 'open', 'completed')"),
        proposals=made(table(spark, d, "customer"), "proposals", "concat('c', c_custkey)", "c_custkey", dyad_id="concat('n', c_nationkey)", text="c_name"),
        ratifications=made(table(spark, d, "orders"), "ratifications", "concat('o', o_orderkey)", "o_orderkey", proposal_id="concat('c', o_custkey)", verdict="if(o_orderstatus = 'F', 'ratified', 'returned_to_draft')"),
    )
    acts = project.project(t)["acts"].where("id LIKE 'act-dr-%' OR id LIKE 'act-ar-%' OR source = 'proposals'")
    return acts.select("id", "mode", "state", "processor", "title")


@query("""SELECT p_partkey, 'I-27: ' || unnest(list_filter([CASE WHEN p_size % 4 = 3 THEN 'unknown path source' END, CASE WHEN p_size % 3 = 0 THEN 'no path resolvable under the config contract' END, CASE WHEN p_partkey % 11 = 0 THEN 'the handle is not a git repo' END,
  CASE WHEN p_partkey % 5 = 0 THEN 'the manifest records no identity' END, CASE WHEN p_partkey % 7 = 0 THEN 'the handle has no identity' END,
  CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 3 <> p_size % 3 THEN 'the handle identity does not match the manifest-recorded identity' END,
  CASE WHEN p_size % 2 = 0 THEN 'resolution did not happen at initiation' END], lambda x: x IS NOT NULL)) AS finding FROM part""")
def acquisition_findings(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "p_partkey", _pick("'flag'", "'config'", "'default'", "'guess'", by="p_size") + " AS path_source", "if(p_size % 3 = 0, '', '/x') AS path", "p_partkey % 11 <> 0 AS git_available", "if(p_partkey % 5 = 0, null, p_partkey % 3) AS manifest_identity",
        "if(p_partkey % 7 = 0, null, p_size % 3) AS repo_identity", "if(p_size % 2 = 0, false, true) AS at_initiation",
    )
    return records.acquisition(rows, ["p_partkey"]).select("p_partkey", "finding")


@query("""WITH l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
e AS (SELECT user_id, max(seq) AS log_end FROM l GROUP BY 1), c AS (SELECT c_custkey AS user_id, unnest([1, 2]) AS part FROM customer),
r AS (SELECT user_id, part, CASE part WHEN 1 THEN 1 ELSE 11 + user_id % 2 END AS first_seq, CASE part WHEN 1 THEN 10 ELSE 20 + user_id % 5 * 20 END AS last_seq FROM c),
a AS (SELECT r.*, CASE part WHEN 1 THEN 1 ELSE 11 END AS expected, (SELECT string_agg(event_type, ',' ORDER BY seq) FROM l WHERE l.user_id = r.user_id AND seq BETWEEN CASE part WHEN 1 THEN 1 ELSE 11 END AND last_seq) AS actual,
  (SELECT string_agg(event_type, ',' ORDER BY seq) FROM l WHERE l.user_id = r.user_id AND seq BETWEEN first_seq AND last_seq) AS claimed, coalesce(log_end, 0) AS log_end FROM r LEFT JOIN e ON e.user_id = r.user_id)
SELECT user_id, first_seq::BIGINT AS first_seq, last_seq::BIGINT AS last_seq, unnest(list_filter([CASE WHEN first_seq <> expected THEN 'I-18: commit doesn''t start at the watermark' END,
  CASE WHEN claimed IS DISTINCT FROM actual THEN 'I-18: committed payload does not embed exactly the events in its claimed range' END, CASE WHEN last_seq > log_end THEN 'I-18: commit claims events beyond the flow log' END], lambda x: x IS NOT NULL)) AS finding FROM a""")
def commit_findings(spark, d):
    """Two commits a user over the log of their events: the second may skip an event or claim too many."""
    from pyspark.sql import Window as W

    log = table(spark, d, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("seq"), F.col("event_type").alias("event"))
    ranges = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("part"))
    ranges = ranges.selectExpr("user_id", "cast(if(part = 1, 1, 11 + user_id % 2) as bigint) AS first_seq", "cast(if(part = 1, 10, 20 + user_id % 5 * 20) as bigint) AS last_seq")
    held = ranges.join(log, "user_id").where("seq BETWEEN first_seq AND last_seq").groupBy("user_id", "first_seq", "last_seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"]).alias("events"))
    commits = ranges.join(held, ["user_id", "first_seq", "last_seq"], "left")
    return records.commit_completeness(commits, log, "user_id").select("user_id", "first_seq", "last_seq", "finding")


@query("""WITH i AS (SELECT l_orderkey AS m, l_linenumber * 1000000 + l_suppkey * 1000 + l_partkey % 1000 AS pos, 'f' || l_partkey AS path, CASE WHEN l_partkey % 50 <> 0 THEN l_comment END AS content, CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN sha256(l_comment) ELSE sha256(CASE WHEN l_partkey % 40 = 0 THEN 'changed' ELSE l_comment END) END AS pin
  FROM (SELECT *, l_returnflag || l_linestatus || l_linenumber AS l_comment FROM lineitem)),
e AS (SELECT *, CASE WHEN content IS NULL THEN 'missing input ' || path WHEN pin IS NOT NULL AND pin <> sha256(content) THEN 'pin mismatch ' || path END AS failure FROM i),
g AS (SELECT m, bool_and(pin IS NOT NULL) AS pinned, count(failure) AS bad, sha256(string_agg(coalesce(content, ''), '' ORDER BY pos, path)) AS output, string_agg(path || chr(0) || coalesce(pin, ''), chr(10) ORDER BY pos, path) AS lines FROM e GROUP BY 1)
SELECT o_orderkey, coalesce(bad, 0) = 0 AND o_orderkey % 4 <> 0 AS ok, CASE WHEN coalesce(bad, 0) = 0 AND o_orderkey % 4 <> 0 THEN coalesce(output, sha256('')) END AS output_hash, coalesce(pinned, true) AS pinned,
  sha256(CASE WHEN o_orderkey % 4 = 0 THEN 'odd' ELSE 'identity' END || chr(0) || o_orderstatus || chr(0) || coalesce(lines, '')) AS manifest_hash FROM orders LEFT JOIN g ON m = o_orderkey""")
def derived_receipts(spark, d):
    """A manifest for each order over its lines as inputs, some pinned to another digest, some missing."""
    manifests = table(spark, d, "orders").selectExpr("o_orderkey AS manifest_id", "if(o_orderkey % 4 = 0, 'odd', 'identity') AS derivation", "o_orderstatus AS toolchain")
    text = "concat(l_returnflag, l_linestatus, l_linenumber)"
    inputs = table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS manifest_id", "struct(l_linenumber * 1000000 + l_suppkey * 1000 + l_partkey % 1000, concat('f', l_partkey)) AS pos", "concat('f', l_partkey) AS path", f"if(l_partkey % 50 <> 0, cast({text} as binary), null) AS content",
        f"CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN sha2({text}, 256) ELSE sha2(if(l_partkey % 40 = 0, 'changed', {text}), 256) END AS pin",
    )
    return derive.derive(manifests, inputs).select(F.col("manifest_id").alias("o_orderkey"), "ok", "output_hash", "pinned", "manifest_hash")


@query("""WITH h AS (SELECT 'f' || p_partkey % 90 || '/' || p_partkey AS path, p_size AS have FROM part WHERE p_partkey % 13 <> 0), w AS (SELECT 'f' || p_partkey % 90 || '/' || p_partkey AS path, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size END AS want FROM part),
c AS (SELECT s_suppkey, path, have, want FROM supplier LEFT JOIN w ON starts_with(path, 'f' || s_suppkey || '/') LEFT JOIN h USING (path) WHERE s_suppkey % 6 <> 0),
g AS (SELECT s_suppkey, bool_or(path IS NOT NULL AND have IS NULL) AS gone, bool_or(have <> want) AS differs, string_agg(path, ', ' ORDER BY path) FILTER (path IS NOT NULL AND have IS NULL) AS lost, string_agg(path, ', ' ORDER BY path) FILTER (have <> want) AS others FROM c GROUP BY 1)
SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'specified-only' WHEN s_suppkey % 4 = 0 OR gone THEN 'absent' WHEN differs THEN 'mutated' ELSE 'instantiated' END AS status,
  CASE WHEN s_suppkey % 6 = 0 THEN 'specified, not implemented' WHEN s_suppkey % 4 = 0 THEN 'not shipped in the full profile (ships in: lean)' WHEN gone THEN 'missing artifacts: ' || lost WHEN differs THEN 'diverged from manifest: ' || others ELSE 'present and pristine' END AS detail
FROM supplier LEFT JOIN g USING (s_suppkey)""")
def component_states(spark, d):
    files = table(spark, d, "part").selectExpr("concat('f', p_partkey % 90, '/', p_partkey) AS path", "cast(p_size as string) AS sha256", "p_partkey")
    manifest = files.withColumn("sha256", F.when(F.col("p_partkey") % 17 == 0, "0").otherwise(F.col("sha256"))).drop("p_partkey")
    comps = table(spark, d, "supplier").selectExpr("s_suppkey AS component", "if(s_suppkey % 6 = 0, 'specified-only', 'shipped') AS kind", "if(s_suppkey % 4 = 0, array('lean'), array('lean', 'full')) AS profiles", "array(concat('f', s_suppkey, '/')) AS artifacts")
    return flows.component_status(comps, files.where("p_partkey % 13 <> 0").drop("p_partkey"), manifest, "full").select(F.col("component").alias("s_suppkey"), "status", "detail")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderkey IS NOT NULL AND o_orderstatus <> 'F' AND o_custkey % 3 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 4 AS accepted
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def budget_accepted(spark, d):
    """Lines as scenarios of their order's brief, within its budget."""
    lines = table(spark, d, "lineitem").selectExpr("l_orderkey AS brief_id", "struct(l_linenumber, l_partkey, l_suppkey) AS scenario_id")
    briefs = table(spark, d, "orders").selectExpr("o_orderkey AS brief_id", "4 AS budget", "o_custkey % 3 AS authored", "o_orderstatus = 'F' AS retired")
    return derive.within_budget(lines, briefs).selectExpr("brief_id AS l_orderkey", "scenario_id.l_linenumber", "scenario_id.l_partkey", "scenario_id.l_suppkey", "accepted")


@query("""SELECT event_id, CASE WHEN f <> t THEN f || '-' || t || '-' || n END AS transition_id, CASE WHEN f = t THEN NULL WHEN n = 1 THEN 'true' ELSE 'default' END AS guard_outcome
FROM (SELECT *, 's' || user_id % 5 AS f, 's' || floor(value)::BIGINT % 5 AS t, CASE WHEN event_type IN ('view', 'error') THEN 1 ELSE 0 END AS n FROM events)""")
def event_transitions(spark, d):
    """The transition of each event by (from, to, trigger); the last of equal definitions counts."""
    kinds = ("click", "error", "purchase", "signup", "view")
    known = [(f"s{a}-s{b}-{m}", f"s{a}", f"s{b}", k, "payload.x" if m else None, 2 * i + j) for i, (a, b, k) in enumerate((a, b, k) for a in range(5) for b in range(5) for k in kinds if a != b) for j, m in enumerate(((0, 1) if k in ("view", "error") else (1, 0)))]
    transitions = spark.createDataFrame(known, "transition_id string, from_state_id string, to_state_id string, trigger string, guard string, ord int")
    events = table(spark, d, "events").selectExpr("event_id", "concat('s', user_id % 5) AS from_state_id", "concat('s', floor(value) % 5) AS to_state_id", "event_type AS trigger")
    return derive.event_pairs(events, transitions).select("event_id", "transition_id", "guard_outcome")


@query("""SELECT event_id, unnest(list_filter([CASE WHEN k < 10 THEN '/k: below minimum' END, CASE WHEN event_type NOT IN ('click', 'view') THEN '/type: not in enum' END, CASE WHEN user_id % 4 = 0 THEN '/user: required' END], lambda x: x IS NOT NULL)) AS error
FROM (SELECT *, CAST(props->>'k' AS BIGINT) AS k FROM events)""")
def schema_errors(spark, d):
    """Events as documents, against a schema: the validator itself."""
    schema = {"type": "object", "required": ["k", "user"], "properties": {"k": {"type": "integer", "minimum": 10}, "type": {"enum": ["click", "view"]}, "user": {"type": "integer"}}}
    doc = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("type"), F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("user")))
    return documents.listed(table(spark, d, "events"), ["event_id"], doc, schema)


@query("SELECT p_partkey, left(sha256(p_name || chr(0) || p_brand || chr(0) || p_size), 16) AS key FROM part")
def content_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", hashing.key_hash(F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")).alias("key"))


@query("SELECT s_name AS id, row_number() OVER (ORDER BY regexp_extract(s_name, '^\\D*'), CAST(regexp_extract(s_name, '\\d+') AS BIGINT)) - 1 AS pos FROM supplier")
def project_order(spark, d):
    return project.ordered(table(spark, d, "supplier").select(F.col("s_name").alias("id"))).select("id", "pos")
