"""Integrity rules over the entity graph: each a DataFrame of violations.

A rule takes the collections and returns ``subject, sub, message``; ``validate``
puts them together with the rule's place and name.  ``sub`` orders a rule's rows.
Message texts are fixed values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.text import blank
from veriloom.operators import integrity
from veriloom.sources.tables import spread

Tables = Mapping[str, DataFrame]
RULES: list[tuple[str, Callable[[Tables], DataFrame]]] = []

#: References between collections, each field with the collection
#: it names (a list's members each).
REFERENCES = {
    "dyads": (("human_id", "humans"), ("agent_id", "agents"),),
    "bonds": (("dyad_id", "dyads"),),
    "intents": (("dyad_id", "dyads"),),
    "claims": (("dyad_id", "dyads"), ("intent_id", "intents"),),
    "falsifiers": (("claim_id", "claims"),),
    "falsification_records": (("claim_id", "claims"), ("falsifier_id", "falsifiers"),),
    "evidence": (("record_id", "falsification_records"),),
    "knowledge_units": (("claim_id", "claims"), ("ledger_id", "ledgers"), ("evidence_ids", "evidence"),),
    "materializations": (("claim_id", "claims"),),
    "playbooks": (("dyad_id", "dyads"),),
    "hats": (("dyad_id", "dyads"),),
    "dispositions": (("dyad_id", "dyads"), ("session_id", "sessions"), ("hat_id", "hats"), ("proposer_id", "agents"), ("disposer_id", "humans"), ("disclosure_ref", "disclosures"), ("supersedes_disposition_id", "dispositions"), ("absorbed_into_directive_id", "directives"),),
    "sessions": (("dyad_id", "dyads"), ("owner_id", "humans"),),
    "transactions": (("session_id", "sessions"),),
    "ledgers": (("dyad_id", "dyads"),),
    "ledger_entries": (("ledger_id", "ledgers"), ("session_id", "sessions"), ("txn_id", "transactions"),),
    "subagents": (("dyad_id", "dyads"),),
    "briefings": (("dyad_id", "dyads"), ("session_id", "sessions"), ("artifact_ref", "artifacts"),),
    "proposals": (("dyad_id", "dyads"),),
    "ratifications": (("proposal_id", "proposals"),),
    "harness_runs": (("principal_id", "principals"), ("dyad_id", "dyads"), ("session_id", "sessions"),),
    "conditions": (("run_id", "harness_runs"),),
    "threads": (("run_id", "harness_runs"),),
    "interaction_prefs": (("run_id", "harness_runs"),),
    "artifacts": (("run_id", "harness_runs"),),
    "strap_gates": (("run_id", "harness_runs"), ("required_condition_ids", "conditions"),),
    "local_vetoes": (("principal_id", "principals"), ("directive_id", "directives"),),
    "directives": (("source_run_id", "harness_runs"), ("target_run_id", "harness_runs"), ("supersedes_directive_id", "directives"), ("disposition_id", "dispositions"),),
    "gate_checks": (("directive_id", "directives"), ("target_run_id", "harness_runs"),),
    "applications": (("directive_id", "directives"), ("gate_check_id", "gate_checks"),),
    "promotions": (("artifact_id", "artifacts"), ("directive_id", "directives"), ("disposition_id", "dispositions"),),
    "releases": (("artifact_ids", "artifacts"),),
    "runbooks": (("release_version", "releases"),),
    "steps": (("runbook_id", "runbooks"), ("tool_id", "tools"),),
    "automaton_runs": (("runbook_id", "runbooks"), ("parent_flow_run_id", "flow_runs"), ("flow_state_id", "flow_states"),),
    "automaton_events": (("run_id", "automaton_runs"),),
    "automaton_flows": (("release_version", "releases"),),
    "flow_states": (("flow_id", "automaton_flows"), ("runbook_id", "runbooks"),),
    "flow_transitions": (("flow_id", "automaton_flows"), ("from_state_id", "flow_states"), ("to_state_id", "flow_states"),),
    "flow_runs": (("flow_id", "automaton_flows"), ("current_state_id", "flow_states"),),
    "flow_transition_events": (("flow_run_id", "flow_runs"),),
    "decision_records": (("disposition_id", "dispositions"),),
}
NULL_OPTION = "decide nothing"
DECIDED = ("approved", "acted")
RUNGS = ("configure", "role", "scenario", "wrap", "patch", "fork")
#: The playbook whose records rule I-17 looks at, where ``validate`` isn't told another.
MUTATIONS = "mutation-playbook"
TRIGGERS = ("timer", "run_completed", "run_aborted", "external")
QUEUE_RANKS = {"conflict": 0, "error": 1, "uncertainty": 2}


def rule(name: str):
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        RULES.append((name, f))
        return f

    return register


def say(template: str, *columns: str | Column) -> Column:
    return F.format_string(template, *columns)


def found(df: DataFrame, *tests: tuple[Column, Column], subject: str = "id") -> DataFrame:
    """One row for each test that holds, in the order of rows, then tests."""
    hits = F.array(*(F.when(holds, F.struct(F.lit(i).alias("i"), message.alias("message"))) for i, (holds, message) in enumerate(tests)))
    rows = df.select(F.col(subject).alias("subject"), "_ord", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return rows.select("subject", (F.col("_ord").cast("bigint") * 1000 + F.col("h.i")).alias("sub"), "h.message")


def keyed(df: DataFrame, key: str, **columns: str) -> DataFrame:
    """``key`` (from ``_key``), given columns under new names, and ``<key>_found``."""
    return df.select(F.col("_key").alias(key), F.lit(True).alias(f"{key}_found"), *(F.col(c).alias(n) for n, c in columns.items()))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@rule("RI")
def references(t: Tables) -> DataFrame:
    """All references in one join: each collection is scanned once for them, and once more to count them.

    References and ids are dealt by what they name to as many tasks as their numbers
    need.  An outer join finds what is missing: Spark moves an anti join into the
    union's parts, and a task then holds all of their sorts and hash maps.
    """
    refs, ids, sizes = [], [], []
    for i, (coll, edges) in enumerate(REFERENCES.items()):
        kinds = dict(t[coll].dtypes)
        one = lambda f: F.col(f) if kinds[f].startswith("array") else F.array(f)
        entries = F.flatten(F.array(*(_entries(one(f), f, to, k) for k, (f, to) in enumerate(edges))))
        sizes.append(t[coll].select(functools.reduce(Column.__add__, (F.coalesce(F.size(f), F.lit(0)) if kinds[f].startswith("array") else F.lit(1) for f, _ in edges)).cast("bigint").alias("n")))
        rows = t[coll].select(F.lit(coll).alias("coll"), "_key", (F.lit(i * 10**9).cast("bigint") + F.col("_ord").cast("bigint") * 1000).alias("at"), F.explode(entries).alias("e"))
        refs.append(rows.select("coll", "_key", (F.col("at") + F.col("e.k")).alias("sub"), "e.field", "e.target", "e.ref").where("ref IS NOT NULL"))
    for coll in sorted({to for edges in REFERENCES.values() for _, to in edges}):
        ids.append(t[coll].select(F.lit(coll).alias("target"), F.col("version" if coll == "releases" else "_key").alias("ref")))
        sizes.append(t[coll].select(F.lit(1).cast("bigint").alias("n")))
    n = union(*sizes).agg(F.sum("n")).first()[0] or 0
    dealt = lambda parts: spread(union(*parts), "target", "ref", rows=n)
    lost = dealt(refs).join(dealt(ids).distinct().withColumn("named", F.lit(True)), ["target", "ref"], "left").where("named IS NULL")
    return lost.select(F.col("_key").alias("subject"), "sub", say("RI: %s.%s.%s -> %s '%s' missing", "coll", "_key", "field", "target", "ref").alias("message"))


def _entries(values: Column, field: str, target: str, k: int) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(k).alias("k"), F.lit(field).alias("field"), F.lit(target).alias("target"), x.alias("ref")))


@rule("I-1")
def materialization(t: Tables) -> DataFrame:
    good = t["falsification_records"].where((F.col("outcome") == "survived") & ~blank(F.col("external_separator"))).select("claim_id", F.lit(True).alias("recorded")).distinct()
    rows = t["materializations"].where("verdict = 'materialized'").join(keyed(t["claims"], "claim_id", claim_state="state"), "claim_id", "left").join(good, "claim_id", "left")
    m = lambda s: say("I-1: materialization %s: " + s, "id")
    return found(
        rows,
        (~F.col("claim_state").eqNullSafe("survived"), m("claim not in survived state")),
        (F.col("recorded").isNull(), m("no surviving record with external separator (IFF1/IFF2)")),
        (~F.forall(F.map_values("gate_results"), lambda x: x), m("covenant gate failed")),
    )


@rule("I-2 ratify")
def no_self_ratify(t: Tables) -> DataFrame:
    rows = t["dispositions"].join(keyed(t["dyads"], "dyad_id", human="human_id"), "dyad_id", "left")
    m = lambda s: say("I-2: disposition %s: " + s, "id")
    return found(
        rows,
        (F.col("proposer_id").eqNullSafe(F.col("disposer_id")), m("proposer == disposer (no-self-ratify)")),
        (F.col("dyad_id_found").isNotNull() & ~F.col("disposer_id").eqNullSafe(F.col("human")), m("disposer is not the dyad human (terminal authority)")),
        (F.col("cta").isNotNull() & (F.col("cta") != "Y/N"), m("more than one CTA per turn (DFD)")),
    )


@rule("I-2 modes")
def disposition_modes(t: Tables) -> DataFrame:
    rows = t["dispositions"].join(keyed(t["local_vetoes"], "veto_id"), "veto_id", "left")
    mode, status, response, absorbed = F.col("mode"), F.col("status"), F.col("response"), F.coalesce("absorbed_into_directive_id", F.lit("")) != ""
    no = lambda c: blank(F.col(c))
    m = lambda s, *c: say("I-2: disposition %s: " + s, "id", *c)
    return found(
        rows,
        ((mode == "authorize") & no("action_ref"), m("authorize mode without named action_ref (explicit authorization names its action)")),
        ((mode == "set_standing") & no("standing_domain"), m("set_standing mode without standing_domain")),
        ((mode == "overrule") & no("veto_id"), m("overrule mode without veto_id")),
        ((mode == "overrule") & ~no("veto_id") & F.col("veto_id_found").isNull(), m("overrule cites unknown veto %s", "veto_id")),
        ((mode == "triage") & no("disclosure_ref"), m("triage mode without disclosure_ref")),
        ((mode == "authorize") & status.isin(*DECIDED) & no("state_ref"), m("authorize without state binding (E2)")),
        ((response == "counter") & no("counter_text"), m("counter response without counter text (E3)")),
        ((response == "counter") & status.isin(*DECIDED), m("counter-proposed disposition cannot be approved (E3)")),
        ((response == "yes") & (status == "proposed"), m("affirmed disposition left proposed (E3)")),
        (absorbed & (mode != "overrule"), m("absorption is an overrule pattern (E7)")),
        (absorbed & (mode == "overrule") & ~status.isin(*DECIDED), m("absorption without approved overrule disposition (E7)")),
    )


@rule("I-2 triage")
def disclosure_triage(t: Tables) -> DataFrame:
    citers = (
        t["dispositions"].where("mode = 'triage'").groupBy(F.col("disclosure_ref").alias("id"))
        .agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_ord", "id"))), lambda x: x["id"]).alias("citers"))
    )
    rows = t["disclosures"].join(citers, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found(
        rows,
        (F.col("n") > 1, say("I-2: disclosure %s: cited by more than one triage disposition (%s) — exactly one outcome", "id", F.array_join("citers", ", "))),
        ((F.col("n") == 0) & (F.col("status") != "open"), say("I-2: disclosure %s: status %s without its triage disposition", "id", "status")),
    )


@rule("I-2 supersession")
def standing_supersession(t: Tables) -> DataFrame:
    """Roots by pointer doubling; only walks that never end, or end elsewhere, are told link by link.

    A walk that runs into a cycle names the member at which it closes: the first
    member of the cycle that it meets, found by doubling too (``closings``).
    """
    members = t["dispositions"].where((F.col("mode") == "set_standing") & (F.col("status") == "approved") & ~blank(F.col("standing_domain"))).select(
        "id", "_ord", F.col("standing_domain").alias("domain"), F.nullif(F.col("supersedes_disposition_id"), F.lit("")).alias("up"))
    same = members.select(F.col("id").alias("up"), "domain", F.lit(True).alias("inside"))
    outside = found(members.join(same, ["up", "domain"], "left").where("up IS NOT NULL"), (F.col("inside").isNull(), say("I-2: disposition %s: set_standing supersedes outside its domain '%s'", "id", "domain")))
    groups = members.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("up").isNull()).alias("roots"), F.min("_ord").alias("_ord"), F.min(F.when(F.col("up").isNull(), F.col("id"))).alias("root"))
    roots = found(groups.where("n > 1"), (F.col("roots") != 1, say("I-2: domain '%s': %s supersession roots — standing policy must form one chain", "domain", F.col("roots").cast("string"))), subject="domain")
    # Inside one domain alone a link is followed; ids are told apart by their domain.
    inner = members.join(same.select("up", "domain", "inside"), ["up", "domain"], "left").select("id", "_ord", "domain", F.struct("domain", "id").alias("node"), F.when(F.col("inside"), F.struct("domain", F.col("up").alias("id"))).alias("above"))
    walked = integrity.chains(inner, "node", "above")
    ended = inner.join(walked, "node").join(groups.where("roots = 1").select("domain", F.col("root").alias("first")), "domain", "left")
    closing = integrity.closings(inner.join(walked.where("cycle").select("node"), "node", "left_semi").select("node", "above"), "node", "above")
    ended = ended.join(closing, "node", "left")
    chains = found(
        ended,
        (F.col("cycle"), say("I-2: disposition %s: supersession cycle at %s", "id", "closing.id")),
        (~F.col("cycle") & F.col("first").isNotNull() & (F.col("root.id") != F.col("first")), say("I-2: disposition %s: supersession chain does not resolve to the domain root", "id")),
    )
    return union(outside, roots, chains)


@rule("I-2 overrule")
def overrule_backing(t: Tables) -> DataFrame:
    backed = t["dispositions"].where((F.col("mode") == "overrule") & F.col("status").isin(*DECIDED))
    bare = integrity.without_child(t["local_vetoes"].where("status = 'overruled'"), "id", backed, "veto_id")
    return found(bare, (F.lit(True), say("I-2: veto %s: status overruled without a backing overrule disposition", "id")))


@rule("I-11")
def citations(t: Tables) -> DataFrame:
    records = keyed(t["decision_records"], "pid", p_rehearsal="rehearsal", p_verdict="verdict")
    acts = keyed(t["dispositions"], "did", d_status="status").withColumnRenamed("did", "pid")
    rows = t["decision_records"].where("NOT rehearsal").select("id", "_ord", F.posexplode("premises").alias("k", "pid")).join(records, "pid", "left").join(acts, "pid", "left")
    record, undecided = F.col("pid_found").isNotNull(), F.col("p_verdict").isin("draft", "proposed", "")
    m = lambda s: say("I-11: record %s: premise cites " + s + " %s", "id", "pid")
    return found(
        rows.withColumn("_ord", F.col("_ord").cast("bigint") * 1000 + F.col("k")),
        (record & F.col("p_rehearsal"), m("quarantined rehearsal record")),
        (record & ~F.col("p_rehearsal") & undecided, m("undecided record")),
        (~record & F.col("did_found").isNotNull() & ~F.col("d_status").isin(*DECIDED), m("undecided disposition")),
        (~record & F.col("did_found").isNull(), m("missing record")),
    )


@rule("I-12")
def separators(t: Tables) -> DataFrame:
    none = blank(F.col("separator_id"))
    return found(
        t["decision_records"].where("dialectic"),
        (none, say("I-12: record %s: dialectic without designated separator", "id")),
        (~none & (F.col("separator_id") == F.col("proposer_id")) & ~F.col("rehearsal"), say("I-12: record %s: self-separation must be labeled rehearsal", "id")),
    )


@rule("I-2 null option")
def null_option(t: Tables) -> DataFrame:
    chosen = t["decision_records"].where((F.col("selected") == NULL_OPTION) & F.array_contains("options", NULL_OPTION))
    rows = chosen.join(keyed(t["dispositions"], "disposition_id", d_mode="mode"), "disposition_id")
    return found(rows, (F.col("d_mode") == "triage", say(f"I-2: record %s: triage mode selected '{NULL_OPTION}' — silence is not an outcome (E5)", "id")))


@rule("I-3")
def knowledge(t: Tables) -> DataFrame:
    later = integrity.later_holders(t["knowledge_units"], ["canonical_home"], ["_ord"], "id")
    rows = t["knowledge_units"].join(keyed(t["claims"], "claim_id", claim_state="state"), "claim_id", "left")
    bad = (F.col("stage") == "kb") & ~F.col("claim_state").eqNullSafe("survived")
    return union(
        found(later, (F.lit(True), say("I-3: knowledge unit %s: canonical_home '%s' already held by %s (single-home)", "id", "canonical_home", "first_holder"))),
        found(rows, (F.lit(False), F.lit("")), (bad, say("I-3: knowledge unit %s: kb stage without survived claim (kb-graduation)", "id"))),
    )


@rule("I-4")
def playbook_triad(t: Tables) -> DataFrame:
    lacks = blank(F.col("play_start")) | blank(F.col("play_stop")) | blank(F.col("play_keep"))
    return found(t["playbooks"], (lacks, say("I-4: playbook %s: must hold exactly three plays (start/stop/keep)", "id")))


@rule("I-5")
def briefings(t: Tables) -> DataFrame:
    return union(
        found(t["briefings"], (blank(F.col("artifact_ref")), say("I-5: briefing %s: no checkable artifact (conversation, not work)", "id"))),
        found(t["ratifications"], ((F.col("verdict") == "returned_to_draft") & blank(F.col("failure")), say("I-5: ratification %s: returned to draft without its failure attached", "id"))),
    )


@rule("I-6")
def sessions(t: Tables) -> DataFrame:
    kinds = t["ledger_entries"].groupBy(F.col("txn_id").alias("id")).agg(F.collect_set("kind").alias("kinds"))
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    return union(
        found(
            t["sessions"],
            (blank(F.col("owner_id")), say("I-6: session %s: no owner (one session, one owner)", "id")),
            (blank(F.col("falsifiable_claim")), say("I-6: session %s: no falsifiable claim", "id")),
        ),
        found(
            t["transactions"].join(kinds, "id", "left"),
            ((F.col("state") == "committed") & ~has("commit"), say("I-6: transaction %s: committed without an atomic ledger commit entry", "id")),
            ((F.col("state") == "aborted") & ~has("abort"), say("I-6: transaction %s: aborted without recording the attempt", "id")),
        ),
    )


@rule("I-7")
def directive_application(t: Tables) -> DataFrame:
    gates = keyed(t["gate_checks"], "gate_check_id", g_directive="directive_id", g_verdict="verdict")
    there = F.col("gate_check_id_found").isNotNull()
    m = lambda s: say("I-7: application %s: gate check " + s, "id")
    open_ = t["conditions"].where("required AND NOT satisfied").select(F.col("run_id").alias("target_run_id"), F.lit(True).alias("unmet")).distinct()
    passed = t["gate_checks"].where("verdict = 'passed'").join(keyed(t["directives"], "directive_id", action="action"), "directive_id").join(open_, "target_run_id", "left")
    return union(
        found(
            t["applications"].join(gates, "gate_check_id", "left"),
            (~there, m("missing")),
            (there & (F.col("g_directive") != F.col("directive_id")), m("is for another directive")),
            (there & (F.col("g_verdict") != "passed"), m("not passed (no bypass)")),
        ),
        found(
            passed,
            ((F.col("action") == "close_completed") & F.col("unmet").isNotNull(), say("I-7: gate check %s: close_completed passed with unsatisfied required conditions", "id")),
            (~F.forall(F.map_values("per_gate"), lambda x: x), say("I-7: gate check %s: passed with a failing per-gate result", "id")),
        ),
    )


@rule("I-8")
def promotions(t: Tables) -> DataFrame:
    twice = integrity.duplicate_keys(t["releases"], ["version"]).agg(F.count("*").alias("k")).where("k > 0")
    known = t["releases"].select(F.col("version").alias("release_version"), F.lit(True).alias("released")).distinct()
    people = (
        keyed(t["artifacts"], "artifact_id", domain="domain", content_hash="content_hash", run_id="run_id")
        .join(keyed(t["harness_runs"], "run_id", dyad_id="dyad_id"), "run_id", "left").join(keyed(t["dyads"], "dyad_id", human="human_id"), "dyad_id", "left")
    )
    domains = t["playbooks"].select("domain", F.lit(True).alias("covered")).distinct()
    applied = t["applications"].select("directive_id", F.lit(True).alias("applied")).distinct()
    rows = (
        t["promotions"].join(known, "release_version", "left").join(keyed(t["dispositions"], "disposition_id", d_status="status", d_mode="mode", d_ref="state_ref", disposer="disposer_id"), "disposition_id", "left")
        .join(people, "artifact_id", "left").join(domains, "domain", "left").join(applied, "directive_id", "left")
    )
    d, a = F.col("disposition_id_found").isNotNull(), F.col("artifact_id_found").isNotNull()
    m = lambda s, *c: say("I-8: promotion %s: " + s, "id", *c)
    return union(
        twice.select(F.lit("releases").alias("subject"), F.lit(-1).cast("bigint").alias("sub"), F.lit("I-8: duplicate AutomatonRelease version").alias("message")),
        found(
            rows,
            (F.col("released").isNull(), m("release %s missing", "release_version")),
            (~F.col("preconditions_ok"), m("preconditions not ok")),
            (~d, m("no Operator disposition (N6)")),
            (d & (F.col("d_status") != "approved"), m("disposition not approved")),
            (d & (F.col("d_status") == "approved") & (F.coalesce("human", F.lit("")) != "") & (F.col("disposer") != F.col("human")), m("disposition disposer is not the dyad human")),
            (d & (F.col("d_mode") != "authorize"), m("disposition is not AUTHORIZE mode (N6)")),
            (d & a & ~F.col("d_ref").eqNullSafe(F.col("content_hash")), m("authorization stale or unbound (N6)")),
            (a & F.col("covered").isNull(), m("domain '%s' has no dyad playbook (playbook before automation)", "domain")),
            (F.col("directive_id").isNotNull() & F.col("applied").isNull(), m("cited directive was never applied")),
        ),
    )


@rule("I-9")
def run_lifecycle(t: Tables) -> DataFrame:
    later = integrity.second_open(t["harness_runs"], ["principal_id", "authority_scope"], ["_ord"], "id", F.col("state") != "closed")
    return union(
        found(later, (F.lit(True), say("I-9: principal %s: more than one non-closed %s run (%s, %s)", "principal_id", "authority_scope", "first_holder", "id"))),
        found(integrity.outside_set(t["local_vetoes"], "status", ["upheld", "overruled"]), (F.lit(True), say("I-9: veto %s: unresolved status (dissent must be logged)", "id"))),
        found(integrity.outside_set(t["authority_policies"], "on_conflict", ["fleet_wins", "local_wins"]), (F.lit(True), say("I-9: authority policy %s: unknown on_conflict", "id"))),
    )


@rule("I-10")
def ordering(t: Tables) -> DataFrame:
    def again(coll: str, parent: str, text: str) -> DataFrame:
        rows = integrity.later_holders(t[coll], [parent, "seq"], ["_ord"], "id")
        return found(rows, (F.lit(True), say(text, parent, F.col("seq").cast("string"))))

    return union(
        again("steps", "runbook_id", "I-10: run-book %s: duplicate step seq %s"),
        again("automaton_events", "run_id", "I-10: automaton run %s: duplicate event seq %s"),
        again("flow_transition_events", "flow_run_id", "I-10: flow run %s: duplicate transition-event seq %s"),
    )


@rule("I-14")
def flow_totality(t: Tables) -> DataFrame:
    def state_flow(key: str) -> DataFrame:
        return keyed(t["flow_states"], key, **{f"{key}_flow": "flow_id"})

    flows = t["automaton_flows"].join(state_flow("initial_state_id"), "initial_state_id", "left")
    moves = t["flow_transitions"].join(state_flow("from_state_id"), "from_state_id", "left").join(state_flow("to_state_id"), "to_state_id", "left")
    away = lambda k: F.col(f"{k}_found").isNotNull() & (F.col(f"{k}_flow") != F.col("flow_id"))
    out = t["flow_transitions"].groupBy(F.col("from_state_id").alias("_key")).agg(F.collect_set("trigger").alias("triggers"))
    states = t["flow_states"].join(out, "_key", "left").withColumn("triggers", F.coalesce("triggers", F.array().cast("array<string>")))
    kind, no = F.col("kind"), lambda *k: ~F.arrays_overlap("triggers", F.array(*map(F.lit, k)))
    m = lambda s, *c: say("I-14: " + s, "_key", *c)
    return union(
        found(flows, (~F.col("initial_state_id_flow").eqNullSafe(F.col("_key")), m("flow %s: initial_state_id '%s' is not a state of this flow", "initial_state_id")), subject="_key"),
        found(
            moves,
            (~F.col("trigger").isin(*TRIGGERS), m("transition %s: unknown trigger '%s'", "trigger")),
            (away("from_state_id"), m("transition %s: from_state %s belongs to another flow", "from_state_id")),
            (away("to_state_id"), m("transition %s: to_state %s belongs to another flow", "to_state_id")), subject="_key",
        ),
        found(
            states,
            (~kind.isin("task", "wait", "end"), m("state %s: unknown kind '%s'", "kind")),
            ((kind == "task") & F.col("runbook_id").isNull(), m("task state %s: runbook_id required")),
            ((kind == "task") & no("run_completed"), m("task state %s: no run_completed transition")),
            ((kind == "task") & no("run_aborted"), m("task state %s: no run_aborted transition (failure must land somewhere)")),
            (kind.isin("wait", "end") & F.col("runbook_id").isNotNull(), m("%2$s state %1$s: runbook_id must be None", "kind")),
            ((kind == "wait") & no("timer", "external"), m("wait state %s: no timer/external transition")),
            ((kind == "end") & ~F.coalesce(F.col("outcome").isin("completed", "aborted"), F.lit(False)), m("end state %s: outcome must be completed|aborted, got '%s'", F.coalesce("outcome", F.lit("None")))),
            ((kind == "end") & (F.size("triggers") > 0), m("end state %s: no outgoing transitions allowed")), subject="_key",
        ),
    )


@rule("I-15")
def determinism(t: Tables) -> DataFrame:
    several = t["flow_transitions"].where("guard IS NULL").groupBy("from_state_id", "trigger").agg(F.count("*").alias("n"), F.min("_ord").alias("_ord"))
    return found(several, (F.col("n") > 1, say("I-15: state %s trigger '%s': %s guardless transitions — statically ambiguous", "from_state_id", "trigger", F.col("n").cast("string"))), subject="from_state_id")


@rule("I-16")
def flow_closure(t: Tables) -> DataFrame:
    rows = t["flow_runs"].join(keyed(t["flow_states"], "current_state_id", s_flow="flow_id", s_kind="kind"), "current_state_id")
    return found(
        rows,
        (F.col("s_flow") != F.col("flow_id"), say("I-16: flow run %s: current state %s belongs to another flow", "_key", "current_state_id")),
        (F.col("state").isin("done", "aborted") & (F.col("s_kind") != "end"), say("I-16: flow run %s: closed as %s outside an end state (in %s)", "_key", "state", "current_state_id")), subject="_key",
    )


@rule("STEP-POLICY")
def step_policy(t: Tables) -> DataFrame:
    p, task = F.col("step_policy"), F.col("kind") == "task"
    number = F.expr(r"try_cast(replace(regexp_extract(step_policy, '^retry:\\s*\\+?([0-9]+(_[0-9]+)*)\\s*$', 1), '_', '') AS DECIMAL(38,0))")
    valid = p.isin("abort", "skip") | F.coalesce(number >= 1, F.lit(False))
    return found(
        t["flow_states"],
        (task & p.isNull(), say("STEP-POLICY: task state %s: step_policy required (abort | skip | retry:<n>)", "_key")),
        (task & p.isNotNull() & ~valid, say("STEP-POLICY: task state %s: malformed step_policy '%s'", "_key", "step_policy")),
        (~task & p.isNotNull(), say("STEP-POLICY: %s state %s: step_policy must be None", "kind", "_key")), subject="_key",
    )


@rule("I-17")
def mutation_records(t: Tables, playbook: str = MUTATIONS) -> DataFrame:
    """The records of the playbook by which a system changes itself; its name is the caller's."""
    adopted, rung = F.col("verdict") == "adopted", F.col("rung")
    m = lambda s, *c: say("I-17: mutation record %s: " + s, "_key", *c)
    return found(
        t["decision_records"].where(F.col("playbook") == playbook),
        (rung.isNotNull() & ~rung.isin(*RUNGS), m(f"unknown rung '%s' (expected one of {', '.join(RUNGS)})", "rung")),
        (F.col("reason_status").isNotNull() & ~F.col("reason_status").isin("accepted", "pending"), m("unknown reason_status '%s' (expected accepted|pending)", "reason_status")),
        (adopted & rung.isNull(), m("adopted with no rung selected")),
        (adopted & F.col("touches_trust_boundary") & (F.size("voided_guarantees") == 0), m("touches trust boundary with no voided_guarantees declared")),
        (adopted & blank(F.col("reason")), m("adopted with no reason stated (mutation without reason is not allowed)")), subject="_key",
    )


def open_queue(t: Tables) -> DataFrame:
    """Open disclosures with their rank, in view order, and whether a triage is in flight."""
    flying = t["dispositions"].where("mode = 'triage' AND status = 'proposed'").select(F.col("disclosure_ref").alias("id"), F.lit(True).alias("flying")).distinct()
    rows = t["disclosures"].where("status = 'open'").join(flying, "id", "left").withColumn("triage_in_flight", F.coalesce("flying", F.lit(False))).drop("flying")
    return integrity.queue_view(rows, "kind", QUEUE_RANKS, ["seq", "_ord"])


@rule("I-13 bar")
def closure_bar(t: Tables) -> DataFrame:
    closed = t["harness_runs"].where("authority_scope = 'governance' AND state = 'closed'").select("_ord", F.col("id").alias("run"), "open_seq")
    rows = closed.join(open_queue(t).select("id", "seq", "pos"), F.col("seq") < F.col("open_seq"))
    return found(rows.withColumn("_ord", F.col("_ord").cast("bigint") * 1000 + F.col("pos")), (F.lit(True), say("I-13: governance run %s closed with undisposed backlog disclosure %s (seq %s < open_seq %s)", "run", "id", F.col("seq").cast("string"), F.col("open_seq").cast("string"))), subject="run")


@rule("I-13 orphan")
def orphan_queue(t: Tables) -> DataFrame:
    draining = t["harness_runs"].where("authority_scope = 'governance' AND state <> 'closed'")
    lost = integrity.unattended(open_queue(t), draining, "id", ["pos"])
    message = say("I-13: %s open disclosure(s) with no non-closed governance run draining (%s)", F.col("n").cast("string"), F.array_join("items", ", "))
    return lost.select(F.lit("queue").alias("subject"), F.lit(0).cast("bigint").alias("sub"), message.alias("message"))


def validate(t: Tables, only: Sequence[str] = (), *, mutation_playbook: str = MUTATIONS) -> DataFrame:
    """``rule_ord, rule, subject, sub, message`` of all violations (or of the rules named)."""
    own = {mutation_records: functools.partial(mutation_records, playbook=mutation_playbook)}
    picked = [(i, name, own.get(f, f)) for i, (name, f) in enumerate(RULES) if not only or name in only]
    return union(*(f(t).select(F.lit(i).alias("rule_ord"), F.lit(name).alias("rule"), "subject", "sub", "message") for i, name, f in picked))
