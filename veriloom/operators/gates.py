"""Validators of requests and of builds that the surveyed documents only specify, and the as-of join they need.

Each validator returns a row for everything that breaks one of its rules: an id, the
``rule`` and a ``message`` (own words: none are specified).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veriloom.functions import documents
from veriloom.operators.prefixes import running_merge

#: The fields of a request.
REQUEST_FIELDS = ("request_id", "request_type", "input", "output_contract", "role", "role_hash")


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, values: Sequence[str], *, since: str | None = None, parts: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` that has its ``on`` and an ``at`` not after its own.

    ``right``'s column of time is ``since`` (default: ``at``); of rows at one time the
    greatest values count.  Null where there is none.  The last values run along each
    key's rows (``running_merge``), so a key may have any number of rows.
    """
    since = since or at
    held = StructType([right.schema[v] for v in values])
    mine = left.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(on)), F.col(f"`{at}`").alias("__at"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("__row"))
    mine = mine.withColumns({"__side": F.lit(1), "__tie": F.monotonically_increasing_id().cast("string"), "__given": F.lit(None).cast("string")})
    row = F.to_json(F.struct(*(F.col(f"`{v}`") for v in values)), {"ignoreNullFields": "false"})
    theirs = right.select(*(F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(on)), F.col(f"`{since}`").cast(mine.schema["__at"].dataType).alias("__at"), row.alias("__tie"))
    theirs = theirs.withColumns({"__side": F.lit(0), "__given": F.to_json(F.create_map(F.lit("v"), "__tie")), "__row": F.lit(None).cast(mine.schema["__row"].dataType)})
    both = running_merge(mine.unionByName(theirs), [f"__k{i}" for i in range(len(on))], ["__at", "__side", "__tie"], "__given", into="__held", parts=parts).where("__side = 1")
    found = F.from_json(F.get_json_object("__held", "$.v"), held)
    return both.withColumn("__found", found).select("__row.*", *(F.col(f"__found.`{v}`").alias(v) for v in values))


def _say(df: DataFrame, key: str, rule: str, message: Column | str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), F.lit(rule).alias("rule"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def not_contained(sets: DataFrame, key: str, members: str, allowed: DataFrame, on: str, member: str) -> DataFrame:
    """``key, outside``: members of a row's set that its ``on`` doesn't allow (``allowed``: on, member; a set-containment join)."""
    each = sets.select(key, on, F.explode(F.array_distinct(members)).alias(member))
    lost = each.join(allowed.select(on, member).distinct(), [on, member], "left_anti")
    return lost.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("outside"))


def issuance(requests: DataFrame, kinds: DataFrame, roles: DataFrame, inputs: Mapping[str, Mapping]) -> DataFrame:
    """R1 to R5 of requests before they are issued.

    ``requests``: the request fields (``input`` as JSON) and ``fields``, the names that
    the record carries; ``kinds``: request_type, kind (what a type may put out; a type
    without any has one row with a null); ``roles``: role, role_hash of sealed bundles;
    ``inputs``: the JSON schema of each type's input.
    """
    known = requests.join(kinds.select("request_type").distinct(), "request_type", "left_semi")
    wrong = F.array().cast("array<string>")
    for name, schema in inputs.items():
        wrong = F.when(F.col("request_type") == name, documents.errors(F.col("input"), schema)).otherwise(wrong)
    shaped = known.withColumn("errors", wrong).where(F.size("errors") > 0)
    beyond = not_contained(known, "request_id", "output_contract", kinds, "request_type", "kind")
    sealed = roles.groupBy("role").agg(F.collect_set("role_hash").alias("hashes"))
    lost = requests.join(sealed, "role", "left").where(~F.coalesce(F.array_contains("hashes", F.col("role_hash")), F.lit(False)))
    more = requests.withColumn("more", F.array_except("fields", F.array(*map(F.lit, REQUEST_FIELDS)))).where(F.size("more") > 0)
    return _all(
        _say(requests.join(known.select("request_id"), "request_id", "left_anti"), "request_id", "R1", F.concat(F.lit("unknown request type "), F.coalesce("request_type", F.lit("None")))),
        _say(shaped, "request_id", "R2", F.concat(F.lit("input: "), F.array_join("errors", "; "))),
        _say(beyond, "request_id", "R3", F.concat(F.lit("contract beyond its type: "), F.array_join("outside", ", "))),
        _say(lost, "request_id", "R4", F.when(F.col("hashes").isNull(), "role has no sealed bundle").otherwise("role hash differs from its bundle")),
        _say(more, "request_id", "R5", F.concat(F.lit("fields beyond the record: "), F.array_join("more", ", "))),
    )


def ingest(requests: DataFrame, artifacts: DataFrame, responses: DataFrame, dispositions: DataFrame, results: Mapping[str, Mapping]) -> DataFrame:
    """I1 to I3 of what a turn brings back; the id is the request's.

    ``artifacts``: request_id (the turn), name, kind, request_ref, disposition_ref;
    ``responses``: request_id (the turn), cites, disposition_ref, refusal, result (JSON);
    ``dispositions``: disposition_id; ``results``: the JSON schema of each type's result.
    """
    contract = requests.select("request_id", F.explode("output_contract").alias("kind")).distinct()
    recorded = dispositions.select(F.col("disposition_id").alias("disposition_ref"), F.lit(True).alias("recorded")).distinct()
    outside = artifacts.join(contract, ["request_id", "kind"], "left_anti")
    cited = artifacts.join(recorded, "disposition_ref", "left")
    told = responses.join(recorded, "disposition_ref", "left").join(requests.select("request_id", "request_type"), "request_id", "left")
    wrong = F.array().cast("array<string>")
    for name, schema in results.items():
        wrong = F.when(F.col("request_type") == name, documents.errors(F.col("result"), schema)).otherwise(wrong)
    refused = F.coalesce("refusal", F.lit(False))
    told = told.withColumn("errors", F.when(~refused, wrong).otherwise(F.array().cast("array<string>")))
    return _all(
        _say(outside, "request_id", "I1", F.concat(F.lit("artifact "), "name", F.lit(" of a kind outside the contract: "), F.coalesce("kind", F.lit("None")))),
        _say(cited.where(~F.col("request_ref").eqNullSafe(F.col("request_id"))), "request_id", "I2", F.concat(F.lit("artifact "), "name", F.lit(" cites another request"))),
        _say(cited.where("recorded IS NULL"), "request_id", "I2", F.concat(F.lit("artifact "), "name", F.lit(" cites no recorded disposition"))),
        _say(told.where(~F.col("cites").eqNullSafe(F.col("request_id"))), "request_id", "I3", "response cites another request"),
        _say(told.where(~refused & F.col("recorded").isNull()), "request_id", "I3", "response cites no recorded disposition"),
        _say(told.where(F.size("errors") > 0), "request_id", "I3", F.concat(F.lit("result: "), F.array_join("errors", "; "))),
    )


def exit_codes(responses: DataFrame, findings: DataFrame) -> DataFrame:
    """``request_id, code``: 4 for a refusal, 1 where something was found, else 0."""
    bad = findings.select(F.col("id").alias("request_id"), F.lit(True).alias("bad")).distinct()
    return responses.join(bad, "request_id", "left").select("request_id", F.when(F.coalesce("refusal", F.lit(False)), 4).when(F.col("bad"), 1).otherwise(0).alias("code"))


def factory(t: Mapping[str, DataFrame], *, parts: int | None = None) -> DataFrame:
    """I-F1 to I-F9 over the records of a factory; the id is the build's, draft's or matter's.

    ``drafts``: draft_id, turn_id, reason_status, touches_trust_boundary, machinery,
    verifier_version; ``verifications``: verification_id, draft_id, build_id, passed,
    abstained; ``builds``: build_id, first_hash, second_hash, inference, hermetic;
    ``contents``: build_id, draft_id; ``states``: build_id, seq, hash (each change of a
    build); ``dispositions``: disposition_id, subject, kind (buildability, authorize),
    mode, hash, verification_id, acknowledges (array), impact; ``promotions``: build_id,
    disposition_id, seq; ``attempts``: build_id, seq, failed, environment_fault;
    ``amendments``: machinery, version, seq; ``matters``: matter_id, machinery, seq,
    version.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    acts = t["dispositions"]
    passed = t["verifications"].where("passed AND NOT coalesce(abstained, false)").select("draft_id", F.lit(True).alias("verified")).distinct()
    buildable = acts.where("kind = 'buildability'").select(F.col("subject").alias("draft_id"), F.lit(True).alias("cleared")).distinct()
    used = t["contents"].join(passed, "draft_id", "left").join(buildable, "draft_id", "left")
    drafts = t["drafts"]
    of_build = t["contents"].join(drafts, "draft_id", "left")

    authority = acts.select("disposition_id", "kind", "mode", F.col("hash").alias("bound"), "verification_id", "acknowledges", "impact")
    cited = t["verifications"].select("verification_id", F.col("build_id").alias("verified_build"))
    promoted = as_of(t["promotions"], t["states"], ["build_id"], "seq", ["hash"], parts=parts).join(authority, "disposition_id", "left").join(cited, "verification_id", "left")
    pending = of_build.where("reason_status = 'pending'").select("build_id", F.lit(True).alias("pending")).distinct()
    abstained = t["verifications"].where("abstained").select("build_id", F.lit(True).alias("abstained")).distinct()
    touching = of_build.where("touches_trust_boundary").select("build_id", F.lit(True).alias("touching")).distinct()
    judged = promoted.join(pending, "build_id", "left").join(abstained, "build_id", "left").join(touching, "build_id", "left")
    owns = lambda what: (F.col("mode") == "overrule") & F.coalesce(F.array_contains("acknowledges", what), F.lit(False))

    # A failed attempt may be followed by another only if a fault of the environment is attested.
    tries = as_of(t["attempts"], t["attempts"].select("build_id", (F.col("seq") + 1).alias("from"), F.col("failed").alias("failed_before"), F.col("environment_fault").alias("fault_before")), ["build_id"], "seq", ["failed_before", "fault_before"], since="from", parts=parts)
    force = as_of(t["matters"], t["amendments"].withColumnRenamed("version", "in_force"), ["machinery"], "seq", ["in_force"], parts=parts)
    return _all(
        _say(used.where("verified IS NULL"), "build_id", "I-F1", F.concat(F.lit("draft "), "draft_id", F.lit(" without a passing verification"))),
        _say(used.where("cleared IS NULL"), "build_id", "I-F1", F.concat(F.lit("draft "), "draft_id", F.lit(" without a buildability disposition"))),
        _say(t["builds"].where(true("inference")), "build_id", "I-F2", "built with an inference backend"),
        _say(t["builds"].where(~F.col("first_hash").eqNullSafe(F.col("second_hash"))), "build_id", "I-F2", "two derivations differ"),
        _say(t["builds"].where(~true("hermetic")), "build_id", "I-F2", "no receipt of hermeticity"),
        _say(judged.where(~F.col("kind").eqNullSafe("authorize") | ~F.col("bound").eqNullSafe(F.col("hash"))), "build_id", "I-F3", "the build isn't the one that was authorized"),
        _say(judged.where(~F.col("verified_build").eqNullSafe(F.col("build_id"))), "build_id", "I-F3", "the authorization cites no verification of the build"),
        _say(judged.where(F.col("pending") & ~F.coalesce(owns("pending"), F.lit(False))), "build_id", "I-F4", "pending reasons without an overrule that acknowledges them"),
        _say(drafts.where(~some("turn_id")), "draft_id", "I-F5", "draft cites no turn"),
        _say(t["builds"].join(t["contents"].select("build_id").distinct(), "build_id", "left_anti"), "build_id", "I-F5", "build cites no draft"),
        _say(of_build.join(drafts.select("draft_id"), "draft_id", "left_anti"), "build_id", "I-F5", F.concat(F.lit("unknown draft "), "draft_id")),
        _say(judged.where(F.col("abstained") & ~F.coalesce(owns("abstention"), F.lit(False))), "build_id", "I-F6", "a verification abstained without an overrule that names it"),
        _say(drafts.where(true("touches_trust_boundary") & ~(some("machinery") & some("verifier_version"))), "draft_id", "I-F7", "the governed machinery or its verifier isn't declared"),
        _say(judged.where(F.col("touching") & ~some("impact")), "build_id", "I-F7", "the authorization declares no governance impact"),
        _say(force.where(~F.col("version").eqNullSafe(F.col("in_force"))), "matter_id", "I-F8", F.format_string("judged under %s, opened under %s", F.coalesce("version", F.lit("None")), F.coalesce("in_force", F.lit("None")))),
        _say(tries.where(true("failed_before") & ~true("fault_before")), "build_id", "I-F9", "tried again after a failure without an attested fault of the environment"),
    )
