import json

import pytest
from pyspark.sql import functions as F

from veriloom.functions import guards, text

CTX = [
    {}, {"a": None}, {"a": 0}, {"a": 1}, {"a": True}, {"a": False}, {"a": "1"}, {"a": ""}, {"a": "x"}, {"a": 1.5}, {"a": {}}, {"a": []}, {"a": {"b": 2}}, {"a": {"b": None}}, {"a": [1]}, {"a": 1, "b": 1.0}, {"a": "x", "b": "x"},
]
EXPRS = ["ctx.a", "not ctx.a", "ctx.a == 1", "ctx.a != 1", "ctx.a == '1'", "ctx.a == None", "ctx.a == True", "ctx.a and ctx.b", "ctx.a or ctx.b", "ctx.a == ctx.b", "ctx.a == ctx.b == 1", "ctx.a.b == 2", "ctx.a.b", "(ctx.a or 'x') == 'x'", "not (ctx.a and ctx.b) == True", "True", "ctx.a != 'x' and not ctx.b", "ctx"]


def test_guards_follow_python(spark):
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(CTX)], "i int, ctx string")
    row = df.select("i", *(guards.compile_guard(e, {"ctx": F.col("ctx")}).alias(f"g{k}") for k, e in enumerate(EXPRS))).orderBy("i").collect()
    for i, c in enumerate(CTX):
        for k, e in enumerate(EXPRS):
            assert row[i][f"g{k}"] == guards.evaluate(e, {"ctx": c}), (e, c)


@pytest.mark.parametrize("bad", ["ctx.a < 1", "f()", "ctx['a']", "a + 1", "other.a", "ctx.__class__", "1 if ctx.a else 2", "", "ctx.a in ctx.b"])
def test_guards_refuse(bad):
    with pytest.raises(guards.GuardError):
        guards.compile_guard(bad, {"ctx": F.lit("{}")})


def test_strict_guards(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{}",)], "ctx string")
    rows = df.select(guards.compile_guard("ctx.a == 1 or ctx.b == 2", {"ctx": F.col("ctx")}, strict=True).alias("g")).collect()
    assert [r.g for r in rows] == [True, None]


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert [one(text.blank(lit(s))) for s in ("", " \t  ", "x", None)] == [True, True, False, True]
    assert [one(text.slug(lit(s))) for s in ("A b--C!", "..x", "!!", "Straße")] == ["a-b--c", "..x", "x", "stra-e"]
    assert one(text.slug_letters(lit("A b.Ü1"))) == "A-b-Ü1"
    assert sorted(["a10", "a9", "b1"], key=lambda s: one(text.natural_key(lit(s)))) == ["a9", "a10", "b1"]
    assert [one(text.version_bump(lit(a), lit(b))) for a, b in (("1.2.3", "2.0"), ("1.2", "1.3.1"), ("1.2.3", "1.2.4rc1"), ("1.2.0", "1.2"), ("1", "1.0.0"))] == ["major", "minor", "patch", "patch", "patch"]
    policy = lambda mode, new: tuple(one(text.update_policy(lit(mode), lit("1.2.3"), lit(new), lit("minor"))))
    assert policy("auto", "1.3.0") == ("drive", "policy=auto, bump=minor within minor", False)
    assert policy("auto", "1.2.3") == ("drive", "policy=auto, bump=patch within minor", False)
    assert policy("auto", "2.0.0") == ("defer", "policy=auto but bump=major exceeds minor", True)
    assert policy("notify", "1.2.4") == ("defer", "policy=notify: surfaced, not driven", True)
    assert policy("off", "2.0") == ("defer", "policy=off: recorded only", False)
    assert policy("odd", "2.0") == ("abort", "unknown updater policy: 'odd'", False)
    assert [one(text.within(lit(p), lit("/a/b"))) for p in ("/a/b", "/a/b/c", "/a/bc", "/a/b/../c", "/a//b/x")] == [True, True, False, False, True]
    assert [one(text.mime_type(lit(p))) for p in ("x.JSON", "y", "z.png")] == ["application/json", "application/octet-stream", "image/png"]


def test_every_item_of_an_array_is_checked(spark):
    from veriloom.functions import documents

    rows = [(json.dumps([1] * 99 + ["x"] + [2]),), (json.dumps([[1] * 70 + ["y"]]),)]
    df = spark.createDataFrame(rows, "d string")
    got = [df.select(documents.errors(F.col("d"), schema).alias("e")).collect()[i].e for i, schema in enumerate(({"items": {"type": "integer"}}, {"items": {"items": {"type": "integer"}}}))]
    assert got == [["/99/: not integer"], ["/0/70/: not integer"]]
    deep = {"type": "integer"}
    for _ in range(13):
        deep = {"items": deep}
    with pytest.raises(ValueError):
        documents.errors(F.col("d"), deep)


def test_minted_identifiers(spark):
    import uuid

    from veriloom.functions import text

    ids = [r.i for r in spark.range(20).select(text.minted().alias("i")).collect()]
    assert len(set(ids)) == 20 and all(uuid.UUID(i).version == 4 for i in ids)


def test_documents_are_parsed_once(spark):
    from veriloom.functions import documents

    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 3}, "b": {"enum": ["x", 1]}}}
    df = spark.createDataFrame([(1, '{"a": 2, "b": "y"}'), (2, '{"a": 3}'), (3, "[]"), (4, None), (5, '{"b": 1}')], "i int, doc string")
    got = documents.listed(df, ["i"], F.col("doc"), schema)
    assert sorted((r.i, r.error) for r in got.collect()) == sorted((r.i, e) for r in df.select("i", documents.errors(F.col("doc"), schema).alias("e")).collect() for e in r.e or [])
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1
