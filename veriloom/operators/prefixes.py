"""Running merges: what the rows of a run up to each row come to, for runs of any length and any keys.

A run's payloads are JSON objects that are merged key by key in order, as a dict is
updated.  Rows are dealt to ranges of (run, order), so a long run lies in several
ranges.  Only for such runs, each range first gives the keys that its part of the run
ends with; a key's value is handed on to the ranges up to the next one that sets it
(or that starts the run anew).  Then each range is folded by itself, row after row,
from what was handed on.  A task holds one row's map at a time, never a run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veriloom.sources.tables import settled

#: What a handed-on name stands for: a key of the payload, or a column of the row before.
KEY, COLUMN = "k", "c"


def running_merge(
    log: DataFrame, run: Sequence[str], order: Sequence[str], payload: str, *,
    into: str = "merged", previous: Sequence[str] = (), resets: Column | None = None, inclusive: bool = True, highest: bool = False, parts: int | None = None,
) -> DataFrame:
    """``log`` with ``into``, the merged payloads of the run's rows up to each row, as JSON with sorted keys.

    ``inclusive``: with the row's own payload.  ``previous``: string columns of which
    ``<name>_before`` gives the run's row before (null at its first).  Where
    ``resets`` holds, what came before is dropped.  ``highest``: values are whole
    numbers, and of each key the highest stays, not the last (without ``resets``).
    ``order`` tells a run's rows apart.  ``parts``: the number of ranges (default: Spark's).

    A payload that is null, no JSON or no object merges nothing.  Runs may be null.
    """
    if highest and resets is not None:
        raise ValueError("resets don't go with the highest values")
    runs = [f"__r{i}" for i in range(len(run))]
    marked = log.withColumns({n: F.col(c) for n, c in zip(runs, run)} | {"__payload": F.col(payload).cast("string"), "__reset": F.coalesce(resets, F.lit(False)) if resets is not None else F.lit(False)})
    ranged = marked.repartitionByRange(parts, *runs, *order) if parts else marked.repartitionByRange(*runs, *order)
    dealt = settled(ranged.withColumn("__part", F.spark_partition_id()))

    given = _handed_on(dealt, runs, order, previous, highest)
    carry_type = given.schema["__carry"].dataType
    lines = dealt.withColumn("__carry", F.lit(None).cast(carry_type)).unionByName(given, allowMissingColumns=True).withColumn("__own", F.col("__carry").isNull())
    out = StructType([*log.schema.fields, StructField(into, StringType()), *(StructField(f"{c}_before", StringType()) for c in previous)])
    names, n_runs, n_state = log.columns, len(runs), 4 + len(runs) + len(previous)

    def fold(batches):
        import json

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, place, state, before = to_arrow_schema(out), None, {}, {}
        for batch in batches:
            own, merged, priors = [], [], [[] for _ in previous]
            for i, (part, *rest) in enumerate(zip(*(column.to_pylist() for column in batch.columns[:n_state]))):
                row_run, (given_text, reset, carry), values = rest[:n_runs], rest[n_runs : n_runs + 3], rest[n_runs + 3 :]
                if place != (part, row_run):
                    place, state, before = (part, row_run), {}, {}
                if carry is not None:
                    for name, value in carry:
                        (state if name[0] == KEY else before)[name[1:]] = json.loads(value)
                    continue
                own.append(i)
                text = None if inclusive else _text(state)
                if reset:
                    state = {}
                _merge(state, _object(given_text), highest)
                merged.append(_text(state) if inclusive else text)
                for column, c in zip(priors, previous):
                    column.append(before.get(c))
                before = dict(zip(previous, values))
            if own:
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([*(column.take(at) for column in batch.columns[n_state:]), *(pa.array(c, pa.string()) for c in (merged, *priors))], schema=arrow)

    wanted = ["__part", *runs, "__payload", "__reset", "__carry", *(F.col(f"`{c}`").cast("string").alias(f"__p{k}") for k, c in enumerate(previous)), *(F.col(f"`{c}`") for c in names)]
    ordered = lines.repartition("__part").sortWithinPartitions("__part", *runs, "__own", *order)
    return ordered.select(*wanted).mapInArrow(fold, out)


def _object(text: str | None) -> dict:
    import json

    try:
        found = json.loads(text) if text else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _merge(state: dict, found: dict, highest: bool) -> None:
    if highest:
        found = {k: v for k, v in found.items() if k not in state or v > state[k]}
    state.update(found)


def _text(state: dict) -> str:
    import json

    return json.dumps(state, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _handed_on(dealt: DataFrame, runs: list[str], order: Sequence[str], previous: Sequence[str], highest: bool) -> DataFrame:
    """``__part, runs, __carry``: for each later range of a run that lies in several, what it starts from."""
    spans = dealt.groupBy(*runs).agg(F.min("__part").alias("__from"), F.max("__part").alias("__to")).where("__from < __to")
    names = [f"{r}s" for r in runs]
    spread = spans.select(*(F.col(r).alias(n) for r, n in zip(runs, names)), "__to")
    same = lambda: [F.col(r).eqNullSafe(F.col(n)) for r, n in zip(runs, names)]
    rows = dealt.join(spread.select(*names), same(), "left_semi").repartition("__part").sortWithinPartitions("__part", *runs, *order)
    ends = StructType([dealt.schema["__part"], *(dealt.schema[r] for r in runs), StructField("name", StringType()), StructField("value", StringType())])
    n_runs = len(runs)

    def last(batches) -> Iterator:
        import json

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, place, state, before, anew, made = to_arrow_schema(ends), None, {}, {}, False, []

        def end() -> None:
            if place is not None:
                part, row_run = place
                found = [(KEY + k, json.dumps(v)) for k, v in state.items()] + [(COLUMN + c, json.dumps(v)) for c, v in before.items()]
                made.extend((part, *row_run, name, value) for name, value in ([(None, None)] if anew else []) + found)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)
            made.clear()
            return batch

        for batch in batches:
            for part, *rest in zip(*(column.to_pylist() for column in batch.columns)):
                row_run, (payload, reset), values = rest[:n_runs], rest[n_runs : n_runs + 2], rest[n_runs + 2 :]
                if place != (part, row_run):
                    end()
                    place, state, before, anew = (part, row_run), {}, {}, False
                if reset:
                    state, anew = {}, True
                _merge(state, _object(payload), highest)
                before = dict(zip(previous, values))
            if made:
                yield out()
        end()
        if made:
            yield out()

    chosen = rows.select("__part", *runs, "__payload", "__reset", *(F.col(f"`{c}`").cast("string").alias(f"__p{k}") for k, c in enumerate(previous)))
    found = settled(chosen.mapInArrow(last, ends))
    if highest:
        so_far = W.partitionBy(*runs, "name").orderBy("__part").rowsBetween(W.unboundedPreceding, 0)
        top = F.max(F.when(F.substring("name", 1, 1) == KEY, F.col("value").cast("bigint"))).over(so_far).cast("string")
        found = found.withColumn("value", F.coalesce(top, "value"))
    # The first range after a part's own that starts the run anew: nothing is handed on beyond it.
    starts = found.groupBy("__part", *runs).agg(F.max(F.col("name").isNull()).alias("anew"))
    after = W.partitionBy(*runs).orderBy("__part").rowsBetween(1, W.unboundedFollowing)
    starts = starts.withColumn("until", F.min(F.when(F.col("anew"), F.col("__part"))).over(after)).select(F.col("__part").alias("__p"), *(F.col(r).alias(f"{r}p") for r in runs), "until")
    again = F.lead("__part").over(W.partitionBy(*runs, "name").orderBy("__part"))
    keys = found.where("name IS NOT NULL").withColumn("again", again)
    keys = keys.join(starts, [F.col("__part") == F.col("__p"), *(F.col(r).eqNullSafe(F.col(f"{r}p")) for r in runs)]).join(spread, same())
    stays = F.when(F.substring("name", 1, 1) == KEY, F.col("until"))
    end = F.least(F.coalesce("again", "__to"), F.coalesce(stays, "__to"), F.col("__to"))
    reach = keys.withColumn("end", end).where("end > __part").withColumn("__part", F.explode(F.sequence(F.col("__part") + 1, F.col("end"))))
    return reach.groupBy("__part", *runs).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__carry"))
