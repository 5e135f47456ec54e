"""MinHash near-duplicates by a signature-coordinate inverted join.

Rows with the same shingle set are one class.  A class has a signature of
``coordinates`` minimum hashes and is posted under coordinate-value pairs.  Two
classes can only be similar enough if at least ``needed`` coordinates agree (the
chance that a linked pair has fewer is under ``miss``), so by the prefix
principle it is enough to post a class under its rarest values, all but
``needed - 1`` of those it shares with any other class; the long lists of common
values are skipped while merging and only looked up when a pair's agreements are
counted.  Pairs over the match threshold are confirmed on full shingle sets.

No list is expanded into all its pairs.  First each member meets the list's
centre (the class whose values are the most common) on full sets; what is kept of
it is the difference between its set and the centre's.  Members that are linked to
the centre are in one component and need not meet one another.  Those that are not
(*far* ones) meet the others of that centre in blocks of bounded size (``crossed``):
their agreements are counted, and pairs over the match threshold are confirmed by
the exact size of their intersection, which two differences from one set give.  A
block emits a spanning forest of its links.  So a list of thousands of copies of
one text costs thousands of rows, and no link is lost to a cap.

Defined results: a null, empty or blank text has no shingles, is linked with
nothing and is its own component; a text with fewer words than a shingle has one
shingle, its whole word sequence; repeated rows are one class; ``component_id``
is the least id reachable; a null id stays null and takes its class's component
if that has an id; an empty table gives an empty result; other columns are
neither read nor returned by ``near_duplicates``.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StructField, StructType

from veriloom.llm.columns import drop_table, map_texts, shared_table
from veriloom.llm.graph import components

_CHUNK = 1 << 15
_U = np.uint64


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased)."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()  # ASCII letters and white space only
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxh3_64_intdigest, words), _U, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, _U(width))
    for i in range(width):
        out = (out ^ h[i : i + n]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return np.unique(out)


def multipliers(coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(b"coordinate %d" % i, digest_size=8).digest() for i in range(coordinates)), "<u8") | _U(1)


def signature(values: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """For each coordinate the shingle that is least in that coordinate's order, marked with the coordinate."""
    best = least = None
    for i in range(0, len(values), _CHUNK):
        part = values[i : i + _CHUNK]
        keys = part[:, None] * odd[None, :]
        keys ^= keys >> _U(32)
        keys *= odd[None, :]
        at = keys.argmin(axis=0)
        low, value = keys[at, np.arange(len(odd))], part[at]
        if best is None:
            best, least = value, low
        else:
            better = low < least
            best, least = np.where(better, value, best), np.where(better, low, least)
    return (best ^ odd) * _U(0xD6E8FEB86659FD93)


def needed_matches(coordinates: int, similarity: float, miss: float) -> int:
    """The most agreements that a pair of this similarity has but for a chance of ``miss``."""
    tail, k = 0.0, 0
    while k < coordinates:
        tail += comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if tail > miss:
            break
        k += 1
    return max(1, k)


def signatures(df: DataFrame, *, width: int, coordinates: int, id_col: str, text_col: str) -> DataFrame:
    """``id_col, n_shingles, key, coords``; key: a 16-byte digest of the set (null: no shingles)."""

    def make():
        odd = multipliers(coordinates)

        def apply(texts):
            n, keys, coords = [], [], []
            for text in texts:
                values = shingle_set(text, width)
                n.append(len(values))
                keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                coords.append(signature(values, odd).view(np.int64) if len(values) else None)
            return [n, keys, coords]

        return apply

    return map_texts(df, make, "n_shingles bigint, key binary, coords array<bigint>", id_col, text_col)


def near_duplicates(
    df: DataFrame,
    *,
    width: int = 5,
    percent: int = 80,
    coordinates: int = 32,
    miss: float = 1e-6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row.

    Links rows whose sets' intersection is at least ``percent`` hundredths of
    their union; ``kept`` marks the row with the component's own id.
    """
    needed = needed_matches(coordinates, percent / 100, miss)
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    base = shared_table(signatures(source, width=width, coordinates=coordinates, id_col="id", text_col="text"))
    classes = shared_table(base.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n_rows"), F.first("coords").alias("coords")))
    posted = shared_table(postings(classes, needed))
    sets = shared_table(candidate_sets(source, posted, width, coordinates))
    star = shared_table(stars(posted, sets, needed, percent))
    links = shared_table(star.where("linked").select("a", "b").union(crossed(star, needed, percent)))
    roots = components(links)

    named = classes.select("key", "rep", "n_rows").join(roots.withColumnRenamed("node", "key"), "key", "left")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("component_id"))
    lone = named.where("root IS NULL AND n_rows > 1").select("key", F.col("rep").alias("component_id"))
    final = shared_table(named.where("root IS NOT NULL").join(least, "root").select("key", "component_id").union(lone))
    for done in (classes, posted, sets, star, links, roots):
        drop_table(done)
    return (
        base.select("id", "n_shingles", "key").join(final, "key", "left")
        .select(
            F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.col("component_id").isNull()).alias("kept"),
        )
    )


def postings(classes: DataFrame, needed: int) -> DataFrame:
    """``key, rep, score, posts``: each class with its rarest shared values, under which it is posted.

    ``score`` sums how common the class's values are; the text that a group of
    copies was made from scores highest among them.
    """
    values = classes.select("key", "rep", F.explode("coords").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    return (
        values.join(shared, "value")
        .groupBy("key").agg(F.first("rep").alias("rep"), F.array_sort(F.collect_list(F.struct("n", "value"))).alias("own"))
        .where(F.size("own") >= needed)
        .select(
            "key", "rep", F.aggregate("own", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]).alias("score"),
            F.transform(F.slice("own", 1, F.size("own") - (needed - 1)), lambda x: x["value"]).alias("posts"),
        )
    )


def candidate_sets(source: DataFrame, posted: DataFrame, width: int, coordinates: int) -> DataFrame:
    """``key, coords, members``: signatures and full shingle sets (hashes, 8 bytes each) of all posted classes.

    Texts are found by the id of their class's ``rep``.  Those of classes without
    any id are found by their key, which all rows without an id are digested for.
    """
    digested = StructType([StructField("key", BinaryType()), StructField("coords", BinaryType()), StructField("members", BinaryType())])

    def run(batches):
        import pyarrow as pa

        odd = multipliers(coordinates)
        for batch in batches:
            keys, coords, members = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = shingle_set(text.as_py() or "", width)
                own = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
                if len(values) and (own == key or key is None):  # not another row of that id
                    keys.append(own)
                    coords.append(signature(values, odd).tobytes())
                    members.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (keys, coords, members)], names=digested.names)

    def digest(texts: DataFrame) -> DataFrame:
        return texts.mapInArrow(run, digested)

    named = digest(source.join(posted.where("rep IS NOT NULL").select(F.col("rep").alias("id"), "key"), "id").select("key", "text"))
    nameless = digest(source.where("id IS NULL").select(F.lit(None).cast("binary").alias("key"), "text")).join(posted.where("rep IS NULL").select("key"), "key", "left_semi")
    return named.union(nameless).dropDuplicates(["key"])


def stars(posted: DataFrame, sets: DataFrame, needed: int, percent: int) -> DataFrame:
    """``a, b, linked, n, coords, apart``: each class ``a`` beside the centres ``b`` of the lists that it is in.

    ``linked``: enough agreements, and enough in common on full sets.  ``apart``:
    the hashes that only one of both sets has; ``n`` and ``coords`` are ``a``'s.
    A class is in few lists (no more than it has posts), so its centres are
    gathered by class and the pairs meet ``a``'s set where they are.
    """
    out = StructType(
        [StructField("a", BinaryType()), StructField("b", BinaryType()), StructField("linked", BooleanType()), StructField("n", IntegerType()), StructField("coords", BinaryType()), StructField("apart", BinaryType())]
    )
    listed = posted.select("key", "score", F.explode("posts").alias("value"))
    centre = listed.groupBy("value").agg(F.max(F.struct("score", "key")).alias("top")).select("value", F.col("top.key").alias("b"))
    pairs = listed.select("value", F.col("key").alias("a")).join(centre, "value").where("a <> b").groupBy("a").agg(F.collect_set("b").alias("b"))
    one = pairs.join(sets.toDF("a", "ca", "sa"), "a").select("a", F.explode("b").alias("b"), "ca", "sa")
    both = one.join(sets.toDF("b", "cb", "sb"), "b").select("a", "b", "ca", "sa", "cb", "sb")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            linked, sizes, apart = [], [], []
            for ca, sa, cb, sb in zip(*(batch.column(i) for i in range(2, 6))):
                x, y = np.frombuffer(sa.as_buffer(), _U), np.frombuffer(sb.as_buffer(), _U)
                agree = int((np.frombuffer(ca.as_buffer(), _U) == np.frombuffer(cb.as_buffer(), _U)).sum())
                rest = np.setxor1d(x, y, assume_unique=True)
                common = (len(x) + len(y) - len(rest)) // 2
                linked.append(agree >= needed and 100 * common >= percent * (len(x) + len(y) - common))
                sizes.append(len(x))
                apart.append(rest.tobytes())
            columns = [batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary()), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int32()), batch.column(2).cast(pa.binary()), pa.array(apart, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return both.mapInArrow(run, out)


def crossed(star: DataFrame, needed: int, percent: int, *, least_rows: int = 256, most_rows: int = 4096, most_hashes: int = 1 << 22) -> DataFrame:
    """``a, b``: a spanning forest of the links between a centre's far members and its other members.

    A centre's far and linked members are dealt by hash to blocks of about
    ``least_rows`` (more, up to ``most_rows``, around centres with very many
    members), and of no more than about ``most_hashes`` differing hashes.  Each
    pair of blocks, at least one of them of far members, is one group.  So a task
    holds two blocks, whatever the size of the list.
    """
    rows = F.count_if("linked"), F.count_if(~F.col("linked"))
    hashes = (F.sum(F.when(test, F.length("apart"))) / 8 for test in (F.col("linked"), ~F.col("linked")))
    counts = star.groupBy("b").agg(*(c.alias(n) for c, n in zip((*rows, *hashes), ("near_rows", "far_rows", "near_hashes", "far_hashes"))))
    held = F.least(F.lit(most_rows), F.greatest(F.lit(least_rows), F.ceil((F.col("near_rows") + F.col("far_rows")) / 64)))
    blocks = lambda side: F.ceil(F.greatest(F.col(f"{side}_rows") / held, F.coalesce(F.col(f"{side}_hashes"), F.lit(0)) / most_hashes)).cast("int")
    counts = counts.where("far_rows > 0 AND near_rows + far_rows > 1").select("b", blocks("far").alias("n_far"), blocks("near").alias("n_near"))
    own = F.when(F.col("linked"), F.col("n_far") + F.pmod(F.xxhash64("a"), F.greatest("n_near", F.lit(1)))).otherwise(F.pmod(F.xxhash64("a"), "n_far")).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("linked"), F.col("n_far")).otherwise(F.col("n_far") + F.col("n_near")) - 1)
    dealt = (
        star.join(counts, "b").withColumn("own", own).withColumn("other", F.explode(others))
        .select("b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "a", "linked", "n", "coords", "apart")
    )
    out = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])

    def run(table):
        return _forest(table, needed, percent)

    # Rows come dealt by centre, which would do for the groups: dealt again, a centre's pairs of blocks are many tasks' work.
    return dealt.repartition("b", "i", "j").groupBy("b", "i", "j").applyInArrow(run, out)


def _forest(table, needed: int, percent: int, tile: int = 512, wide: int = 4096):
    """The links of one pair of blocks, each component joined to one of its members (or to the centre)."""
    import pyarrow as pa

    keys, centre = table.column("a").to_pylist(), table.column("b")[0].as_py()
    own, linked, n = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("own", "linked", "n"))
    first, second = int(table.column("i")[0].as_py()), int(table.column("j")[0].as_py())
    coords = np.stack([np.frombuffer(c, _U) for c in table.column("coords").to_pylist()])
    apart = [np.frombuffer(x, _U) for x in table.column("apart").to_pylist()]
    lengths = np.array([len(x) for x in apart])
    label = np.where(linked, -1, np.arange(len(keys)))  # -1: linked to the centre
    xs, ys = np.flatnonzero(own == first), np.flatnonzero(own == second)
    for at in range(0, len(xs), tile):
        for to in range(at if first == second else 0, len(ys), tile):
            x, y = xs[at : at + tile], ys[to : to + tile]
            agree = np.zeros((len(x), len(y)), np.int16)
            for c in range(coords.shape[1]):
                agree += coords[x, c][:, None] == coords[y, c][None, :]
            near = (agree >= needed) & (label[x][:, None] != label[y][None, :])
            rows, cols = near.any(axis=1), near.any(axis=0)
            if not rows.any():
                continue
            x, y, near = x[rows], y[cols], near[np.ix_(rows, cols)]
            common = _common([apart[i] for i in x], [apart[i] for i in y], wide)
            total = n[x][:, None] + n[y][None, :]
            inside = (total - (lengths[x][:, None] + lengths[y][None, :] - 2 * common)) // 2
            near &= 100 * inside >= percent * (total - inside)
            for r in np.flatnonzero(near.any(axis=1)):
                met = np.unique(label[np.append(y[near[r]], x[r])])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
    edges = [i for i in np.flatnonzero(~linked) if label[i] != i]
    ends = [centre if label[i] < 0 else keys[label[i]] for i in edges]
    return pa.table({"a": pa.array([keys[i] for i in edges], pa.binary()), "b": pa.array(ends, pa.binary())})


def _common(x: list[np.ndarray], y: list[np.ndarray], wide: int) -> np.ndarray:
    """How many hashes each of ``x`` and each of ``y`` have in common: a product of 0/1 matrices over the hashes that both sides have."""
    (vx, ox), (vy, oy) = ((np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])) for side in (x, y))
    shared = np.intersect1d(vx, vy)
    out = np.zeros((len(x), len(y)), np.int64)
    if not len(shared):
        return out
    places = []
    for values, owners in ((vx, ox), (vy, oy)):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], owners[hit][order]))
    for low in range(0, len(shared), wide):
        sides = []
        for (at, owners), count in zip(places, (len(x), len(y))):
            a, b = np.searchsorted(at, [low, low + wide])
            m = np.zeros((count, min(wide, len(shared) - low)), np.float32)
            m[owners[a:b], at[a:b] - low] = 1
            sides.append(m)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out
