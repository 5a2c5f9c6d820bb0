"""Near-duplicate classes by an LSH forest over MinHash signatures.

1.  One pass turns every text into its set of distinct 5-word shingles and keeps
    the set's size, a 128-bit digest of it and a signature of 96 minima.
    Documents with equal sets become one class before anything is compared, so
    a group of exact copies of any size costs one row from here on.
2.  The forest has 32 orders of the signature.  ``repartitionByRange`` and a sort
    lay all classes out in every order; the document id is part of the range,
    so even one region that holds a third of all rows is cut into equal
    partitions.  Each sorted run yields longest-common-prefix neighbours as
    candidates.  The depth adapts by region: a region (classes that agree on the
    first three minima) of up to ``small`` classes gives all its pairs; a larger
    one is descended level by level and gives the pairs of its small
    sub-regions, the nearest neighbours in order and a link to its first class.
    The first and last rows of every partition are compared in a second, small
    step, so no region is lost where a partition ends.
3.  Every class is verified against its best candidate on full sets, which yields
    most links; components are built, and all candidates still in different
    components are verified in a second round.
4.  A large region whose classes still lie in several components is completed
    exactly: its classes are joined on the rarest quarter of their shingles
    (prefix and position filter under one global order), which meets every pair
    of similarity 0.75 or more.

A pair of similarity 0.75 agrees in one order's first three minima with
probability 0.42 and is a candidate unless none of 32 orders agrees, which
happens to 3 in 100 million such pairs; pairs of higher similarity are missed
less.

Defined cases: a null or blank text has an empty set, is linked with nothing and
is its own component; fewer than five words are one shingle; repeated rows get
equal results; a null ``doc_id`` is linked with nothing, has a null component
and is kept; very long texts are hashed piece by piece (about 60 bytes a word at
once).  Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as wd
from gridloom.llm.columns import text_batches
from gridloom.llm.components import components, merged
from gridloom.llm.shingle_sets import packed, rare_pairs, sets_of, verified
from gridloom.llm.store import Store

SHINGLE = 5
TREES = 32
MINIMA = 96
#: Rows (one for each class and order) of a sorted run of the forest, held by one task at 32 bytes each.
RUN = 1 << 20
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A region up to this many classes gives all its pairs.
SMALL = 16
_MULTIPLIERS = np.random.default_rng(75).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Minima that each order looks at first: three of its own, then some of the others.
_ORDERS = np.array([[(3 * t + j) % MINIMA for j in range(3)] + [(3 * t + 3 + 31 * j) % MINIMA for j in range(1, 4)] for t in range(TREES)])

_SIGNED = "doc_id long, n long, s1 long, s2 long, sig binary"
_RUN = "kind int, x long, y long, hi long, lo long, n long"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])
    for batch in batches:
        ids = batch.column(0)
        for first, last, data, offsets in wd.slices(batch.column(1)):
            sets, bounds = sets_of(data, offsets, SHINGLE)
            n = np.diff(bounds)
            s1, s2 = np.zeros(last - first, np.uint64), np.zeros(last - first, np.uint64)
            minima = np.zeros((last - first, MINIMA), np.uint32)
            if full := np.flatnonzero(n).tolist():
                at = bounds[:-1][full]
                s1[full] = np.add.reduceat(sets, at)
                s2[full] = np.add.reduceat(wd.mix(sets ^ np.uint64(0xA5A5A5A5DEADBEEF)), at)
                for k, a in enumerate(_MULTIPLIERS):
                    minima[full, k] = np.minimum.reduceat(sets * a, at) >> np.uint64(32)
            yield pa.record_batch([ids.slice(first, last - first), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([m.tobytes() for m in minima], pa.binary())], schema=schema)


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and order; hi holds the order and three levels, lo three more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, MINIMA).astype(np.uint64)
        level = sig[:, _ORDERS]  # rows, orders, levels
        hi = np.arange(TREES, dtype=np.uint64) << np.uint64(54)
        hi = hi[None, :] | ((level[:, :, 0] >> np.uint64(14)) << np.uint64(36)) | ((level[:, :, 1] >> np.uint64(14)) << np.uint64(18)) | (level[:, :, 2] >> np.uint64(14))
        lo = ((level[:, :, 3] >> np.uint64(12)) << np.uint64(40)) | ((level[:, :, 4] >> np.uint64(12)) << np.uint64(20)) | (level[:, :, 5] >> np.uint64(12))
        yield pa.record_batch([pa.array(hi.ravel().view(np.int64)), pa.array(lo.ravel().view(np.int64)), pa.array(np.repeat(ids, TREES)), pa.array(np.repeat(n, TREES))], names=["hi", "lo", "doc_id", "n"])


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's run of equal keys, size of each row's run) of sorted rows."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    run = np.cumsum(new) - 1
    return run, np.bincount(run)[run]


def neighbours(hi: np.ndarray, lo: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one sorted run, and the rows of its large regions."""
    size = len(hi)
    region, members = _runs(hi)
    left, right = [], []

    def pair(i: np.ndarray, j: np.ndarray) -> None:
        fits = (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (ids[i] != ids[j])
        left.append(ids[i[fits]])
        right.append(ids[j[fits]])

    def all_pairs(run: np.ndarray, wanted: np.ndarray, most: int) -> None:
        for d in range(1, most):
            i = np.flatnonzero(wanted[: size - d] & (run[: size - d] == run[d:])) if d < size else np.zeros(0, np.int64)
            if not len(i):
                break
            pair(i, i + d)

    all_pairs(region, members <= SMALL, SMALL)
    large = members > SMALL
    if large.any():
        rest = large
        for shift in (40, 20, 0):
            run, count = _runs(hi, lo >> shift)
            all_pairs(run, rest & (count <= SMALL), SMALL)
            rest = rest & (count > SMALL)
        all_pairs(region, large, 5)
        start = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
        i = np.flatnonzero(large)
        pair(start[region[i]], i)
    if not left:
        return np.zeros((0, 2), np.int64), large
    a, b = np.concatenate(left), np.concatenate(right)
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0), large


def _out(kind: int, x, y=None, hi=None, lo=None, n=None) -> pa.RecordBatch:
    zero = np.zeros(len(x), np.int64)
    cols = [pa.array(np.full(len(x), kind, np.int32))] + [pa.array(zero if c is None else c) for c in (x, y, hi, lo, n)]
    return pa.record_batch(cols, names=["kind", "x", "y", "hi", "lo", "n"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (0) of one sorted partition, its edge rows (1) and the rows of its large regions (2)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    hi, lo, ids, n = (table.column(c).to_numpy() for c in ("hi", "lo", "doc_id", "n"))
    pairs, large = neighbours(hi, lo, ids, n)
    yield _out(0, pairs[:, 0].copy(), pairs[:, 1].copy())
    i = np.arange(len(hi))
    edge = ((hi == hi[0]) & (i < SMALL)) | ((hi == hi[-1]) & (i >= len(hi) - SMALL))
    yield _out(1, ids[edge], None, hi[edge], lo[edge], n[edge])
    # A region that reaches a partition's end may be large over several partitions.
    reach = edge | large
    yield _out(2, ids[reach], large[reach].astype(np.int64), hi[reach])


def _ends(table: pa.Table) -> pa.Table:
    table = table.sort_by([("lo", "ascending"), ("x", "ascending")])
    hi, lo, ids, n = (table.column(c).to_numpy() for c in ("hi", "lo", "x", "n"))
    pairs, _ = neighbours(hi, lo, ids, n)
    return pa.table({"x": pairs[:, 0].copy(), "y": pairs[:, 1].copy()})


def _complete(spark: SparkSession, store: Store, rest: DataFrame, part: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact candidate pairs between components inside the large regions ``rest(hi, doc_id)``."""
    placed = rest.join(part, rest.doc_id == part.id, "left").select("hi", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("hi").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("k")).where(f"low <> high and k > {SMALL}")
    mixed = store.put(mixed.select("hi")).hint("merge")  # a sort-merge join of stored rows is one that AQE splits where a region is hot
    open_ = store.put(placed.join(mixed, "hi", "left_semi").select("doc_id", "component").distinct())
    if open_.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    return rare_pairs(store, sets, open_, PERCENT)


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``."""
    text_batches(spark)
    store = Store(spark, "minhash-forest", by_python=True)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = store.put(text, _sign, _SIGNED)
    classes = store.put(signed.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")))
    planted = signed.join(classes.withColumnRenamed("rep", "doc_id"), ["s1", "s2", "doc_id"], "left_semi").select("doc_id", "n", "sig").mapInArrow(_plant, "hi long, lo long, doc_id long, n long")
    runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * TREES // RUN))
    walked = store.put(planted.repartitionByRange(runs, "hi", "lo", "doc_id").sortWithinPartitions("hi", "lo", "doc_id"), _walk, _RUN)
    ends = walked.where("kind = 1").select("hi", "lo", "x", "n").groupBy("hi").applyInArrow(_ends, "x long, y long")
    pairs = store.put(walked.where("kind = 0").select("x", "y").unionAll(ends).groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("orders")))
    rest = walked.where("kind = 2").select("hi", F.col("x").alias("doc_id"))

    ids = store.put(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionAll(rest.select("doc_id")).distinct())
    sets = packed(store, text, ids, SHINGLE)
    best = pairs.groupBy("b").agg(F.max(F.struct("orders", (-F.col("a")).alias("low"))).alias("top")).select((-F.col("top.low")).alias("a"), "b")
    links = verified(store, best, sets, PERCENT)
    part = components(spark, links, store)

    left = part.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    right = part.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    apart = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    part = merged(spark, part, verified(store, apart, sets, PERCENT), store)
    extra = _complete(spark, store, rest, part, sets)
    links_3 = verified(store, extra, sets, PERCENT)
    if not links_3.isEmpty():
        part = merged(spark, part, links_3, store)

    # Members of a class follow their first document; AQE splits a hot class.
    first = store.put(classes.join(part, classes.rep == part.id, "left").select("s1", "s2", F.coalesce("component", "rep").alias("c"))).hint("merge")
    member = signed.select("doc_id", "n", "s1", "s2").join(first, ["s1", "s2"], "left")
    root = F.when(F.col("n") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return member.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each class (rows with a null id stay)."""
    gone = near_duplicates(spark, docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM m UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept FROM s LEFT JOIN c ON s.doc_id = c.a
"""
