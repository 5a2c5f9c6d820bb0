"""Exact Jaccard join of word n-gram sets by a partition of the universe.

Let two sets of a and b shingles have Jaccard similarity 0.85 or more.  Then at
most ``H = 15 (a + b) / 185`` shingles are in one of them only.  If a hash deals
all shingles to more than H segments, the two sets agree wholly in some segment.

*   Sizes are cut into bands, a half wider each.  A band has its own number of
    segments, made for the largest sets that its sets can link with; a set is
    dealt by its own band, and by the band below where it can link there.
*   The key of a segment is the sum of its shingles' hashes.  Equal keys meet by a
    shuffle and a sort; a key's sets go by as a stream, so a group of any size is
    held by nobody.
*   Each set is compared with the first set of its groups that it shares most
    keys with, which joins nearly all links; components are built.  Only groups of
    several components are looked at further, and only pairs of two of them.
*   Allocation by cost: a segment that is empty, or whose key is so common that
    its pairs of different components outnumber its sets by ``COSTLY`` times, is
    allotted nothing.  Each band has some segments more than H needs (``SPARE``),
    so a set may have that many such segments and still lose no link.  Where it has
    more, its segments are allotted two differences instead of one: each is met
    with every one of its shingles left out as well, by keys of the same cost at
    most.  Of a pair that fails to meet so, at most half of H segments differ by two
    or more, and in all others its common part is too costly a key, which each of
    the two sets sees from its own keys.  So only sets with such keys in more than
    ``H / 2 + SPARE`` segments, which consist of passages that very many documents
    share, can still have links that are not found; these few are completed by
    their rarest shingles.  So every link between different components is found,
    whatever the data.
*   A pair must share at least as many keys as its sizes imply, less the segments
    that were allotted nothing; those that do are compared on their full sets.

Defined cases: a null or blank text has an empty set, is linked with nothing and
is its own component; fewer than four words are one shingle; repeated rows get
equal results; a null ``doc_id`` is linked with nothing and has a null component;
very long texts are hashed piece by piece.  Only ``doc_id`` and ``text`` are read;
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import words as wd
from gridloom.llm.columns import text_batches
from gridloom.llm.components import components, merged
from gridloom.llm.shingle_sets import cells, packed, rare_pairs, sets_of, unpack, verified
from gridloom.llm.store import Store

SHINGLE = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A key with more pairs of different components than this for each of its sets is allotted nothing.
COSTLY = 4
#: Classes that a task remembers, so that further copies in it are passed over.
SEEN = 1 << 18


def _bands() -> np.ndarray:
    """The least size of each band; smaller sets link with equal ones only."""
    out = [next(a for a in range(1, 100) if 100 * a >= PERCENT * (a + 1))]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


BAND = _bands()
_TOP = BAND[1:] - 1
#: Most shingles that are in one set only, of the spare segments of each band, and its segments.
DIFFER = (100 - PERCENT) * (_TOP + 100 * _TOP // PERCENT) // (100 + PERCENT)
SPARE = np.maximum(1, (DIFFER + 1) // 3)
SEGMENTS = DIFFER + 1 + SPARE

#: Kinds of key, in a key's last bit: a whole segment, and one less a shingle, or whole to be met by such.
WHOLE, LESS = 0, 1
_KEYS = "key long, doc_id long, meta long"


def bands_of(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sets, band) by each set's own band, and by the band below for sets that can link with one there."""
    own = np.searchsorted(BAND, n, side="right") - 1
    in_any = np.flatnonzero(own >= 0)
    low = np.flatnonzero((own >= 1) & (100 * _TOP[np.maximum(own - 1, 0)] >= PERCENT * n))
    return [(in_any, own[in_any]), (low, own[low] - 1)]


def deal(tokens: np.ndarray, n: np.ndarray, band: np.ndarray, extra: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, set, number) of sets of n tokens each, which lie one behind the other.

    Without ``extra``, the whole non-empty segments, with the number of segments that the set leaves empty, and the further keys, with their segment's number, of sets with more empty segments than their band has to spare; with it, the further keys only, where ``extra`` is how many more segments are allotted nothing.
    """
    segments = SEGMENTS[band]
    first = np.concatenate(([0], np.cumsum(segments)))
    owner = np.repeat(np.arange(len(n)), n)
    hashed = wd.mix(tokens ^ np.uint64(0x9B1A3D5F7C2E4860))
    slot = first[owner] + (((hashed & np.uint64(0xFFFFFFFF)) * segments[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    value = wd.mix(hashed ^ np.uint64(0x6A09E667F3BCC909))
    total = np.zeros(first[-1], np.uint64)
    np.add.at(total, slot, value)
    filled = np.bincount(slot, minlength=int(first[-1])) > 0
    holder = np.repeat(np.arange(len(n)), segments)
    place = np.arange(int(first[-1])) - first[holder]
    salt = wd.mix((band[holder].astype(np.uint64) << np.uint64(40)) | place.astype(np.uint64))
    empty = segments - np.bincount(holder[filled], minlength=len(n))

    def keys(sums: np.ndarray, salts: np.ndarray, kind: int) -> np.ndarray:
        return ((wd.mix(sums + salts) & ~np.uint64(1)) | np.uint64(kind)).view(np.int64)

    if extra is None:
        yield keys(total[filled], salt[filled], WHOLE), holder[filled], empty[holder[filled]]
    over = (empty if extra is None else empty + extra) > SPARE[band]
    if over.any():
        at = over[holder]
        yield keys(total[at], salt[at], LESS), holder[at], place[at]
        at = over[owner]
        yield keys(total[slot[at]] - value[at], salt[slot[at]], LESS), owner[at], place[slot[at]]


def _rows(tokens: np.ndarray, bounds: np.ndarray, ids: np.ndarray, which: np.ndarray, band: np.ndarray, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Key rows of the sets ``which``; meta holds the set's size, its band and the key's number (see ``deal``)."""
    n = np.diff(bounds)
    if not len(which):
        return
    own = n[which]
    start = np.concatenate(([0], np.cumsum(own)))
    take = np.arange(int(start[-1])) + np.repeat(bounds[:-1][which] - start[:-1], own)
    for key, of, number in deal(tokens[take], own, band, extra):
        meta = (own[of] << 32) | (band[of] << 24) | np.minimum(number, (1 << 24) - 1)
        yield pa.record_batch([pa.array(key), pa.array(ids[which[of]]), pa.array(meta)], names=["key", "doc_id", "meta"])


def _digests(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, first and second half of a 128-bit digest) of each set."""
    n = np.diff(bounds)
    s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        s1[full] = np.add.reduceat(sets, bounds[:-1][full])
        s2[full] = np.add.reduceat(wd.mix(sets ^ np.uint64(0xA5A5A5A5DEADBEEF)), bounds[:-1][full])
    return n, s1, s2


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in wd.slices(batch.column(1)):
            n, s1, s2 = _digests(*sets_of(data, offsets, SHINGLE))
            yield pa.record_batch([batch.column(0).slice(first, last - first), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], names=["doc_id", "n", "s1", "s2"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of one set of each class in the task."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        for first, last, data, offsets in wd.slices(batch.column(1)):
            sets, bounds = sets_of(data, offsets, SHINGLE)
            n, s1, s2 = _digests(sets, bounds)
            new = np.zeros(len(n), bool)
            for k, digest in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                if digest not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    new[k] = True
            ids = batch.column(0).slice(first, last - first).to_numpy()
            for which, band in bands_of(n):
                at = new[which]
                yield from _rows(sets >> np.uint64(16), bounds, ids, which[at], band[at])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted keys that several have, with the first of their group; rows of the further kinds all stay."""
    held = None  # the last row's key, its group's first id and meta, and whether that first row is still to be given
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, meta = (c.to_numpy() for c in batch.columns)
        begins = np.ones(len(key), bool)
        begins[1:] = key[1:] != key[:-1]
        waits = held is not None and held[3]
        if held is not None and held[0] == key[0]:
            begins[0] = False
        elif waits:
            waits = False
        start = np.where(begins, np.arange(len(key)), -1)
        start = np.maximum.accumulate(start)
        first_doc = np.where(start >= 0, doc[np.maximum(start, 0)], held[1] if held else 0)
        first_meta = np.where(start >= 0, meta[np.maximum(start, 0)], held[2] if held else 0)
        follows = np.zeros(len(key), bool)
        follows[:-1] = ~begins[1:]
        give = ~begins | follows | ((key & 1) != WHOLE)
        columns = [key[give], doc[give], meta[give], first_doc[give], first_meta[give]]
        if waits:
            columns = [np.concatenate(([v], c)) for v, c in zip((held[0], held[1], held[2], held[1], held[2]), columns, strict=True)]
        last = len(key) - 1
        held = (key[last], first_doc[last], first_meta[last], bool(begins[last]) and not bool(give[last]))
        yield pa.record_batch([pa.array(c) for c in columns], names=["key", "doc_id", "meta", "first", "first_meta"])


#: The parts of meta and of a key, as SQL.
_SIZE, _BAND, _NUMBER, _KIND = "shiftright(meta, 32)", "cast(shiftright(meta, 24) & 255 as int)", f"meta & {(1 << 24) - 1}", "key & 1"


def _table(values: np.ndarray):
    return F.array(*[F.lit(int(v)) for v in values])


def _placed(store: Store, rows: DataFrame, part: DataFrame) -> DataFrame:
    """Key rows with their set's component, where a key has several; ``costly`` says whether its pairs are too many."""
    rows = rows.join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    rows = rows.select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"), F.expr(_SIZE).cast("int").alias("n"), F.expr(_BAND).alias("band"), F.expr(_NUMBER).cast("int").alias("number"))
    own = rows.withColumn("same", F.count("*").over(Window.partitionBy("key", "component")))  # one exchange by key serves both windows
    of_key = Window.partitionBy("key")
    own = own.withColumn("k", F.count("*").over(of_key)).withColumn("same", F.sum("same").over(of_key)).where("k * k > same")
    return store.put(own.withColumn("costly", F.expr(f"k * k - same > {2 * COSTLY} * k")).drop("k", "same"))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of different components with equal keys, once for each key and band."""
    side = lambda x: rows.select("key", F.col("doc_id").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("number").alias(f"z{x}"), *(["band"] if x == "a" else []))
    return side("a").join(side("b"), "key").where(f"a < b and ca <> cb and 100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) among ``rows``, whose number is how many segments are allotted nothing, that share as many keys as their sizes need."""
    met = _met(rows).groupBy("a", "b", "band").agg(F.count("*").alias("k"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("za").alias("za"), F.max("zb").alias("zb"))
    need = F.get(_table(SEGMENTS), F.col("band")) - F.floor((100 - PERCENT) * (F.col("na") + F.col("nb")) / (100 + PERCENT)) - F.least("za", "zb")
    return met.where(F.col("k") >= need).select("a", "b").distinct()


def _further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Further keys of packed sets: rows (doc_id, shingles, band, segments allotted nothing beside the empty ones)."""
    for batch in batches:
        raw, offsets = cells(batch.column(1))
        ids, band, extra = (batch.column(k).to_numpy() for k in (0, 2, 3))
        for i in range(batch.num_rows):
            tokens = unpack(raw[offsets[i] : offsets[i + 1]])
            one = np.array([i])
            yield from _rows(tokens, np.array([0, len(tokens)]), ids[one], np.array([0]), band[one].astype(np.int64), extra[one])


def _ids(store: Store, rows: DataFrame, *columns: str) -> DataFrame:
    return store.put(rows.select(F.explode(F.array(*columns)).alias("doc_id")).distinct())


def _links(store: Store, text: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are links; only sets of documents in pairs are made and moved."""
    pairs = store.put(pairs.select("a", "b"))
    return pairs if pairs.isEmpty() else verified(store, pairs, packed(store, text, _ids(store, pairs, "a", "b"), SHINGLE), PERCENT)


def joined(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``."""
    text_batches(spark)
    store = Store(spark, "ngram-join", by_python=True)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = store.put(text.mapInArrow(_keys, _KEYS).repartition("key").sortWithinPartitions("key", "doc_id"), _groups, _KEYS + ", first long, first_meta long")

    # Every set with the first of its groups that it shares most keys with, if these are not a few only: what is left out here is met below.
    sizes = "shiftright(meta, 32), shiftright(first_meta, 32)"
    stars = met.where(f"{_KIND} = {WHOLE} and doc_id <> first and 100 * least({sizes}) >= {PERCENT} * greatest({sizes})")
    stars = stars.groupBy(F.col("first").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("k"), F.min(F.expr(_BAND)).alias("band"))
    stars = stars.where(2 * F.col("k") >= F.get(_table(SPARE), F.col("band")))
    best = stars.groupBy("b").agg(F.max(F.struct("k", (-F.col("a")).alias("low"))).alias("top")).select((-F.col("top.low")).alias("a"), "b")
    part = components(spark, _links(store, text, best), store)

    # Groups of several components, by their whole segments.
    open_ = _placed(store, met.where(f"{_KIND} = {WHOLE}").select("key", "doc_id", "meta"), part)
    costly = store.put(open_.where("costly").groupBy("doc_id", "band").agg(F.count("*").alias("extra")))
    cheap = open_.where("not costly").join(costly, ["doc_id", "band"], "left").withColumn("number", F.col("number") + F.coalesce("extra", F.lit(0)))
    part = merged(spark, part, _links(store, text, _pairs(cheap)), store)

    # Sets with more segments allotted nothing than their band can spare: with a shingle left out.
    over = open_.where("costly").select("doc_id", "band", "number").distinct().join(costly, ["doc_id", "band"]).where(F.col("number") + F.col("extra") > F.get(_table(SPARE), F.col("band")))
    over = store.put(over)
    more = packed(store, text, _ids(store, over, "doc_id"), SHINGLE).join(over.select("doc_id", "band", "extra"), "doc_id").select("doc_id", "shingles", "band", "extra").mapInArrow(_further, _KEYS)
    less = more.unionByName(met.where(f"{_KIND} <> {WHOLE}").select("key", "doc_id", "meta"))
    open_ = _placed(store, less, part)
    part = merged(spark, part, _links(store, text, _met(open_.where("not costly")).select("a", "b").distinct()), store)

    # Sets that consist of common passages.
    blind = open_.where("costly").groupBy("doc_id", "band").agg(F.countDistinct("number").alias("k")).where(2 * F.col("k") > F.get(_table(DIFFER + 2 * SPARE), F.col("band")))
    rest = blind.select("doc_id").distinct().join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    rest = store.put(rest)
    if not rest.isEmpty():
        sets = packed(store, text, _ids(store, rest, "doc_id"), SHINGLE)
        part = merged(spark, part, verified(store, rare_pairs(store, sets, rest, PERCENT), sets, PERCENT), store)

    # Documents of one class share a component, whose name is the smallest id of all its classes.
    signed = store.put(text, _sign, "doc_id long, n long, s1 long, s2 long")
    classes = signed.where("n > 0 and doc_id is not null").join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    classes = store.put(classes.groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.min("component").alias("component")).withColumn("component", F.coalesce("component", "low")))
    named = store.put(classes.groupBy("component").agg(F.min("low").alias("component_id")))
    of = store.put(classes.join(named.hint("merge"), "component").select("s1", "s2", "component_id")).hint("merge")
    member = signed.join(of, ["s1", "s2"], "left")
    return member.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM m UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM s LEFT JOIN c ON s.doc_id = c.a
"""
