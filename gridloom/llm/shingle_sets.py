"""Sets of word shingles: made from texts, packed, and compared pair by pair.

Packing the sets of a few documents of a large table needs no join of texts: a
sieve, a bit field of bounded size made of the wanted ids, tells each task which
rows it can pass over.  A row that it lets through by chance costs time only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as wd
from gridloom.llm.store import Store

_SPACE = wd.white_space_split()
#: Bits of the largest sieve (8 MB); past some ten million ids it lets more and more rows through.
MOST_BITS = 1 << 26
_SALTS = np.array([0x51ED270B9F1C2A77, 0x8C72E6A1B3D4F019, 0x2F0B6D95C3E8A741, 0xD1B54A32D192ED03], np.uint64)


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each document and their bounds."""
    hashes, bounds = wd.word_hashes(data, offsets, _SPACE)
    shingles, part = wd.shingle_hashes(hashes, bounds, shingle)
    sets = [np.unique(shingles[a:b]) for a, b in zip(part[:-1], part[1:], strict=True)]
    return (np.concatenate(sets) if sets else shingles), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate([wd.mix(ids.view(np.uint64) ^ salt) & np.uint64(bits - 1) for salt in _SALTS])


class Sieve:
    """Which ids may be among the wanted ones; all wanted ones are."""

    def __init__(self, ids: DataFrame):
        """``ids`` has one long column without nulls."""
        bits = 1 << 16
        wanted = 16 * ids.count()
        while bits < min(wanted, MOST_BITS):
            bits *= 2

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            field = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                at = _places(batch.column(0).to_numpy(), bits)
                np.bitwise_or.at(field, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            words = field.view(np.int64)
            at = np.flatnonzero(words)
            if len(at):
                yield pa.record_batch([pa.array(at), pa.array(words[at])], names=["at", "word"])

        table = ids.mapInArrow(mark, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        field = np.zeros(bits // 64, np.int64)
        field[table.column("at").to_numpy()] = table.column("word").to_numpy()
        self.field: Broadcast = ids.sparkSession.sparkContext.broadcast(field.view(np.uint8))  # MOST_BITS / 8 bytes at most

    def passes(self, ids: np.ndarray) -> np.ndarray:
        field = self.field.value
        at = _places(ids, 8 * len(field)).reshape(len(_SALTS), -1)
        return ((field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def packed(store: Store, text: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles): the full sets of the rows of ``text(doc_id, text)`` whose id is in ``ids(doc_id)``, and of few others, as sorted 6-byte hashes; pairs of sets of 20,000 confuse a shingle once in 700,000 pairs."""
    sieve = Sieve(ids)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            let = sieve.passes(own.fill_null(0).to_numpy(zero_copy_only=False)) & own.is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(let))
            for first, last, data, offsets in wd.slices(batch.column(1)):
                sets, bounds = sets_of(data, offsets, shingle)
                raw = np.ascontiguousarray(sets >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
                yield pa.record_batch([batch.column(0).slice(first, last - first), pa.array([raw[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])

    return store.put(text, pack, "doc_id long, shingles binary")


def unpack(raw: bytes | np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = (np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column, without a copy."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _checks(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            if batch.num_rows:
                (left, lo), (right, ro) = cells(batch.column(2)), cells(batch.column(3))
                for i in range(batch.num_rows):
                    both = np.concatenate([unpack(left[lo[i] : lo[i + 1]]), unpack(right[ro[i] : ro[i + 1]])])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common >= percent * (len(both) - common) and common:
                        keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return check


def verified(store: Store, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` with 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    return store.put(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right"), _checks(percent), "a long, b long")


#: Shingles whose frequency is known exactly for the prefix filter's order; others count as rare, which is as right but prunes less.
MOST_COMMON = 1 << 18


def _prefixes(shared: Broadcast, percent: int):
    """Rows (shingle, doc_id, n, place) for the rarest part of each set, by (frequency, hash), that any set similar enough meets; ``shared`` is (sorted common shingles, their counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = shared.value
        for batch in batches:
            shingles, docs, sizes, places = [], [], [], []
            for d, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = unpack(raw)
                keep = len(own) - -(-percent * len(own) // 100) + 1
                often = np.zeros(len(own), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    often = np.where(common[at] == own, count[at], 0)
                order = np.lexsort((own, often))[:keep]
                # A shingle of no other document meets none.
                real = np.flatnonzero(often[order] > 0) if len(common) < MOST_COMMON else np.arange(len(order))
                shingles.append(own[order[real]].view(np.int64))
                docs += [d] * len(real)
                sizes += [len(own)] * len(real)
                places.append(real)
            if shingles:
                yield pa.record_batch([pa.array(np.concatenate(shingles)), pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.concatenate(places))], names=["shingle", "doc_id", "n", "place"])

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = b"".join(batch.column(1).to_pylist())
        for at in range(0, len(raw), 6 << 20):
            shingle, k = np.unique(unpack(raw[at : at + (6 << 20)]), return_counts=True)
            yield pa.record_batch([pa.array(shingle.view(np.int64)), pa.array(k)], names=["shingle", "k"])


def rare_pairs(store: Store, sets: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of different components among ``wanted(doc_id, component)`` that miss no pair of the similarity.

    Prefix and position filter: with shingles ordered from rare to common, two
    sets similar enough share a shingle of both prefixes, and the shingles
    from there on are enough for the overlap they need.
    """
    own = store.put(sets.join(wanted.select("doc_id"), "doc_id", "left_semi"))
    top = own.mapInArrow(_tally, "shingle long, k long").groupBy("shingle").agg(F.sum("k").alias("k")).where("k > 1").orderBy(F.desc("k"), "shingle").limit(MOST_COMMON)
    table = top.toArrow()
    common, count = table.column("shingle").to_numpy().view(np.uint64), table.column("k").to_numpy()
    order = np.argsort(common)
    shared = sets.sparkSession.sparkContext.broadcast((common[order], count[order]))  # 16 bytes for each of MOST_COMMON at most
    rows = own.mapInArrow(_prefixes(shared, percent), "shingle long, doc_id long, n long, place long").join(wanted, "doc_id")
    # Only shingles of several components can link them.
    rows = store.put(rows)
    several = store.put(rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle"))
    rows = store.put(rows.join(several.hint("merge"), "shingle", "left_semi"))
    side = lambda x: rows.select("shingle", F.col("doc_id").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"))
    enough = f"{100 + percent} * least(na - pa, nb - pb) >= {percent} * (na + nb)"
    return side("a").join(side("b"), "shingle").where(f"a < b and ca <> cb and {enough}").select("a", "b").distinct()
