"""Periodic runs in word sequences, found by block matching.

A run is a stretch of consecutive words with smallest period q and length of at
least ``max(6, 4 * q)`` that no neighbouring word extends at that period.

At scale B, a power of two, runs of period B to 2B - 1 are sought.  Such a run
holds a block of B words that is aligned to a multiple of B in the document and
occurs again q words later, still inside the run.  So the aligned blocks are the
keys of an Aho-Corasick automaton over integer sequences (a number for each
distinct word), the document is searched for them, and an occurrence at a
distance of B to 2B - 1 from its block is a seed, which is extended word by word
to both sides.

What is not searched cannot hold a seed: every sequence of ``min(B, 8)`` words
that begins in a run's first ``length - q`` words occurs again less than 2B words
later, so only stretches of at least that many such places are searched at scale
B.  These places are found for many documents at once.  A block whose whole
neighbourhood lies in one run of a shorter period needs no search either: two
periods over so long a stretch have a common divisor as a period, so a longer
smallest period is impossible there.

A text is one sequence and is read whole by one task; rows are independent, so
nothing is shuffled.

Defined cases: a null or blank text has no words and no run; ``doc_id`` decides
how the query alters a text, a null one leaves it as it is; repeated rows get equal
results; a text of n words takes some 100 bytes a word for as long as it is
looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as wd
from gridloom.llm.columns import text_batches

#: A run has this many words at least, and this many times its period.
LEAST, TIMES = 6, 4
#: Longest sequence whose next occurrence is looked up before blocks are searched.
GRAM = 8
_FAR = np.int64(1 << 62)


def _gap(codes: np.ndarray) -> np.ndarray:
    """How far ahead each value occurs again (``_FAR`` if it does not)."""
    order = np.argsort(codes, kind="stable")
    gap = np.full(len(codes), _FAR, np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def gaps(codes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For sequences of 1, 2, 4 and 8 numbers: how far ahead in its own document the one that begins at each place occurs again."""
    n, out, size = len(codes), [], 1
    document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    code = document * (int(codes.max(initial=0)) + 1) + codes
    while True:
        if size > 1:
            half = size // 2
            inside = np.zeros(n, bool)
            inside[: max(n - size + 1, 0)] = document[: max(n - size + 1, 0)] == document[size - 1 :]
            at = np.flatnonzero(inside)
            rank = np.unique(code, return_inverse=True)[1]
            code = np.arange(-1, -n - 1, -1)  # a sequence that its document's end cuts short equals no other
            code[at] = rank[at] * n + rank[at + half]
        out.append(_gap(code))
        if size == GRAM:
            return out
        size *= 2


def _stretches(near: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the maximal stretches of true places that have ``least`` places or more."""
    step = np.diff(np.concatenate(([0], near.view(np.int8), [0])))
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    keep = last - first >= least
    return first[keep], last[keep]


def candidates(gap: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(B, first, last + 1) of the stretches where a run of period B to 2B - 1 may begin, for each scale up to documents of ``longest`` words."""
    size = 1
    while TIMES * size <= longest:
        gram = min(size, GRAM)
        first, last = _stretches(gap[gram.bit_length() - 1] < 2 * size, max((TIMES - 1) * size, LEAST - size) - gram + 1)
        if len(first):
            yield size, first, last
        size *= 2


def _equal(codes: np.ndarray, i: int, j: int, most: int) -> int:
    """How many of the ``most`` words from i and from j on are equal before the first that is not."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        differs = np.flatnonzero(codes[i + done : i + done + step] != codes[j + done : j + done + step])
        if len(differs):
            return done + int(differs[0])
        done += step
        step *= 2
    return most


def _equal_before(codes: np.ndarray, i: int, j: int, most: int) -> int:
    """The same for the words before i and j, going back."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        differs = np.flatnonzero(codes[i - done - step : i - done] != codes[j - done - step : j - done])
        if len(differs):
            return done + step - 1 - int(differs[-1])
        done += step
        step *= 2
    return most


def _seeds(codes: np.ndarray, size: int, first: int, last: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of an aligned block, distance of an occurrence) for the blocks of one stretch; ``last`` bounds the blocks, the search goes on behind it."""
    n = len(codes)
    places = np.arange(-(-first // size) * size, last - size + 1, size)
    places = places[reach[places] < np.minimum(places + 3 * size, n)]
    if not len(places):
        return places, places
    start, stop = int(places[0]), min(n, int(places[-1]) + 3 * size)
    automaton, number, key_of = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, {}
    for p in places.tolist():
        key = tuple(codes[p : p + size].tolist())
        if key not in number:
            number[key] = len(number)
            automaton.add_word(key, number[key])
        key_of[p] = number[key]
    automaton.make_automaton()
    at, distance = [], []
    for end, key in automaton.iter(tuple(codes[start:stop].tolist())):
        t = start + end - size + 1
        p = (t // size - 1) * size  # the one aligned place B to 2B - 1 words before
        if key_of.get(p) == key:
            at.append(p)
            distance.append(t - p)
    return np.array(at, np.int64), np.array(distance, np.int64)


def runs(codes: np.ndarray, stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one document, by start and period; ``stretches`` are (B, first, last + 1) by B."""
    n = len(codes)
    found: list[tuple[int, int, int]] = []
    reach, scale = np.zeros(n, np.int64), 0
    for size, first, last in stretches:
        if size != scale:  # reach[i]: the furthest end of the shorter-period runs that begin at or before i
            scale = size
            reach = np.zeros(n, np.int64)
            for s, length, _ in found:
                reach[s] = max(reach[s], s + length)
            reach = np.maximum.accumulate(reach)
        gram = min(size, GRAM)
        at, distance = _seeds(codes, size, first, min(last + gram - 1, n), reach)
        order = np.lexsort((at, distance))
        d_before, end_before = 0, -1
        for p, d in zip(at[order].tolist(), distance[order].tolist(), strict=True):
            if (d == d_before and p + d < end_before) or reach[p] >= p + d + size:
                continue
            s = p - _equal_before(codes, p, p + d, p)
            e = p + d + size + _equal(codes, p + size, p + d + size, n - p - d - size)
            d_before, end_before = d, e
            if e - s >= max(LEAST, TIMES * d) and reach[s] < e:
                found.append((s, e - s, d))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def _altered(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places that the query's altered text takes its words from; none if the text stays."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _summary(words: list[bytes], own: list[tuple[int, int, int]]) -> tuple:
    top = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
    kept = words
    if own:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, length, q in own:
            drop[s + q] += 1
            drop[s + length] -= 1
        kept = [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in own)
    milli = 1000 * top[1] // top[2] if own else None
    return len(own), top[0], top[1], top[2], milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), own


_NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs")
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _RUN)
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>"


def _of_slice(ids: list, data: bytes, offsets: list[int], alter: bool) -> Iterator[tuple]:
    texts = [data[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    if alter:
        for k, (doc_id, own) in enumerate(zip(ids, texts, strict=True)):
            if (place := _altered(doc_id, len(own))) is not None:
                texts[k] = [own[i] for i in place.tolist()]
    number: dict[bytes, int] = {}
    for own in texts:
        for w in dict.fromkeys(own):
            number.setdefault(w, len(number))
    bounds = np.concatenate(([0], np.cumsum([len(own) for own in texts], dtype=np.int64)))
    codes = np.fromiter((number[w] for own in texts for w in own), np.int64, int(bounds[-1]))
    where: dict[int, list[tuple[int, int, int]]] = {}
    if len(codes):
        for size, first, last in candidates(gaps(codes, bounds), int(np.diff(bounds).max())):
            for k, a, b in zip((np.searchsorted(bounds, first, side="right") - 1).tolist(), first.tolist(), last.tolist(), strict=True):
                where.setdefault(k, []).append((size, a - int(bounds[k]), b - int(bounds[k])))
    for k, own in enumerate(texts):
        yield ids[k], *_summary(own, runs(codes[bounds[k] : bounds[k + 1]], where[k]) if k in where else [])


def _find(alter: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in wd.slices(batch.column(1)):
                ids = batch.column(0).slice(first, last - first)
                rows = list(_of_slice(ids.to_pylist(), data.tobytes(), offsets.tolist(), alter))
                columns = [pa.array([r[j + 1] for r in rows], kind) if kind != _RUN else pa.array([[{"start": s, "length": length, "period": q} for s, length, q in r[j + 1]] for r in rows], kind) for j, kind in enumerate(_KINDS)]
                yield pa.record_batch([ids, *columns], names=["doc_id", *_NAMES])

    return run


def periodic_runs(docs: DataFrame, alter: bool = False) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)`` with all its runs and what remains when each is cut to its first period.

    With ``alter``, one document in ten (by its id) first has the words from some place on replaced by repetitions of those there, as the query asks.
    """
    text_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_find(alter), SCHEMA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), alter=True).drop("runs")
