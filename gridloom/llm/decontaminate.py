"""Benchmark decontamination by SimHash windows, multi-index Hamming search and exact verification.

Words are maximal runs of letters and digits of the lower-cased text, so case,
punctuation and line breaks do not hide a passage.  Each benchmark item has a
64-bit SimHash of its words, weighted by inverse document frequency among the
items (whole numbers, so sums are exact in any order).  A document's whole text
is fingerprinted in windows of the items' sizes (sizes within 12% share one
window size) at a step of an eighth of the window.

Items are indexed by eight 8-bit blocks.  Fingerprints within radius ``RADIUS``
agree with an item's in at least one block up to ``RADIUS // BLOCKS`` bits, and
every such variant of every item's block is in the index, so all fingerprints
within the radius are found, not some of them.

Each candidate is then verified exactly: among the item-sized windows that start
within a window's step of it, the best weighted Jaccard similarity of 5-word
shingles (multiplicity times the weight of the shingle's words) must be at least
0.75.  One pass with running sums of the entering and the leaving shingle does it.

A window is left unfingerprinted only where that verification cannot succeed: a
similarity of 0.75 needs shared shingles of at least 0.75 of the item's weight,
and all shingles of any item around the window weigh less than that for the
lightest item of its size.

The items are the query set.  They are read to the driver in parts of up to
``ITEMS`` (chosen by a hash of the id) and shipped to every task; each further
part is one more pass over the documents.  Weights are those of all items.  An
index takes about 1 KB and 24 bytes a word for each item.

Defined cases: null or blank texts and items match nothing; items of fewer than
five words have one shingle, their whole sequence; a text shorter than an item is
one window; empty tables give no rows; repeated rows give repeated results; very
long texts are read in slices (an Arrow batch, then 60 bytes a word of a text).
Only ``doc_id``, ``text``, ``item_id`` are read; other columns may have any name.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as wd
from gridloom.llm.columns import in_place, text_batches

SHINGLE = 5
#: Similarity needed, in hundredths.
PERCENT = 75
RADIUS = 15
BLOCKS = 8
#: Items of one index; more are searched part by part.
ITEMS = 20_000
#: Words whose bits are held at once.
WORDS = 1 << 16
_CLASS = wd.letters_and_digits()
_HITS = 20
U = np.uint64


def tokens(texts: pa.Array, size: int = wd.SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, data, offsets in wd.slices(pc.utf8_lower(texts.cast(pa.large_string())), size):
        yield first, last, *wd.word_hashes(data, offsets, _CLASS, lower=False)


def bits_of(words: np.ndarray) -> np.ndarray:
    """1 or 0 for each of 64 bits of each word."""
    raw = np.ascontiguousarray(wd.mix(words ^ U(0x5157C0DE))).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def prints_of(words: np.ndarray, weight: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The SimHash of each window of words; at most WORDS words' bits are held at once."""
    sums = np.zeros((len(start), 64), np.int64)
    size = stop - start
    at = 0
    while at < len(start):
        to = at + max(1, int(np.searchsorted(np.cumsum(size[at : at + WORDS]), WORDS, side="right")))
        if to == at + 1:
            for k in range(int(start[at]), int(stop[at]), WORDS):
                cut = slice(k, min(k + WORDS, int(stop[at])))
                sums[at] += weight[cut] @ (2 * bits_of(words[cut]).astype(np.int64) - 1)
        else:
            first = np.cumsum(size[at:to]) - size[at:to]
            where = np.arange(int(size[at:to].sum())) + np.repeat(start[at:to] - first, size[at:to])
            sums[at:to] = np.add.reduceat((2 * bits_of(words[where]).astype(np.int32) - 1) * weight[where].astype(np.int32)[:, None], first, axis=0)
        at = to
    return np.ascontiguousarray(np.packbits(sums > 0, axis=1, bitorder="little")).view(np.uint64).ravel()


def runs(words: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of every k words in sequence."""
    n = max(0, len(words) - k + 1)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = sum(words[j : n + j] * wd._ROLL[j] for j in range(k))
    return wd.mix(total + U(k)), sum(weight[j : n + j] for j in range(k))


class Member:
    """A sorted set of hashes with a bit table before it."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.hit = np.zeros(1 << _HITS, bool)
        self.hit[(self.values >> U(64 - _HITS)).astype(np.int64)] = True

    def places(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``asked`` are in the set, their places in it)."""
        at = np.flatnonzero(self.hit[(asked >> U(64 - _HITS)).astype(np.int64)])
        where = np.searchsorted(self.values, asked[at])
        real = self.values[np.minimum(where, len(self.values) - 1)] == asked[at] if len(at) else np.zeros(0, bool)
        return at[real], where[real]


def item_words(items: list[tuple[int, str | None]]) -> list[tuple[int, np.ndarray]]:
    """(id, words) of the items that have both."""
    items = sorted((i, t) for i, t in items if i is not None and t)
    out = []
    for first, last, words, bounds in tokens(pa.array([t for _, t in items], pa.large_string())):
        out += [(items[k][0], words[bounds[k - first] : bounds[k - first + 1]]) for k in range(first, last) if bounds[k - first + 1] > bounds[k - first]]
    return out


class Index:
    """Benchmark items, small enough to be sent to every task; ``df`` (words' item counts) and ``n`` (items) may cover more items than these."""

    def __init__(self, items: list[tuple[int, str | None]], df: Counter | None = None, n: int | None = None):
        own = item_words(items)
        self.ids, self.words = [i for i, _ in own], [w for _, w in own]
        if df is None:
            df, n = Counter(w for own in self.words for w in set(own.tolist())), len(self.words)
        self.vocabulary = Member(np.concatenate(self.words or [np.zeros(0, U)]))
        self.weights = np.array([round(1000 * (math.log((1 + n) / (1 + df[w])) + 0.1)) for w in self.vocabulary.values.tolist()], np.int64)
        self.unknown = round(1000 * (math.log(1 + n) + 0.1))
        self.targets, self.totals, shingles = [], [], defaultdict(list)
        self.prints = np.zeros(len(own), U)
        for k, w in enumerate(self.words):
            weight = self.weigh(w)
            self.prints[k] = prints_of(w, weight, np.array([0]), np.array([len(w)]))[0]
            size = min(SHINGLE, len(w))
            hashes, mass = runs(w, weight, size)
            self.targets.append(dict(Counter(hashes.tolist())))
            self.totals.append(int(mass.sum()))
            shingles[size].append(hashes)
        self.known = {k: Member(np.concatenate(v)) for k, v in shingles.items()}
        # Window sizes: items within 12% of a size share it.
        self.sizes: dict[int, list[int]] = defaultdict(list)
        size = 0
        for k in sorted(range(len(own)), key=lambda k: len(self.words[k])):
            if not size or len(self.words[k]) > 1.12 * size:
                size = len(self.words[k])
            self.sizes[size].append(k)
        self.tables = {m: self._tables(own) for m, own in self.sizes.items()}

    def _tables(self, own: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block, (bounds, items) by block value, with all variants of up to RADIUS // BLOCKS bits."""
        width = 64 // BLOCKS
        masks = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(width), r)], np.int64)
        out = []
        for b in range(BLOCKS):
            value = ((self.prints[own] >> U(width * b)) & U((1 << width) - 1)).astype(np.int64)
            key = (value[:, None] ^ masks[None, :]).ravel()
            item = np.repeat(np.array(own, np.int32), len(masks))
            order = np.argsort(key, kind="stable")
            out.append((np.searchsorted(key[order], np.arange((1 << width) + 1)), item[order]))
        return out

    def weigh(self, words: np.ndarray) -> np.ndarray:
        """The weight of each word."""
        weight = np.full(len(words), self.unknown, np.int64)
        at, where = self.vocabulary.places(words)
        weight[at] = self.weights[where]
        return weight

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (fingerprint, item) of this window size within the radius."""
        found = []
        width = 64 // BLOCKS
        for b, (bounds, items) in enumerate(self.tables[size]):
            value = ((prints >> U(width * b)) & U((1 << width) - 1)).astype(np.int64)
            count = bounds[value + 1] - bounds[value]
            # So many fingerprints at a time that their entries stay few.
            cuts = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 1, 1 << 20))
            for low, high in itertools.pairwise([*cuts.tolist(), len(prints)]):
                c = count[low:high]
                if not c.sum():
                    continue
                i = np.repeat(np.arange(low, high), c)
                offset = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
                item = items[np.repeat(bounds[value[low:high]], c) + offset]
                near = np.bitwise_count(prints[i] ^ self.prints[item]) <= RADIUS
                found.append(np.stack([i[near], item[near]], 1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(found), axis=0)
        return both[:, 0], both[:, 1]


def best_window(index: Index, item: int, words: np.ndarray, weight: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """The best (similarity, start) over item-sized windows that start in low..high."""
    m, target, wanted = len(index.words[item]), index.targets[item], index.totals[item]
    high = max(low, min(high, len(words) - m))
    size = min(SHINGLE, m)
    if len(words) - low < size:
        return 0.0, low
    hashes, mass = runs(words[low : high + m], weight[low : high + m], size)
    k = min(m - size + 1, len(hashes))
    total = np.concatenate(([0], np.cumsum(mass)))
    total = (total[k:] - total[:-k]).tolist()
    hashes, mass = hashes.tolist(), mass.tolist()
    have: dict[int, int] = {}
    common, best, where = 0, 0.0, low
    for j, h in enumerate(hashes):
        if h in target:
            have[h] = n = have.get(h, 0) + 1
            if n <= target[h]:
                common += mass[j]
        if j >= k and (old := hashes[j - k]) in target:
            have[old] = n = have[old] - 1
            if n < target[old]:
                common -= mass[j - k]
        if j >= k - 1 and common and (value := common / (total[j - k + 1] + wanted - common)) > best:
            best, where = value, low + j - k + 1
    return best, where


def finder(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0)
            for first, last, words, bounds in tokens(batch.column(1)):
                if len(words):
                    rows += _search(index, first, words, bounds)
            doc, item, value, start, size = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            yield pa.record_batch([ids.take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(value, pa.float64()), pa.array(start, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def _search(index: Index, first: int, words: np.ndarray, bounds: np.ndarray) -> list[tuple]:
    weight = None
    best: dict[tuple[int, int], tuple[float, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    count = np.diff(bounds)
    reached: dict[int, np.ndarray] = {}
    for k, known in index.known.items():
        # A run over a border between documents is in no document.
        hashes = wd.mix(sum(words[j : len(words) - k + 1 + j] * wd._ROLL[j] for j in range(k)) + U(k)) if len(words) >= k else np.zeros(0, U)
        at, _ = known.places(hashes)
        at = at[np.searchsorted(bounds, at, side="right") == np.searchsorted(bounds, at + k - 1, side="right")]
        if not len(at):
            continue
        if weight is None:
            weight = index.weigh(words)
        mass = np.zeros(len(words), np.int64)
        mass[at] = sum(weight[at + j] for j in range(k))
        reached[k] = np.concatenate(([0], np.cumsum(mass)))
    for size, own in index.sizes.items():
        if (k := min(SHINGLE, size)) not in reached:
            continue
        step = max(1, size // 8)
        longest = max(len(index.words[i]) for i in own)
        # Starts at every step; a text shorter than the window has one window, itself.
        per = np.where(count > 0, np.maximum(0, count - size + step - 1) // step + 1, 0)
        doc = np.repeat(np.arange(len(per)), per)
        at = bounds[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * step
        # All item-sized windows that verification would look at lie in low..high.
        low, high = np.maximum(at - step - (longest - size), bounds[:-1][doc]), np.minimum(at + step + longest, bounds[1:][doc])
        rich = np.flatnonzero(100 * (reached[k][high] - reached[k][low]) >= PERCENT * min(index.totals[i] for i in own))
        for part in np.array_split(rich, len(rich) // 4096 + 1) if len(rich) else []:
            i, items = index.candidates(size, prints_of(words, weight, at[part], np.minimum(at[part] + size, bounds[1:][doc[part]])))
            for w, item in zip(i.tolist(), items.tolist(), strict=True):
                d, s = int(doc[part[w]]), int(at[part[w]])
                m = len(index.words[item])
                if (d, item, s) in tried or best.get((d, item), (0.0, 0))[0] == 1.0:
                    continue
                tried.add((d, item, s))
                text, weights = words[bounds[d] : bounds[d + 1]], weight[bounds[d] : bounds[d + 1]]
                s -= int(bounds[d])
                value, start = best_window(index, item, text, weights, max(0, s - step - max(0, m - size)), s + step)
                if 100 * value >= PERCENT and value > best.get((d, item), (0.0, 0))[0]:
                    best[d, item] = (value, start)
    return [(first + d, index.ids[item], value, start, len(index.words[item])) for (d, item), (value, start) in sorted(best.items())]


def load(items: DataFrame) -> Iterator[Index]:
    """An index for each part of the items, all with the weights of all items."""
    rows = items.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    parts = -(-rows.count() // ITEMS)
    read = lambda k: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", F.lit("part")), F.lit(parts)) == k).collect()]
    if parts <= 1:
        yield Index(read(0) if parts else [])
        return
    df: Counter = Counter()
    n = 0
    for k in range(parts):
        for _, words in item_words(read(k)):
            df.update(set(words.tolist()))
            n += 1
    for k in range(parts):
        yield Index(read(k), df, n)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) for every document that holds an item."""
    text_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def searched(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches):
            yield from finder(shared.value)(batches)

        return text.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")

    out = None
    for index in load(items):
        out = searched(index) if out is None else out.unionAll(searched(index))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; judged in place, without a join."""
    at = docs.columns.index("text")

    def kept(docs: DataFrame, index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = finder(shared.value)
            for batch in batches:
                rows = pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["doc_id", "text"])
                keep = np.ones(batch.num_rows, bool)
                for out in find(iter([rows])):
                    keep[out.column(0).to_numpy()] = False
                yield batch.filter(pa.array(keep))

        return in_place(docs, run)

    for index in load(items):
        docs = kept(docs, index)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
