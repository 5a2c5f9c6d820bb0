"""The n-gram join against all pairs, with keys at any cost, and its guarantee on pairs of sets at the border."""

import random
import re

import numpy as np
import pytest

from gridloom.llm import ngram_join

rng = random.Random(11)
VOCABULARY = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "nrstl"]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, k):
    words = text.split()
    for at in rng.sample(range(len(words)), k):
        words[at] = "zz" + rng.choice(VOCABULARY)
    return " ".join(words)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}


def plain(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def texts():
    out = ["", None, "one", "one two three", "ONE two three", "\t", "a b c d", "a b c d e"]
    for n in (9, 10, 12, 20, 40, 90, 200, 500):
        for _ in range(6):
            base = prose(n)
            words = base.split()
            out += [base, edited(base, max(1, n // 40)), edited(base, max(1, n // 60)), " ".join(words[: n - n // 12]), base + " " + prose(max(1, n // 9)), base.upper()]
    passage = prose(120)  # most of these are one passage, so common keys and few own ones
    out += [f"{prose(8)} {passage} {prose(k % 5 + 2)}" for k in range(60)]
    out += [f"{passage} {VOCABULARY[k]}" for k in range(40)]
    return out


@pytest.mark.parametrize("costly", [ngram_join.COSTLY, 1, 0])
def test_join_matches_all_pairs(spark, monkeypatch, costly):
    monkeypatch.setattr(ngram_join, "COSTLY", costly)
    rng.seed(costly)
    rows = list(enumerate(texts()))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows)


def keys_of(sets, band, extra=None):
    out = [set() for _ in sets]
    n = np.array([len(s) for s in sets])
    for key, of, _ in ngram_join.deal(np.concatenate(sets), n, np.array([band] * len(sets)), extra):
        for k, o in zip(key.tolist(), of.tolist(), strict=True):
            out[o].add(k)
    return out


def test_every_pair_at_the_border_meets():
    """Sets that differ by as much as they may share a key, whichever segments are allotted nothing."""
    random_ = np.random.default_rng(5)
    for size in [6, 7, 8, 9, 11, 13, 17, 25, 40, 80, 300, 2000]:
        for _ in range(60):
            small = int(random_.integers(size, size * 6 // 5 + 1))
            large = int(random_.integers(small, 100 * small // 85 + 1))
            common = -(-85 * (small + large) // 185)
            if common > small:
                continue
            tokens = random_.integers(0, 1 << 48, small + large - common, dtype=np.uint64)
            a, b = tokens[:small], np.concatenate([tokens[:common], tokens[small:]])
            shared = [band for _, bands in [(0, ngram_join.bands_of(np.array([small]))[0][1])] for band in bands.tolist()]
            assert len(b) == large and len(shared) == 1
            one, other = keys_of([a, b], shared[0])
            assert one & other
            # With all segments allotted two differences: more keys are shared than half of the differences hide.
            m, differ = int(ngram_join.SEGMENTS[shared[0]]), int(ngram_join.DIFFER[shared[0]])
            x, y = keys_of([a, b], shared[0], np.array([m, m]))
            assert x & y and m - differ // 2 > 0


def test_nulls_repeated_rows_and_other_columns(spark):
    text = prose(30)
    docs = spark.createDataFrame([(5, text, 1), (5, text, 1), (9, text + " end", 2), (None, text, 3), (None, None, 4), (3, None, 5)], "doc_id long, text string, key int").withColumnRenamed("key", "component")
    got = sorted(map(tuple, ngram_join.joined(spark, docs).collect()), key=str)
    assert got == sorted([(5, 27, 5), (5, 27, 5), (9, 28, 5), (None, 27, None), (None, 0, None), (3, 0, 3)], key=str)
    assert ngram_join.joined(spark, docs.limit(0)).count() == 0
