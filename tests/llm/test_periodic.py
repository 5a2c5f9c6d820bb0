"""Periodic runs against a plain search of all periods, and the query against the contract word by word."""

import hashlib
import random
import re
import zlib

from gridloom.llm import periodic
from gridloom.llm.queries import queries

SF = "/root/testdata/sf0.001"


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            run = w[i : j + q]
            if len(run) >= max(6, 4 * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.append((i, len(run), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, alter):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if alter and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    own = plain_runs(w)
    dropped = {i for s, length, q in own for i in range(s + q, s + length)}
    top = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(own), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
        sha("".join(f"{s},{length},{q}\n" for s, length, q in own)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)),
    )


def made_words(rng):
    w, kinds = [], rng.choice([1, 2, 2, 3, 4, 30])
    for _ in range(rng.randint(0, 8)):
        unit = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 12))]
        w += unit * rng.randint(1, 9)
        del w[len(w) - rng.randint(0, 3) :]
    return w * rng.choice([1, 1, 1, 2, 5])


def test_runs_match_a_plain_search(spark):
    rng = random.Random(8)
    texts = [" ".join(made_words(rng)) for _ in range(400)] + ["x " * 700, "a b " * 300, "a a a a a b " * 40, ("a " * 50 + "b ") * 9, "é x\x0by " * 30, "\t\n", "", None, "a a a a a", "a a a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs).collect()}
    assert got == {i: plain_runs(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_query_matches_a_plain_version(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries()["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text, True)
    assert sum(v[1] > 0 for v in got.values()) > len(got) // 20


def test_long_texts_nulls_repeated_rows_and_other_columns(spark):
    long_ = " ".join(f"w{i % 5000}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long_, 3), (1, long_, 3), (None, "a " * 8, 4), (None, None, 5)], "doc_id long, text string, start int")
    got = periodic.periodic_runs(docs, alter=True).collect()
    assert len(got) == 4 and got[0] == got[1] and (got[0].start, got[0].length, got[0].period) == (0, 60_000, 5000)
    assert (got[2].doc_id, got[2].n_runs, got[2].period) == (None, 1, 1) and (got[3].n_runs, got[3].start) == (0, None)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
