"""The ten operators against brute force, round trips and held-out accuracy, with the odd cases of each docstring."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, decontaminate, html_main, language, minhash_forest, mixing, secrets, spotsigs, url_filter, warc

SF = "/root/testdata/sf0.001"
rng = random.Random(4)
VOCABULARY = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "nrstl"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, sig string, component string"


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, k):
    words = text.split()
    for at in rng.sample(range(len(words)), k):
        words[at] = "zz" + rng.choice(VOCABULARY)
    return " ".join(words)


def table(spark, texts, ids=None, sources=None):
    rows = [(i, t, "en", s, len(t or ""), 7, "x", "y") for i, t, s in zip(ids or range(len(texts)), texts, sources or ["a"] * len(texts), strict=True)]
    return spark.createDataFrame(rows, DOCS)


# -- 7 ------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    base = [prose(n) for n in (80, 120, 60, 200)]
    shared = prose(60)
    texts = [None, "", " \t\n", "one", "one", "One two", "a b c d", "a b c d e"]
    for b in base:
        texts += [b, b, b.upper(), *[edited(b, k) for k in (1, 1, 2, 2, 3, 4, 6)]]
    texts += [shared + " " + prose(25) for _ in range(30)] + [edited(shared, 1) for _ in range(40)] + [prose(3000), prose(50)]
    out = {r.doc_id: r for r in minhash_forest.near_duplicates(spark, table(spark, texts)).collect()}
    want = brute_components(list(enumerate(texts)))
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in out.items())


def test_components_with_further_links(spark):
    from gridloom.llm.components import components, merged
    from gridloom.llm.store import Store

    r = random.Random(2)
    first, more = ([(r.randrange(300), r.randrange(300)) for _ in range(n)] for n in (150, 60))
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    store = Store(spark, "test")
    plain = {x.id: x.component for x in components(spark, frame([e for e in first + more]), store).collect()}
    got = [(x.id, x.component) for x in merged(spark, components(spark, frame(first), store), frame(more), store).collect()]
    assert len(got) == len(dict(got)) and dict(got) == plain
    none = merged(spark, components(spark, frame([]), store), frame([]), store)
    assert none.count() == 0


def test_large_groups_are_completed(spark):
    base = prose(100)
    texts = [edited(base, 1) for _ in range(150)] + [edited(base, 5) for _ in range(40)] + [base]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.near_duplicates(spark, table(spark, texts)).collect()}
    assert out == brute_components(list(enumerate(texts)))


def test_near_duplicates_odd_rows(spark):
    empty = table(spark, [])
    assert minhash_forest.near_duplicates(spark, empty).count() == 0
    t = prose(30)
    twice = table(spark, [t, t, t, None], [5, 5, 3, None])
    rows = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash_forest.near_duplicates(spark, twice).collect())
    assert rows == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert minhash_forest.keep_one(spark, twice).columns == twice.columns


def test_near_duplicates_start_no_program_for_their_tables(tmp_path):
    """Hadoop's local file system starts chmod for what it writes; a session with another chmod before it in PATH tells."""
    import os
    import subprocess
    import sys

    (tmp_path / "chmod").write_text(f'#!/bin/sh\necho "$@" >> {tmp_path}/started\nexec /bin/chmod "$@"\n')
    (tmp_path / "chmod").chmod(0o755)
    code = f"""
from pyspark.sql import SparkSession
from gridloom.llm import minhash_forest
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
docs = spark.createDataFrame([(k, "a b c d e f g h " + "xyz"[k // 2]) for k in range(6)], "doc_id long, text string")
assert sorted(r.doc_id for r in minhash_forest.keep_one(spark, docs).collect()) == [0, 2, 4]
spark.range(1).write.parquet("{tmp_path}/by_spark")
"""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PATH": f"{tmp_path}:{os.environ['PATH']}", "PYTHONPATH": top}
    subprocess.run([sys.executable, "-c", code], env={k: v for k, v in env.items() if not k.startswith("PYSPARK_GATEWAY")}, check=True, timeout=300)
    started = (tmp_path / "started").read_text()
    assert "/by_spark" in started and "/shared/minhash-forest" not in started


def test_tables_by_python(spark):
    from gridloom.llm.store import Store

    store = Store(spark, "test", by_python=True)
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as int) as k", "id % 2 = 0 as even", "encode(cast(id as string), 'UTF-8') as raw", "if(id % 3 = 0, null, cast(id as string)) as text")
    got = store.put(df)
    assert got.dtypes == df.dtypes and sorted(got.collect()) == sorted(df.collect())
    assert store.put(got.where("id < 0")).count() == 0 and store.put(got.where("id < 0")).dtypes == df.dtypes
    one = store.put(df.select("id"), lambda batches: (b for b in batches), "id long")
    assert one.agg(F.sum("id")).first()[0] == 499500
    store.drop(got)
    import os

    assert store.folder and not os.path.exists(f"{store.folder}/t1")


# -- 3 ------------------------------------------------------------------------------------------


def weighted_shingles(words, weight):
    """Weight of each shingle in a word sequence, by a plain loop."""
    k = min(5, len(words))
    out = Counter()
    for j in range(len(words) - k + 1):
        out[tuple(words[j : j + k])] += sum(weight(w) for w in words[j : j + k])
    return out


def brute_leaks(docs, items):
    """The best similarity over all item-sized windows of every document, where it is 0.75 or more."""
    import math

    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    own = {i: w for i, t in items if (w := split(t))}
    df = Counter(w for words in own.values() for w in set(words))
    weight = lambda w: round(1000 * (math.log((1 + len(own)) / (1 + df[w])) + 0.1))
    out = {}
    for d, text in docs:
        words = split(text)
        for i, item in own.items():
            target, m = weighted_shingles(item, weight), len(item)
            best = 0
            for s in range(max(1, len(words) - m + 1)) if words else ():
                have = weighted_shingles(words[s : s + m], weight)
                if have.keys() & target.keys():
                    common = sum(min(v, target[h]) for h, v in have.items())
                    best = max(best, common / (sum(have.values()) + sum(target.values()) - common))
            if best >= 0.75:
                out[d, i] = best
    return out


def test_leaks_match_brute_force(spark):
    items = [prose(n) for n in (12, 20, 35, 36, 60, 3)] + [None, "", "!!"]
    long = items[4].split()
    docs = [prose(40) + " " + items[k] + " " + prose(30) for k in range(5)]
    docs += [items[2].upper().replace(" ", ",\n"), prose(500), None, "", items[0], prose(900) + " " + items[3] + " " + prose(900)]
    docs += [prose(50) + " " + " ".join([*long[:30], "zzz", *long[31:]]) + " " + prose(20), " ".join(long[:25]), "ab " + items[5] + " cd", items[5], " ".join(items[5].split()[:2])]
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, doc_id int")
    want = brute_leaks(list(enumerate(docs)), list(enumerate(items)))
    for most in (20_000, 3):  # in one part, and in several
        decontaminate.ITEMS = most
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(table(spark, docs), bench).collect()}
        clean = {r.doc_id for r in decontaminate.drop_leaks(table(spark, docs), bench).collect()}
        decontaminate.ITEMS = 20_000
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        assert clean == set(range(len(docs))) - {d for d, _ in got}
    assert {(k, k) for k in range(5)} <= set(got) and {(5, 2), (10, 3), (11, 4), (13, 5), (14, 5)} <= set(got) and (12, 4) not in got
    assert decontaminate.leaks(table(spark, []), bench).count() == 0
    assert decontaminate.leaks(table(spark, docs), bench.limit(0)).count() == 0
    twice = decontaminate.leaks(table(spark, [docs[0], docs[0]], [4, 4]), bench.unionAll(bench)).where("item_id = 0")
    assert twice.count() in (2, 4)


def test_leaks_of_few_rare_words_among_common_ones():
    """Most words of an item are in every item and weigh little; what a window lacks of those must not hide it."""
    common = VOCABULARY[:40]
    items = [" ".join(" ".join(rng.choice(common) for _ in range(20)) + " " + " ".join(f"rare{k}x{j}" for j in range(20)) for _ in range(1)) for k in range(40)]
    docs = []
    for k, item in enumerate(items):
        words = item.split()
        # The light part is replaced, the heavy one stays.
        docs.append((k, " ".join([*(f"other{k}x{j}" if j % 4 == 0 and j < 4 else w for j, w in enumerate(words[:20])), *words[20:]])))
    want = brute_leaks(docs, list(enumerate(items)))
    import pyarrow as pa

    (got,) = decontaminate.finder(decontaminate.Index(list(enumerate(items))))(iter([pa.record_batch([pa.array(range(40)), pa.array([t for _, t in docs])], names=["doc_id", "text"])]))
    assert {(r["doc_id"], r["item_id"]) for r in got.to_pylist()} == set(want) == {(k, k) for k in range(40)}


def test_long_items_are_found_fast():
    import time

    import pyarrow as pa

    items = [prose(5000) for _ in range(3)]
    index = decontaminate.Index(list(enumerate(items)))
    text = " ".join([prose(300), items[0], prose(200), *items[1:]])
    began = time.time()
    (got,) = decontaminate.finder(index)(iter([pa.record_batch([pa.array([7]), pa.array([text])], names=["doc_id", "text"])]))
    assert [(r["item_id"], r["similarity"], r["first_word"]) for r in got.to_pylist()] == [(0, 1.0, 300), (1, 1.0, 5500), (2, 1.0, 10500)]
    assert time.time() - began < 3


def test_recall_of_edited_passages():
    """Of passages with so many replaced words, those within the similarity are found."""
    import pyarrow as pa

    items = [prose(rng.randint(20, 90)) for _ in range(25)]
    index = decontaminate.Index(list(enumerate(items)))
    for edits in (1, 2, 3):
        docs = [(k, prose(30) + " " + edited(t, edits) + " " + prose(30)) for k, t in enumerate(items)]
        want = set(brute_leaks(docs, list(enumerate(items))))
        (got,) = decontaminate.finder(index)(iter([pa.record_batch([pa.array([k for k, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])]))
        found = {(r["doc_id"], r["item_id"]) for r in got.to_pylist()}
        assert found <= want and len(found) >= 0.9 * len(want), (edits, len(found), len(want))


def test_index_finds_all_within_radius():
    import numpy as np

    index = decontaminate.Index([(k, prose(20)) for k in range(40)])
    r = np.random.default_rng(0)
    prints = r.integers(0, 2**63, 3000, dtype=np.uint64)
    for k in range(0, 3000, 3):  # some near an item
        bits = r.choice(64, r.integers(0, 20), replace=False)
        prints[k] = index.prints[k % 40] ^ np.uint64(sum(1 << int(b) for b in bits))
    (size,) = index.sizes
    got = set(zip(*(a.tolist() for a in index.candidates(size, prints)), strict=True))
    assert got == {(i, j) for i in range(3000) for j in range(40) if int(prints[i] ^ index.prints[j]).bit_count() <= decontaminate.RADIUS}


# -- 10 -----------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-5, None, "en"), (-6, " 12 !", None), (-7, "", "xx")], "doc_id long, text string, lang string"))
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows.values() if r.held_out and r.doc_id >= 0]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (-5, -6, -7))
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert language.identify(docs.limit(0)).count() == 0


def test_text_of_no_learned_language_is_rejected(spark):
    r = random.Random(1)
    noise = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(n))
    planted = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
        noise(20), noise(300), noise(5000), "zx qj kk", None, "12 !",
    ]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where(r"text rlike '\\p{L}'")
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(planted)], "doc_id long, text string, lang string")
    left = {x.doc_id for x in language.keep_identified(docs.unionByName(more)).collect()}
    assert left == {x.doc_id for x in docs.collect()}


# -- 9 ------------------------------------------------------------------------------------------


def base_spans(x):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    x = x or ""
    v = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(x) if len(m[1]) >= 6]
    v += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    v += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(v)]


SECRETS = [
    None, "", "token=abc", "Token = 'abcdef' é🎉 password:\"hunter2x\"", "AKIA" + "B" * 16 + " AKIA12", "x" * 10 + "0123456789abcdef" * 2, "secret=token:abcdefgh",
    "api_key: " + "ab12" * 8 + " tail", " ".join(f"token=aaaaaa{k}" for k in range(300)), "key 9fKq2LmZx81VbTqWe72Lpz0 end", "an_ordinary_identifier_name here and getUserAccountName2",
    "🎉" * 50 + "passwd=abcdef1", "apikey=secret=deadbeef",
]


def test_secrets_match_regular_expressions(spark):
    rows = {r.doc_id: r for r in secrets.secrets(table(spark, SECRETS)).collect()}
    for k, text in enumerate(SECRETS):
        want = base_spans(text)
        assert rows[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [s for s in rows[k].spans.split(",") if s and not s.startswith("random")] == want
        assert rows[k].n_assign == sum(s.startswith("assign") for s in want)
    assert rows[9].spans == "random:4:27" and rows[10].spans == ""


def test_random_tokens_without_digits(spark):
    words = ["kXqZvTbRwLpJmNcY", "QzHkVxWpRtYbNmLcKj", "hJkWqXzPvBnRtYcMdGfLsQwEzXkVbNpT"]
    plain = ["getUserAccountNameFromDatabase", "x" * 40, "hahahahahahahahahaha", "--------------------a", "reeuxouierauxaux", "/usr/share/document/library", "INTERNATIONALISATION"]
    rows = {r.doc_id: r.spans for r in secrets.secrets(table(spark, [f"key {w} end" for w in words + plain])).collect()}
    assert [rows[k] for k in range(len(words))] == [f"random:4:{4 + len(w)}" for w in words]
    assert all(rows[len(words) + k] == "" for k in range(len(plain)))


def test_redaction_leaves_no_secret_and_clean_rows_alone(spark):
    docs = table(spark, SECRETS)
    out = {r.doc_id: r for r in secrets.redacted(docs).collect()}
    assert secrets.redacted(docs).columns == docs.columns
    for k, text in enumerate(SECRETS):
        found = secrets.secrets(table(spark, [out[k].text])).first() if k in (3, 4, 5, 7, 9) else None
        assert found is None or found.spans == ""
        if k in (0, 1, 2, 10):
            assert out[k].text == text
        elif text:
            assert out[k].n_chars == len(out[k].text)
    assert secrets.redacted(docs.limit(0)).count() == 0


# -- 1 ------------------------------------------------------------------------------------------


def test_mix_follows_targets_and_sql(spark):
    import duckdb

    sources = ["a", "b", None, "c", "b"] * 60
    texts = [None if k % 37 == 0 else prose(1 + k % 50) for k in range(300)]
    docs = table(spark, texts, sources=sources)
    rows = mixing.copies_of(spark, docs).drop("pattern").toPandas()
    again = mixing.copies_of(spark, docs).drop("pattern").toPandas()
    documents = docs.select("doc_id", "text", "source").toPandas()
    want = duckdb.sql(mixing.OP1_SQL).df()
    order = lambda f: f[sorted(f.columns)].sort_values("doc_id").reset_index(drop=True)
    assert (order(rows) == order(want)).all().all() and (order(rows) == order(again)).all().all() and len(documents) == 300
    rows["source"] = [str(sources[k]) for k in rows.doc_id]
    assert (rows.taken <= 3 * rows["size"]).all()
    for _, own in rows.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 25
    assert mixing.copies_of(spark, docs.limit(0)).count() == 0


def test_mix_of_repeated_rows_matches_sql(spark):
    import duckdb

    rows = [(5, "a b c d e f", "s"), (5, "a b c d e f", "s")] * 12 + [(None, "x y z", "t"), (None, "x y z", "t"), (None, None, None), (7, "w " * 9, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents = docs.toPandas().astype({"doc_id": "Int64"})
    got = mixing.copies_of(spark, docs).drop("pattern").toPandas()
    want = duckdb.sql(mixing.OP1_SQL).df()
    plain = lambda f: sorted(tuple(-1.0 if v != v else float(v) for v in r) for r in f[sorted(f.columns)].astype(float).itertuples(index=False))
    assert plain(got) == plain(want) and len(documents) == len(rows)
    for s in ("s", "t"):
        own = [r for r in mixing.copies_of(spark, docs.where(f"source = '{s}'")).collect()]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9
    taken = mixing.mixed(spark, docs.withColumn("copies", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("a.b", F.lit(2)))
    assert taken.columns == ["doc_id", "text", "source", "copies", "row", "a.b", "copies_2", "target"]
    words = sum(len(r.text.split()) * r.copies_2 for r in taken.collect())
    assert words == got.taken.sum() and {r.copies for r in taken.collect()} == {"mine"}


def test_mix_of_overlapping_sources_is_least_cost(spark):
    """Against all integer flows of a small program: the largest flow, and among those the least repetition cost."""
    import itertools

    r = random.Random(8)
    for _ in range(12):
        member = [sorted(r.sample(range(2), r.randint(1, 2))) for _ in range(3)]
        capacity, quota = [r.randint(1, 3) for _ in member], [r.randint(0, 6) for _ in range(2)]
        arcs = [(p, s) for p, m in enumerate(member) for s in m]
        best = None
        for flow in itertools.product(*[range(min(3 * capacity[p], quota[s]) + 1) for p, s in arcs]):
            by_pattern = [sum(f for f, (p, _) in zip(flow, arcs, strict=True) if p == k) for k in range(3)]
            if any(b > 3 * c for b, c in zip(by_pattern, capacity, strict=True)) or any(sum(f for f, (_, s) in zip(flow, arcs, strict=True) if s == k) > quota[k] for k in range(2)):
                continue
            value = (-sum(flow), sum(max(0, b - c) + max(0, b - 2 * c) for b, c in zip(by_pattern, capacity, strict=True)))
            best = value if best is None else min(best, value)
        flows = mixing.min_cost_flow(capacity, member, quota)
        sums = [sum(f.values()) for f in flows]
        assert (-sum(sums), sum(max(0, b - c) + max(0, b - 2 * c) for b, c in zip(sums, capacity, strict=True))) == best


def test_mix_of_overlapping_members(spark):
    """Documents of both sources fill the quota that its own documents cannot."""
    rows = [(k, prose(10), ["a"] if k < 40 else ["b"] if k < 44 else ["a", "b"] if k < 100 else []) for k in range(103)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, names array<string>")
    out = {r.doc_id: r for r in mixing.copies_of(spark, docs, F.col("names")).collect()}
    assert all(out[k].taken == 0 and out[k].target is None for k in range(100, 103))
    flows = mixing.min_cost_flow([400, 560, 40], [[0], [0, 1], [1]], [int(t) for t in mixing.targets([960, 600], [1, 2], 1000)])
    want = {'["0a"]': sum(flows[0].values()), '["0a","0b"]': sum(flows[1].values()), '["0b"]': sum(flows[2].values())}
    got = Counter()
    for r in out.values():
        got[r.pattern] += r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(got[p] - w) <= 10 for p, w in want.items()), (got, want)


def test_flow_uses_overlap_and_first_copies_first():
    # Pattern 0 serves either source, pattern 1 only source 1: the shared words go to source 0.
    flows = mixing.min_cost_flow([100, 100], [[0, 1], [1]], [100, 100])
    assert flows == [{0: 100}, {1: 100}]
    flows = mixing.min_cost_flow([10, 100], [[0], [0]], [150])
    assert flows[0][0] == 20 or flows[0][0] == 10 and flows[1][0] == 140 or sum(f[0] for f in flows) == 150
    assert sum(mixing.min_cost_flow([10], [[0]], [100])[0].values()) == 30
    assert mixing.targets([10, 1000], [1, 1], 1010) == [30.0, 980.0]


# -- 8 ------------------------------------------------------------------------------------------


def spots(text):
    """The signatures' strings, by a plain loop."""
    anchors = set(spotsigs.ANCHORS)
    w = re.findall(r"(?:[^\W_])+", (text or "").lower())
    out = set()
    content = [k for k, x in enumerate(w) if x not in anchors]
    for k, x in enumerate(w):
        if x in anchors and k + 1 in content:
            after = [j for j in content if j > k][:2]
            if len(after) == 2:
                out.add((x, *[w[j] for j in after]))
    return out, len(w)


def test_spotsigs_fingerprints(spark):
    text = "The cat of the old house is asleep, and a dog barks in THE garden of my aunt."
    texts = [text, text.upper(), "the the the", "", None, "!!", "a dog", prose(300), text + " the end came on a day of rain", "été the naïve wolf ran"]
    rows = sorted(spotsigs.edited_fingerprints(table(spark, texts)).collect(), key=lambda r: r.doc_id)
    clean = [t or "" for t in texts]
    for k, r in enumerate(rows):
        half = len(clean[k]) // 2
        want = clean[k][: len(clean[k]) - half] + clean[(k + 1) % len(clean)][:half]
        assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.n_chars == len(clean[k])
        found, n = spots(clean[k])
        assert len(r.fingerprint) == 8 * (len(found) + (1 if n or clean[k] else 0))
        assert 0 <= r.near_edited <= 1
    assert rows[0].fingerprint == rows[1].fingerprint and rows[0].near_next == 1
    assert rows[3].near_next == 1 and rows[3].fingerprint == ""
    a, b = (spots(texts[k])[0] | {"^"} for k in (7, 8))
    assert abs(rows[7].near_next - len(a & b - {"^"}) / len(a | b)) < 0.05
    assert spotsigs.edited_fingerprints(table(spark, [])).count() == 0


def test_spotsigs_cover_texts_without_anchors(spark):
    menu = "home news shop sport music film games books cars maps"
    far = ["zz" + w for w in prose(200).split()]
    texts = [menu, menu.replace("maps", "jobs"), "home news", " ".join([*far, "the", "zza", "zzb"]), " ".join([*far[:150], *far[:50], "the", "zza", "zzb"])]
    rows = sorted(spotsigs.edited_fingerprints(table(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert len({r.fingerprint for r in rows}) == 5 and len(rows[0].fingerprint) == 8 * 10
    assert rows[0].near_next == 9 / 11 and all(r.near_edited < 1 for r in rows[:1]) and rows[3].near_next < 1
    assert len(rows[3].fingerprint) > 8 * 100


def test_next_document_over_sparse_and_repeated_ids(spark):
    ids = [0, 31, 32, 5000, 5000, 10**9, None]
    texts = [f"text number {k} of this run" for k in range(len(ids))]
    rows = spotsigs.edited_fingerprints(table(spark, texts, ids)).collect()
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2]).encode()).hexdigest() for k, t in enumerate(texts))
    assert Counter(r.edited_sha256 for r in rows) == want


def test_next_document_of_many_rows_without_ids(spark):
    """All rows form one circle: each text's edited form ends with the beginning of some other row's, and every row is once the next."""
    texts = [f"{k:03d} the text {k} of no id" for k in range(60)]
    ids = [1, 2, *[None] * 58]
    docs = table(spark, texts, [-1] * 60).drop("doc_id").withColumn("n", F.substring("text", 1, 3).cast("int"))
    docs = docs.withColumn("doc_id", F.when(F.col("n") < 2, F.col("n") + 1).cast("long"))
    rows = spotsigs.edited_fingerprints(docs).collect()
    want = {hashlib.sha256((t[: len(t) - len(t) // 2] + o[: len(t) // 2]).encode()).hexdigest(): (k, j) for k, t in enumerate(texts) for j, o in enumerate(texts)}
    edges = dict(want[r.edited_sha256] for r in rows)
    assert len(edges) == 60 and edges[0] == 1 and sum(r.doc_id is None for r in rows) == ids.count(None)
    seen, k = [], 0
    while k not in seen:
        seen.append(k)
        k = edges[k]
    assert len(seen) == 60


def test_spotsigs_pairs_match_brute_force(spark):
    anchors = ["the", "of", "and", "in"]
    base = [" ".join(f"{rng.choice(anchors)} {rng.choice(VOCABULARY)}" for _ in range(60)) for _ in range(4)]
    texts = [t for b in base for t in (b, b, edited(b, 2), edited(b, 4), edited(b, 15))]
    docs = table(spark, texts)
    got = {(r.a, r.b) for r in spotsigs.similar_pairs(docs).collect()}
    sig = {r.doc_id: frozenset(r.s) for r in docs.select("doc_id", spotsigs.signatures(docs.text).alias("s")).collect()}
    first = {}
    for i in sorted(sig):
        first.setdefault(sig[i], i)
    reps = sorted(first.values())
    want = {(a, b) for a in reps for b in reps if a < b and len(sig[a] & sig[b]) >= 0.75 * len(sig[a] | sig[b])}
    assert got == want and want


@pytest.mark.parametrize("percent", [50, 55, 75, 90])
def test_alike_sets_against_all_pairs(spark, percent):
    r = np.random.default_rng(percent)
    sets = []
    for n in (1, 2, 4, 8, 16, 64, 100, 110, 180, 200):
        base = r.choice(10**6, n, replace=False) + 1000
        for keep in {n, n - n * (100 - percent) // 100, -(-n * percent // 100), -(-n * percent // 100) - 1, n // 2}:
            if keep > 0:
                sets += [set(base[:keep].tolist()), set(base[:keep].tolist()) | {1, 2}, set(base[-keep:].tolist())]
    sets = sorted({tuple(sorted(x)) for x in sets})
    df = spark.createDataFrame([(k, list(x)) for k, x in enumerate(sets)], "rep long, sig array<long>")
    want = {}
    for a, x in enumerate(sets):
        for b in range(a + 1, len(sets)):
            common, whole = len(set(x) & set(sets[b])), len(set(x) | set(sets[b]))
            if 100 * common >= percent * whole:
                want[a, b] = common / whole
    assert {(p.a, p.b): p.likeness for p in spotsigs.alike(df, percent).collect()} == want and len(want) > 20
    assert spotsigs.alike(df.limit(0), percent).count() == 0


def test_bands_part_sizes_that_cannot_be_alike():
    for percent in (2, 50, 55, 75, 99):
        starts = spotsigs.bands(percent, 5000)
        for k in range(len(starts) - 2):
            # The largest set of a partition, and the least of the one after the next.
            assert 100 * (starts[k + 1] - 1) < percent * starts[k + 2]


# -- 4 ------------------------------------------------------------------------------------------


def test_url_rules_and_model(spark):
    urls = {
        "https://a.b.net/x": ("a.b.net", "/x", "net/", "block"), "http://WWW.Example.NET/en/1?q=/": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "http://notexample.net/en/1": ("notexample.net", "/en/1", "net/", "block"), "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "x://y.org/fr/a#b": ("y.org", "/fr/a", "org/fr/", "allow"), "nothing": ("", "", None, "allow"), "http://net": ("net", "", None, None), None: ("", "", None, "allow"),
        "http://free-casino-bonus.example.com/en/3": ("free-casino-bonus.example.com", "/en/3", None, "block"), "http://city-museum.example.com/en/3": ("city-museum.example.com", "/en/3", None, "allow"),
    }
    rows = spark.createDataFrame([(k, u, "h", 0.5) for k, u in enumerate(urls)], "page_id long, url string, host string, score double")
    got = {r.page_id: r for r in url_filter.verdicts(rows).collect()}
    for k, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert verdict is None or got[k].verdict == verdict
    assert url_filter.verdicts(rows.limit(0)).count() == 0


def test_url_model_matches_a_plain_recursion(spark):
    """Scores by the definition: Witten-Bell through all known contexts, no automaton."""
    import math

    samples = [(url_filter.symbols(r.url.split("://")[1]), r.rejected) for r in url_filter.default_samples(spark).limit(400).collect()]
    samples = [(s, k % 2 == 0) for k, (s, _) in enumerate(samples)]
    model = url_filter.Model(samples)
    seen = {True: Counter(), False: Counter()}
    for text, rejected in samples:
        p = "^" + text
        for i in range(1, len(p)):
            for k in range(min(url_filter.ORDER, i) + 1):
                seen[rejected][p[i - k : i], p[i]] += 1
    after = {r: {} for r in seen}
    for r in seen:
        for (context, _), n in seen[r].items():
            total, kinds = after[r].get(context, (0, 0))
            after[r][context] = (total + n, kinds + 1)
    known = {c for c in {*after[True], *after[False]} if sum(after[r].get(c, (0, 0))[0] for r in after) >= url_filter.LEAST} | {"", "^"}

    def chance(r, context, c):
        lower = chance(r, context[1:], c) if context else 1 / url_filter.WIDTH
        total, kinds = after[r].get(context, (0, 0))
        return (seen[r][context, c] + kinds * lower) / (total + kinds) if total else lower

    texts = [s for s, _ in samples[:40]] + ["qqq.zz/\u00e9\u00e9x", "A.B/%", "x", "\U0001f389" * 3 + "ad", "a" * 50_000]
    got = {r.s: r.v for r in spark.createDataFrame([(t,) for t in texts], "s string").select("s", url_filter.scored(F.col("s"), model).alias("v")).collect()}
    for t in texts[:-1]:
        p = "^" + url_filter.symbols(t)
        total = 0
        for i in range(1, len(p)):
            context = next(p[max(0, i - k) : i] for k in range(min(url_filter.ORDER, i), -1, -1) if p[i - k : i] in known)
            total += math.log(chance(True, context, p[i])) - math.log(chance(False, context, p[i]))
        assert abs(got[t] - total / len(t)) < 0.001, t
    assert all(abs(got[t] - model.score(t)) < 1e-9 for t in texts)


def test_url_threshold_keeps_its_false_positive_rate(spark):
    made = url_filter.Filter(url_filter.default_samples(spark))
    rows = url_filter.default_samples(spark).collect()
    score = lambda u: made.model.score(u.split("://")[1])
    blocked = {k: sum(score(r.url) > made.threshold for r in rows if r.rejected is k) / sum(r.rejected is k for r in rows) for k in (True, False)}
    assert blocked[False] <= 0.02 and blocked[True] >= 0.9
    one_class = url_filter.Filter(url_filter.default_samples(spark).where("rejected"))
    assert one_class.threshold == float("inf")
    r = spark.createDataFrame([(1, "http://a.b/" + "x" * 300_000), (1, "http://a.b/" + "x" * 300_000), (None, "http://\u00e9.org/fr/1")], "page_id long, url string")
    out = url_filter.verdicts(r.withColumn("host", F.lit(1)).withColumn("a.b", F.lit(2))).collect()
    assert len(out) == 3 and [(x.host, x.rule) for x in out if x.page_id is None] == [("\u00e9.org", "org/fr/")]


# -- 5 ------------------------------------------------------------------------------------------


def test_html_main_text(spark):
    trees = html_main.train(120)
    r = random.Random(77)
    right = 0
    for _ in range(40):
        source, main = html_main.made_page(r)
        page = html_main.parse(source)
        right += html_main.main_texts([source], trees)[0].split("\n\n") == [t for _, t in page.segments if t in main]
    assert right >= 38
    pages = [(1, "u", "<html><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>A &amp; B</h1><p>One\n two<br>three<p>" + "four " * 400 + "</article><footer>&copy; me</footer>"), (2, None, None), (3, "u", ""), (4, "u", "<div>" * 3000 + "x")]
    out = {r.page_id: r for r in html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), trees).collect()}
    assert out[1].text == "A & B\n\nOne two three\n\n" + ("four " * 400).strip() and out[1].n_chars == len(out[1].text)
    assert out[2].text == "" and out[3].text == "" and len(out) == 4


def test_unclosed_dropped_elements_do_not_cut_the_page():
    def text(source):
        return " ".join(t for _, t in html_main.parse(source).segments)

    assert text("<html><head><title>T</title><meta charset=x><p>One<p>two") == "One two"
    assert text("<html><head><title>T</title><style>x</style>Bare <b>text</b>") == "Bare text"
    assert text("<head><script>a<p>b</script></head><body>one<head>two") == "onetwo" and text("<head><title>T</title>") == ""
    for tag in ("button", "select", "object", "map", "svg"):
        assert text(f"<body><div>a <{tag}>b</div><p>c</p></body>") == "a b c"
        assert text(f"<div>a<{tag}>b<p>c") == "ab c"
        assert text(f"<div>a<{tag}><div>b</div>x</{tag}>c</div><p>d") == "ac d"
        assert text(f"<div>a<{tag}>b</div></{tag}><p>c") == "ab c"
    assert text("<div>a<svg/>b<object><object>x</object>y</object>c<textarea>d<p>e") == "abcd e"
    assert len(html_main.parse("<button><p>x" * 20000).segments) == 20000


def test_decoding_keeps_nothing_below_a_dropped_node():
    import numpy as np

    page = html_main.parse("<body><div><p>good text</p></div><div><p>other</p></div></body>")
    keep = html_main.decode(page, np.array([1.0, -9.0, 2.0, 1.0, 1.0]))
    assert not keep[1] and not keep[2] and keep[3] and keep[4]


# -- 6 ------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    talks = {
        1: [("user", control), ("assistant", control)], 2: [("assistant", "  lead <\\| <| x \n\n"), ("assistant", ""), ("user", " a"), ("assistant", "日本語 🎉é\n ")],
        3: [("assistant", None), (None, "q")], 4: [("as<|im_sep|>", "q"), ("assistant", " " * 50)], 5: [("user", "x"), ("assistant", "word " * 30000)],
    }
    rows = spark.createDataFrame([(c, k, r, t, "z") for c, turns in talks.items() for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.formatted(rows.repartition(4)).collect()}
    for c, turns in talks.items():
        turns = [(r or "", t or "") for r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert out[c].formatted_chars == len(out[c].formatted) and out[c].n_turns == len(turns)
    assert chat.formatted(rows.limit(0)).count() == 0


def test_mask_is_that_of_all_offsets():
    """The tokens of each assistant text by looking at every token's offsets."""
    with open(chat.TOKENIZER, encoding="utf-8") as f:
        tokenizer = chat.tokenizer_from(f.read())
    for talk in ([("user", "<|im_end|>"), ("assistant", "  lead <\\| <| x \n\n"), ("assistant", ""), ("assistant", "日本語 🎉é\n ")], [("assistant", " " * 50)], [("assistant", "é" * 20 + "  "), ("user", "🎉"), ("assistant", "\t\t x \n")], [("assistant", prose(400))]):
        formatted, spans = chat.render(talk)
        encoding = tokenizer.encode(formatted, add_special_tokens=False)
        stops = [b for _, b in encoding.offsets]
        starts = [min(a, stops[k - 1]) if k else 0 for k, (a, _) in enumerate(encoding.offsets)]
        got = chat.mask(spans, chat.Offsets(encoding))
        for (a, b), (first, last) in zip(spans.tolist(), got, strict=True):
            assert list(range(first, last)) == [k for k in range(len(stops)) if stops[k] > a and starts[k] < b]
            assert formatted[starts[first] : stops[last - 1]] == formatted[a:b] if last > first else a == b


# -- 2 ------------------------------------------------------------------------------------------


def test_warc_derivatives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "<html><head><title>t</title></head><body><p>One &amp;\n two</p><script>x</script><p>three</p>"), (2, None, None)], "page_id long, url string, html string")
    responses = warc.responses(pages)
    derived = warc.derive(responses)
    rows = {(r.target_uri, r.type): r for r in derived.collect()}
    assert len(rows) == 4 and bytes(rows["http://a/é", "conversion"].block) == b"One & two\nthree"
    ids = {r.target_uri: r.record_id for r in responses.collect()}
    source = {r.target_uri: bytes(r.block) for r in responses.collect()}
    for (uri, kind), r in rows.items():
        head = {h.name: h.value for h in r.headers}
        assert head["WARC-Refers-To"] == ids[uri] == r.refers_to and head["WARC-Type"] == kind
        assert head["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and int(head["Content-Length"]) == len(r.block)
        if kind == "metadata":
            assert f"source-block-digest: {warc.digest(source[uri])}".encode() in bytes(r.block) and b"http-header-content-type: text/html" in bytes(r.block)
    warc.write(derived, str(tmp_path / "w"))
    back = {(r.target_uri, r.type): r for r in warc.read(spark, str(tmp_path / "w" / "*.gz")).collect()}
    assert {k: (bytes(r.block), r.record_id, r.refers_to) for k, r in back.items()} == {k: (bytes(r.block), r.record_id, r.refers_to) for k, r in rows.items()}
    assert warc.derive(responses.limit(0)).count() == 0


def test_warc_source_headers_and_encodings(spark, tmp_path):
    import gzip
    import zlib

    html = "<p>caf\u00e9</p><!-- x --><p title='a>b'>two<br>three<script>if (a<b) {}</script>"
    body = html.encode("latin-1")
    packed = gzip.compress(body)
    chunks = b"".join(b"%x;q=1\r\n%s\r\n" % (len(packed[k : k + 20]), packed[k : k + 20]) for k in range(0, len(packed), 20)) + b"0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n"
    plain = b"HTTP/1.1 404 No\r\nContent-Type: text/plain\r\nContent-Encoding: deflate\r\n\r\n" + zlib.compress(b"a < b")
    own = {"a": head + chunks, "b": plain, "c": b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nnot gzip", "d": b"", "e": bytes(range(256)) * 3 + b"\r\n"}
    stated = {"a": warc.digest(chunks), "b": "sha1:AAAA", "c": "md5:x"}
    rows = []
    for k, block in own.items():
        headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{k}>"), ("WARC-IP-Address", "10.0.0.1"), ("WARC-Warcinfo-ID", "<urn:info>"), ("Content-Length", str(len(block)))] + [("WARC-Payload-Digest", v) for v in [stated.get(k)] if v]
        rows.append((f"<urn:{k}>", "response", None, "http://x", None, headers, bytearray(block)))
    rows.append(("<urn:info>", "warcinfo", None, None, None, [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("Content-Length", "3")], bytearray(b"a:b")))
    warc.write(spark.createDataFrame(rows, warc.RECORD).coalesce(2), str(tmp_path / "in"))
    for whole in (False, True):
        read = warc.read(spark, str(tmp_path / "in"), whole)
        assert {r.record_id: bytes(r.block) for r in read.collect()} == {f"<urn:{k}>": b for k, b in own.items()} | {"<urn:info>": b"a:b"}
    out = {(r.refers_to, r.type): r for r in warc.derive(read).collect()}
    assert len(out) == 2 * len(own) and sorted(map(str, warc.derive_files(spark, str(tmp_path / "in")).collect())) == sorted(map(str, out.values()))
    text = {k: bytes(out[f"<urn:{k}>", "conversion"].block).decode() for k in own}
    assert text["a"] == "caf\u00e9\ntwo\nthree" and text["b"] == "a < b" and text["c"] == "not gzip" and text["d"] == ""
    info = {k: bytes(out[f"<urn:{k}>", "metadata"].block).decode() for k in own}
    assert "source-warc-ip-address: 10.0.0.1\r\n" in info["a"] and f"source-warc-payload-digest: {stated['a']}\r\n" in info["a"]
    assert "source-payload-digest-valid: true" in info["a"] and "source-payload-digest-valid: false" in info["b"] and "-valid" not in info["c"]
    assert {h.name: h.value for h in out["<urn:a>", "conversion"].headers}["WARC-Warcinfo-ID"] == "<urn:info>"
    nested = [("<urn:n>", "response", None, None, None, [("Content-Length", "20")], bytearray(b"x\r\n\r\nWARC/1.0\r\n\r\n..."))]
    warc.write(spark.createDataFrame(nested, warc.RECORD), str(tmp_path / "nested"))
    assert [bytes(r.block) for r in warc.read(spark, str(tmp_path / "nested")).collect()] == [b"x\r\n\r\nWARC/1.0\r\n\r\n..."]  # written apart, so read whole
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "a.warc").write_bytes(b"WARC/1.0\r\nContent-Length: 24\r\n\r\nx\r\n\r\nWARC/1.0\r\n\r\n...........\r\n\r\n")
    with pytest.raises(Exception, match="whole=True"):
        warc.read(spark, str(tmp_path / "foreign")).collect()


def test_warc_query_matches_a_plain_loop(spark):
    """Every page gives two records of the query; its text holds all words outside tags and scripts, in order."""
    from gridloom.llm.queries import queries

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    rows = queries()["op2_warc_derivatives"](spark, SF).collect()
    assert len(rows) == 2 * len(pages) and {r.refers_to for r in rows} and len({r.record_id for r in rows}) == len(rows)
    by_url = {}
    for r in rows:
        by_url.setdefault((r.target_uri, r.type), []).append(r)
        assert len(r.content.encode()) == int(r.content_length) and warc.digest(r.content.encode()) == r.warc_block_digest
    import html as entities

    for p in pages:
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", p.html)
        want = entities.unescape(re.sub(r"<[A-Za-z/!][^>]*>", " ", body)).split()
        assert any(r.content.split() == want for r in by_url[p.url, "conversion"])
        assert all("source-payload-digest-valid: true" in r.content for r in by_url[p.url, "metadata"])


# -- pipeline -----------------------------------------------------------------------------------


def test_pipeline_on_whole_tables(spark):
    import corpus_pipeline

    documents = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id for r in docs.collect()}
        assert after <= before
        if name != "mix":
            assert docs.columns == columns
        if name == "near_dedup":
            want = brute_components([(i, documents[i].text) for i in before])
            assert after == {i for i in before if want[i][1] == i}
        if name == "decontaminate":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert all(i not in after for i in before if any(t in documents[i].text for t in items))
        if name == "secrets":
            assert after == before
    assert docs.count() and {"copies", "target"} <= set(docs.columns)
    out = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in every column, repeated rows, an empty table, and columns whose names the operators use themselves."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["row", "copies", "target", "_gone", "cuts", "base", "item_id", "sig", "n", "component", "a.b"]
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "token=abcdefgh", None, None, 3), (10**6, None, "en", "web", 0), (10**6 + 1, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(odd).unionByName(odd)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        if name == "near_dedup":  # the odd rows that the language stage took, once more
            docs = docs.unionByName(odd, allowMissingColumns=True).fillna(dict.fromkeys(names[:-1], "")).select(*[F.lit(n).alias(n) if n in names else n for n in columns])
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns[: len(columns)] == columns and all([r[n] for n in names] == names for r in rows)
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and empty.columns == out.columns
        if name in ("near_dedup", "secrets", "decontaminate"):
            assert sum(r.doc_id is None for r in rows) == docs.where("doc_id is null").count()
        docs = spark.createDataFrame(rows, out.schema)
        columns = columns if name != "mix" else out.columns
