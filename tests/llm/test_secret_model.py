"""The spans that the secret models add, against a plain loop; recall on strings they have not seen; odd tables."""

import random
import time
from collections import Counter

import regex
from pyspark.sql import functions as F

from gridloom.llm import secrets


def plain_ratio(spark):
    """log ratios by character pair, from the training folds of the default samples."""
    rows = secrets.default_samples(spark).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(4))).where("fold > 0 and length(text) >= 2").collect()
    counts = {True: Counter(), False: Counter()}
    for r in rows:
        counts[r.random].update(zip(r.text, r.text[1:], strict=False))
    import math

    def log(kind, a, b):
        total = sum(n for (x, _), n in counts[kind].items() if x == a)
        return math.log((counts[kind][a, b] + 0.5) / (total + 0.5 * 95))

    chars = [chr(c) for c in range(32, 127)]
    return {(a, b): log(True, a, b) - log(False, a, b) for a in chars for b in chars}


def test_added_spans_match_a_plain_loop(spark):
    ratio = plain_ratio(spark)
    _, least = secrets.train(secrets.default_samples(spark))
    r = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.3:
                parts.append("".join(r.choice(alphabet) for _ in range(r.randint(10, 40))))
            elif kind < 0.5:
                parts.append(r.choice("_-/").join(r.choice(secrets.ORDINARY) for _ in range(4)))
            elif kind < 0.6:
                parts.append("token=" + "".join(r.choice(alphabet) for _ in range(20)))
            elif kind < 0.7:
                parts.append("".join(r.choice("0123456789abcdef") for _ in range(30)))
            elif kind < 0.8:
                parts.append("é" + "".join(r.choice(alphabet) for _ in range(20)) + r.choice(["", "ü"]))
            else:
                parts.append(r.choice(secrets.ORDINARY))
        texts.append(" ".join(parts))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.spans.split(",") if x.spans else [] for x in secrets.secrets(rows).collect()}
    n = 0
    for k, text in enumerate(texts):
        base = [tuple(map(int, s.split(":")[1:])) for s in got[k] if not s.startswith("random")]
        want = []
        for m in regex.finditer(secrets.TOKEN, text):
            w = m[0]
            mean = sum(ratio[p] for p in zip(w, w[1:], strict=False)) / (len(w) - 1)
            digits = any(c.isdigit() for c in w)
            if abs(mean - least) < 0.001 or abs(mean - least - secrets.STRICTER) < 0.001:
                want = None
                break
            if mean > least + (0 if digits else secrets.STRICTER) and (digits or len(set(w)) >= secrets.DISTINCT) and not any(a < m.end() and m.start() < b for a, b in base):
                want.append(f"random:{m.start()}:{m.end()}")
        if want is not None:
            assert [s for s in got[k] if s.startswith("random")] == want, text
            n += len(want)
    assert n > 100


def test_recall_on_unseen_random_strings(spark):
    r = random.Random(9)
    kinds = {
        "base62": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "base64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
        "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "letters": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    }
    rows = [(kind, n, "key " + "".join(r.choice(chars) for _ in range(n)) + " end") for kind, chars in kinds.items() for n in (20, 32, 40) for _ in range(200)]
    wide = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    found = {x.doc_id for x in secrets.secrets(wide).where("spans <> ''").collect()}
    share = {key: sum(k in found for k, (a, b, _) in enumerate(rows) if (a, b) == key) / 200 for key in {(a, b) for a, b, _ in rows}}
    print(sorted(share.items()))
    assert all(v >= (0.9 if kind != "letters" else 0.75) for (kind, _), v in share.items()), share
    plain = ["_".join(r.choice(secrets.ORDINARY) for _ in range(r.randint(2, 5))) for _ in range(1000)]
    clean = secrets.secrets(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")).where("spans <> ''").count()
    assert clean <= 10


def test_names_of_the_users_columns_stay(spark):
    names = ["base", "all_spans", "more", "cuts", "new_text", "_base", "_text", "a.b"]
    rows = [(1, "token=abcdefgh x", *names), (1, "token=abcdefgh x", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = secrets.redacted(docs)
    assert out.columns == docs.columns
    got = sorted(out.collect(), key=lambda r: r.doc_id or 0)
    assert [tuple(r)[2:] for r in got] == [tuple(names)] * 3 and [r.text for r in got] == [None, "[secret] x", "[secret] x"]


def test_very_many_spans_in_one_text(spark):
    text = " ".join(f"token=aaaaaa{k} 9fKq2LmZx81VbTqWe72Lpz0" for k in range(5000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = secrets.secrets(docs).first()
    assert r.n_assign == 5000 and r.spans.count(",") == 9999
    assert secrets.redacted(docs).first().text == " ".join(["[secret]"] * 10000)
    assert time.time() - began < 60
