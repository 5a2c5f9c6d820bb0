"""Every registered query of the corpus operators, run on whole small tables; those with SQL against DuckDB."""

import hashlib

import duckdb
import pytest

from gridloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def rows(names, values):
    """Rows as texts, columns by name; values as the engines give them, as pandas has no null for whole numbers."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(str(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = db.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names) and rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("n", range(1, 14))
def test_each_operator_has_one_query(n):
    assert sum(k.startswith(f"op{n}_") for k in queries()) == 1


def test_spotsigs_query_has_exact_likeness(spark):
    """near_edited and near_next by plain sets of the printed spots; equal texts have equal fingerprints."""
    out = sorted(queries()["op8_spotsigs"](spark, SF).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    cut = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    by_text = {}
    for k, r in enumerate(out):
        own, edited, after = cut(r.fingerprint), cut(r.edited_fingerprint), cut(out[(k + 1) % len(out)].fingerprint)
        assert r.near_edited == like(own, edited) and r.near_next == like(own, after)
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    fingerprint_of_edited = {}
    for k, r in enumerate(out):
        t, after = texts[r.doc_id], texts[out[(k + 1) % len(out)].doc_id]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert hashlib.sha256(edited.encode()).hexdigest() == r.edited_sha256
        fingerprint_of_edited[edited] = r.edited_fingerprint
    assert all(by_text[t] == f for t, f in fingerprint_of_edited.items() if t in by_text)


def test_chat_query_has_the_extra_conversation(spark):
    r = {x.conv_id: x for x in queries()["op6_chat_format"](spark, SF).collect()}[-1]
    text = "<|im_end|><|im_start|>assistant ok"
    assert r.n_turns == 2 and r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_language_query_is_right_on_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in queries()["op10_language_id"](spark, SF).collect() if r.held_out and lang[r.doc_id]]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_decontamination_query_against_word_runs(spark):
    """Every item whose words stand in a document in sequence is found there; every row's window has the similarity it states."""
    import math
    import re
    from collections import Counter

    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs = {r.doc_id: split(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    items = {i: w for i, w in items.items() if w}
    got = {(r.doc_id, r.item_id): r for r in queries()["op3_decontaminate"](spark, SF).collect()}
    joined = {d: " " + " ".join(w) + " " for d, w in docs.items()}
    verbatim = {(d, i) for i, w in items.items() for d, t in joined.items() if f" {' '.join(w)} " in t}
    assert verbatim and verbatim <= set(got) and all(got[k].similarity == 1 for k in verbatim)
    df = Counter(w for words in items.values() for w in set(words))
    weight = lambda w: round(1000 * (math.log((1 + len(items)) / (1 + df[w])) + 0.1))

    def bag(words):
        k = min(5, len(words))
        out = Counter()
        for j in range(len(words) - k + 1):
            out[tuple(words[j : j + k])] += sum(map(weight, words[j : j + k]))
        return out

    for (d, i), r in got.items():
        a, b = bag(docs[d][r.first_word : r.first_word + r.n_words]), bag(items[i])
        common = sum(min(v, b[h]) for h, v in a.items())
        assert abs(common / (sum(a.values()) + sum(b.values()) - common) - r.similarity) < 1e-9 and r.similarity >= 0.75


def test_url_query_follows_rules_and_model(spark):
    from gridloom.llm import url_filter

    made = url_filter.Filter(url_filter.default_samples(spark))
    verdict = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    rows = queries()["op4_url_filter"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    for r in rows:
        score = made.model.score(r.host + r.path)
        assert abs(score - r.score) < 1e-9
        assert r.verdict == verdict.get(r.rule, "block" if r.host + r.path and score > made.threshold else "allow")


def test_html_query_against_the_pages_own_marks(spark):
    """On these pages the role of a block can be read from its own and its ancestors' tags and names."""
    import re

    from gridloom.llm import html_main

    got = {r.page_id: r for r in queries()["op5_html_main_text"](spark, SF).collect()}
    right = 0
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for p in pages:
        page = html_main.parse(p.html or "")
        want = []
        for node, text in page.segments:
            tags, names = set(), ""
            while node >= 0:
                tags.add(page.tag[node])
                names += " " + page.attrs[node]
                node = page.parent[node]
            if not tags & {"nav", "header", "footer", "aside", "form"} and not re.search(r"\b(ad|ads|cookie|notice|comments?|menu|sidebar|footer|header|share|related)\b", names):
                want.append(text)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url
        right += got[p.page_id].text == "\n\n".join(want)
    assert right >= 0.98 * len(pages)


ODD = ("row", "copies", "target", "base", "more", "sig", "k", "g", "text_2", "h", "pattern", "size", "n", "s1", "component", "rule", "score", "turns", "headers", "block", "html_2", "c0", "_need", "a.b")


@pytest.mark.parametrize("n", range(1, 11))
def test_tables_with_other_columns_repeated_rows_and_nulls(spark, n):
    """Other columns under the operators' own names change nothing; equal rows have equal results; nulls and empty tables go through."""
    from pyspark.sql import functions as F

    from gridloom.llm import chat, decontaminate, html_main, language, minhash_forest, mixing, secrets, spotsigs, url_filter, warc

    docs = spark.createDataFrame(
        [(1, "the cat of the house sat on a mat near token=abcdefgh today", "en", "a"), (1, "the cat of the house sat on a mat near token=abcdefgh today", "en", "a"), (None, None, None, None), (2, "", "de", "b"), (3, "ein Haus " * 20, "de", "b")],
        "doc_id long, text string, lang string, source string",
    )
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>x</p>"), (1, "http://a.b/c", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string")
    talks = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (2, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    items = spark.createDataFrame([(1, "the house sat on a mat near"), (None, None), (2, "")], "item_id long, text string")
    run = {
        1: (docs, lambda d: mixing.copies_of(spark, d)), 2: (pages, lambda d: warc.derive(warc.responses(d))), 3: (docs, lambda d: decontaminate.leaks(d, items)),
        4: (pages, url_filter.verdicts), 5: (pages, html_main.extract), 6: (talks, chat.formatted), 7: (docs, lambda d: minhash_forest.near_duplicates(spark, d)),
        8: (docs, spotsigs.edited_fingerprints), 9: (docs, secrets.secrets), 10: (docs, language.identify),
    }
    table, f = run[n]
    plain = sorted(map(str, f(table).collect()))
    wide = table
    for name in ODD:
        wide = wide.withColumn(name, F.lit(7))
    assert sorted(map(str, f(wide).collect())) == plain
    if n not in (3, 6):
        assert len(plain) == table.count() * (2 if n == 2 else 1)
    if n == 6:
        assert len(plain) == 3 and any("n_turns=2" in r and "conv_id=1" in r for r in plain)
    assert f(wide.limit(0)).count() == 0
