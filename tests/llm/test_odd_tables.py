"""Archives whose pages end in line ends or hold a border, and languages learned from rows without ids or with one id."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import language, warc


def test_pages_that_end_in_line_ends_lose_no_record(spark, tmp_path):
    """Pieces of many lengths, so that borders fall on the ends of read buffers too."""
    n = 60_000
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.b/"), F.col("id")).alias("url"), F.concat(F.lit("<p>"), F.expr("repeat('x', cast(id % 97 as int))"), F.lit("</p>\r\n")).alias("html"))
    path = str(tmp_path / "crlf")
    warc.write(warc.responses(pages), path, "none")
    assert warc.read(spark, path).agg(F.count("*"), F.countDistinct("record_id")).first()[:] == (n, n)
    made = warc.derive_files(spark, path)
    assert made.agg(F.count("*"), F.countDistinct("record_id")).first()[:] == (2 * n, 2 * n)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_a_page_that_holds_a_border(spark, tmp_path, compression):
    inner = "<p>before</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n<p>after</p>"
    pages = spark.createDataFrame([(1, "http://a/1", inner), (2, "http://a/2", "<p>plain</p>\r\n"), (3, None, None)], "page_id long, url string, html string")
    path = str(tmp_path / "inner")
    warc.write(warc.responses(pages), path, compression)
    direct = {r.record_id: bytes(r.block) for r in warc.derive(warc.responses(pages)).collect()}
    for made in (warc.derive_files(spark, path), warc.derive(warc.read(spark, path))):
        assert {r.record_id: bytes(r.block) for r in made.collect()} == direct and len(direct) == 6


def test_pieces_are_read_to_their_end():
    two = b"1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 2\r\n\r\nde"
    assert [r["block"] for r in warc._records(two)] == [b"abc", b"de"]
    for bad in (b"1\r\nContent-Length: 3\r\n\r\nabcd\r\n", b"1\r\nContent-Length: 9\r\n\r\nabc"):
        with pytest.raises(ValueError):
            list(warc._records(bad))


WORDS = {
    "en": "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont la avec son les mais comme ou si leur y dont aux".split(),
}


def held(spark, ids):
    rng = random.Random(6)
    rows = [(ids(k), " ".join(rng.choice(WORDS[lang]) for _ in range(25)), lang) for k in range(3000) for lang in WORDS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).collect()
    order = {r[1]: r[2] for r in rows}
    texts = language.keep_identified(docs)
    right = docs.select("text").join(texts.select("text"), "text", "left_semi").count()
    by_lang = {r.lang_pred: r.n for r in language.identify(docs).groupBy("lang_pred").agg(F.count("*").alias("n")).collect()}
    assert len(got) == len(rows) and len(order) == len(rows)
    return by_lang, right / len(rows)


@pytest.mark.parametrize("ids", [lambda k: k, lambda k: None, lambda k: 1], ids=["own", "null", "one"])
def test_languages_are_learned_whatever_the_ids(spark, ids):
    by_lang, kept = held(spark, ids)
    assert set(by_lang) == set(WORDS) and all(abs(n - 3000) < 60 for n in by_lang.values())
    assert kept > 0.98


def test_a_language_of_one_repeated_text_is_learned(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(WORDS["en"]) for _ in range(25)), "en") for k in range(2000)] + [(k, " ".join(WORDS["de"]), "de") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 2000, "de": 2000}
