"""Language identification by hierarchical discrimination.

A document's family is predicted first (one linear SVM for each family against
the rest); within the family, one-versus-one linear SVMs separate the related
languages and vote.  Features are hashed byte bigrams and trigrams of the
lower-cased letters of the whole text, as square roots of relative frequencies.

The classifier is fitted on the driver on a bounded sample of labelled rows:
about ``PER_LANGUAGE`` distinct texts of each language, chosen by their own hash
(never more than twice that many feature rows reach the driver).  Everything
else covers all rows.

Defined cases: a null text and a text without a letter are ``und`` with score 0;
without any labelled row every other document is ``und`` too; with one learned
language all get it with score 1.  Repeated rows get equal results; an empty
table gives no rows.  Features are made for up to 256 texts or half a megabyte at
once, or for one longer text (about 60 bytes a byte of it).  Only ``doc_id``,
``text`` and, for fitting, ``lang`` are read; other columns may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import words as wd
from gridloom.llm.columns import in_place, text_batches

DIMENSIONS = 4096
PER_LANGUAGE = 400
#: Languages that are learned at most; more labels than that are an input error.
MOST_LANGUAGES = 200

# ISO 639-1 codes by language family; a code not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca co es fr gl it la oc pt ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "iranian": "ckb fa ku ps tg",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "sinitic": "yue zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"={lang}")


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, matrix): unit rows of hashed letter n-grams; a text without letters has a zero row."""
    letters = wd.letters_and_digits()
    letters[48:58] = False
    for first, last, data, offsets in wd.slices(pc.utf8_lower(texts.cast(pa.large_string())), 1 << 19, 256):
        rows = last - first
        doc = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
        inside = letters[data] if len(data) else np.zeros(0, bool)
        keep = inside.copy()
        keep[1:] |= inside[:-1]  # one separator after each run of letters
        value = np.where(inside, data, 32)[keep].astype(np.uint32)
        doc = doc[keep]
        count = np.zeros((rows, DIMENSIONS), np.float32)
        for k in (2, 3):
            if len(value) < k:
                continue
            gram = value[: len(value) - k + 1] + np.uint32(k)
            for j in range(1, k):
                gram = gram * np.uint32(0x01000193) ^ value[j : len(value) - k + 1 + j]
            gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
            same = doc[: len(gram)] == doc[k - 1 :]
            where = doc[: len(gram)] * DIMENSIONS + gram
            count += np.bincount(where[same], minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)
        total = count.sum(1, keepdims=True)
        yield first, last, np.sqrt(count / np.maximum(total, 1))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights (last one the bias) of a linear SVM with squared hinge loss, by accelerated gradient descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float32)
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * np.float32(cost)
    step = np.float32(1 / (1 / len(x) + 4 * cost))
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = v / np.float32(len(x)) - 2 * (weight * slack * y) @ x
        new = v - step * grad
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * z, -30, 30)))


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    #: family -> its languages, and for each pair of them the weights (positive: the first)
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    #: language -> log probabilities of its n-grams, their usual mean over a text, and how far below it a text may be
    usual: dict[str, tuple[np.ndarray, float, float]] = field(default_factory=dict)

    def fits(self, x: np.ndarray, langs: list[str]) -> np.ndarray:
        """Whether each row's n-grams are as likely in its language as those of the learned texts.

        The likelihood is of this language alone, so text of a language that was not learned fails whichever learned one is nearest.
        """
        out = np.ones(len(x), bool)
        y = np.array(langs, object)
        for lang, (log, mean, depth) in self.usual.items():
            rows = np.flatnonzero(y == lang)
            out[rows] = mean - x[rows] ** 2 @ log <= depth + _spread(x[rows])
        return out

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        if not self.families:
            return ["und"] * n, np.zeros(n)
        x1 = np.hstack([x, np.ones((n, 1), x.dtype)])
        if len(self.families) > 1:
            p = _sigmoid(x1 @ self.family_weights.T)
            p = p / p.sum(1, keepdims=True)
            chosen, score = p.argmax(1), p.max(1)
        else:
            chosen, score = np.zeros(n, int), np.ones(n)
        lang = np.empty(n, object)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            own = self.members[name]
            if len(own) == 1 or not len(rows):
                lang[rows] = own[0]
                continue
            win = np.zeros((len(rows), len(own)))
            for i, j in itertools.combinations(range(len(own)), 2):
                q = _sigmoid(x1[rows] @ self.pairs[own[i], own[j]])
                win[:, i] += (q >= 0.5) + q * 1e-3
                win[:, j] += (q < 0.5) + (1 - q) * 1e-3
            best = win.argmax(1)
            lang[rows] = np.array(own, object)[best]
            worst = np.ones(len(rows))
            for i, j in itertools.combinations(range(len(own)), 2):
                q = _sigmoid(x1[rows] @ self.pairs[own[i], own[j]])
                worst = np.where(best == i, np.minimum(worst, q), np.where(best == j, np.minimum(worst, 1 - q), worst))
            score[rows] = score[rows] * worst
        return lang.tolist(), score


#: Learned rows that a language needs for a limit of its own; with fewer all its texts fit.
LEAST_ROWS = 20
#: A text may lie so far (nats an n-gram) below its language's mean at least.
LEAST_DEPTH = 2.0


def _grams(x: np.ndarray) -> np.ndarray:
    """About the number of n-grams of each row: the least frequent one counts once."""
    return 1 / np.where(x > 0, x, 1).min(1) ** 2


def _spread(x: np.ndarray) -> np.ndarray:
    """What the mean log probability of a text may vary by, for its length alone."""
    return 10 / np.sqrt(_grams(x))


def _log_probabilities(x: np.ndarray) -> np.ndarray:
    count = (x**2 * _grams(x)[:, None]).sum(0) + 0.5
    return np.log(count / count.sum())


def usual(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The entry of ``Model.usual`` for a language's rows; mean and depth are of rows that their own probabilities have not seen."""
    fold = np.arange(len(x)) % 4
    value = np.zeros(len(x))
    for k in range(4):
        value[fold == k] = x[fold == k] ** 2 @ _log_probabilities(x[fold != k])
    mean = float(np.average(value, weights=_grams(x)))
    return _log_probabilities(x), mean, max(LEAST_DEPTH, 1.5 * float(np.quantile(mean - value - _spread(x), 0.995)))


def fit(x: np.ndarray, langs: list[str]) -> Model:
    model, y = Model(), np.array(langs, object)
    for lang in sorted(set(langs)):
        model.members.setdefault(family(lang), []).append(lang)
    model.families = sorted(model.members)
    own = np.array([family(lang) for lang in langs], object)
    if len(model.families) > 1:
        model.family_weights = np.stack([fit_svm(x, np.where(own == f, 1.0, -1.0)) for f in model.families])
    for langs_ in model.members.values():
        for a, b in itertools.combinations(langs_, 2):
            rows = (y == a) | (y == b)
            model.pairs[a, b] = fit_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))
    for lang in set(langs):
        rows = (y == lang) & (x > 0).any(1)
        if rows.sum() >= LEAST_ROWS:
            model.usual[lang] = usual(x[rows])
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` distinct texts of each language of ``docs(text, lang)``.

    A text's own hash decides whether it is drawn, so ids do not matter and copies count once; a language's text of the least hash
    is always drawn.
    """
    text_batches(docs.sparkSession)
    draw = F.pmod(F.xxhash64(F.col("text"), F.lit("language sample")), F.lit(1 << 40))
    known = docs.where("lang is not null and text is not null").select("lang", "text", draw.alias("draw"))
    of = known.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("k"), F.min("draw").alias("least"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(of) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not of:
        return Model()
    most = F.create_map(*[F.lit(v) for r in of for v in (r.lang, max(r.least, int((1 << 40) * min(1.0, per_language / max(1, r.k)))))])
    sample = known.where(F.col("draw") <= most[F.col("lang")]).dropDuplicates(["lang", "draw", "text"])
    # Some more than wanted come where the distinct count is wrong or a hash is shared; the order makes the cut the same in every run.
    sample = sample.orderBy("draw", "lang", "text").limit(2 * per_language * len(of)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, x in features(batch.column(1)):
                raw = [np.concatenate([(at := np.flatnonzero(r)).astype(np.float32), r[at]]).tobytes() for r in x]
                yield pa.record_batch([batch.column(0).slice(first, last - first), pa.array(raw, pa.binary())], names=["lang", "x"])

    rows = sample.mapInArrow(run, "lang string, x binary").collect()
    rows = sorted((r for r in rows if len(r.x)), key=lambda r: (r.lang, bytes(r.x)))
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        at, value = np.frombuffer(r.x, np.float32).reshape(2, -1)
        x[i, at.astype(int)] = value
    return fit(x, [r.lang for r in rows]) if rows else Model()


def lettered(text: pa.Array) -> np.ndarray:
    return np.array(pc.fill_null(pc.match_substring_regex(text.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False))


def predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            with_letters = lettered(text)
            for first, last, x in features(text):
                lang, score = model.predict(x)
                ok = with_letters[first:last]
                lang = [v if k else "und" for v, k in zip(lang, ok, strict=True)]
                yield pa.record_batch([batch.column(0).slice(first, last - first), pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0).astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return run


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows whose crc32(doc_id) mod 4 is 2 are never learned from."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(columns.where(~held_out()))
    out = columns.select("doc_id", "text").mapInArrow(predictor(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A document whose best language gets less than this is rejected by the pipeline stage.
LEAST_SCORE = 0.25


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without those that have no language, too low a score or letters unlike their language's; all labelled rows may be learned from; the text is judged in place, without a join."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(columns)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            keep = lettered(text)
            for first, last, x in features(text):
                lang, score = model.predict(x)
                keep[first:last] &= (np.array(lang, object) != "und") & (score >= least) & model.fits(x, lang)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return in_place(docs, run)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
