"""URL filters: host and path rules, and a character language-model ratio.

Two variable-order Markov models (contexts of up to ``ORDER`` characters that
occur at least ``LEAST`` times, Witten-Bell smoothed through all shorter contexts
down to a uniform distribution) are trained from labelled URLs
(``samples(url, rejected)``; the default set is made by rule from word lists).
They become one automaton: a state is the longest known context, and for each
state and character a table holds the log ratio of the two models' probabilities
and the next state.  A URL's score is the sum of the ratios along its characters
divided by their number.  A URL is blocked if its score exceeds the threshold,
which lies where a share of ``FALSE_POSITIVES`` of the accepted samples that the
models have not seen would be blocked.

Rules come first: the longest fitting one decides.  On the data all is one
projection: a text is split into characters once and followed through the table,
a constant array of the plan, so a URL costs time and memory in proportion to its
length.  The models are fitted on the driver on a bounded sample: up to
``MOST_SAMPLES`` rows of each class, drawn by a hash of the URL.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule, gets score 0 and is always allowed; without samples of both classes the
model blocks nothing; an empty table gives no rows; repeated rows get equal
results.  Only ``page_id`` and ``url`` are read; other columns may have any name.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.spotsigs import ANCHORS

ORDER = 4
LEAST = 2
MOST_SAMPLES = 20_000
FALSE_POSITIVES = 0.01
#: Characters the models tell apart; any other counts as one more, and letters as lower case.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-._/~%"
WIDTH = len(SYMBOLS) + 1
#: Bits of a state's number beside the running sum, and whole steps of a nat.
STATE, NAT = 20, 1000
#: (verdict, rule): a host and its subdomains, and the beginning of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words of host names, for the default samples.
REJECTED = (
    "adult ads banner bets betting bingo bonus casino cams cash cheap click coupon crack credit dating deals debt diet discount dollar download enlarge escort farm "
    "free gambling gift hack hot jackpot keygen loan loans lottery lucky meds naked nude offer payday pharmacy phentermine pills poker popup porn prize promo replica "
    "roulette sale sex sexy slots spam spy stream torrent track tracker traffic viagra warez weightloss win winner xxx xx x"
).split()
ACCEPTED = (
    "academy archive art atlas author bakery bank bicycle bird book bread bridge castle church cinema city clinic club college community company concert council "
    "craft culture dance design doctor earth engineering family farming film forest forum garden gallery geology guide harbour health heritage history home hospital "
    "house island journal kitchen lake language law library literature magazine maker map market mathematics medicine museum music nature news ocean opera orchestra "
    "painting paper park people philosophy photo physics planet poetry radio railway recipe report research restaurant river school science shop society "
    "sport station street student teacher theatre town travel tree university valley village voice weather "
    "weekly wiki winter woman world writer"
).split()


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the rule that decides, its verdict); null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def default_samples(spark: SparkSession) -> DataFrame:
    """(url, rejected): every listed word, and pairs of listed words, in the same shapes for both classes."""

    def made(words: list[str], rejected: bool) -> DataFrame:
        all_ = F.from_json(F.lit(json.dumps(words)), "array<string>")
        pick = lambda k: F.element_at(all_, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
        of = lambda k, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(values))) + 1).cast("int"))
        n = spark.range(1500)
        host = F.concat(of(1, "", "", "www.", "blog.", "m."), F.element_at(all_, (F.pmod("id", F.lit(len(words))) + 1).cast("int")), F.when(F.col("id") % 3 > 0, F.concat(of(2, "-", "-", ""), pick(3))).otherwise(""), of(4, ".example.com", ".example.org", ".example.net", ".com", ".org", ".net"))
        path = F.concat(of(5, "/en/", "/de/", "/fr/", "/es/", "/"), F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1000)).cast("string"), of(7, "", "", ".html", "/"))
        return n.select(F.concat(F.lit("https://"), host, path).alias("url"), F.lit(rejected).alias("rejected"))

    return made(REJECTED, True).unionAll(made(ACCEPTED + sorted({w for w in ANCHORS if len(w) > 2 and w.isascii()}), False))


def symbols(text: str) -> str:
    """The text in the models' alphabet; ``*`` is any other character."""
    return "".join(c if c in SYMBOLS else "*" for c in text.translate(str.maketrans(UPPER, LOWER)))


class Model:
    """The automaton of both models: ``table[state * WIDTH + character]`` is (ratio in steps of a nat) * 2^STATE + next state."""

    def __init__(self, samples: list[tuple[str, bool]]):
        self.counts: dict[bool, dict[str, Counter]] = {True: defaultdict(Counter), False: defaultdict(Counter)}
        for text, rejected in samples:
            padded = "^" + symbols(text)
            own = self.counts[rejected]
            for i in range(1, len(padded)):
                for k in range(min(ORDER, i) + 1):
                    own[padded[i - k : i]][padded[i]] += 1
        seen = Counter()
        for own in self.counts.values():
            for context, after in own.items():
                seen[context] += after.total()
        self.contexts = sorted({"", "^", *(c for c, n in seen.items() if n >= LEAST)}, key=lambda c: (len(c), c))
        number = {c: k for k, c in enumerate(self.contexts)}
        if len(number) >= 1 << STATE:
            raise ValueError("too many contexts; take fewer samples")
        self.start = number["^"]
        self.table = []
        chance: dict[str, list[list[float]]] = {}
        for context in self.contexts:
            below = chance[context[1:]] if context else [[1 / WIDTH] * WIDTH] * 2
            chance[context] = [self._smoothed(rejected, context, lower) for rejected, lower in zip((True, False), below, strict=True)]
            for c, p, q in zip(SYMBOLS + "*", *chance[context], strict=True):
                after = (context + c)[-ORDER:]
                while after not in number:
                    after = after[1:]
                self.table.append((round(NAT * (math.log(p) - math.log(q))) << STATE) + number[after])

    def _smoothed(self, rejected: bool, context: str, lower: list[float]) -> list[float]:
        after = self.counts[rejected].get(context)
        if not after:
            return lower
        total, kinds = after.total(), len(after)
        return [(after[c] + kinds * p) / (total + kinds) for c, p in zip(SYMBOLS + "*", lower, strict=True)]

    def score(self, text: str) -> float:
        """The same walk on the driver, for calibration."""
        acc = self.start
        for c in symbols(text):
            state = acc & ((1 << STATE) - 1)
            acc += self.table[state * WIDTH + (SYMBOLS + "*").index(c)] - state
        return (acc >> STATE) / NAT / len(text) if text else 0.0


def scored(text: Column, model: Model) -> Column:
    """The mean log ratio over a text's characters; 0 for an empty text."""
    table = F.from_json(F.lit(json.dumps(model.table)), "array<bigint>")
    code = [len(SYMBOLS)] * 128
    for k, c in enumerate(SYMBOLS):
        code[ord(c)] = code[ord(c.upper())] = k
    codes = F.from_json(F.lit(json.dumps(code)), "array<int>")
    # One sign for each character beyond ASCII, as splitting goes by UTF-16 units.
    characters = F.split(F.regexp_replace(text, r"[^\x00-\x7F]", "*"), "")
    state = lambda acc: acc.bitwiseAND(F.lit((1 << STATE) - 1))
    step = lambda acc, c: acc - state(acc) + F.get(table, (state(acc) * WIDTH + F.get(codes, F.ascii(c))).cast("int"))
    total = F.aggregate(characters, F.lit(model.start).cast("long"), step)
    return F.when(F.length(text) > 0, F.shiftright(total, STATE) / NAT / F.length(text)).otherwise(0.0)


class Filter:
    """The trained ``model`` and the ``threshold`` above which a url is blocked."""

    def __init__(self, samples: DataFrame):
        url = F.col("url").cast("string")
        seen = samples.select(F.concat(host_of(url), path_of(url)).alias("s"), F.coalesce(F.col("rejected"), F.lit(False)).alias("rejected")).where("s <> ''").distinct()
        size = {r.rejected: r["count"] for r in seen.groupBy("rejected").count().collect()}
        share = F.when(F.col("rejected"), MOST_SAMPLES / max(1, size.get(True, 0))).otherwise(MOST_SAMPLES / max(1, size.get(False, 0)))
        drawn = seen.where(F.pmod(F.xxhash64("s", F.lit("draw")), F.lit(1 << 20)) < share * (1 << 20)).withColumn("fold", F.pmod(F.xxhash64("s"), F.lit(4)))
        rows = sorted((r.s, r.rejected, r.fold) for r in drawn.limit(3 * MOST_SAMPLES).collect())  # the draw gives about 2 * MOST_SAMPLES at most
        self.model = Model([(s, rejected) for s, rejected, fold in rows if fold])
        held = sorted(self.model.score(s) for s, rejected, fold in rows if not fold and not rejected)
        both = held and any(rejected for _, rejected, _ in rows)
        self.threshold = held[min(len(held) - 1, int(len(held) * (1 - FALSE_POSITIVES)))] if both else math.inf


def verdicts(pages: DataFrame, samples: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages(page_id, url)``."""
    made = Filter(default_samples(pages.sparkSession) if samples is None else samples)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, what = rule_for(F.col("host"), F.col("path"), rules)
    judged = rows.select("page_id", "host", "path", name.alias("rule"), what.alias("ruled"), scored(F.concat("host", "path"), made.model).alias("score"))
    by_model = F.when((F.concat("host", "path") != "") & (F.col("score") > made.threshold), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op4_url_filter`` that SQL can express: hosts, paths and deciding rules."""
    return op4_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


URL_RULES_SQL = f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN (host = '{r[: r.index('/')]}' OR suffix(host, '.{r[: r.index('/')]}')) AND prefix(path, '{r[r.index('/') :]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])))} END AS rule FROM p
"""
