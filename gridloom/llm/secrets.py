"""Secret scans: fixed patterns, and tokens that look random to Markov models.

Two character bigram models, one of random strings and one of ordinary
identifiers, are trained from labelled samples (``samples(text, random)``; the
default set is made by rule).  A token of 16 or more characters with a letter is
a secret of kind ``random`` if its mean log-likelihood ratio exceeds a threshold, calibrated
on a quarter of the samples that the models have not seen, at which no ordinary
sample passes; for a token without digits the threshold is stricter.  The fixed patterns find assignments, access keys and hex runs;
their spans always stay, and a random span that meets one of them is left out.

Everything on the data runs as column expressions.  The models are two tables of
95 by 95 counts; the log ratio is a constant array in the plan.

Defined cases: a null text is empty and has no spans; positions are code points;
k matches in one text cost about k * (k / 64 + 64) steps; a text's spans are held
at once (about 100 bytes each); repeated rows get equal results; an empty table
gives no rows.  Only ``doc_id`` and ``text`` are read; other columns may have any
name.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.columns import fresh, own

# The base patterns, by kind, in the order that breaks ties.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"(?<![\p{L}\p{N}+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+(?!\p{L})"
#: A token without digits must exceed the threshold by so much more, and have so many different characters.
STRICTER, DISTINCT = 0.25, 8
#: Letters and digits of ordinary identifiers, for the default samples.
ORDINARY = (
    "account action address after agent alert allow answer append archive array article async audio author backup balance batch before billing binary block branch "
    "browser buffer build button cache calendar callback camera channel chapter character check client cluster code collection column comment commit company compare "
    "compile config connection container content context control convert count create current customer data database debug default delete deploy description detail "
    "device dialog directory document domain download driver element email engine entry error event example execute export extension failure feature field file filter "
    "folder format forward frame function garden general global graph group handler header height history holiday image import index initial input install instance "
    "interface internal invoice item journal keyboard language layout length library license limit list loader local location manager market matrix maximum member memory "
    "message method minimum model module monitor mouse network node notice number object offset operation option order output package page parameter parent partition "
    "password path pattern payment people performance picture platform player policy position prefix preview price process product profile program project property "
    "protocol provider public query question queue random range reader record region register release remote render report request resource response result return review "
    "route sample schedule schema screen script search section security segment sequence server service session setting shadow signal simple singleton source stage "
    "standard station status storage strategy stream string structure student style summary support switch system table target template temporary terminal thread "
    "timeout title token toolbar transaction transform translation traveller update upload user utility validation value vector version video view visitor volume "
    "warning weather window worker writer zone der die und nicht werden gesellschaft entwicklung verbindung les des pour dans avec mouvement situation los las para "
    "informacion desarrollo nacion"
).split()


STEP = 64


def once(value: Column, f) -> Column:
    """``f(value)`` with the value formed once; a lambda would else form it anew for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spans(text: Column, pattern: str, kind: str, order: int, keep=None, group: int = 0) -> Column:
    """array<struct<start, rank, kind, stop, word>> of a pattern's matches, leftmost and non-overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(
        F.arrays_zip(found.alias("m"), part.alias("g")),
        F.slice(gaps, F.lit(1), F.size(found)),
        lambda x, gap: F.struct(F.length(gap).alias("gap"), F.length(x["m"]).alias("len"), x["m"].alias("m"), x["g"].alias("g")),
    )

    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["gap"] + x["len"])

    def placed(p: Column, sums: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(sums, F.lit(1), F.floor(i / STEP).cast("int")), F.lit(0), lambda a, v: a + v) + total(F.slice(p, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP))
        made = F.transform(p, lambda x, i: F.struct((before(i) + x["gap"]).alias("start"), x["len"].alias("len"), x["m"].alias("word"), x["g"].alias("g")))
        made = F.filter(made, keep) if keep else made
        return F.transform(made, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + x["len"]).alias("stop"), x["word"].alias("word")))

    def run(pieces: Column) -> Column:
        sums = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / STEP).cast("int")), lambda b: total(F.slice(p, b * STEP + 1, F.lit(STEP))))
        return once(pieces, lambda p: once(sums(p), lambda q: placed(p, q)))

    none = F.lit(None).cast("array<struct<start:int,rank:int,kind:string,stop:int,word:string>>")
    return F.coalesce(F.when(text.rlike(pattern), run(pieces)).otherwise(none), F.from_json(F.lit("[]"), "array<struct<start:int,rank:int,kind:string,stop:int,word:string>>"))


def default_samples(spark: SparkSession) -> DataFrame:
    """(text, random): 3,000 random strings in several alphabets and 6,000 ordinary identifiers, made by rule."""
    n = spark.range(1000)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id")).cast("binary"), 256)
    raw = F.base64(F.unhex(digest))
    random = n.select(F.explode(F.array(F.substring(digest, 1, 32), F.substring(F.regexp_replace(raw, "[+/=]", ""), 1, 30), F.substring(raw, 1, 40))).alias("text"), F.lit(True).alias("random"))
    words = F.from_json(F.lit(json.dumps(ORDINARY)), "array<string>")
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(ORDINARY))) + 1).cast("int"))
    a, b, c = pick(1), pick(2), pick(3)
    ordinary = n.select(
        F.explode(
            F.array(
                F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("/", a, b, c), F.concat(a, b, c),
                F.concat_ws("-", a, b, F.pmod(F.xxhash64("id"), F.lit(3000)).cast("string")),
            )
        ).alias("text"),
        F.lit(False).alias("random"),
    )
    return random.unionAll(ordinary)


def _ratio(counts: dict[bool, dict[tuple[int, int], int]]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) over codes 32..126, add-half smoothed."""
    total = {k: [0.0] * 95 for k in (True, False)}
    for k in (True, False):
        for (a, _), n in counts[k].items():
            total[k][a] += n
    p = lambda k, a, b: (counts[k].get((a, b), 0) + 0.5) / (total[k][a] + 0.5 * 95)
    return [round(math.log(p(True, a, b)) - math.log(p(False, a, b)), 4) for a in range(95) for b in range(95)]


def mean_ratio(word: Column, table: Column) -> Column:
    code = lambda i: F.ascii(F.substring(word, i, F.lit(1))) - 32
    pair = lambda i: F.get(table, code(i) * 95 + code(i + 1))
    return F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), F.lit(0.0), lambda s, i: s + F.coalesce(pair(i), F.lit(0.0))) / (F.length(word) - 1)


def train(samples: DataFrame) -> tuple[Column, float]:
    """(the log ratios as a constant column, the threshold)."""
    seen = samples.where("length(text) >= 2").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(4)))
    pairs = seen.where("fold > 0").select("random", "text", F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i"))
    pairs = pairs.select("random", (F.ascii(F.substring("text", F.col("i"), F.lit(1))) - 32).alias("a"), (F.ascii(F.substring("text", F.col("i") + 1, F.lit(1))) - 32).alias("b"))
    counts: dict[bool, dict] = {True: {}, False: {}}
    for r in pairs.where("a between 0 and 94 and b between 0 and 94").groupBy("random", "a", "b").count().collect():
        counts[r.random][r.a, r.b] = r["count"]
    table = F.from_json(F.lit(json.dumps(_ratio(counts))), "array<double>")
    held = seen.where("fold = 0").select("random", mean_ratio(F.col("text"), table).alias("x")).groupBy("random").agg(F.max("x").alias("high"), F.percentile_approx("x", 0.05).alias("low")).collect()
    found = {r.random: r for r in held}
    if True not in found or False not in found:
        return table, 0.0
    return table, max(found[False].high + 0.1, (found[False].high + found[True].low) / 2)


def looks_random(word: Column, table: Column, least: float) -> Column:
    varied = F.size(F.array_distinct(F.split(word, ""))) >= DISTINCT
    digits = word.rlike("[0-9]")
    return (digits | varied) & (mean_ratio(word, table) > F.when(digits, least).otherwise(least + STRICTER))


def running(values: Column, best) -> Column:
    """The array of ``best`` (``F.array_max`` or ``F.array_min``) over each element and all before it."""
    both = F.greatest if best is F.array_max else F.least

    def made(v: Column, tops: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            block = F.floor(i / STEP).cast("int")
            near = best(F.slice(v, block * STEP + 1, i % STEP + 1))
            return F.when(block > 0, both(near, best(F.slice(tops, F.lit(1), block)))).otherwise(near)

        return F.transform(v, at)

    tops = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda b: best(F.slice(v, b * STEP + 1, F.lit(STEP))))
    return once(values, lambda v: F.when(F.size(v) > 0, once(tops(v), lambda t: made(v, t))).otherwise(F.from_json(F.lit("[]"), "array<int>")))


def apart(base: Column, more: Column) -> Column:
    """``base`` and those of ``more`` that meet none of it, sorted."""

    def kept(all_: Column) -> Column:
        before = running(F.transform(all_, lambda x: F.when(x["rank"] < 3, x["stop"]).otherwise(0)), F.array_max)
        after = F.reverse(running(F.reverse(F.transform(all_, lambda x: F.when(x["rank"] < 3, x["start"]).otherwise(2**31 - 1))), F.array_min))
        return once(before, lambda b: once(after, lambda a: F.filter(all_, lambda x, i: (x["rank"] < 3) | (F.get(b, i) <= x["start"]) & (F.get(a, i) >= x["stop"]))))

    return F.when((F.size(base) > 0) & (F.size(more) > 0), once(F.array_sort(F.concat(base, more)), kept)).otherwise(F.concat(base, more))


def found(text: Column, samples: DataFrame) -> tuple[Column, Column]:
    """(the base spans, all spans) of a text, each sorted; the second is formed from a column that holds the first."""
    table, least = train(samples)
    base = F.array_sort(
        F.concat(
            spans(text, ASSIGN, "assign", 0, lambda x: F.length(x["g"]) >= 6, 1),
            spans(text, ACCESS, "access", 1, lambda x: F.length(x["word"]) >= 20),
            spans(text, HEX, "hex", 2),
        )
    )
    return base, spans(text, TOKEN, "random", 3, lambda x: looks_random(x["word"], table, least))


def scan(docs: DataFrame, samples: DataFrame | None = None) -> tuple[DataFrame, str, str]:
    """``docs(text)`` with two more columns, and their names: the base spans and all spans."""
    base, all_, more = fresh(docs.columns, "base", "all_spans", "more")
    first, tokens = found(F.coalesce(F.col("text").cast("string"), F.lit("")), default_samples(docs.sparkSession) if samples is None else samples)
    wide = docs.withColumn(base, first).withColumn(more, tokens)
    return wide.withColumn(all_, apart(F.col(base), F.col(more))).drop(more), base, all_


def joined(array: str) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def secrets(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    wide, base, all_ = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), samples)
    of = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return wide.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(all_).alias("spans"))


MARK = "[secret]"


def redacted(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """``docs`` with every span replaced by a mark; ``n_chars`` follows, other columns and clean rows stay as they are."""
    wide, _, all_ = scan(docs, samples)
    cuts, new = fresh(wide.columns, "cuts", "new_text")
    text = F.col("text").cast("string")

    def merged(found: Column) -> Column:
        """Spans that touch an earlier one are merged into it: cuts are (start, stop) with no overlap."""

        def led(stops: Column) -> Column:
            # A cut ends where the running stop stands when the next cut begins.
            last = F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), F.get(stops, i).alias("stop"), F.coalesce(x["start"] >= F.get(stops, i - 1), F.lit(True)).alias("leads")))
            ends = lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)["leads"], F.lit(True)))
            return once(last, lambda a: F.zip_with(F.filter(a, lambda x: x["leads"]), ends(a), lambda x, y: F.struct(x["start"].alias("start"), y["stop"].alias("stop"))))

        return once(running(F.transform(found, lambda x: x["stop"]), F.array_max), led)

    piece = lambda c, i: F.concat(F.lit(MARK), text.substr(c["stop"] + 1, F.coalesce(F.get(F.col(f"{cuts}.start"), i + 1), F.length(text)) - c["stop"]))
    pieces = F.concat(text.substr(F.lit(1), F.get(cuts, F.lit(0))["start"]), F.array_join(F.transform(cuts, piece), ""))
    out = wide.withColumn(cuts, F.when(F.size(all_) > 0, merged(F.col(all_)))).withColumn(new, F.when(F.col(cuts).isNotNull(), pieces).otherwise(text))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(new).cast(docs.schema[c].dataType).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col(cuts).isNotNull(), F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(own(c))
    return out.select(*columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op9_secret_scan`` that SQL can express: the base spans."""
    return op9_secret_scan(spark, sf_dir).drop("spans")


_SQL_ASSIGN = r"""'((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_FOUND = "SELECT doc_id, {0} AS rank, '{1}' AS kind, regexp_extract_all(x, {2}) AS m, regexp_extract_all(x, {2}, {3}) AS g, string_split_regex(x, {2}) AS s FROM t WHERE regexp_matches(x, {2})"
SECRET_BASE_SPANS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
k AS ({_FOUND.format(0, "assign", _SQL_ASSIGN, 2)} UNION ALL {_FOUND.format(1, "access", "'AKIA[A-Z0-9]+'", 0)} UNION ALL {_FOUND.format(2, "hex", "'[0-9a-f]+'", 0)}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
v AS (SELECT * FROM u WHERE CASE rank WHEN 0 THEN length(g[i]) >= 6 WHEN 1 THEN length(m[i]) >= 20 ELSE length(m[i]) >= 24 END),
p AS (SELECT doc_id, rank, kind, (list_sum(list_transform(s[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0))::BIGINT AS start, length(m[i]) AS n FROM v),
j AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) AS found FROM p GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(found, '')) AS base_sha256 FROM t LEFT JOIN j ON t.doc_id = j.doc_id
"""
