"""Document fingerprints by SpotSigs, as column expressions.

The text is lower-cased and reduced to its letter and digit runs.  Every common
word (an anchor) that a content word follows gives a spot: the anchor and the
next two content words, common words between them skipped.  The beginning of the
text is an anchor too, so every text with a word has a signature.  Where spots
are few for the text's length (menus, other languages), every content word and
the next one give a chain too, so the whole text counts.  A document's
fingerprint is its sorted set of spot hashes (32 bits each, hexadecimal); equal
texts have equal fingerprints.

Likeness is the Jaccard similarity of two sets.  Sets are partitioned by their
size: a pair can be alike enough only inside a partition or between adjacent ones,
and there only if the prefixes of both, rare spots first, share a spot
(``similar_pairs`` joins by partition and spot), which prunes the comparisons.

Defined cases: a null text is empty; an empty text has the empty fingerprint; two
empty sets have likeness 1, an empty and another 0; a text without letters and
digits has one signature, of itself; rows without a ``doc_id`` come after all
others, by 4096 parts of their texts' hashes and then by text, so that however many
there are they do not meet in one task; repeated ids follow each other in the order
of their text.  A text, its neighbour and their spots are held at once (about ten
times the text).  Only ``doc_id`` and ``text`` are read; other columns may have any
name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a about after all also am an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like "
    "may more most no not of on one only or other our out over she so some such than that the their them then there these they this to two up was we were what when "
    "which who will with would you your "
    "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist kann man mit nach nicht noch nur "
    "oder sein sich sie sind so über um und uns von vor war was wenn werden wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais ne nous ont ou par pas plus pour qu que qui sa se ses son sont sur un "
    "une vous "
    "al como con de del el ella en entre era es esta este ha la las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también un una "
    "uno y ya"
).split()
CHAIN = 2
#: A text with fewer spots than one for so many words has a chain from every content word too.
SPARSE = 40
#: Ids of one window; each group of ids holds at most so many.
GROUP = 32


def trie(words: list[str]) -> str:
    """A regular expression for exactly these words, branching by character."""
    tree: dict = {}
    for w in words:
        at = tree
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = {}

    def build(node: dict) -> str:
        branches = [ch + build(sub) for ch, sub in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + "?" * ("" in node)

    return build(tree)


_MARK = rf"(?<= )({trie(sorted(set(ANCHORS)))})(?= )"
_NEXT = r" (?:#[^ ]+ )*+[^ #][^ ]*+"
_SPOT = r"(?<= )(?=(#[^ ]+ [^ #][^ ]*+" + _NEXT * (CHAIN - 1) + " ))"
#: A chain from every content word.
_EACH = r"(?<= )(?=([^ #][^ ]*+" + _NEXT * (CHAIN - 1) + " ))"
_HEAD = r"^ (?:#[^ ]+ )*+([^ #][^ ]*+(?:" + _NEXT * (CHAIN - 1) + ")?)"


def _code(s: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(s), 32)


def signatures(text: Column) -> Column:
    """The sorted distinct spot hashes (long, below 2^32) of a text."""
    words = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")
    marked = F.regexp_replace(words, _MARK, "#$1")

    bound = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    plain = lambda s: F.regexp_replace(s, " #[^ ]+", "")

    def made(m: Column) -> Column:
        spots = F.transform(F.regexp_extract_all(m, F.lit(_SPOT), F.lit(1)), lambda s: _code(plain(s)))
        head = F.regexp_extract(m, _HEAD, 1)
        first = F.concat(F.lit("^ "), F.when(head == "", m).otherwise(plain(head)))
        n = F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))) - 1
        each = F.transform(F.regexp_extract_all(m, F.lit(_EACH), F.lit(1)), lambda s: _code(F.concat(F.lit("* "), plain(s))))
        whole = bound(spots, lambda s: F.when(F.size(s) * SPARSE < n, F.concat(s, each)).otherwise(s))
        return F.array_sort(F.array_distinct(F.concat(F.array(_code(first)), whole)))

    # A one-element transform binds the marked text, and the spots, once.
    full = bound(marked, made)
    empty = F.from_json(F.lit("[]"), "array<bigint>")
    return F.when(text.isNull() | (F.length(text) == 0), empty).when(~text.rlike(r"[\p{L}\p{N}]"), F.array(_code(text))).otherwise(full)


def printed(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; the intersection is formed only where both sets have elements."""
    common = F.size(F.array_intersect(a, b))
    empty = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), empty).otherwise(common / (F.size(a) + F.size(b) - common))


def length_class(size: Column, tau: float = 0.75) -> Column:
    return F.when(size > 0, F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -math.log(tau))).cast("int")


#: Spots are counted by so many parts of their hashes, which bounds the table of counts whatever the corpus.
PARTS = 1 << 16


def bands(percent: int, most: int = 1 << 31) -> list[int]:
    """The least sizes of the partitions: each is more than 100 / ``percent`` times the one before, so sets two partitions apart are never so alike."""
    out = [1]
    while out[-1] <= most:
        out.append(100 * out[-1] // percent + 1)
    return out


def similar_pairs(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b, likeness) for documents of different fingerprints with a likeness of ``percent`` in 100 or more, between class representatives.

    Equal fingerprints are one class, named by its smallest id.  Rows without an id and empty fingerprints have no pair.
    """
    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sig")).where("size(sig) > 0 and doc_id is not null")
    return alike(signed.groupBy("sig").agg(F.min("doc_id").alias("rep")), percent)


def alike(sets: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b, likeness) of all pairs of ``sets(rep, sig)``, distinct sets of numbers, with 100 * intersection >= ``percent`` * union (``percent`` from 2 to 99).

    Every comparison is of whole numbers.  A set of n spots in common order of all sets, rare ones first, shares one of its
    first n - ceil(n * percent / 100) + 1 with every set like it.  Rarity is that of a spot's part of ``PARTS``, of which
    there is a small table; any order that is the same for all sets gives the same pairs.
    """
    if not 2 <= percent <= 99:
        raise ValueError("percent must be from 2 to 99")
    spots = sets.select("rep", F.size("sig").alias("n"), F.explode("sig").alias("spot")).withColumn("part", F.pmod(F.xxhash64("spot"), F.lit(PARTS)))
    # At most PARTS rows.
    rarity = spots.groupBy("part").agg(F.count("*").alias("f"))
    ordered = spots.join(F.broadcast(rarity), "part").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("f", "spot"))).alias("all"))
    starts = F.array(*[F.lit(v) for v in bands(percent)])
    band = F.size(F.filter(starts, lambda v: v <= F.col("n")))
    prefix = F.slice("all", 1, (F.col("n") - F.expr(f"(n * {percent}L + 99) div 100") + 1).cast("int"))
    keyed = ordered.select("rep", "n", band.alias("band"), F.explode(prefix).alias("first")).select("rep", "n", "band", "first.spot")
    # The smaller set of a pair lies in the larger one's partition or in the one before.
    a = keyed.select("spot", "band", F.col("rep").alias("a"), F.col("n").alias("na"))
    b = keyed.select("spot", F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("band"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, ["band", "spot"]).where(f"(na < nb or na = nb and a < b) and 100L * na >= {percent}L * nb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = sets.select(F.col("rep").alias("a"), F.col("sig").alias("x")), sets.select(F.col("rep").alias("b"), F.col("sig").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    both = met.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.size("x") + F.size("y") - common).alias("whole"))
    return both.where(f"100 * common >= {percent} * whole").select("a", "b", (F.col("common") / F.col("whole")).alias("likeness"))


def following(values: DataFrame) -> DataFrame:
    """(v, next) for distinct long ``v``: the next larger value, the smallest for the largest.

    Windows hold at most 4096 values; the borders between them are solved by the same step on their groups.
    """
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None or high - low < 4096:
        order = Window.partitionBy(F.lit(0)).orderBy("v")
        return values.select("v", F.coalesce(F.lead("v").over(order), F.lit(low).cast("long")).alias("next"))
    grouped = values.withColumn("g", F.shiftright("v", 12))
    firsts = grouped.groupBy("g").agg(F.min("v").alias("first"))
    step = following(firsts.select(F.col("g").alias("v"))).select(F.col("v").alias("g"), F.col("next").alias("h"))
    border = step.join(firsts.select(F.col("g").alias("h"), F.col("first").alias("after")), "h").select("g", "after")
    inner = grouped.withColumn("next", F.lead("v").over(Window.partitionBy("g").orderBy("v")))
    return inner.join(border, "g").select("v", F.coalesce("next", "after").alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they and the next document's are."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = int(math.log2(GROUP))
    group = F.when(F.col("doc_id").cast("long").isNull(), F.lit(1 << (63 - bits)) + F.shiftrightunsigned(F.xxhash64(text), 52)).otherwise(F.shiftright(key, bits))
    # The one exchange of texts; signatures are formed after it, so that it carries nothing else and both uses share it.
    base = docs.select(key.alias("k"), group.alias("g"), text.alias("text")).repartition("g")
    order = Window.partitionBy("g").orderBy("k", "text")
    # Each text is signed once and its signature carried to the row before; only the first text of a group is signed again for the border.
    placed = base.withColumn("sig", signatures(F.col("text"))).select("*", F.lead("text").over(order).alias("after"), F.lead("sig").over(order).alias("next_sig"), F.lag("k").over(order).isNull().alias("first"))
    groups = following(docs.select(group.alias("v")).distinct())
    heads = placed.where("first").select(F.col("g").alias("next"), F.col("text").alias("head"))
    border = groups.join(heads, "next").select(F.col("v").alias("g"), "head", signatures(F.col("head")).alias("head_sig"))
    whole = placed.join(border, "g").select("k", "text", "sig", F.coalesce("after", "head").alias("after"), F.coalesce("next_sig", "head_sig").alias("next_sig"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("after", F.lit(1), half))
    out = whole.select("k", n.cast("long").alias("n_chars"), "sig", "next_sig", "text", "after", edited.alias("edited"))
    out = out.withColumn("edited_sig", signatures(F.col("edited")))
    out = out.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("text", "after", "edited")
    return out.select(
        F.when(F.col("k") < 2**63 - 1, F.col("k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        printed(F.col("sig")).alias("fingerprint"),
        printed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
        length_class(F.size("sig")).alias("length_class"),
    )


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spotsigs_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op8_spotsigs`` that SQL can express: lengths and edited texts."""
    return op8_spotsigs(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


SPOTSIGS_EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS after FROM documents)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2)) AS edited_sha256 FROM d
"""
