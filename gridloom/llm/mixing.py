"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to).  A flow network routes each pattern's words to the quotas of its sources;
the first copy of a word is free, the second costs 1, the third 2, so repetition
is used only where a quota cannot be met otherwise.  The flow fixes how many
words each pattern gives; seeded selection then turns it into copies of whole
documents: all get the full rounds, and the remainder goes to documents in the
order of a seeded hash as long as they fit; what is left then goes to the one
further document whose size comes closest to it, if that brings the pattern
nearer to its flow.

Only sums by pattern and by (pattern, 1 of 4096 hash buckets) are formed, both
with map-side combination; exact order is needed in one bucket of each pattern.
What a pattern takes comes down to one row: its full rounds, the last document in
hash order that the remainder reaches, and the one further document.  Those rows
are broadcast, so no document moves.  The flow runs on the driver over the
patterns: at most ``MOST_PATTERNS`` (more is a ValueError).

Defined cases: null or blank texts have size 0 and are taken 0 times over;
a null source is a source of its own, ordered last; a row without a ``doc_id`` is
hashed by its text; repeated rows are separate documents, of which one, not each,
gets a further copy; a row of no source (an empty ``members``) is taken 0 times
and has no target; an empty table gives no rows.  Ties of the hash are broken by
doc_id and size.  Sizes are counted in whole texts, one text at a time.  Only
``doc_id``, ``text`` and ``source`` are read; other columns may have any name.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.columns import fresh, own
from gridloom.llm.store import Store

WORD = r"[^\x20\x09-\x0D]+"
COPIES = 3
SEED = "mix-1"
MOST_PATTERNS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], total: int) -> list[float]:
    """Shares of ``total`` by weight, none above COPIES times its size; the excess is reshared by weight."""
    order = sorted((k for k in range(len(sizes)) if weights[k]), key=lambda k: (COPIES * sizes[k] / weights[k], k))
    out = [0.0] * len(sizes)
    left, weight = total, sum(weights)
    for i, k in enumerate(order):
        if COPIES * sizes[k] * weight <= left * weights[k]:
            out[k] = float(COPIES * sizes[k])
            left, weight = left - COPIES * sizes[k], weight - weights[k]
        else:
            for j in order[i:]:
                out[j] = left * weights[j] / weight
            break
    return out


def min_cost_flow(capacity: list[int], member: list[list[int]], quota: list[int], copies: int = COPIES) -> list[dict[int, int]]:
    """Words from each pattern to each of its sources, at least cost among the largest flows.

    The copies of a pattern are parallel arcs of cost 0, 1, 2 from the root, so the cost is convex.  Primal and dual by
    turns: shortest distances give potentials, and a largest flow along arcs of no reduced cost is added at once, by
    blocking flows.  A path costs 0 to ``copies - 1``, so there are at most ``copies`` turns.
    """
    n, m = len(capacity), len(quota)
    root, sink = n + m, n + m + 1
    to: list[int] = []
    cap: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, c: int, w: int) -> None:
        for u, v, x, y in ((a, b, c, w), (b, a, 0, -w)):
            out[u].append(len(to))
            to.append(v)
            cap.append(x)
            cost.append(y)

    for p, words in enumerate(capacity):
        for k in range(copies):
            arc(root, p, words, k)
        for s in member[p]:
            arc(p, n + s, copies * words, 0)
    for s, words in enumerate(quota):
        arc(n + s, sink, words, 0)
    potential = [0] * len(out)
    infinite = float("inf")
    while True:
        far: list[float] = [infinite] * len(out)
        far[root] = 0
        heap = [(0, root)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in out[u]:
                if cap[e] and (x := d + cost[e] + potential[u] - potential[to[e]]) < far[to[e]]:
                    far[to[e]] = x
                    heapq.heappush(heap, (x, to[e]))
        if far[sink] == infinite:
            break
        for u, d in enumerate(far):
            if d < infinite:
                potential[u] += d
        free = lambda u, e: cap[e] and far[to[e]] < infinite and not cost[e] + potential[u] - potential[to[e]]
        while True:
            # A blocking flow by levels: each arc that led nowhere is passed over from then on.
            level = {root: 0}
            queue = [root]
            for u in queue:
                for e in out[u]:
                    if to[e] not in level and free(u, e):
                        level[to[e]] = level[u] + 1
                        queue.append(to[e])
            if sink not in level:
                break
            at = [0] * len(out)
            path: list[int] = []
            u = root
            while True:
                if u == sink:
                    most = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= most
                        cap[e ^ 1] += most
                    keep = next(k for k, e in enumerate(path) if not cap[e])
                    u = to[path[keep] ^ 1]
                    del path[keep:]
                while at[u] < len(out[u]):
                    e = out[u][at[u]]
                    if level.get(to[e]) == level[u] + 1 and free(u, e):
                        break
                    at[u] += 1
                if at[u] < len(out[u]):
                    path.append(out[u][at[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break
    flows: list[dict[int, int]] = []
    for p in range(n):
        flows.append({to[e] - n: cap[e ^ 1] for e in out[p] if n <= to[e] < n + m and cap[e ^ 1]})
    return flows


def _facts(members: Column | None, seed: str, row: Column) -> list[Column]:
    """What the mix needs of a document: doc_id, size, pattern, h (its place in hash order) and row."""
    names = F.array(F.col("source").cast("string")) if members is None else members
    keys = F.array_sort(F.array_distinct(F.transform(names, lambda s: F.coalesce(F.concat(F.lit("0"), s), F.lit("1")))))
    text = F.col("text").cast("string")
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        word_count(text).alias("size"),
        F.coalesce(F.to_json(keys), F.lit("[]")).alias("pattern"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary")).alias("h"),
        row.cast("long").alias("row"),
    ]


_KEY = "struct(h, doc_id, size, row)"


def _plan(spark: SparkSession, store: Store, sized: DataFrame) -> DataFrame:
    """One row for each pattern: pattern, source_size, target, rounds, edge (documents up to it get one copy more) and last (the row of the one further document)."""
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("words")).orderBy("pattern").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns = [json.loads(r.pattern) for r in rows]
    words = [r.words for r in rows]
    sources = sorted({s for p in patterns for s in p})
    at = {s: k for k, s in enumerate(sources)}
    member = [[at[s] for s in p] for p in patterns]
    size = [0] * len(sources)
    for w, m in zip(words, member, strict=True):
        for k in m:
            size[k] += w
    target = targets(size, [1 + k % 3 for k in range(len(sources))], sum(w for w, m in zip(words, member, strict=True) if m))
    flows = min_cost_flow(words, member, [int(t) for t in target])
    made = [
        (r.pattern, sum(size[k] for k in m) if m else None, float(sum(target[k] for k in m)) if m else None, sum(f.values()) // w if w else 0, sum(f.values()) % w if w else 0)
        for r, w, m, f in zip(rows, words, member, flows, strict=True)
    ]
    # MOST_PATTERNS rows at most, here and below: small enough to broadcast.
    plan = F.broadcast(spark.createDataFrame(made, "pattern string, source_size long, target double, rounds long, rest long"))

    bucket = F.substring("h", 1, 3)
    sums = sized.groupBy("pattern", bucket.alias("cut")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("pattern").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = sums.withColumn("high", F.sum("words").over(before)).withColumn("low", F.col("high") - F.col("words"))
    cut = store.put(edges.join(plan, "pattern").where("low <= rest and rest < high").select("pattern", "cut", "low", "rest"))
    order = Window.partitionBy("pattern").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close = sized.join(F.broadcast(cut), "pattern").where(bucket == F.col("cut")).withColumn("fits", F.sum("size").over(order) + F.col("low") <= F.col("rest"))
    reached = close.groupBy("pattern").agg(F.max(F.expr(f"if(fits, {_KEY}, null)")).alias("edge"), F.sum(F.expr("if(fits, size, 0)")).alias("more"))
    # Without one in the cut bucket, the edge lies before all of it: its name is a beginning of their hashes.
    none = F.expr("named_struct('h', cut, 'doc_id', cast(null as bigint), 'size', cast(null as bigint), 'row', cast(null as bigint))")
    edge = store.put(cut.join(F.broadcast(reached), "pattern", "left").select("pattern", F.coalesce("edge", none).alias("edge"), (F.col("rest") - F.col("low") - F.coalesce("more", F.lit(0))).alias("left")))
    miss = F.abs(F.col("size") - F.col("left"))
    beyond = sized.where("size > 0").join(F.broadcast(edge), "pattern").where(F.expr(f"{_KEY} > edge") & (miss < F.col("left")))
    last = beyond.groupBy("pattern").agg(F.min(F.struct(miss.alias("miss"), "h", "doc_id", "size", "row")).alias("last"))
    out = plan.join(F.broadcast(edge), "pattern", "left").join(F.broadcast(last), "pattern", "left")
    return F.broadcast(store.put(out.select("pattern", "source_size", "target", "rounds", "edge", F.col("last.row").alias("last"))))


def _counted(x: Column) -> Column:
    key = F.struct(x["h"], x["doc_id"], x["size"], x["row"])
    extra = F.coalesce(key <= x["edge"], F.lit(False))
    once = F.coalesce(x["last"] == x["row"], F.lit(False))
    return F.when(x["size"] > 0, x["rounds"] + F.when(extra, 1).otherwise(0) + F.when(once, 1).otherwise(0)).otherwise(0).cast("long")


def copies_of(spark: SparkSession, docs: DataFrame, members: Column | None = None, seed: str = SEED) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target, taken, copies, pattern.

    ``members`` is an array of source names, by default the one ``source``; a
    document of several sources may serve any of them.  Sources by code point,
    null last, weigh 1, 2, 3, repeating; source_size and target are sums over a
    document's sources.
    """
    store = Store(spark, "mixing")
    sized = store.put(docs.select(*_facts(members, seed, F.monotonically_increasing_id())))
    out = sized.join(_plan(spark, store, sized), "pattern").withColumn("copies", F.element_at(F.transform(F.array(F.struct("h", "doc_id", "size", "row", "rounds", "edge", "last")), _counted), 1))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "pattern")


def mixed(spark: SparkSession, docs: DataFrame, members: Column | None = None, seed: str = SEED) -> DataFrame:
    """The documents the mix takes, with ``copies`` saying how often and ``target`` what their source is to give.

    Rows are numbered in a stored copy, so that each row follows its own count, repeated ids or not.  The input's own
    columns stay as they are; where it has these two names already, the new ones get a number behind them.
    """
    store = Store(spark, "mixed")
    facts, plan, copies, target = fresh(docs.columns, "facts", "plan", "copies", "target")
    whole = store.put(docs.withColumn(facts, F.struct(*_facts(members, seed, F.monotonically_increasing_id()))))
    inner = [F.col(facts)[c].alias(c) for c in ("doc_id", "size", "pattern", "h", "row")]
    made = _plan(spark, store, whole.select(*inner))
    both = whole.join(F.broadcast(made.select(F.struct("*").alias(plan))), F.col(f"{facts}.pattern") == F.col(f"{plan}.pattern"))
    # The names inside the two structs stand for themselves in one struct of results.
    count = F.element_at(F.transform(F.array(F.struct(*inner, *[F.col(plan)[c].alias(c) for c in ("target", "rounds", "edge", "last")])), _counted), 1)
    return both.withColumn(copies, count).where(own(copies) > 0).select(*[own(c) for c in docs.columns], own(copies), F.col(plan)["target"].alias(target))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies_of(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("pattern")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
             md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
w AS (SELECT source, words, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM s),
o AS (SELECT *, sum(words) OVER () AS total, sum(weight) OVER () AS weights,
        coalesce(sum({COPIES} * words) OVER (ORDER BY {COPIES} * words / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
        coalesce(sum(weight) OVER (ORDER BY {COPIES} * words / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM w),
f AS (SELECT *, {COPIES} * words * (weights - used) <= (total - caps) * weight AS full_ FROM o),
g AS (SELECT *, total - coalesce(sum({COPIES} * words) FILTER (full_) OVER (), 0) AS room, weights - coalesce(sum(weight) FILTER (full_) OVER (), 0) AS share FROM f),
t AS (SELECT source, words, CASE WHEN full_ THEN ({COPIES} * words)::DOUBLE ELSE (room * weight)::DOUBLE / share::DOUBLE END AS target FROM g),
q AS (SELECT *, CASE WHEN words > 0 THEN floor(target)::BIGINT // words ELSE 0 END AS rounds, CASE WHEN words > 0 THEN floor(target)::BIGINT % words ELSE 0 END AS rest FROM t),
r AS (SELECT d.*, q.words, q.target, q.rounds, q.rest, CASE WHEN sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS extra
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
l AS (SELECT *, rest - sum(size * extra) OVER (PARTITION BY source) AS left_ FROM r),
n AS (SELECT *, CASE WHEN extra = 0 AND size > 0 AND abs(size - left_) < left_ THEN abs(size - left_) END AS miss FROM l),
m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss NULLS LAST, h, doc_id, size) = 1 AND miss IS NOT NULL AS once FROM n),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE rounds + extra + CASE WHEN once THEN 1 ELSE 0 END END::BIGINT AS copies FROM m)
SELECT doc_id, size, words AS source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""
