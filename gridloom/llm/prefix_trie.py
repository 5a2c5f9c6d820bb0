"""The trie of conversation prefixes, merged family by family.

1.  Each turn becomes a digest of its role and text and a count of words, so no
    text moves.
2.  Conversations meet by family, the base id ``c - c % 20``, sorted with the base
    conversation first.  Its first turns (three at most) are all that the others
    need of it, so the rebuilt conversations go by as a stream, and each family's
    trie is a table of its nodes: the digest of the path, its depth, the members
    seen, and the digests of the ancestors 1, 2, 4, ... steps up.
3.  Nodes of a task's families are combined (up to ``HELD`` at once) before they
    are shuffled, so a node that very many families share, as the root is, comes
    once for each filling of that table; then all are merged by digest.
4.  Sums over subtrees take one round for each doubling of the depth: what a node
    holds of the ``2^k`` levels below it goes to its ancestor ``2^k`` steps up.
    A round is a partial aggregation and a join of unique keys.
5.  The ids that end at a node pass in order through a hash, one at a time.

Nothing is held for a whole family, node or conversation but a path's digests (16
bytes for each turn of the longest conversation).

Defined cases: rows are ordered by turn (null first), then by the SHA-256 of role
and text; repeated rows are repeated turns; a null role or text is empty; rows
with a null ``conv_id`` belong to no conversation; a negative id's remainder is
negative or 0, as SQL has it; an empty table has no node.  Only ``conv_id``,
``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.store import Store

#: Ids from one base to the next.
FAMILY = 20
#: Turns taken from the base conversation are fewer than this.
HEADS = 4
#: Nodes that a task combines before it passes them on; some 500 bytes each.
HELD = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"
_ROOT = b"\0" * 16
_BUILT = pa.schema([("node", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("up", pa.list_(pa.binary()))])
_BUILT_SQL = "node binary, conv_id long, depth long, n long, words long, up array<binary>"


class Builder:
    """Nodes of the conversations passed so far and where each conversation ends."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}
        self.ends: list[tuple[bytes, int]] = []

    def begin(self, conv_id: int) -> None:
        self.conv_id, self.path = conv_id, [_ROOT]
        self._see(_ROOT, 0)

    def turn(self, digest: bytes, words: int) -> None:
        node = hashlib.blake2b(self.path[-1] + digest, digest_size=16).digest()
        self.path.append(node)
        self._see(node, words)

    def _see(self, node: bytes, words: int) -> None:
        known = self.nodes.get(node)
        if known:
            known[0] = min(known[0], self.conv_id)
            known[2] += 1
            return
        depth, up, step = len(self.path) - 1, [], 1
        while step <= depth:
            up.append(self.path[depth - step])
            step *= 2
        self.nodes[node] = [self.conv_id, depth, 1, words, up]

    def end(self) -> None:
        self.ends.append((self.path[-1], self.conv_id))

    def full(self) -> bool:
        return len(self.nodes) >= HELD or len(self.ends) >= HELD

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Nodes, and with a null depth the ends."""
        rows = [(k, *v) for k, v in self.nodes.items()] + [(k, c, None, None, None, None) for k, c in self.ends]
        self.nodes, self.ends = {}, []
        for at in range(0, len(rows), 8192):
            yield pa.record_batch([pa.array([r[j] for r in rows[at : at + 8192]], kind) for j, kind in enumerate(_BUILT.types)], schema=_BUILT)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tries of sorted families: rows (base, conv_id, digest of the turn, words)."""
    made, base, conv, head, skip = Builder(), None, None, [], 0
    for batch in batches:
        for own_base, own_conv, digest, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own_base != base:
                base, head = own_base, []
            if own_conv != conv:
                if conv is not None:
                    made.end()
                    if made.full():
                        yield from made.flush()
                conv = own_conv
                made.begin(conv)
                taken = zlib.crc32(str(conv).encode()) % HEADS
                skip = 0 if conv == base else taken
                if conv != base:
                    for turn in head[:taken]:
                        made.turn(*turn)
            if conv == base and len(head) < HEADS - 1:
                head.append((digest, words))
            if skip:
                skip -= 1
            else:
                made.turn(digest, words)
                if len(made.nodes) >= HELD:
                    yield from made.flush()
    if conv is not None:
        made.end()
    yield from made.flush()


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hash of its ids) of rows (node, conv_id) in order."""
    node, sha = None, None
    for batch in batches:
        nodes, hashes = [], []
        for own, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own == node:
                sha.update(f",{conv}".encode())
                continue
            if node is not None:
                nodes.append(node)
                hashes.append(sha.hexdigest())
            node, sha = own, hashlib.sha256(str(conv).encode())
        yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array(hashes, pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])


def trie(rows: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``rows(conv_id, turn, role, text)`` with families rebuilt."""
    spark = rows.sparkSession
    store = Store(spark, "prefix-trie")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    turns = rows.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("said"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    sorted_ = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", "turn", "said")
    built = store.put(sorted_.select("base", "conv_id", "said", "words").mapInArrow(_families, _BUILT_SQL))
    parts = built.where("depth is not null").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n").alias("n_convs"), F.max("words").alias("words"), F.first("up").alias("up"))
    nodes = store.put(parts)
    children = nodes.where("depth > 0").groupBy(F.get("up", F.lit(0)).alias("node")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, "node", "left").select(
        "node", "up", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    )
    sums = store.put(own)
    deepest, k = nodes.agg(F.max("depth")).first()[0] or 0, 0
    while 1 << k <= deepest:
        more = sums.where(F.size("up") > k).groupBy(F.get("up", F.lit(k)).alias("node")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        added = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))]
        summed = store.put(sums.join(more, "node", "left").select("node", "up", "n_children", *added))
        store.drop(sums)
        sums, k = summed, k + 1
    ends = built.where("depth is null").select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_end_hashes, "node binary, ends_sha256 string")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.drop("words").withColumn("parent", F.get("up", F.lit(0))).drop("up").join(sums.drop("up"), "node").join(ends, "node", "left").join(parents, "parent", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The CRC-32 of a string of ASCII characters, byte by byte and bit by bit.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
OP12_SQL = f"""
WITH RECURSIVE t AS (SELECT conv_id::BIGINT AS c, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said,
        len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(said ORDER BY turn NULLS FIRST, said) AS said, list(words ORDER BY turn NULLS FIRST, said) AS words FROM t GROUP BY c),
h AS (SELECT o.*, {_CRC.format('o.c::VARCHAR')} % {HEADS} AS h FROM o),
r AS (SELECT h.c, coalesce(b.said[1 : h.h::INT], []) || coalesce(h.said[h.h::INT + 1 :], []) AS said, coalesce(b.words[1 : h.h::INT], []) || coalesce(h.words[h.h::INT + 1 :], []) AS words
      FROM h LEFT JOIN o b ON b.c = h.c - h.c % {FAMILY}),
p AS (SELECT c, d, said[1 : d::INT] AS path, CASE WHEN d > 0 THEN words[d::INT] ELSE 0 END AS words, d = len(said) AS last FROM (SELECT *, unnest(range(0, len(said) + 1)) AS d FROM r)),
n AS (SELECT path, any_value(d) AS d, min(c) AS c, count(*) AS k, any_value(words) AS w, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last) AS ends FROM p GROUP BY path),
f AS (SELECT *, path[1 : d::INT - 1] AS up FROM n),
kids AS (SELECT up, count(*) AS kids FROM f WHERE d > 0 GROUP BY up),
v AS (SELECT f.*, coalesce(kids, 0) AS kids FROM f LEFT JOIN kids ON f.path = kids.up),
a AS (SELECT path[1 : e::INT] AS path, kids, k, w FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM v)),
s AS (SELECT path, count(*) FILTER (WHERE kids = 0) AS leaves, sum((k - 1) * w) AS saved FROM a GROUP BY path)
SELECT v.c AS conv_id, v.d AS depth, u.c AS parent_conv_id, v.k AS n_convs, v.kids AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON v.path = s.path LEFT JOIN n u ON v.d > 0 AND v.up = u.path
"""
