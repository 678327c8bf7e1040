"""Operator 13: prefix trie of conversations, by adaptive radix trees.

A turn becomes a fixed-width big-endian id of ``WIDTH`` bytes (word count of its text,
then the digest of role and text), a conversation the bytes of its turns. Equal
conversations become one key with their number, smallest id and the hash of all ids.

Keys are dealt by their first turn. Where the keys below a turn pass ``limit`` bytes they
are dealt by one turn more, and so on: those few crowded prefixes are nodes of their own
(one round of jobs per turn of such a prefix). Each remaining group is one adaptive radix
tree in one task: nodes of 4, 16, 48 or 256 children that grow as needed, one-child paths
compressed. Only byte depths that are whole turns become nodes of the result. Figures of
the crowded prefixes are summed upwards from the trees' roots.

Cases: rows without a conv_id are ignored; null role or text is empty; turns come in
ascending order, null first, equal numbers by word count and digest, repeated rows are
turns of their own; an empty table gives no node; other columns are ignored. A
conversation is one key of ``WIDTH`` bytes a turn, held in one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import map_groups, materialise, table

WIDTH = 20
LIMIT = 4 << 20        # bytes of keys in one tree
CHUNK = 1024           # conversation ids that may stand in one row
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")


class Node:
    """Inner node of an adaptive radix tree; ``entry`` is the key that ends here."""

    __slots__ = ("path", "layout", "bytes", "kids", "entry", "sample")

    def __init__(self, path: bytes, sample: bytes):
        self.path, self.sample = path, sample
        self.layout, self.bytes, self.kids, self.entry = 4, bytearray(), [], None

    def child(self, b: int):
        if self.layout <= 16:
            at = self.bytes.find(b)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[b]
            return self.kids[at - 1] if at else None
        return self.kids[b]

    def put(self, b: int, node: Node) -> None:
        """Adds or replaces the child at byte ``b``; a full node changes to the next layout."""
        if self.layout <= 16:
            at = self.bytes.find(b)
            if at >= 0:
                self.kids[at] = node
                return
            if len(self.kids) < self.layout:
                self.bytes.append(b)
                self.kids.append(node)
                return
            if self.layout == 4:
                self.layout = 16
            else:
                index = bytearray(256)
                for i, x in enumerate(self.bytes):
                    index[x] = i + 1
                self.layout, self.bytes = 48, index
            self.put(b, node)
        elif self.layout == 48:
            if self.bytes[b]:
                self.kids[self.bytes[b] - 1] = node
            elif len(self.kids) < 48:
                self.kids.append(node)
                self.bytes[b] = len(self.kids)
            else:
                every = [self.kids[x - 1] if x else None for x in self.bytes]
                self.layout, self.bytes, self.kids = 256, bytearray(), every
                self.kids[b] = node
        else:
            self.kids[b] = node

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None] if self.layout == 256 else self.kids


def _common(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def insert(root: Node | None, key: bytes, entry) -> Node:
    """The tree with ``key`` in it; keys are distinct."""
    if root is None:
        root = Node(key, key)
        root.entry = entry
        return root
    node, above, at = root, None, 0          # at: bytes of key used before node.path
    while True:
        rest = key[at:at + len(node.path)]
        n = _common(node.path, rest)
        if n < len(node.path):               # the path splits
            fork = Node(node.path[:n], key)
            fork.put(node.path[n], node)
            node.path = node.path[n + 1:]
            if above is None:
                root = fork
            else:
                above.put(key[at - 1], fork)
            node, at = fork, at + n
        else:
            at += n
        if at == len(key):
            node.entry = entry
            return root
        below = node.child(key[at])
        if below is None:
            leaf = Node(key[at + 1:], key)
            leaf.entry = entry
            node.put(key[at], leaf)
            return root
        above, node, at = node, below, at + 1


def tree_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of the radix tree over one group of keys, from the group's own depth on."""
    root, cut, up = None, rows["cut"][0].as_py(), rows["up"][0].as_py()
    for key, n, conv, ends in zip(*(rows[c].to_pylist() for c in ("key", "n", "conv", "ends")), strict=True):
        root = insert(root, key, (n, conv, ends))
    depth, above, words, n_convs, conv_id, ends_of = [], [], [], [], [], []
    stack = [(root, -1, -1)]                 # node, byte depth above its first byte, last whole turn above
    while stack:
        node, before, parent = stack.pop()
        end = before + 1 + len(node.path)
        for at in range((max(before, 0) // WIDTH + 1) * WIDTH, end + 1, WIDTH):
            if at // WIDTH < cut:
                continue
            depth.append(at // WIDTH)
            above.append(parent)
            words.append(int.from_bytes(node.sample[at - WIDTH:at - WIDTH + 4], "big"))
            n_convs.append(0)
            conv_id.append(None)
            ends_of.append(_NO_ENDS)
            parent = len(depth) - 1
        if node.entry:
            n_convs[parent], conv_id[parent], ends_of[parent] = node.entry
        stack.extend((k, end, parent) for k in node.children())
    kids, leaves, saved = [0] * len(depth), [0] * len(depth), [0] * len(depth)
    for i in reversed(range(len(depth))):    # children come after their parents
        leaves[i] = leaves[i] or 1
        saved[i] += (n_convs[i] - 1) * words[i]
        p = above[i]
        if p >= 0:
            kids[p] += 1
            n_convs[p] += n_convs[i]
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            conv_id[p] = conv_id[i] if conv_id[p] is None else min(conv_id[p], conv_id[i])
    parents = [conv_id[p] if p >= 0 else None for p in above]
    tops = [None if p >= 0 else up for p in above]
    return pa.table([pa.array(conv_id, pa.int64()), pa.array(depth, pa.int64()), pa.array(parents, pa.int64()),
                     pa.array(n_convs, pa.int64()), pa.array(kids, pa.int64()), pa.array(leaves, pa.int64()),
                     pa.array(saved, pa.int64()), pa.array(ends_of, pa.string()), pa.array(tops, pa.string())],
                    names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256", "up"])


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, id)``: id is the turn's fixed-width id in hexadecimal."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    n = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.concat(F.lpad(F.lower(F.hex(n.cast("long"))), 8, "0"), digest).alias("id"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, key)``: the first h turns of every twentieth conversation lead those after it."""
    own = turns(conversations).groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"]).alias("ids"))
    own = materialise(own, "trie-own")
    leads = own.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("ids", 1, 3).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    with_lead = own.withColumn("base", F.expr("conv_id - conv_id % 20")).withColumn("h", h).join(leads, "base", "left")
    none = F.array().cast("array<string>")
    parts = F.concat(F.slice(F.coalesce("lead", none), F.lit(1), F.col("h")),
                     F.slice("ids", F.col("h") + 1, F.greatest(F.size("ids"), F.lit(1))))
    return with_lead.select("conv_id", F.unhex(F.array_join(parts, "")).alias("key"))


def _hash_ends(batches):
    """One row per key: ids arrive in ascending chunks and go through SHA-256 as they come."""
    digest = last = key = low = None
    n = 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([n], pa.int64()), pa.array([low], pa.int64()),
             pa.array([digest.hexdigest()])], names=["key", "n", "conv", "ends"])

    for b in batches:
        out = []
        for k, one, count, least, ids in zip(*(b.column(c).to_pylist() for c in ("digest", "key", "n", "low", "ids")),
                                             strict=True):
            if k != last:
                if last is not None:
                    out.append(row())
                digest, last, key, low, n = hashlib.sha256(), k, one, least, 0
            else:
                digest.update(b",")
            digest.update(ids.encode())
            n += count
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
    if last is not None:
        yield row()


def distinct_keys(convs: DataFrame) -> DataFrame:
    """``(key, n, conv, ends)``: each distinct conversation once, with the hash of the ids that have it."""
    chunk = F.expr(f"conv_id div {CHUNK} - int(conv_id < 0)")
    pieces = convs.withColumn("digest", F.unhex(F.md5("key"))).groupBy("digest", chunk.alias("chunk")).agg(
        F.first("key").alias("key"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"),
        F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))
    # Ascending ids: a chunk's ids all lie below the next chunk's.
    ordered = pieces.repartition("digest").sortWithinPartitions("digest", "low")
    return ordered.select("digest", "key", "n", "low", "ids").mapInArrow(
        _hash_ends, "key binary, n long, conv long, ends string")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    keys = materialise(distinct_keys(rebuilt(conversations)), "trie-keys")
    top = keys.groupBy().agg(F.sum("n").alias("n"), F.min("conv").alias("conv")).where("n is not null").select(
        F.lit("root").alias("g"), F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("words"), "n", "conv")
    tops, cold, rest, d = [], None, keys.withColumn("up", F.lit("root")), 0
    while True:
        ends = rest.where(F.length("key") == d * WIDTH).select(F.col("up").alias("g"), "ends")
        tops.append(materialise(top.join(ends, "g", "left"), f"trie-top-{d}"))
        deeper = rest.where(F.length("key") > d * WIDTH).withColumn(
            "g", F.md5(F.substring("key", 1, (d + 1) * WIDTH)))
        last = F.conv(F.hex(F.substring("key", d * WIDTH + 1, 4)), 16, 10).cast("long")
        crowded = materialise(deeper.groupBy("g").agg(
            F.min("up").alias("up"), F.min(last).alias("words"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
            F.count(F.lit(1)).alias("keys"), F.sum(F.length("key")).alias("bytes")).where(
            (F.col("keys") > 1) & (F.col("bytes") > limit)).drop("keys", "bytes"), f"trie-crowded-{d}")
        ids = crowded.select("g")
        trees = deeper.join(ids, "g", "left_anti").withColumn("cut", F.lit(d + 1))
        cold = trees if cold is None else cold.unionByName(trees)
        if not crowded.take(1):
            break
        rest = materialise(deeper.join(ids, "g", "left_semi").drop("up").withColumnRenamed("g", "up"), f"trie-rest-{d}")
        top, d = crowded, d + 1
    dealt = cold.select(F.xxhash64("g").alias("g1"), F.xxhash64("g", F.lit(1)).alias("g2"), "cut", "up", "key", "n",
                        "conv", "ends")
    nodes = materialise(map_groups(dealt, ["g1", "g2"], tree_nodes, f"{_NODE}, up string"), "trie-nodes")
    roots = nodes.where("up is not null")
    sums = roots.select("up", "n_leaves", "saved_tokens")
    done, below = [], None
    for t in reversed(tops):                  # crowded prefixes, the deepest first
        every = sums if below is None else sums.unionByName(below.select("up", "n_leaves", "saved_tokens"))
        kids = every.groupBy(F.col("up").alias("g")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        depth = len(tops) - 1 - len(done)
        below = materialise(t.join(kids, "g", "left").select(
            "g", "up", F.col("conv").alias("conv_id"), F.lit(depth).cast("long").alias("depth"),
            F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("l", F.lit(1)).alias("n_leaves"),
            (F.coalesce("s", F.lit(0)) + (F.col("n") - 1) * F.col("words")).alias("saved_tokens"),
            F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256")), f"trie-sum-{depth}")
        done.append(below)
    above = done[0]
    for t in done[1:]:
        above = above.unionByName(t)
    of = above.select(F.col("g").alias("up"), F.col("conv_id").alias("of"))
    names = [x.split()[0] for x in _NODE.split(", ")]
    linked = above.drop("g").unionByName(roots.drop("parent_conv_id")).join(of, "up", "left").withColumnRenamed(
        "of", "parent_conv_id")
    return nodes.where("up is null").select(*names).unionByName(linked.select(*names))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


# Exact: every pair of an ancestor and a descendant of one conversation; CRC-32 bit by bit.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
u AS (
  SELECT conv_id, turn, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS w,
    md5(length(r) || ':' || r || x) AS i FROM t),
o AS (
  SELECT conv_id, list(i ORDER BY turn NULLS FIRST, w, i) AS ids, list(w ORDER BY turn NULLS FIRST, w, i) AS ws
  FROM u GROUP BY conv_id),
h AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: list_transform(range(8),
      lambda b: (ascii(ch)::BIGINT >> b) & 1)))),
    lambda a, bit: CASE WHEN xor(a, bit) & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 4 AS h FROM o),
e AS (
  SELECT o.conv_id, list_concat(coalesce(b.ids[1:h], []), o.ids[h + 1:]) AS ids,
    list_concat(coalesce(b.ws[1:h], []), o.ws[h + 1:]) AS ws
  FROM o JOIN h ON h.conv_id = o.conv_id LEFT JOIN o b ON b.conv_id = h.base),
p AS (
  SELECT conv_id, d, md5(array_to_string(ids[1:d], ',')) AS k, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w,
    d = len(ids) AS last
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM e)),
n AS (
  SELECT k, d, min(conv_id) AS c, count(*) AS n, any_value(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
  FROM p GROUP BY k, d),
pr AS (
  SELECT DISTINCT a.k AS ak, a.d AS ad, b.k AS bk, b.d AS bd FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d >= a.d),
kids AS (SELECT ak AS k, ad AS d, count(*) AS kids FROM pr WHERE bd = ad + 1 GROUP BY ak, ad),
up AS (SELECT bk AS k, bd AS d, n.c AS parent FROM pr JOIN n ON n.k = ak AND n.d = ad WHERE bd = ad + 1),
total AS (
  SELECT ak AS k, ad AS d, sum(CASE WHEN kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.w) AS saved
  FROM pr JOIN n ON n.k = bk AND n.d = bd LEFT JOIN kids ON kids.k = bk AND kids.d = bd GROUP BY ak, ad)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, parent AS parent_conv_id, n.n AS n_convs,
  coalesce(kids, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM n JOIN total USING (k, d) LEFT JOIN kids USING (k, d) LEFT JOIN up USING (k, d)
"""
