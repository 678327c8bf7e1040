"""Operator 3: n-gram Jaccard self-join by signature trees.

Two documents link when the Jaccard similarity of their distinct word-shingle
sets is at least ``percent`` / 100. The result is exact up to 64-bit hashes.

Routing. Linked sets of sizes x <= y differ in at most (x + y)(1 - t)/(1 + t)
shingles. Sets are put in size bands of ratio 1.5 (a set near the upper end also
goes to the next band); a band's hash space is cut into more slices than two of
its sets may differ in, so linked sets agree on ``spare`` + 1 whole slices or more. A subtree of the
forest holds the sets that agree on a slice: its key is (band, slice, digest of
the slice). A set needs no subtree for slices smaller than its (``spare`` + 1)-th smallest:
the largest slice that it agrees on with a partner is never among them, on either side.
There are enough spare slices that empty ones, which unrelated sets would share, fall under
this. In bands up to ``SMALL`` shingles slices would be empty too often; there the keys are a
set's first shingles in hash order, as many as it may lack plus one, of which linked sets
share one. Subtrees with the same members are built once, and
sets that are equal are one member.

Trees. The members of a subtree are sorted into leaves of ``FANOUT`` and upper
levels of the same fan-out; each node holds the OR of its members' token bitmaps,
their smallest and largest size and the most tokens that share a bit. Two nodes
can hold a link only if min(largest sizes, bits in common + shared bits) reaches
the overlap that their smallest sizes ask for; all other node pairs are pruned.

1. In each set's largest subtree, single-node traversals pair it with the most
   central member that the bounds leave (central: nearest to the bits that most
   members have); the pairs are verified on the full sets, and the links'
   connected components follow.
2. In every subtree that still holds two components, dual traversal of the tree
   with itself finds the pairs of different components that the bounds leave. First
   only the best pair of each member outside the subtree's main component is
   verified. Pairs inside a component change nothing and are skipped.
3. With the components that these links give, all pairs that the bounds leave in a
   subtree are followed, but only a spanning forest of them is written. The forests of
   all subtrees join to groups of near sets, and every pair left lies in one group.
   A group's full sets are compared once, by wider bitmaps and then exactly, and a
   spanning forest of the links is written. So the rows written are fewer than the
   members, while the pairs may be as many as their square.

A subtree of more than ``BLOCK`` members is dealt out by blocks: stage 1 keeps
the blocks apart, stages 2 and 3 compare each block of members outside the subtree's
main component with all blocks, so no pair is lost and no task holds more than
two blocks. In a group of near sets a member counts once for every ``PART`` bytes of its set.

Cases: null or wordless text has no shingles and links with nothing; a text of
fewer words than a shingle is one shingle. Rows are kept one to one, repeated rows
included; a null id keeps its row, has a null component and links with nothing.
Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm import textops
from premia.llm.common import bounded, components, discard, map_groups, materialise

FANOUT = 8
BLOCK = 2048
PART = 8192
SMALL = 64                # bands up to this size are routed by single shingles
SETS_SCHEMA = "doc_id long, n long, d1 long, d2 long, keys array<long>"


def _bands() -> list[int]:
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, lows[-1] * 3 // 2))
    return lows


_LOWS = np.array(_bands(), np.int64)


@lru_cache(maxsize=None)
def slices(band: int, percent: int) -> tuple[int, int]:
    """Hash slices of a band, and how many of them are spare: linked sets agree on one more than are spare.

    Spare slices are as many as keep the band's smallest sets from having more empty ones (mean and four deviations).
    """
    high = int(_LOWS[band + 1]) - 1
    differ = (100 - percent) * 2 * high // (100 + percent)
    if not differ:
        return 1, 0
    n, spare = -(-int(_LOWS[band]) * percent // 100), 1 + differ // 6
    while spare < 2 * differ:
        k = differ + spare + 1
        one, two = (1 - 1 / k) ** n, (1 - 2 / k) ** n
        mean = k * one
        spread = max(0.0, mean + k * (k - 1) * two - mean * mean)
        if mean + 4 * sqrt(spread) <= spare:
            break
        spare += 1 + spare // 16
    return differ + spare + 1, spare


def routing_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the subtrees that the sorted set ``s`` goes to."""
    band = int(np.searchsorted(_LOWS, len(s), "right")) - 1
    out = []
    bands = [band]       # and all that hold sets large enough to be linked with
    while 100 * len(s) >= percent * int(_LOWS[bands[-1] + 1]):
        bands.append(bands[-1] + 1)
    code = textops.mix(s)
    total = np.concatenate([[np.uint64(0)], np.cumsum(code, dtype=np.uint64)])
    for b in bands:
        k, spare = slices(b, percent)
        if k == 1:      # linked sets of this band are equal, hence one member already
            continue
        if _LOWS[b] <= SMALL:
            first = len(s) + percent * len(s) // -100 + 1
            out.append(textops.mix(textops.mix(np.uint64([b << 44])) + code[:first]))
            continue
        cut = np.searchsorted((s >> np.uint64(32)) * np.uint64(k) >> np.uint64(32), np.arange(k + 1, dtype=np.uint64))
        tag = np.arange(k, dtype=np.uint64) + np.uint64(b << 44)
        keys = textops.mix(textops.mix(tag) + (total[cut[1:]] - total[cut[:-1]]))
        size = np.diff(cut)
        out.append(keys[size >= np.partition(size, spare)[spare]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: id, set size, 128-bit digest of the set and its routing keys."""
    def run(batches):
        for whole in batches:
            for b in textops.pieces(whole):
                n, d1, d2, keys, off = [], [], [], [], [0]
                for s in textops.shingle_sets(b.column("text"), words):
                    n.append(len(s))
                    d1.append(textops.mix(s).sum(dtype=np.uint64))
                    d2.append(textops.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    k = routing_keys(s, percent) if len(s) else s
                    keys.append(k)
                    off.append(off[-1] + len(k))
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()),
                     pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))],
                    names=["doc_id", "n", "d1", "d2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, SETS_SCHEMA)


def bitmap_bytes(n: int) -> int:
    """Bytes of a bitmap: two bits a token or more, a power of two, 32 at least.

    Unrelated sets then reach about half of the overlap that a link asks for. A set's bitmap goes to each of
    its subtrees, so its width is most of what is shuffled.

    Sizes within a factor of two of each other may get different widths; the wider
    one is folded (bits are taken modulo the narrower width).
    """
    return 1 << max(5, int(2 * n - 1).bit_length() - 3)


def shared_keys(routed: DataFrame) -> DataFrame:
    """The rows ``(id, key)`` whose key has more than one, by one shuffle; a task streams its sorted
    rows and holds one batch, however many rows a key has."""
    def run(batches):
        held = None                # the last row so far and whether its key came before
        for b in batches:
            if not b.num_rows:
                continue
            ids, keys = (b.column(c).to_numpy() for c in ("id", "key"))
            before = np.append(False, keys[1:] == keys[:-1])
            if held:
                ids, keys = np.append(held[0], ids), np.append(held[1], keys)
                before = np.concatenate([[held[2]], [keys[0] == keys[1]], before[1:]])
            keep = before | np.append(keys[1:] == keys[:-1], False)
            keep[-1] = False
            held = (ids[-1], keys[-1], bool(before[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(keys[keep])], names=["id", "key"])
        if held and held[2]:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())],
                                             names=["id", "key"])

    return routed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id long, key long")


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").join(bounded(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")


def _bitmap(s: np.ndarray, width: int) -> bytes:
    flags = np.zeros(width * 8, np.uint8)
    flags[(textops.mix(s) & np.uint64(width * 8 - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def bitmap_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``(id, n, bits)`` of the documents in ``ids(id)``."""
    def run(batches):
        for whole in batches:
            for b in textops.pieces(whole):
                n, bits = [], []
                for s in textops.shingle_sets(b.column("text"), words):
                    n.append(len(s))
                    bits.append(_bitmap(s, bitmap_bytes(len(s))))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()),
                                                  pa.array(bits, pa.binary())], names=["id", "n", "bits"])

    return _of_ids(docs, ids).mapInArrow(run, "id long, n long, bits binary")


def set_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``(id, shingles)`` of the documents in ``ids(id)``: sorted 64-bit hashes."""
    def run(batches):
        for whole in batches:
            for b in textops.pieces(whole):
                raw = [s.tobytes() for s in textops.shingle_sets(b.column("text"), words)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(raw, pa.binary())],
                                                 names=["id", "shingles"])

    return _of_ids(docs, ids).mapInArrow(run, "id long, shingles binary")


class SignatureTree:
    """Bulk-loaded tree over one group's members, in their given order."""

    def __init__(self, size: np.ndarray, bits: list[bytes], comp: np.ndarray):
        width = min(map(len, bits))
        rows = np.zeros((len(bits), width // 8), np.uint64)
        for i, b in enumerate(bits):
            rows[i] = np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0)
        shared = size - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        self.levels = [(rows, size, size, shared, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            rows, lo, hi, shared, c0, c1 = self.levels[-1]
            at = np.arange(0, len(rows), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(rows, at, axis=0), np.minimum.reduceat(lo, at),
                                np.maximum.reduceat(hi, at), np.maximum.reduceat(shared, at),
                                np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    def possible(self, level: int, a: np.ndarray, other: int, b: np.ndarray, percent: int) -> np.ndarray:
        """Which node pairs (a at level, b at other) can hold a link between different components."""
        ra, loa, hia, sa, ca0, ca1 = self.levels[level]
        rb, lob, hib, sb, cb0, cb1 = self.levels[other]
        keep = (hia[a] * 100 >= lob[b] * percent) & (hib[b] * 100 >= loa[a] * percent)
        keep &= ~((ca0[a] == ca1[a]) & (cb0[b] == cb1[b]) & (ca0[a] == cb0[b]))
        at = np.flatnonzero(keep)
        step = max(1, (8 << 20) // max(1, ra.shape[1] * 8))
        for i in range(0, len(at), step):
            x = at[i:i + step]
            common = np.bitwise_count(ra[a[x]] & rb[b[x]]).sum(axis=1, dtype=np.int64)
            most = np.minimum(np.minimum(hia[a[x]], hib[b[x]]), common + np.minimum(sa[a[x]], sb[b[x]]))
            keep[x] = most * (100 + percent) >= percent * (loa[a[x]] + lob[b[x]])
        return keep

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits that members a and b have in common."""
        rows = self.levels[0][0]
        step = max(1, (8 << 20) // max(1, rows.shape[1] * 8))
        return np.concatenate([np.bitwise_count(rows[a[i:i + step]] & rows[b[i:i + step]]).sum(axis=1, dtype=np.int64)
                               for i in range(0, len(a), step)])

    def _children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return nodes[:, None] * FANOUT + np.arange(FANOUT)

    def eccentricity(self) -> np.ndarray:
        """Bits in which each member differs from the bits that more than half of the members have."""
        rows = self.levels[0][0]
        step = max(1, (4 << 20) // (rows.shape[1] * 64))
        votes = sum(np.unpackbits(rows[i:i + step].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
                    for i in range(0, len(rows), step))
        most = np.packbits(2 * votes > len(rows)).view(np.uint64)
        return np.bitwise_count(rows ^ most).sum(axis=1, dtype=np.int64)

    def search(self, member: int, percent: int) -> np.ndarray:
        """Members that can link with ``member``."""
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            if level < len(self.levels) - 1:
                nodes = self._children(level + 1, nodes).ravel()
                nodes = nodes[nodes < len(self.levels[level][0])]
            nodes = nodes[self.possible(level, nodes, 0, np.full(len(nodes), member), percent)]
        return nodes

    def pairs(self, percent: int):
        """Arrays (a, b), a < b, of all members that can link: dual traversal of the tree with itself."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            ok = self.possible(level, a, level, b, percent) & ((a < b) | (level > 0))
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            for i in range(0, len(a), 1 << 12):
                ca, cb = self._children(level, a[i:i + (1 << 12)]), self._children(level, b[i:i + (1 << 12)])
                x = np.repeat(ca, FANOUT, axis=1).ravel()
                y = np.tile(cb, (1, FANOUT)).ravel()
                real = (x <= y) & (y < len(self.levels[level - 1][0]))
                stack.append((level - 1, x[real], y[real]))


class Forest:
    """Trees over nodes that grow as edges come in; ``root`` is the smallest node of each node's tree."""

    def __init__(self, root: np.ndarray):
        self.root = root

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of the edges (a, b) that joined two trees; the other edges lie inside a tree."""
        used, at = [], np.arange(len(a))
        while True:
            x, y = self.root[a[at]], self.root[b[at]]
            apart = x != y
            if not apart.any():
                return np.concatenate(used) if used else np.zeros(0, np.int64)
            at, low, high = at[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            # Each root with an edge to a smaller one hooks to the smallest of them.
            order = np.lexsort((low, high))
            first = order[np.append(True, high[order][1:] != high[order][:-1])]
            used.append(at[first])
            self.root[high[first]] = low[first]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _pairs_table(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def first_partners(group: pa.Table, percent: int) -> pa.Table:
    """Stage 1 in one block: each member with the most central member that the bounds leave."""
    ids, n = group["id"].to_numpy(), group["n"].to_numpy()
    order = np.lexsort((ids, n))
    ids, n, bits = ids[order], n[order], group["bits"].take(pa.array(order)).to_pylist()
    tree = SignatureTree(n, bits, np.arange(len(ids)))
    left, out = np.ones(len(ids), bool), []
    for at in np.lexsort((ids, tree.eccentricity())):
        if left[at]:
            left[at] = False
            found = tree.search(int(at), percent)
            found = found[left[found]]
            left[found] = False
            out.append((np.full(len(found), ids[at]), ids[found]))
    return _pairs_table(out)


def cross_pairs(group: pa.Table, percent: int, best: bool = False) -> pa.Table:
    """Stages 2 and 3 in one block pair: the pairs of different components that the bounds leave.

    ``side`` 0 rows belong to the row block and 1 to the column block; a pair needs
    a row-block member. ``best``: of each row-block member, only the pair with most
    bits in common. Otherwise a spanning forest of all pairs, fewer than the members.
    """
    ids, n, comp, side = (group[c].to_numpy() for c in ("id", "n", "comp", "side"))
    order = np.lexsort((side, ids))
    order = order[np.append(True, ids[order][1:] != ids[order][:-1])]
    order = order[np.lexsort((ids[order], n[order], comp[order]))]
    ids, n, comp, side = ids[order], n[order], comp[order], side[order]
    tree = SignatureTree(n, group["bits"].take(pa.array(order)).to_pylist(), comp)
    out, most, partner = [], np.zeros(len(ids), np.int64), np.full(len(ids), -1)
    forest = Forest(np.arange(len(ids)))
    for a, b in tree.pairs(percent):
        if not best:
            ok = np.flatnonzero((side[a] == 0) | (side[b] == 0))
            ok = ok[forest.add(a[ok], b[ok])]
            out.append((ids[a[ok]], ids[b[ok]]))
            continue
        bits = tree.common(a, b)
        for x, y in ((a, b), (b, a)):
            np.maximum.at(most, x, bits)
            top = bits == most[x]
            partner[x[top]] = y[top]
    if best:
        x = np.flatnonzero((partner >= 0) & (side == 0))
        out.append((ids[x], ids[partner[x]]))
    return _pairs_table(out)


def overlaps(sets: list[np.ndarray], x: int, others: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of set ``x`` with the sets ``others``, all sorted and not empty."""
    own, out = sets[x], []
    step = max(1, (1 << 19) // max(len(sets[i]) for i in others))
    for i in range(0, len(others), step):
        part = [sets[j] for j in others[i:i + step]]
        flat = np.concatenate(part)
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        starts = np.cumsum([0, *map(len, part[:-1])])
        out.append(np.add.reduceat(own[at] == flat, starts, dtype=np.int64))
    return np.concatenate(out)


def exact_links(group: pa.Table, percent: int) -> pa.Table:
    """Stage 3 in one block pair of a group of near sets: a spanning forest of the links between different components.

    Members of a size band, and smaller ones that may link with them, share a tree over bitmaps of
    eight bits a shingle or more; the pairs that it leaves are counted on the full sets.
    """
    ids, comp, side = (group[c].to_numpy() for c in ("id", "comp", "side"))
    raw, seen = group["shingles"].to_pylist(), {}
    for i in np.lexsort((side, ids)):
        seen.setdefault((ids[i], raw[i]), i)
    order = np.array(list(seen.values()))
    size = np.array([len(raw[i]) // 8 for i in order])
    by = np.lexsort((ids[order], size, comp[order]))
    order, size = order[by], size[by]
    ids, comp, side, sets = ids[order], comp[order], side[order], [np.frombuffer(raw[i], np.uint64) for i in order]
    forest, out = Forest(np.searchsorted(comp, comp)), []
    for band in np.unique(np.searchsorted(_LOWS, size, "right") - 1):
        low, end = int(_LOWS[band]), int(_LOWS[band + 1])
        take = np.flatnonzero((100 * size >= percent * low) & (size < end))
        width = 4 * bitmap_bytes(end - 1)
        tree = SignatureTree(size[take], [_bitmap(sets[i], width) for i in take], comp[take])
        for a, b in tree.pairs(percent):
            a, b = take[a], take[b]
            ok = (side[a] == 0) | (side[b] == 0)
            a, b = a[ok], b[ok]
            by = np.argsort(a, kind="stable")
            firsts, starts = np.unique(a[by], return_index=True)
            for x, others in zip(firsts, np.split(b[by], starts[1:]), strict=True):
                others = others[forest.root[others] != forest.root[x]]
                if not len(others):
                    continue
                both = overlaps(sets, x, others)
                others = others[100 * both >= percent * (size[x] + size[others] - both)]
                others = others[forest.add(np.full(len(others), x), others)]
                out.append((np.full(len(others), ids[x]), ids[others]))
    return _pairs_table(out)


def verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that link, by their full sets."""
    def run(batches):
        for p in batches:
            a, b = p.column("sa").to_pylist(), p.column("sb").to_pylist()
            ok = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b")], names=["a", "b"]).filter(
                pa.array(ok, pa.bool_()))

    pairs = materialise(pairs, "jaccard-pairs")
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "jaccard-ids")
    s = materialise(set_table(docs, ids, words), "jaccard-sets")
    rows = pairs.join(s.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        s.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    links = materialise(rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "jaccard-links")
    discard(s)
    return links


def cross_blocks(rows: DataFrame, comp: DataFrame, data: DataFrame) -> DataFrame:
    """Block pairs (key, r, q) of the members ``rows(key, id, weight)`` of each key that holds several components, with
    their ``data``."""
    labelled = rows.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).select(
        "key", "id", "weight", "comp")
    # Members outside the component with most members of the key make the row blocks.
    per = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("w"))
    main = materialise(per.groupBy("key").agg(F.max(F.struct("k", "comp", "w")).alias("t"), F.count(F.lit(1)).alias("comps"),
                                              F.sum("w").alias("all")).where("comps > 1").select(
        "key", F.col("t.comp").alias("main"), (F.col("all") - F.col("t.w")).alias("rest"), "all"), "jaccard-mixed")
    grid = labelled.drop("weight").join(main, "key").join(data, "id")
    nr, nc = F.ceil(F.col("rest") / BLOCK), F.ceil(F.col("all") / BLOCK)
    row = F.pmod(F.xxhash64("id"), nr).cast("long")
    col = F.pmod(F.xxhash64("id"), nc).cast("long")
    span = lambda k: F.sequence(F.lit(0).cast("long"), (k - 1).cast("long"))
    fields = ["key", "id", "comp", *[c for c in data.columns if c != "id"]]
    as_row = grid.where("comp <> main").select(*fields, F.lit(0).alias("side"), row.alias("r"), F.explode(span(nc)).alias("q"))
    as_col = grid.select(*fields, F.lit(1).alias("side"), F.explode(span(nr)).alias("r"), col.alias("q"))
    return as_row.unionByName(as_col)


def cross_candidates(rows: DataFrame, comp: DataFrame, bits: DataFrame, percent: int, best: bool) -> DataFrame:
    """Distinct pairs of different components in the subtrees that hold several (see ``cross_pairs``)."""
    return map_groups(cross_blocks(rows.select("key", "id", F.lit(1).alias("weight")), comp, bits), ["key", "r", "q"],
                      lambda group: cross_pairs(group, percent, best), "a long, b long").distinct()


def near_links(near: DataFrame, comp: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join all components that any links inside the groups ``near(id, component)`` join."""
    near = materialise(near.select("id", F.col("component").alias("key")), "jaccard-near")
    s = materialise(set_table(docs, near, words), "jaccard-sets")
    weight = s.groupBy("id").agg(F.sum(F.ceil(F.length("shingles") / PART)).alias("weight"))
    links = materialise(map_groups(cross_blocks(near.join(weight, "id"), comp, s), ["key", "r", "q"],
                                   lambda group: exact_links(group, percent), "a long, b long").distinct(), "jaccard-links")
    discard(s)
    return links


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id`` (smallest id reachable by links)."""
    table = materialise(shingle_table(docs, words, percent), "jaccard-keys")
    some = table.where("n > 0 and doc_id is not null")
    reps = some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    # Rows that link with nothing stay out of the join, where they would all meet on one key.
    alone = table.where("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("rep"))
    member = materialise(some.select("doc_id", "n", "d1", "d2").join(reps, ["n", "d1", "d2"]).select(
        "doc_id", "n", "rep").unionByName(alone), "jaccard-members")
    copies = bounded(materialise(member.where("n > 0 and doc_id > rep").select("doc_id").distinct(), "jaccard-copies"))
    routed = some.where(F.size("keys") > 0).select("doc_id", "keys").join(copies, "doc_id", "left_anti").select(
        F.col("doc_id").alias("id"), F.explode("keys").alias("key"))

    # Subtrees of two members or more; of subtrees with the same members, one.
    rows = materialise(shared_keys(routed), "jaccard-routed")
    discard(table)
    trees = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("m"),
                                    F.sum(F.pmod(F.xxhash64("id"), F.lit((1 << 31) - 1))).alias("h1"),
                                    F.sum(F.pmod(F.xxhash64("id", F.lit(7)), F.lit((1 << 31) - 1))).alias("h2"))
    trees = materialise(trees.groupBy("c", "m", "h1", "h2").agg(F.min("key").alias("key")).select("key", "c"),
                        "jaccard-trees")
    rows = materialise(rows.join(bounded(trees), "key"), "jaccard-rows")
    texts = docs.where("doc_id is not null")
    ids = materialise(rows.select("id").distinct(), "jaccard-ids")
    bits = materialise(bitmap_table(texts, ids, words), "jaccard-bits")

    largest = rows.groupBy("id").agg(F.max(F.struct("c", "key")).alias("t")).select("id", "t.c", "t.key")
    blocks = F.ceil(F.col("c") / BLOCK)
    stage1 = map_groups(largest.join(bits, "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks)),
                        ["key", "block"], lambda group: first_partners(group, percent), "a long, b long")
    links = verify(stage1.distinct(), texts, words, percent)

    comp = components(links)
    links = links.unionByName(verify(cross_candidates(rows, comp, bits, percent, True), texts, words, percent))
    comp = components(links)
    near = components(cross_candidates(rows, comp, bits, percent, False))
    links = links.unionByName(near_links(near, comp, texts, words, percent))
    comp = components(links)
    linked = member.where("rep is not null").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return linked.unionByName(member.where("rep is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)


# Exact: inverted join on shingles, then labels that spread along links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY 1, 2, nx.n, ny.n HAVING 100 * count(*) >= 90 * (nx.n + ny.n - count(*))),
reach AS (
  SELECT doc_id AS id, doc_id AS c FROM documents
  UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE r.c < l.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM reach GROUP BY 1) r ON r.id = d.doc_id
"""
