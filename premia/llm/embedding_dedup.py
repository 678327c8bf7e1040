"""Operator 9: near-duplicate vectors by NN-descent.

Vectors with equal labels are compared by cosine in double precision; pairs of at least
``threshold`` link. Equal vectors of a label are one node with a multiplicity.

1. First graph: nodes are sorted by sign codes of random hyperplanes, several times, and
   each is compared with the next ``NEXT`` of its label. The number of codes follows the
   largest label, so that a pair at the threshold is missed by all with at most ``MISSED``.
2. NN-descent: each node's list of its best ``k`` neighbours, found from either side, is
   joined with itself: neighbours of a node are compared with each other, if one of them
   is new, and every pair found is offered to both ends' lists. It ends when a round
   renews at most the share ``DELTA`` of the lists.
3. Links among the lists give connected components. A list full of links is
   saturated: the node may have more. Saturated nodes are covered by balls no wider
   than a link; every node of the label within two links of a ball's centre and outside
   its component is compared with the ball's members, so all links of saturated nodes
   join components. A pair found but dropped from both ends' lists has saturated ends.
   Links are counted inside components, block by block; only counts leave a task.
4. Audit: nodes sampled by the hash of their id are compared with all rows. Recall is the
   mean over sampled nodes with links of the share of their own links that lie inside
   their component, small components apart; the sample grows until it holds ``ENOUGH``
   such nodes (or all nodes, or ``AUDIT_BYTES`` of vectors). Below ``RECALL``, the descent
   goes on with twice the list and more codes, and after ``TRIES`` all nodes of a label
   are compared with each other in blocks.

Cases: a null label or vector, an empty or zero vector, or one with a null or
non-finite component links with nothing, and so do vectors of different length.
Rows are kept one to one; rows that repeat an id are one vector if they are equal,
a null id keeps its row and links with nothing. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premia.llm import textops
from premia.llm.common import bounded, components, is_empty, map_groups, materialise

K = 10
NEXT = 10
MISSED = 0.001
DELTA = 0.01
BLOCK = 4096
WIDE = 16_384             # nodes or centres of balls that one task compares
AUDIT = 400
ENOUGH = 100
AUDIT_BYTES = 16 << 20
RECALL = 0.98
TRIES = 4
_EDGES = "a long, b long, sim double"


def nodes(vectors: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """All rows with their node, and the nodes ``(id, cls, unit, copies)``; unit is a normalised double vector."""
    e = F.col("embedding").cast("array<double>")
    fine = (F.col(label).isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0)
            & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(e, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"),
                          F.when(fine, F.transform(e, lambda x: x + 0.0)).alias("e"))
    rows = materialise(rows.withColumn("h1", F.xxhash64("label", "e")).withColumn("h2", F.xxhash64("e", "label")),
                       "nn-rows")
    groups = rows.where("e is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"))
    firsts = rows.where("e is not null").join(groups, ["h1", "h2"]).where("vec_id = id").select(
        "id", "copies", F.xxhash64("label", F.size("e")).alias("cls"), "e").dropDuplicates(["id"])

    def unit(batches):
        for b in batches:
            out = []
            for x in b.column("e").to_pylist():
                x = np.array(x)
                x = x / np.abs(x).max()      # no overflow or underflow of the squares
                out.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cls"), pa.array(out, pa.binary()), b.column("copies")],
                                             names=["id", "cls", "unit", "copies"])

    table = materialise(firsts.select("id", "cls", "e", "copies").mapInArrow(
        unit, "id long, cls long, unit binary, copies long"), "nn-nodes")
    # Rows without a vector to compare stay out of the join, where a label's would all meet on one key.
    members = rows.where("e is not null").join(groups.select("h1", "h2", "id"), ["h1", "h2"]).select("vec_id", "id")
    members = members.unionByName(rows.where("e is null").select("vec_id", F.lit(None).cast("long").alias("id")))
    return members, table


def _matrix(col) -> np.ndarray:
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _edge_table(a, b, sim) -> pa.Table:
    return pa.table({"a": pa.array(np.asarray(a, np.int64)), "b": pa.array(np.asarray(b, np.int64)),
                     "sim": pa.array(np.asarray(sim, float))})


def _same_width(batch, fn):
    """``fn(ids, cls, matrix, first rows)`` for runs of rows whose vectors have one length."""
    size = np.array([len(x) for x in batch.column("unit").to_pylist()])
    cut = np.flatnonzero(np.append(True, size[1:] != size[:-1])) if len(size) else []
    for i, j in zip(cut, [*cut[1:], len(size)], strict=True):
        yield from fn(batch.slice(i, j - i))


def code_edges(table: DataFrame, first_code: int, codes: int) -> DataFrame:
    """Each node with its successors in the order of each sign code, within its label."""
    def run(batches):
        for b in batches:
            for part in _same_width(b, lambda x: [x]):
                m = _matrix(part.column("unit"))
                for c in range(first_code, first_code + codes):
                    planes = np.random.default_rng(1000 + c).standard_normal((m.shape[1], 60))
                    bits = (m @ planes > 0).astype(np.int64)
                    code = bits @ (np.int64(1) << np.arange(59, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("cls"), pa.array(np.full(len(m), c)), pa.array(code),
                         part.column("unit")], names=["id", "cls", "code", "at", "unit"])

    def neighbours(batches):
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b] if held is None else [*held, b]).combine_chunks()
            ids, cls, code = (rows[c].to_numpy() for c in ("id", "cls", "code"))
            unit = rows["unit"].to_pylist()
            width = max(map(len, unit), default=0) // 8
            m = np.zeros((len(unit), width))
            for i, u in enumerate(unit):
                m[i, :len(u) // 8] = np.frombuffer(u)
            old = 0 if held is None else len(rows) - b.num_rows
            for d in range(1, NEXT + 1):
                i = np.arange(max(0, old - d), len(rows) - d)
                i = i[(cls[i] == cls[i + d]) & (code[i] == code[i + d]) & (i + d >= old)]
                if len(i):
                    yield from _edge_table(ids[i], ids[i + d], np.einsum("ij,ij->i", m[i], m[i + d])).to_batches()
            held = rows.slice(max(0, len(rows) - NEXT)).to_batches()

    coded = table.mapInArrow(run, "id long, cls long, code long, at long, unit binary")
    n = max(1, table.rdd.getNumPartitions())
    ordered = coded.repartitionByRange(n * 2, "cls", "code", "at", "id").sortWithinPartitions("cls", "code", "at", "id")
    return ordered.mapInArrow(neighbours, _EDGES)


def code_count(widest: int, threshold: float) -> int:
    """Codes by which a pair at ``threshold`` in a label of ``widest`` nodes is missed with at most MISSED.

    Two nodes come close in a code's order if they share its leading bits down to runs of NEXT nodes.
    """
    bit = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    close = bit ** np.log2(max(2.0, widest / NEXT))
    return int(np.clip(np.ceil(np.log(MISSED) / np.log(max(1e-9, 1 - close))), 4, 64))


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """Of each node ``a`` its k best neighbours among directed edges ``(a, b, sim, seen)``.

    ``low`` is what a pair must exceed to enter a's list, ``fresh`` whether the list has an entry not seen before.
    """
    best = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("seen").alias("seen"))
    w, own = Window.partitionBy("a").orderBy(F.desc("sim"), "b"), Window.partitionBy("a")
    top = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    return top.withColumn("low", F.when(F.count(F.lit(1)).over(own) < k, -2.0).otherwise(F.min("sim").over(own))).withColumn(
        "fresh", F.min("seen").over(own) == 0)


def directed(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).withColumn("seen", F.lit(0))


def local_join(lists: DataFrame, table: DataFrame) -> DataFrame:
    """Directed edges between neighbours of a node, not both seen before, that enter their first end's list."""
    def compare(groups: pa.Table) -> pa.Table:
        ids, seen, low = (groups[c].to_numpy() for c in ("b", "seen", "low"))
        m = _matrix(groups["unit"])
        sim = m @ m.T
        i, j = np.nonzero((sim > low[:, None]) & ~((seen[:, None] == 1) & (seen[None, :] == 1))
                          & (ids[:, None] != ids[None, :]))
        return _edge_table(ids[i], ids[j], sim[i, j])

    low = lists.select(F.col("a").alias("b"), "low").distinct()
    rows = lists.where("fresh").select("a", "b", "seen").join(low, "b", "left").join(
        table.select(F.col("id").alias("b"), "unit"), "b").select("a", "b", "seen", F.coalesce("low", F.lit(-2.0)).alias("low"), "unit")
    return map_groups(rows, ["a"], compare, _EDGES).withColumn("seen", F.lit(0))


def descend(lists: DataFrame, table: DataFrame, k: int, n: int) -> DataFrame:
    """The lists after rounds of local joins, until a round renews few of their entries."""
    while True:
        known = lists.select("a", "b", "sim", F.lit(1).alias("seen"))
        lists = materialise(best_lists(known.unionByName(local_join(lists, table)), k), "nn-lists")
        if lists.where("seen = 0").count() <= DELTA * k * n:
            return lists


def _forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Row and column numbers of links that connect what all true entries connect."""
    turned, rows, cols = linked.T.copy(), np.ones(len(linked), bool), np.ones(linked.shape[1], bool)
    a, b = [], []
    for s in np.flatnonzero(linked.any(axis=1)).tolist():
        todo = [s] if rows[s] else []
        rows[s] = False
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(linked[i] & cols).tolist():
                cols[j] = False
                more = np.flatnonzero(turned[j] & rows).tolist()
                rows[more] = False
                todo += more
                a += [i, *more]
                b += [j] * (1 + len(more))
    return a, b


def exact_links(table: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b, sim)`` that connect what all links of a label connect: its nodes compared in blocks."""
    def compare(group: pa.Table) -> pa.Table:
        m, ids, x, y = _sides(group)
        sim = m[x] @ m[y].T
        a, b = _forest(sim >= threshold)
        return _edge_table(ids[x[a]], ids[y[b]], sim[a, b])

    grid = _grid(table, table, "cls", ["cls", "id", "unit"], BLOCK).where("r <= q")
    return map_groups(grid, ["cls", "r", "q"], compare, _EDGES)


def _grid(rows: DataFrame, cols: DataFrame, key: str, fields: list[str], block: int) -> DataFrame:
    """``rows`` (side 0) and ``cols`` (side 1) of a key, dealt so that each pair of their blocks meets at one (r, q)."""
    count = lambda df, name: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias(name))
    sizes = bounded(materialise(count(rows, "rows").join(count(cols, "cols"), key), "nn-grid"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    return rows.join(sizes, key).select(*fields, F.lit(0).alias("side"), own("rows").alias("r"), every("cols").alias("q")).unionByName(
        cols.join(sizes, key).select(*fields, F.lit(1).alias("side"), every("rows").alias("r"), own("cols").alias("q")))


def _sides(group: pa.Table):
    side, ids = (group[c].to_numpy() for c in ("side", "id"))
    return _matrix(group["unit"]), ids, np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def enlarge(lists: DataFrame, comp: DataFrame, table: DataFrame, threshold: float, k: int) -> DataFrame | None:
    """Links ``(a, b, sim)`` of saturated nodes to nodes outside their components, one for each node and ball."""
    linked = lists.where(F.col("sim") >= threshold)
    full = materialise(linked.groupBy(F.col("a").alias("id")).count().where(F.col("count") >= k).select("id"), "nn-full")
    if is_empty(full):
        return None
    angle = np.arccos(min(1.0, threshold))
    rows = full.join(comp, "id")
    parts = rows.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    rows = rows.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).join(table, "id")

    def cover(group: pa.Table) -> pa.Table:
        m, ids = _matrix(group["unit"]), group["id"].to_numpy()
        ball, left = np.zeros(len(ids), np.int64), np.arange(len(ids))
        while len(left):
            near = m[left] @ m[left[0]] >= threshold
            near[0] = True
            ball[left[near]] = ids[left[0]]
            left = left[~near]
        return group.select(["id", "cls", "component", "unit"]).append_column("ball", pa.array(ball))

    balls = materialise(map_groups(rows.select("component", "part", "id", "cls", "unit"), ["component", "part"], cover,
                                   "id long, cls long, component long, unit binary, ball long"), "nn-balls")
    known = table.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    reach = np.cos(min(np.pi, 2 * angle)) - 1e-9

    def near(group: pa.Table) -> pa.Table:
        m, ids, x, y = _sides(group)
        comps, balls, out = group["component"].to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(x), 512):
            part = x[i:i + 512]
            a, b = np.nonzero((m[part] @ m[y].T >= reach) & (comps[part][:, None] != comps[y][None, :]))
            out.append(ids[part[a]])
            balls.append(ids[y[b]])
        return pa.table({"ball": pa.array(np.concatenate(balls)), "id": pa.array(np.concatenate(out))})

    fields = ["cls", "id", "component", "unit"]
    asked = materialise(map_groups(_grid(known, balls.where("ball = id"), "cls", fields, WIDE), ["cls", "r", "q"], near,
                                   "ball long, id long"), "nn-asked")

    def first_links(group: pa.Table) -> pa.Table:
        m, ids, x, y = _sides(group)
        a, b, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in range(0, len(x) if len(y) else 0, 512):
            part = x[i:i + 512]
            sim = m[part] @ m[y].T
            best, at = sim.argmax(axis=1), np.arange(len(part))
            at = at[sim[at, best] >= threshold]
            a.append(ids[part[at]])
            b.append(ids[y[best[at]]])
            sims.append(sim[at, best[at]])
        return _edge_table(np.concatenate(a), np.concatenate(b), np.concatenate(sims))

    fields = ["ball", "id", "unit"]
    return materialise(map_groups(_grid(asked.join(table, "id"), balls, "ball", fields, BLOCK), ["ball", "r", "q"], first_links,
                                  _EDGES), "nn-enlarged")


def link_counts(comp: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """``(id, n)``: of each node the copies of other nodes of its component that it links with."""
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    rows = comp.join(size, "component").join(table, "id")
    blocks = F.ceil(F.col("c") / BLOCK)
    own = F.pmod(F.xxhash64("id"), blocks).cast("long")
    span = F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))
    fields = ["component", "id", "copies", "unit"]
    as_row = rows.select(*fields, F.lit(0).alias("side"), own.alias("r"), F.explode(span).alias("q"))
    as_col = rows.select(*fields, F.lit(1).alias("side"), F.explode(span).alias("r"), own.alias("q"))

    def count(group: pa.Table) -> pa.Table:
        side, ids, copies = (group[c].to_numpy() for c in ("side", "id", "copies"))
        m = _matrix(group["unit"])
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = np.zeros(len(x), np.int64)
        for i in range(0, len(x), 512):
            part = x[i:i + 512]
            linked = (m[part] @ m[y].T >= threshold) & (ids[part][:, None] != ids[y][None, :])
            n[i:i + 512] = linked @ copies[y]
        return pa.table({"id": pa.array(ids[x]), "n": pa.array(n)})

    return map_groups(as_row.unionByName(as_col), ["component", "r", "q"], count, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n"))


def audit(table: DataFrame, comp: DataFrame, threshold: float, n: int) -> float | None:
    """The lower recall of nodes in small and in other components: mean share of a sampled node's links inside its own.

    The sample is drawn from all nodes and as much again from those with a link found. None: no sampled node has a link,
    so nothing was measured.
    """
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    known = table.join(comp.join(size, "component"), "id", "left").select(
        "id", "cls", "unit", F.coalesce("component", "id").alias("component"), F.coalesce("c", F.lit(1)).alias("c"))
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    near = comp.count()
    width = table.agg(F.max(F.octet_length("unit"))).first()[0] or 1
    most = max(AUDIT, AUDIT_BYTES // width)
    asked = AUDIT
    while True:
        drawn = (unit * F.lit(max(1, n)) < F.lit(asked << 30)) | (
            (F.col("c") > 1) & (unit * F.lit(max(1, near)) < F.lit(asked << 30)))
        sample = known.where(drawn).limit(3 * most).collect()     # a bounded sample
        queries: dict = {}
        for i, r in enumerate(sample):
            queries.setdefault((r["cls"], len(r["unit"])), []).append((i, r["id"], r["component"], bytes(r["unit"])))

        def run(batches, queries=queries, total=len(sample)):
            true, found = np.zeros(total, np.int64), np.zeros(total, np.int64)
            for b in batches:
                cls, ids, comps = (b.column(c).to_numpy() for c in ("cls", "id", "component"))
                units = b.column("unit").to_pylist()
                for (c, width), q in queries.items():
                    at = [i for i in np.flatnonzero(cls == c).tolist() if len(units[i]) == width]
                    if not at:
                        continue
                    m = np.frombuffer(b"".join(units[i] for i in at)).reshape(len(at), -1)
                    for k in range(0, len(q), 512):
                        to = q[k:k + 512]
                        sim = m @ np.frombuffer(b"".join(x[3] for x in to)).reshape(len(to), -1).T >= threshold
                        sim &= ids[at][:, None] != np.array([x[1] for x in to])[None, :]
                        nth = [x[0] for x in to]
                        true[nth] += sim.sum(axis=0)
                        found[nth] += (sim & (comps[at][:, None] == np.array([x[2] for x in to])[None, :])).sum(axis=0)
            i = np.flatnonzero(true)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(true[i]), pa.array(found[i])], names=["i", "true", "found"])

        got = known.mapInArrow(run, "i long, true long, found long").groupBy("i").agg(
            F.sum("true").alias("true"), F.sum("found").alias("found")).collect()
        if len(got) >= ENOUGH or asked >= min(n, most):
            break
        asked = min(8 * asked, most)
    shares: dict = {}
    for r in got:
        shares.setdefault(sample[r["i"]]["c"] <= K, []).append(r["found"] / r["true"])
    return min((float(np.mean(x)) for x in shares.values()), default=None)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, k: int = K) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``."""
    members, table = nodes(vectors)
    labels = table.groupBy("cls").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    n, codes = labels["n"] or 0, code_count(labels["most"] or 0, threshold)
    lists = share = None
    for attempt in range(TRIES):
        found = directed(code_edges(table, attempt * codes, codes))
        if lists is not None:
            found = found.unionByName(lists.select("a", "b", "sim", "seen"))
        lists = descend(materialise(best_lists(found, k), "nn-lists"), table, k, n)
        linked = lists.where(F.col("sim") >= threshold).select("a", "b")
        comp = materialise(components(linked), "nn-components")
        more = enlarge(lists, comp, table, threshold, k)
        if more is not None and not is_empty(more):
            comp = materialise(components(linked.union(more.select("a", "b"))), "nn-components")
        share = audit(table, comp, threshold, n)
        if share is None or share >= RECALL:
            break
        k *= 2
    if share is None or share < RECALL:      # nothing measured is no pass
        comp = materialise(components(exact_links(table, threshold)), "nn-components")
    n = link_counts(comp, table, threshold)
    per = table.select("id", "copies").join(n, "id", "left").join(comp, "id", "left").select(
        "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = members.where("id is not null").join(per, "id", "left").select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("c").alias("component_id"))
    out = out.unionByName(members.where("id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS c FROM embeddings
  UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id WHERE r.c < l.b)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, r.c AS component_id,
  e.vec_id = r.c AS kept
FROM embeddings e JOIN (SELECT id, min(c) AS c FROM reach GROUP BY 1) r ON r.id = e.vec_id
"""
