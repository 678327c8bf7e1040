"""Near copies that do not link: the join writes rows in proportion to a group's members, and loses no link."""

import random

import numpy as np
import pyarrow as pa
import pytest

from premia.llm import jaccard_join
from premia.llm.common import components, materialise
from test_llm_operators import brute_components, make_docs


def near_texts(r, n, words, changed):
    """Copies of one text, each with ``changed`` words of its own, in random places."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for i in r.sample(range(words), changed):
            w[i] = f"own{k}x{i}"
        out.append(" ".join(w))
    return out


def linked(sets, percent):
    return lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])


@pytest.mark.parametrize("members", [40, 160])
def test_rows_of_a_near_group_grow_with_its_members(members):
    r = np.random.default_rng(1)
    common = r.integers(0, 1 << 64, 88, np.uint64)
    sets = [np.unique(np.append(common, r.integers(0, 1 << 64, 12, np.uint64))) for _ in range(members)]
    assert 100 * 88 < 80 * 112          # no two link, but the bounds cannot tell for most
    ids = np.arange(members)
    group = pa.table({"id": ids, "n": np.full(members, 100), "comp": ids, "side": np.zeros(members, np.int64),
                      "bits": [jaccard_join._bitmap(s, jaccard_join.bitmap_bytes(100)) for s in sets]})
    got = jaccard_join.cross_pairs(group, 80)
    tree = jaccard_join.SignatureTree(np.full(members, 100), group["bits"].to_pylist(), ids)
    left = {(min(x, y), max(x, y)) for a, b in tree.pairs(80) for x, y in zip(a.tolist(), b.tolist())}
    assert len(left) > 5 * members and len(got) < members
    pairs = set(zip(got["a"].to_pylist(), got["b"].to_pylist()))
    assert pairs <= left
    assert brute_components(range(members), lambda a, b: (a, b) in pairs) == brute_components(
        range(members), lambda a, b: (a, b) in left)
    whole = pa.table({"id": ids, "comp": ids, "side": np.zeros(members, np.int64), "shingles": [s.tobytes() for s in sets]})
    assert len(jaccard_join.exact_links(whole, 80)) == 0


def test_forest_of_random_edges():
    r = np.random.default_rng(2)
    for n in (2, 9, 60):
        forest, edges, kept = jaccard_join.Forest(np.arange(n)), set(), set()
        for _ in range(4):
            a, b = r.integers(0, n, (2, n // 2))
            edges |= {*zip(a.tolist(), b.tolist()), *zip(b.tolist(), a.tolist())}
            at = forest.add(a, b)
            kept |= {*zip(a[at].tolist(), b[at].tolist()), *zip(b[at].tolist(), a[at].tolist())}
            want = brute_components(range(n), lambda a, b: (a, b) in edges)
            assert forest.root.tolist() == [want[i] for i in range(n)]
        assert brute_components(range(n), lambda a, b: (a, b) in kept) == want
        assert len(kept) == 2 * (n - len(set(want.values())))


@pytest.mark.parametrize("block,part", [(2048, 8192), (4, 64)])
def test_near_links_equal_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "PART", part)
    r = random.Random(5)
    texts = near_texts(r, 25, 60, 5) + near_texts(r, 25, 60, 6) + near_texts(r, 10, 60, 9)
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (5, 7, 40, 49, 60, 75, 95, 118, 300, 374)]   # links across bands
    sets = [set(t.split()) for t in texts]
    docs = make_docs(spark, texts + [texts[0]])
    ids = range(len(texts))
    want = brute_components(ids, linked(sets, 80))
    assert 5 < len(set(want.values())) < len(texts) - 20
    near = materialise(spark.createDataFrame([(i, 0) for i in ids], "id long, component long"), "test")
    for old in ([], [(1, 0), (61, 60)]):          # some components known before
        comp = spark.createDataFrame([x for a, b in old for x in ((a, b), (b, b))], "id long, component long")
        known = spark.createDataFrame(old, "a long, b long")
        links = jaccard_join.near_links(near, comp, docs, 1, 80)
        rows = links.collect()
        assert all(linked(sets, 80)(x.a, x.b) for x in rows)
        got = {x.id: x.component for x in components(links.union(known)).collect()}
        edges = {*old, *((b, a) for a, b in old)}
        both = brute_components(ids, lambda a, b: (a, b) in edges or linked(sets, 80)(a, b))
        assert {i: got.get(i, i) for i in ids} == both


def test_near_groups_in_the_whole_join(spark, monkeypatch):
    made = []
    real = jaccard_join.cross_candidates

    def counted(rows, comp, bits, percent, best):
        out = materialise(real(rows, comp, bits, percent, best), "test")
        made.append((best, out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "cross_candidates", counted)
    r = random.Random(9)
    texts = near_texts(r, 120, 90, 10) + near_texts(r, 4, 90, 2)      # the first do not link with each other, the others do
    sets = [set(t.split()) for t in texts]
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(make_docs(spark, texts), 1, 80).collect()}
    assert got == brute_components(range(len(texts)), linked(sets, 80))
    assert [best for best, _ in made] == [True, False] and 0 < made[1][1] < 4 * len(texts)
