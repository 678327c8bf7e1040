"""Operators 11 to 13 against brute force and SQL on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from premia.llm import collocations, phrase_automata, prefix_trie

DOCS = "doc_id long, text string, lang string, h long, s string, n long, late string, rank int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2, "y", 3) for i, t, lang in rows], DOCS)


def some_words(r, n, vocab=3000):
    return [f"W{r.randrange(vocab)}" for _ in range(n)]


# ---- 11 -------------------------------------------------------------------------------------------------------------

def brute_remove(rows):
    first = {}
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in texts:
        if d is not None:
            for p in range(len(w) - 19):
                k = tuple(w[p:p + 20])
                first[k] = min(first.get(k, (d, p)), (d, p))
    out = []
    for d, w in texts:
        gone = set()
        if d is not None:
            for p in range(len(w) - 19):
                if (d, p) > first[tuple(w[p:p + 20])]:
                    gone.update(range(p, p + 20))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def passages():
    r = random.Random(3)
    base = some_words(r, 150)
    shared, line = some_words(r, 60), some_words(r, 21)
    join = " ".join
    texts = [None, "", " \n\t", "one", join(base), join(base), join(base).lower(), join(base[:70] + ["X"] + base[70:]),
             join(base[30:90]), "a " * 500, "a " * 500 + "b", join(shared + shared), " ".join(some_words(r, 40)),
             join(some_words(r, 10) + shared + some_words(r, 10)), join(shared[:25]) + "\n\v" + join(shared[26:]),
             join(some_words(r, 5000, 90000) + shared), "é " * 30, join(base[:19]), join(base[:20])]
    texts += [join(some_words(r, 30) + line + some_words(r, 30)) for _ in range(40)]
    texts += [join(line[:12] + some_words(r, 25)) for _ in range(40)]
    return [(i * 3 % 97, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot,patterns", [(phrase_automata.HOT, phrase_automata.PATTERNS), (3, 8)])
def test_repeats_removed_as_by_brute_force(spark, hot, patterns):
    rows = passages()
    rows += [(None, rows[4][1]), rows[7], rows[13], (rows[13][0], "other " * 25), (-5, rows[11][1])]
    got = phrase_automata.remove_repeats(docs_frame(spark, [(d, t, "en") for d, t in rows]), hot, patterns)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_remove(rows)


def test_repeats_of_no_documents(spark):
    assert phrase_automata.remove_repeats(docs_frame(spark, [])).collect() == []


def test_late_documents_lose_what_an_earlier_one_holds(spark):
    """Near copies in a large group: every stretch that is equal to an earlier one goes, in all of them."""
    r = random.Random(11)
    base = some_words(r, 120)
    rows = []
    for i in range(150):
        w = list(base)
        w[r.randrange(120)] = f"Z{i}"
        rows.append((i, " ".join(w)))
    got = phrase_automata.remove_repeats(docs_frame(spark, [(d, t, None) for d, t in rows]), 10, 50)
    assert sorted(map(tuple, got.collect()), key=str) == brute_remove(rows)


# ---- 12 -------------------------------------------------------------------------------------------------------------

def brute_collocations(rows, threshold, top):
    n, f = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i:i + m])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    longer = defaultdict(int)
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i:i + m]] = max(longer[lang, p[i:i + m]], a)
    per = defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * longer[lang, p] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        per[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in per.items()
                  for i, (s, a, p, x, y) in enumerate(sorted(v)[:top]))


def phrase_rows():
    r = random.Random(8)
    idioms = ["New  York\tcity", "kick the bucket", "é à la carte", "in the end", "of the"]
    out = [(None, None), ("en", None), ("en", ""), ("und", ". ,;"), ("fr", "a")]
    for i in range(120):
        words = [r.choice(idioms) if r.random() < 0.2 else f"v{min(int(r.expovariate(0.15)), 60)}" for _ in range(r.randrange(60))]
        out.append((r.choice(["en", "en", "en", "fr", None, "und"]), "".join(w + r.choice([" ", " ", " ", "\t ", ". ", "\n", "!"]) for w in words)))
    return out + [("en", "NEW york CITY " * 4000), ("zz", "hello there friend. " * 31), ("zz", "hello there friend. " * 31)]


@pytest.mark.parametrize("threshold,top,part_chars", [(30, 2000, collocations.PART_CHARS), (5, 7, 2000)])
def test_collocations_equal_brute_force(spark, threshold, top, part_chars):
    rows = phrase_rows()
    frame = docs_frame(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)]).repartition(5)
    got = collocations.collocations(frame, top, threshold, part_chars)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_collocations(rows, threshold, top)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_collocations_sql_agrees_with_brute_force():
    rows = phrase_rows()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(t, lang) for lang, t in rows], columns=["text", "lang"]))
    got = sorted(map(tuple, con.execute(collocations.ORACLE_SQL).fetchall()))
    assert got == brute_collocations(rows, 30, 2000)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_frame(spark, [])).collect() == []
    assert collocations.collocations(docs_frame(spark, [(1, None, None), (2, "", "en"), (3, "a b", "en")])).collect() == []


def test_summary_keeps_every_frequent_key():
    """Merged in any pieces, a summary of more than mass / threshold counters holds all keys of that frequency."""
    r = np.random.default_rng(2)
    keys = np.concatenate([np.repeat(np.arange(40), 30), r.integers(1000, 60_000, 9000)]).astype(np.uint32)
    r.shuffle(keys)
    summary = collocations.MisraGries(len(keys) // 30 + 1)
    for part in np.array_split(keys, 37):
        summary.merge(*np.unique(part, return_counts=True))
        summary.settle()
        assert len(summary.keys) <= summary.capacity
    assert set(range(40)) <= set(summary.at_least(30).tolist()) and summary.lost < 30


# ---- 13 -------------------------------------------------------------------------------------------------------------

CONVS = "conv_id long, turn long, role string, text string, key string, n long, up string, ends int"


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0), n, digest, (role, text)))
    own = {c: [(x[3], x[1]) for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
    members, ends, words = defaultdict(set), defaultdict(set), {(): 0}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            p = tuple(x[0] for x in seq[:d])
            members[p].add(c)
            if d:
                words[p] = seq[d - 1][1]
        ends[tuple(x[0] for x in seq)].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * words[p]
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()), key=str)


def conversation_rows():
    r = random.Random(4)
    rows = []
    for c in list(range(130)) + [-1, -7, -20, -41, 5000]:
        if c in (40, 60):
            continue
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, r.choice(["user", "assistant"]), f"say {r.randrange(2)}"))
    for c in range(200, 260):             # equal conversations
        rows += [(c, 0, "user", "hi there"), (c, 1, "bot", "hello"), (c, 2, "user", "x y z"), (c, 3, "bot", None)]
    for c in range(300, 360):             # one first turn, then many
        rows += [(c, 0, "user", "start"), (c, 1, None, f"then {c}"), (c, None, "sys", " \n"), (c, 2, "", "a\x00b")]
    rows += [(7, 1, "user", "again"), (7, 1, "user", "again"), (None, 0, "user", "lost"), (9, -3, "user", ""), (9, None, None, None)]
    rows += [(400, t, "user", f"long {t % 3}") for t in range(700)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [prefix_trie.LIMIT, 200, 1])
def test_trie_equals_brute_force(spark, limit):
    rows = conversation_rows()
    if limit == 1:
        rows = [x for x in rows if x[0] != 400]      # each shared turn is a round of jobs
    frame = spark.createDataFrame([(*x, "k", 1, "u", 2) for x in rows], CONVS)
    got = prefix_trie.prefix_trie(frame, limit)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_sql_agrees_with_brute_force():
    rows = [x for x in conversation_rows() if x[0] != 400 and (x[3] or "") != "a\x00b"]
    con = duckdb.connect()
    con.register("conversations", pa.table({k: pa.array([x[i] for x in rows], t) for i, (k, t) in enumerate(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])}))
    assert sorted(map(tuple, con.execute(prefix_trie.ORACLE_SQL).fetchall()), key=str) == brute_trie(rows)


def test_trie_of_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVS)).collect() == []
    only = spark.createDataFrame([(None, 0, "user", "x", "k", 1, "u", 2)], CONVS)
    assert prefix_trie.prefix_trie(only).collect() == []


def test_radix_tree_layouts_grow():
    root = None
    keys = [bytes([b]) + b"\0" * 19 for b in range(256)]
    random.Random(1).shuffle(keys)
    seen = set()
    for i, k in enumerate(keys):
        root = prefix_trie.insert(root, k, (1, i, "e"))
        seen.add(root.layout)
    assert seen == {4, 16, 48, 256} and len(root.children()) == 256
    assert all(root.child(k[0]).entry[1] == i and root.child(k[0]).path == k[1:] for i, k in enumerate(keys))
