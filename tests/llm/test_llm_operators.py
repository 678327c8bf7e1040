"""Corpus operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from premia.llm import (
    decontaminate,
    embedding_dedup,
    jaccard_join,
    langid,
    license_scan,
    packing,
    quality,
    suffix_dedup,
    toxicity,
    warc,
)
from premia.llm.common import components, shared_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, key string"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def rng_text(r, n, vocab=400):
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


def make_docs(spark, texts, first=0):
    rows = [(None if t == "NOID" else first + i, t, None if i % 5 == 0 else "en", f"s{i % 2}", len(t or ""), 0.5, 1, "k")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    r = random.Random(5)
    base = rng_text(r, 120, 5000)
    words = base.split()
    near = [" ".join(words[:k] + ["zz"] + words[k + 1:]) for k in (3, 40, 90)]
    shared = rng_text(r, 70, 5000)
    return [None, "", "  \n", "one", "one two", "ONE two", base, base, *near, rng_text(r, 30) + " " + shared + " " + rng_text(r, 9),
            shared, rng_text(r, 200) + "\n" + shared, "NOID", "a " * 300, "a " * 300 + "b", base + " " + base, rng_text(r, 3000, 9000)]


def words_of(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\n", " ").split()


def oracle(sql, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v)
    return con.execute(sql).df()


def same(got, want):
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a = got[cols].sort_values(cols, ignore_index=True)
    b = want[cols].sort_values(cols, ignore_index=True)
    assert len(a) == len(b)
    assert (a.astype(float) == b.astype(float)).all().all()


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (101, 100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_components(spark, k, percent):
    texts = odd_texts()
    r = random.Random(8)
    for _ in range(12):                    # borderline pairs
        w = rng_text(r, 80, 3000).split()
        texts += [" ".join(w)] + [" ".join(w[:i] + ["q"] + w[i + 1:]) for i in r.sample(range(80), 2)] + [" ".join(w[:-9])]
    docs = make_docs(spark, texts)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(docs, k, percent).collect()}
    sets = {}
    for i, t in enumerate(texts):
        if t != "NOID":
            w = words_of(t)
            sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    comp = brute_components(list(sets), lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    assert {i: (len(s), comp[i]) for i, s in sets.items()} == {i: x for i, x in got.items() if i is not None}
    assert got[None][1] is None


def test_jaccard_links_across_size_bands(spark):
    r = random.Random(6)
    texts = []
    for i in range(40):
        w = [f"p{i}w{j}" for j in range(13)]
        texts += [" ".join(r.sample(w, 13)), " ".join(w[:8])]
    got = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(make_docs(spark, texts), 1, 60).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_unrelated_sets_share_no_subtree():
    r = np.random.default_rng(4)
    for n, percent in ((1, 80), (9, 80), (12, 80), (27, 80), (70, 80), (149, 80), (400, 80), (30, 90), (500, 90)):
        keys = [jaccard_join.routing_keys(np.unique(r.integers(0, 1 << 64, n, np.uint64)), percent) for _ in range(3000)]
        _, members = np.unique(np.concatenate(keys), return_counts=True)
        assert len(members) == 0 or members.max() <= 3, (n, percent)


def test_jaccard_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    r = random.Random(2)
    w = rng_text(r, 100, 3000).split()
    texts = [" ".join(w[:i] + [f"x{i}"] + w[i + 1:]) for i in range(0, 100, 3)] + [rng_text(r, 50) for _ in range(9)]
    got = jaccard_join.jaccard_components(make_docs(spark, texts), 3, 90).toPandas()
    sets = [{tuple(t.split()[j:j + 3]) for j in range(len(t.split()) - 2)} for t in texts]
    comp = brute_components(range(len(texts)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]))
    assert dict(zip(got.doc_id, got.component_id)) == comp


def test_jaccard_and_suffix_empty(spark):
    docs = spark.createDataFrame([], EMPTY)
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert suffix_dedup.repeated_spans(docs).count() == 0
    assert suffix_dedup.cut_repeats(docs).count() == 0


def brute_spans(texts, size):
    first, out = {}, {}
    for i, t in sorted(texts.items()):
        w = words_of(t)
        for p in range(len(w) - size + 1):
            g = tuple(w[p:p + size])
            if g in first:
                out.setdefault(i, set()).update(range(p, p + size))
            first.setdefault(g, (i, p))
    spans = set()
    for i, at in out.items():
        at = sorted(at)
        cut = [0] + [j for j in range(1, len(at)) if at[j] != at[j - 1] + 1] + [len(at)]
        spans |= {(i, at[a], at[b - 1] + 1) for a, b in zip(cut, cut[1:])}
    return spans


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeated_spans(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = odd_texts()
    docs = make_docs(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 12"))       # a repeated row is the same document
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert got == brute_spans({i: t for i, t in enumerate(texts) if t not in (None, "NOID")}, 50)


def test_cut_repeats_keeps_clean_text(spark):
    texts = odd_texts()
    got = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(make_docs(spark, texts)).collect()}
    assert got[6] == texts[6] and 7 not in got                      # the first copy stays, the second goes
    assert 12 not in got                                            # wholly inside an earlier document
    assert got[13].split() == texts[13].split()[:200]
    assert got[1] == "" and got[0] is None and got[4] == "one two"


def test_packing_round_trip(spark):
    r = random.Random(1)
    texts = [None, "", " ", "a  b", "NOID", *(rng_text(r, n) for n in (1, 5, 700, 2500)), "é ü \n\n x\t", "<|endoftext|> 's"] * 3
    docs = make_docs(spark, texts)
    got = packing.piece_digests(docs).toPandas()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path())
    for i, t in enumerate(texts):
        if t == "NOID":
            continue
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all() and s.length.sum() <= 2048
    assert packing.pack(spark.createDataFrame([], EMPTY), packing.tokenizer_path()).count() == 0


def test_packing_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(9)
    got = packing.pack(docs, packing.tokenizer_path()).toPandas()
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and fill.sum() / (2048 * len(fill)) > 0.97
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()


@pytest.mark.parametrize("split", ["128m", "3k"])
def test_warc_round_trip(spark, split):
    m = warc.MAGIC
    rows = [(1, "u", m + "Content-Length: 3\r\n\r\nabc\r\n\r\n" + m), (2, None, None), (3, "a\r\nb", ("x" * 3000 + m) * 9),
            (4, "u", "\r\n\r\n" + m + "Content-Length: 0\r\n\r\n\r\n\r\n"), (5, "u", "é" * 9), (5, "u", "é" * 9), (6, "u", "é" * 9),
            (7, "u", ""), (None, "u", "é" * 9)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = shared_path(spark, "test-warc")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        warc.write_archives(pages.coalesce(2), path)
        got = warc.resolve(warc.read_archives(spark, path)).toPandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    key = lambda x: (x is None, x or 0)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = max(j for j, _, g in rows if j is not None and (g or "") == (h or ""))
        kind = "response" if i is None or i == top else "revisit"
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else top))
    have = [tuple(None if pd.isna(x) else x for x in r) for r in got[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]].itertuples(index=False)]
    assert sorted(have, key=lambda r: key(r[0])) == sorted(want, key=lambda r: key(r[0]))
    sql = oracle(warc.ORACLE_SQL, pages=pd.DataFrame({"page_id": pd.array([r[0] for r in rows], "Int64"), "html": [r[2] for r in rows]}))
    stated = [tuple(None if pd.isna(x) else x for x in r) for r in sql.itertuples(index=False)]
    assert sorted(stated, key=lambda r: key(r[0])) == sorted(want, key=lambda r: key(r[0]))


def test_warc_min_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    path = shared_path(spark, "test-warc")
    warc.write_archives(pages, path, min_bytes=3)
    assert {r.record_type for r in warc.read_archives(spark, path).collect()} == {"response"}


def test_decontamination_brute_force(spark):
    r = random.Random(4)
    items = [rng_text(r, n, 3000) + ". " + rng_text(r, 6, 3000) + "." for n in (10, 20, 45, 60)] + ["short one"]
    table = [(i, t, 0.0) for i, t in enumerate(items)] + [(9, None, 0.0), (None, "x y z", 0.0), (10, "", 0.0)]
    bench = spark.createDataFrame(table, "item_id long, text string, score double")
    cut = items[2].split()
    texts = [rng_text(r, 300, 3000) + " " + items[0].upper() + " " + rng_text(r, 30, 3000), rng_text(r, 500, 3000), None, "", "NOID",
             items[1], " ".join(cut[:-3]), " ".join(cut[:20]), rng_text(r, 117, 3000) + " " + items[3] + " tail", "a short one b", items[4]]
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(make_docs(spark, texts), bench).collect()}
    assert got == {(0, 0), (5, 1), (6, 2), (8, 3), (9, 4), (10, 4)}
    assert decontaminate.contaminated(spark.createDataFrame([], EMPTY), bench).count() == 0
    assert decontaminate.contaminated(make_docs(spark, texts), bench.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(make_docs(spark, texts), bench).collect()
    assert len(kept) == len(texts) - 6


def brute_contained(texts, items):
    """(text, item) pairs where one passage holds 0.8 of the item's question and answer shingles."""
    plain = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    top = {}
    for x in items:
        n = max(1, len(plain(x)))
        top[(n - 1).bit_length()] = max(top.get((n - 1).bit_length(), 0), n)
    out = set()
    for j, item in enumerate(items):
        parts = [plain(x) for x in decontaminate.split_item(item)]
        sets = [{tuple(p[i:i + min(5, len(p))]) for i in range(len(p) - min(5, len(p)) + 1)} for p in parts if p]
        cell = top[(max(1, len(plain(item))) - 1).bit_length()]
        for i, t in enumerate(texts):
            w = plain(t)
            for lo in range(0, len(w), cell):
                part = w[lo:lo + 2 * cell]
                held = sum(any(tuple(part[k:k + len(s)]) == s for k in range(len(part))) for one in sets for s in one)
                if held >= 0.8 * sum(map(len, sets)):
                    out.add((i, j))
    return out


def test_decontamination_without_answers(spark):
    """Whole questions quoted without their rare answers, and other parts of items, as by computed shingle containment."""
    r = random.Random(21)
    items = [rng_text(r, 40, 60) + ". " + " ".join(f"rare{i}x{j}" for j in range(5)) + "." for i in range(40)]
    items += [rng_text(r, r.randrange(5, 70), 60) + "? " + rng_text(r, r.randrange(1, 9), 900) + "." for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [rng_text(r, 20, 60) + " " + x.split(".")[0] + " " + rng_text(r, 25, 60) for x in items[:40]]
    for x in items:
        w = x.split()
        lo, n = r.randrange(len(w)), int(len(w) * r.uniform(0.75, 1.0))
        texts += [" ".join(w[:n]), " ".join(w[len(w) - n:]), " ".join(w[:lo] + ["zz"] + w[lo + 1:]), rng_text(r, 80, 60)]
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(make_docs(spark, texts), bench).collect()}
    want = brute_contained(texts, items)
    assert got == want and {(i, i) for i in range(40)} <= want


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()))
    got = langid.identify(docs, model).where(langid.held_out()).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd = langid.identify(make_docs(spark, [None, "", "123 !!", "NOID"]), model).toPandas()
    assert odd.lang_pred.tolist()[:3] == ["und"] * 3 and odd.score.tolist()[:3] == [0, 0, 0] and len(odd) == 4
    odd = langid.identify(make_docs(spark, ["²½", "Ⅷ ①②", "١٢", "½ a"]), model).toPandas()
    assert odd.lang_pred.tolist()[:3] == ["und"] * 3 and odd.lang_pred[3] != "und"
    assert langid.learn(docs.limit(0)) == {}
    assert langid.identify(make_docs(spark, []), model).count() == 0
    assert langid.identify(make_docs(spark, ["word"]), {}).first().lang_pred == "und"


def test_out_of_place_distance_by_hand():
    langs, grams, ranks = langid.compile_profiles({"x": [5, 7], "y": [7]})
    assert langs == ["x", "y"] and grams.tolist() == [5, 7] and ranks.tolist() == [[0, -1], [1, 0]]


def test_toxicity(spark):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        w = [f"{a}{b}" for a, b in zip(r.choices("klmnprt", k=60), r.choices(["ab", "eko", "uri"], k=60))]
        if bad:
            w[20] = r.choice(["vilo", "V1lo", "víl0", "vіlo"])
        elif i % 10 == 1:
            w[30:32] = ["vilo", "flower"]
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    docs = make_docs(spark, texts + [None, "", "NOID"])
    model = toxicity.learn(docs, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).select("doc_id", "score", "predicted").toPandas()
    assert len(got) == 303 and got.score.between(0, 1).all()
    truth = dict(labels)
    told = got[got.doc_id.isin(truth)]
    assert (told.doc_id.map(truth) == told.predicted).mean() > 0.98
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).agg({"score": "max"}).first()[0] == 0


def test_fold():
    assert toxicity.fold("Ѕtup1d! c@fé 2024 (x)") == " stupid cafe x "


def test_quality_grades(spark):
    r = random.Random(6)
    rows = [("a" * 5 + "!" * g * 4 + " ".join(r.choices(["kk", "ll", "mm"], k=20)) + "!" * g * 9, float(g)) for g in [0, 1, 2, 3] * 60]
    model = quality.fit(spark.createDataFrame(rows, "text string, rating double"), steps=60)
    assert model["grades"] == [0, 1, 2, 3] and (np.diff(model["t"]) >= 0).all()
    docs = spark.createDataFrame([(i, t, 0.0) for i, (t, _) in enumerate(rows)] + [(None, None, 0.0)], "doc_id long, text string, expected_grade double")
    got = quality.predict(docs, model, tail=2).toPandas()
    truth = np.array([g for _, g in rows])
    assert np.corrcoef(got.expected_grade[:-1], truth)[0, 1] > 0.9 and got.tail_probability.between(0, 1 + 1e-9).all()
    one = quality.fit(spark.createDataFrame([("x", 2.0)], "text string, rating double"))
    assert quality.predict(docs, one, tail=1).first().expected_grade == 2
    assert quality.fit(spark.createDataFrame([], "text string, rating double"))["grades"] == [0.0]


def test_quality_gradient_numerically():
    g = np.random.default_rng(0)
    x, y = g.standard_normal((40, 5)), g.integers(0, 4, 40)
    w, t = g.standard_normal(5) * 0.1, np.array([-1.0, 0.2, 1.1])
    _, gw, gt = quality.gradient(w, t, x, y)
    for v, grad in ((w, gw), (t, gt)):
        for i in range(len(v)):
            v[i] += 1e-6
            up = quality.gradient(w, t, x, y)[0]
            v[i] -= 2e-6
            down = quality.gradient(w, t, x, y)[0]
            v[i] += 1e-6
            assert abs((up - down) / 2e-6 - grad[i]) < 1e-3


def test_patience_alignment():
    assert license_scan.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    a, b = list("abcxdef"), list("abcydeZf")
    assert [a[i] for i, _ in license_scan.align(a, b)] == list("abcdef")
    assert all(a[i] == b[j] for i, j in license_scan.align(a, b)) and license_scan.align([], b) == []


def plain(template):
    return template.replace("«", "").replace("»", "")


def test_license_scan(spark):
    t = {k: plain(v) for k, v in license_scan.TEMPLATES.items()}
    texts = [None, "", "NOID", "word " * 50 + t["Apache-2.0"] + " word", t["MIT"].upper(), t["GPL-3.0"].replace("work", "thing"),
             "licensed word under word the word license", t["CC-BY-NC-4.0"] + "\n" + t["MIT"], rng_text(random.Random(1), 400)]
    got = {(r.doc_id, r.license) for r in license_scan.scan(make_docs(spark, texts)).collect()}
    assert got == {(3, "Apache-2.0"), (4, "MIT"), (5, "GPL-3.0"), (7, "CC-BY-NC-4.0"), (7, "MIT")}
    assert license_scan.scan(spark.createDataFrame([], EMPTY)).count() == 0


def found_in(text, templates=None):
    table = [license_scan.Template(*x) for x in templates or license_scan.built_in()]
    return license_scan.notices(license_scan.words_of(text), table)


def test_every_template_is_named():
    r = random.Random(6)
    for name, text in license_scan.built_in():
        w = plain(text).split()
        for body in (w, [x for k, x in enumerate(w) if len(w) < 60 or k % 12 or "«" in text]):
            got = found_in(rng_text(r, 300) + " " + " ".join(body) + " " + rng_text(r, 300))
            assert [x[0] for x in got] == [name], (name, got)


@pytest.mark.parametrize("text,want", [
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]), ("Licensed under CC BY 2.0.", ["CC-BY-2.0"]),
    ("Licensed under CC BY-XY 4.0.", []), ("Licensed under CC BY 7.0.", []), ("Licensed under the Apache License, Version 1.1.", []),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", []),
    ("This work is licensed under the GNU General Public License, version 1.", [])])
def test_no_license_for_another(text, want):
    assert [x[0] for x in found_in(text)] == want


def test_license_with_passages_inside_and_many():
    r = random.Random(7)
    mit = plain(dict(license_scan.TEXTS[::-1])["MIT"])
    w = mit.split()
    names = " ".join(f"Name{k} Surname{k}" for k in range(3000))
    got = found_in(rng_text(r, 100) + " " + " ".join(w[:60]) + " " + names + " " + " ".join(w[60:]))
    assert [(x[0], x[1]) for x in got] == [("MIT", 1.0)] and got[0][3] - got[0][2] > 6000
    # Half a licence isn't one; its first sentence is a template of its own.
    assert [x[0] for x in found_in(" ".join(w[:80]))] == ["MIT-text"]
    assert [x[0] for x in found_in((mit + " " + rng_text(r, 5) + " ") * 50)] == ["MIT"] * 50
    line = plain(license_scan.TEMPLATES["Apache-2.0"])
    assert len(found_in((line + " ") * 8000)) == 8000


def test_license_spans_that_overlap():
    r = random.Random(8)
    rows = [("abc"[r.randrange(3)], r.randrange(80, 101) / 100, s, s + r.randrange(1, 20), r.randrange(1, 30))
            for s in (r.randrange(400) for _ in range(300))]
    best = []
    for x in sorted(rows, key=lambda x: (-x[4], -x[1], x[2], x[0])):
        if all(x[3] <= y[2] or y[3] <= x[2] for y in best):
            best.append(x)
    assert license_scan.apart(rows) == [x[:4] for x in sorted(best, key=lambda x: x[2:])]


def test_license_template_table(spark, monkeypatch):
    docs = make_docs(spark, ["some words of a house licence here", None, ""])
    table = spark.createDataFrame([("House", "words of a «house licence»", 1), ("None", None, 1), (None, "some words", 1), ("Void", "", 1)],
                                  "license string, text string, doc_id long")
    got = license_scan.scan(docs, table).collect()
    assert [tuple(r) for r in got] == [(0, "House", 1.0, 1, 6)]
    assert license_scan.scan(docs, table.limit(0)).count() == 0
    monkeypatch.setattr(license_scan, "TABLE_BYTES", 3)
    with pytest.raises(ValueError, match="templates"):
        license_scan.scan(docs, table)


def test_embedding_components(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 8)
    g = np.random.default_rng(7)
    base = g.standard_normal((40, 16))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[0] + g.standard_normal(16) * 0.05], 0) for i in range(30)]
    rows += [(200, rows[5][1], 2), (201, rows[5][1], 2), (201, rows[5][1], 2), (202, rows[5][1], 1), (203, [2 * x for x in rows[5][1]], 2)]
    odd = [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None] * 16, 1),
           (305, rows[0][1], None), (306, [1.0] * 4, 0), (307, [float("inf")] * 16, 1), (None, rows[0][1], 0)]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, label int, id int")
    got = embedding_dedup.near_duplicates(table).toPandas()
    assert len(got) == len(rows) + len(odd)
    by = {i: (np.array(v), c) for i, v, c in rows}
    cos = lambda a, b: by[a][1] == by[b][1] and by[a][0] @ by[b][0] / np.sqrt(by[a][0] @ by[a][0] * (by[b][0] @ by[b][0])) >= 0.98
    comp = brute_components(list(by), cos)
    for r in got.itertuples():
        if pd.isna(r.vec_id) or r.vec_id >= 300:
            assert r.n_links == 0 and r.kept
            continue
        want = sum(cos(int(r.vec_id), j) for j in by if j != r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == (want, comp[int(r.vec_id)], comp[int(r.vec_id)] == r.vec_id)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("module,query", [(jaccard_join, "op3_jaccard_join"), (suffix_dedup, "op2_suffix_dedup"),
                                          (embedding_dedup, "op9_embedding_dedup")])
def test_oracles(spark, module, query):
    want = oracle(module.ORACLE_SQL, **{t: pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "embeddings")})
    same(getattr(module, query)(spark, SF).toPandas(), want)


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert 0.8 < out.doc_id.nunique() / docs.count() <= 1
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    assert set(out.doc_id) == {r.doc_id for r in kept.select("doc_id").collect()}


def test_fold_wide_and_long():
    assert toxicity.fold("ﬁne МАТ й́ 한 ї") == " fine mat i "
    once = toxicity.fold("A1b c|d _3x é")
    assert toxicity.fold(once) == once
    long = "x" * 200_000                       # no quadratic search for signs
    assert toxicity.fold(long) == f" {long} "


def test_spared_matches_against_all_pairs():
    auto = toxicity.automaton({"weights": {"ab": 1.5, "b": 2.0, "i": 1.75}, "phrases": ["ab b", "i ab", "b i"]})
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice(["ab", "b", "i", "x"]) for _ in range(rng.randint(0, 25))]
        pairs = {"ab b", "i ab", "b i"}
        inside = [any(0 <= j < len(words) - 1 and f"{words[j]} {words[j + 1]}" in pairs for j in (i - 1, i))
                  for i in range(len(words))]
        left = [{"ab": 1.5, "b": 2.0, "i": 1.75}[w] for w, s in zip(words, inside, strict=True) if w != "x" and not s]
        assert toxicity.matches(" ".join(words), auto)[:3] == (sum(left), max(left, default=0.0), len(left))


def test_links_of_saturated_lists(spark, monkeypatch):
    """Two dense groups that link across: every list is full of links to its own side."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "WIDE", 50)
    g = np.random.default_rng(3)
    a = np.zeros((240, 32))
    a[:, 0], a[120:, 1] = 1, np.tan(0.17)           # the sides' centres are at a cosine of 0.9856
    a += g.standard_normal(a.shape) * 0.002
    far = g.standard_normal((60, 32))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([*a, *far])]
    lists = []
    for i in range(240):
        own = [j for j in range(240) if j // 120 == i // 120 and j != i][:10]
        lists += [(i, j, 1.0) for j in own]
    members, table = embedding_dedup.nodes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    lists = spark.createDataFrame(lists, "a long, b long, sim double")
    comp = spark.createDataFrame([(i, i // 120 * 120) for i in range(240)], "id long, component long")
    more = embedding_dedup.enlarge(lists, comp, table, 0.98, 10).collect()
    assert {r.a for r in more} == set(range(240)) and all(r.a // 120 != r.b // 120 for r in more)
    assert embedding_dedup.enlarge(lists.where("a % 120 <> b % 120 + 1").limit(9), comp, table, 0.98, 10) is None


def test_two_dense_groups_are_one_component(spark):
    g = np.random.default_rng(3)
    a = np.zeros((600, 32))
    a[:, 0], a[300:, 1] = 1, np.tan(0.17)
    a += g.standard_normal(a.shape) * 0.002
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(a)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    u = a / np.linalg.norm(a, axis=1)[:, None]
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    got = got.sort_values("vec_id")
    assert (got.component_id == 0).all() and (got.n_links.to_numpy() == want).all() and want.min() > 300


def warc_entries_then(monkeypatch, act):
    """``warc.entries`` followed by ``act(session of the scan)``: something that happens between the two passes."""
    entries = warc.entries

    def wrapped(lines):
        out = entries(lines)
        rows = out.collect()
        act(lines.sparkSession)
        return lines.sparkSession.createDataFrame(rows, out.schema)

    monkeypatch.setattr(warc, "entries", wrapped)


def warc_pages(spark):
    path = shared_path(spark, "test-warc")
    pages = spark.createDataFrame([(i, "u", f"{i} " * 900) for i in range(40)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), path)
    return path


def test_warc_parallelism_changes_between_passes(spark, monkeypatch):
    path = warc_pages(spark)
    monkeypatch.setattr(warc, "_lines", lambda s, p, f=warc._lines: (s.conf.set("spark.sql.files.openCostInBytes", "1k"), f(s, p))[1])
    key = "spark.sql.leafNodeDefaultParallelism"
    warc_entries_then(monkeypatch, lambda s: s.conf.set(key, "37"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        got = warc.read_archives(spark, path).collect()
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(i, f"{i} " * 900) for i in range(40)]


def test_warc_unknown_range_is_an_error(spark, monkeypatch):
    path = warc_pages(spark)
    key = "spark.sql.files.maxPartitionBytes"
    warc_entries_then(monkeypatch, lambda s: s.conf.set(key, "7k"))
    old = spark.conf.get(key)
    try:
        with pytest.raises(Exception, match="did not see"):
            warc.read_archives(spark, path).collect()
    finally:
        spark.conf.set(key, old)


def test_embedding_audit_and_exact_search(spark, monkeypatch):
    """A large group found whole does not hide missed pairs; if every try fails, labels are compared exactly."""
    g = np.random.default_rng(5)
    u = g.standard_normal((500, 24))
    u[:200] = u[0] + g.standard_normal((200, 24)) * 0.02
    u[301:500:2] = u[300:499:2] + g.standard_normal((100, 24)) * 0.02
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(u)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    _, table = embedding_dedup.nodes(vectors)
    comp = spark.createDataFrame([(i, 0) for i in range(200)], "id long, component long")
    assert embedding_dedup.audit(table, comp, 0.98, 500) < 0.1
    linked = g.random((30, 40)) < 0.03
    a, b = embedding_dedup._forest(linked)
    both = [(i, 100 + j) for i, j in zip(*np.nonzero(linked), strict=True)]
    ids = sorted({x for e in both for x in e})
    assert linked[a, b].all()
    assert brute_components(ids, lambda x, y: (x, y) in both or (y, x) in both) == brute_components(
        ids, lambda x, y: (x, y - 100) in set(zip(a, b, strict=True)) or (y, x - 100) in set(zip(a, b, strict=True)))
    assert embedding_dedup.code_count(5_000, 0.98) < embedding_dedup.code_count(10_000_000, 0.98)
    monkeypatch.setattr(embedding_dedup, "TRIES", 0)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    got = embedding_dedup.near_duplicates(vectors).toPandas().sort_values("vec_id")
    m = u / np.linalg.norm(u, axis=1)[:, None]
    near = m @ m.T >= 0.98
    assert (got.n_links.to_numpy() == near.sum(axis=1) - 1).all()
    assert dict(zip(got.vec_id, got.component_id, strict=True)) == brute_components(range(500), lambda x, y: near[x, y])


def test_quality_of_words_of_one_shape(spark, monkeypatch):
    """Texts of equal word lengths and signs, in Latin and other letters: only their words tell the grade."""
    r = random.Random(8)
    good, bad = ["море", "дом", "table", "river"], ["мммм", "ддд", "xxxxx", "qzqzq"]
    rows = []
    for i in range(160):
        shape = [r.randrange(4) for _ in range(30)]
        rows += [(" ".join([bad, good][g][k] for k in shape) + ".", float(g)) for g in (0, 1)]
    model = quality.fit(spark.createDataFrame(rows[:240], "text string, rating double"))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = quality.predict(docs, model, tail=1).toPandas().sort_values("doc_id").tail_probability[240:]
    assert got[1::2].min() > 0.5 > got[::2].max()
    text = "".join(r.choices("abcdé ж.", k=1000))
    whole = quality._chars(text)
    monkeypatch.setattr(quality, "PIECE", 7)
    assert (quality._chars(text) == whole).all() and whole.sum() == 999 + 997
