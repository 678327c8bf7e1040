"""Pipeline: repeated ids, tables removed after use; every corpus query on empty tables; ties and very long texts."""

import os
import random

import pytest

import corpus_pipeline
from premia.llm import decontaminate, jaccard_join, langid, license_scan
from premia.llm.common import shared_path
from premia.llm.queries import registry
from test_llm_operators import DOCS, SF, make_docs, plain, rng_text

TABLES = ["documents", "labels", "pages", "benchmark", "embeddings", "conversations"]


def test_ids_with_several_texts_lose_none(spark):
    r = random.Random(3)
    a, b, c, d = (rng_text(r, 120, 5000) for _ in range(4))
    near = a.replace(a.split()[60], "zz")
    rows = [(7, a), (7, a), (7, b), (7, c), (3, near), (9, d), (None, a), (None, a), (4, ""), (4, None), (11, d)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1, 0.5, 1, "k") for k, (i, t) in enumerate(rows)], DOCS)
    want = [(x.doc_id, x.text) for x in corpus_pipeline.one_text_per_id(docs).collect()]
    texts = sorted([a, b, c])
    # numbers in order of id and text: 4 null, 4 empty, 7 the three texts; 11 is the largest id
    expect = [(4, None), (13, ""), (7, texts[0]), (11 + 4, texts[1]), (11 + 5, texts[2]), (3, near), (9, d), (11, d), (None, a), (None, a)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(want, key=key) == sorted(expect, key=key)
    for parts in (1, 5):        # the same rows however they are dealt
        out = corpus_pipeline.join_near_duplicates(spark, docs.repartition(parts), SF)
        assert out.columns == docs.columns
        got = sorted([(x.doc_id, x.text) for x in out.collect()], key=key)
        gone = {next(x for x in expect if x[1] == a), (11, d)}      # the copy of document 3, the copy of 9
        assert got == sorted([x for x in expect if x not in gone], key=key)
    assert corpus_pipeline.one_text_per_id(docs.where("doc_id in (3, 9, 11)")).count() == 3


def test_rows_that_link_with_nothing_in_the_join(spark):
    text = rng_text(random.Random(4), 40)
    rows = [(1, text), (None, text), (2, text), (3, ""), (4, None), (None, ""), (5, "  ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 1, "k") for i, t in rows], DOCS)
    got = jaccard_join.jaccard_components(docs, 5, 80).collect()
    n = len(set(zip(*[text.split()[k:] for k in range(5)])))
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, n, 1), (None, n, None), (2, n, 1), (3, 0, 3), (4, 0, 4), (None, 0, None), (5, 0, 5)], key=str)


def test_run_leaves_only_its_result(spark):
    folder = os.path.dirname(shared_path(spark, "x")).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, SF)
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and next(iter(new)).startswith("pipeline-packing") and out.count() > 0


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none"))
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


@pytest.mark.parametrize("query", sorted(registry()))
def test_empty_tables(spark, no_rows, query):
    assert registry()[query][0](spark, no_rows).collect() == []


def test_very_long_texts_and_ties(spark):
    r = random.Random(8)
    bench = spark.createDataFrame([(i, rng_text(r, 25, 3000) + "? " + rng_text(r, 6, 3000) + ".") for i in range(30)],
                                  "item_id long, text string")
    items = {x.item_id: x.text for x in bench.collect()}
    filler = " ".join(f"v{r.randrange(50_000)}" for _ in range(150_000))
    long = filler + "\n" + items[4] + " " + filler + " " + items[11]
    docs = make_docs(spark, [long, long, items[4] + " " + items[4], filler])
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench.union(bench)).collect()}
    assert got == {(0, 4), (0, 11), (1, 4), (1, 11), (2, 4)}
    first = next(x for x in decontaminate.contaminated(docs, bench).collect() if (x.doc_id, x.item_id) == (2, 4))
    assert first.start_word == 0        # of two equal passages the first

    notice = plain(license_scan.TEMPLATES["MIT"])
    found = license_scan.scan(make_docs(spark, [f"{filler} {notice} {filler} {notice}", filler, notice, notice])).collect()
    assert sorted((x.doc_id, x.license) for x in found) == [(0, "MIT"), (0, "MIT"), (2, "MIT"), (3, "MIT")]

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()))
    text = docs.where("lang = 'de' and n_chars > 500").orderBy("doc_id").first().text
    got = langid.identify(make_docs(spark, [text, text, (text + "\n") * (2_000_000 // len(text))]), model).collect()
    assert [x.lang_pred for x in got] == ["de"] * 3 and got[0].score == got[1].score
