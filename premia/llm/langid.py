"""Operator 10: language identification by rank-order profiles of character n-grams.

A language's profile is the list of its most frequent character n-grams (n = 1..3,
words padded by a space), in order of frequency. A document's own list is compared
to each profile by the out-of-place distance: the sum over the document's n-grams
of the difference of ranks, or ``profile_size`` for an n-gram the profile lacks.
The nearest profile wins; ties go to the first language by name.

Documents with null text or no letter get ``und`` with score 0. A null language
is never learned. With nothing to learn from, every document is ``und``. Rows are
kept one to one, repeated rows and null ids included; other columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILE_SIZE = 400        # n-grams in a language's profile and in a document's list
SAMPLE_PER_LANG = 3000    # expected number of training documents per language
MAX_LANGS = 1000          # largest number of learned languages (profiles go to every task)
_BITS = 21                # of a code point
# Letters and other numerals make words; a text without a letter has none.
_NOT_LETTER = re.compile(r"[\W\d_]+")


def _grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a lower-cased text; empty without letters."""
    words = _NOT_LETTER.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):
        return np.zeros(0, np.uint64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    two = (c[:-1] << np.uint64(_BITS)) | c[1:]
    three = (two[:-1] << np.uint64(_BITS)) | c[2:]
    return np.concatenate([c[c != 32], two, three])


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_grams(text), return_counts=True)


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in rank order; ties by code."""
    if len(grams) > size:
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= cut
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


def learn(train: DataFrame, profile_size: int = PROFILE_SIZE, per_lang: int = SAMPLE_PER_LANG) -> dict[str, list[int]]:
    """Profiles from ``train(doc_id, text, lang)``.

    The sample is bounded: of each language, documents are taken by the hash of
    their id with probability ``per_lang`` over the language's count. Whole texts
    count. Only the profiles themselves (languages x profile_size) reach the driver.
    """
    train = train.select("doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null")
    sizes = train.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    if not sizes:
        return {}
    # One literal per language, so that no text is shuffled to take the sample.
    of = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], r["count"])])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = train.where(unit * of[F.col("lang")] < F.lit(per_lang << 30)).select("lang", "text")

    def count(batches):
        total: dict = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                g, c = _counts(text)
                into = total.setdefault(lang, {})
                for x, n in zip(g.tolist(), c.tolist(), strict=True):
                    into[x] = into.get(x, 0) + n
        for lang, into in total.items():
            yield pd.DataFrame({"lang": lang, "gram": list(into.keys()), "n": list(into.values())})

    grams = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    # The global list needs no row beyond a slice's own top list, so no window sees a whole language.
    from pyspark.sql import Window
    part = Window.partitionBy("lang", F.pmod("gram", F.lit(64))).orderBy(F.desc("n"), "gram")
    whole = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rank = F.row_number()
    top = grams.withColumn("r", rank.over(part)).where(F.col("r") <= profile_size)
    top = top.withColumn("r", rank.over(whole)).where(F.col("r") <= profile_size)
    rows = top.select("lang", "gram", "r").collect()  # languages x profile_size at most
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["r"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def distances(text: str, langs: list[str], grams: np.ndarray, ranks: np.ndarray, size: int) -> np.ndarray | None:
    """Out-of-place distance to each language, as a share of the largest possible; None without letters."""
    g, c = _counts(text)
    if not len(g):
        return None
    own = _top(g, c, size)
    at = np.minimum(np.searchsorted(grams, own), max(0, len(grams) - 1))
    known = grams[at] == own if len(grams) else np.zeros(len(own), bool)
    place = np.arange(len(own))[:, None]
    r = np.where(known[:, None], ranks[at] if len(grams) else 0, -1)
    d = np.where(r >= 0, np.minimum(np.abs(r - place), size), size)
    return d.sum(axis=0) / (size * len(own))


def compile_profiles(profiles: dict[str, list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, all their n-grams sorted, and each n-gram's rank per language (-1: not in it)."""
    langs = sorted(profiles)
    grams = np.unique(np.array([g for x in langs for g in profiles[x]], np.uint64))
    ranks = np.full((len(grams), len(langs)), -1, np.int64)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(grams, np.array(profiles[lang], np.uint64)), j] = np.arange(len(profiles[lang]))
    return langs, grams, ranks


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE_SIZE) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (1 less the share of the largest distance).

    Columns of ``docs`` named so are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    packed = json.dumps(profiles)

    def predict(batches):
        model = compile_profiles(json.loads(packed))
        for b in batches:
            pred, score = [], []
            for text in b.column("text").to_pylist():
                d = distances(text, *model, size) if text and model[0] else None
                j = None if d is None else int(np.argmin(d))
                pred.append("und" if d is None else model[0][j])
                score.append(0.0 if d is None else float(1 - d[j]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def held_out(col: str = "doc_id"):
    """The rows that are never learned from: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
