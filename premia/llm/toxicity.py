"""Operator 7: toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Folding: lower case, compatibility and accent folding, homoglyphs of other scripts and
digits or signs inside words replaced by the Latin letters they look like; whatever is
no letter then separates words.

Lexicon: words of labelled training texts whose smoothed log odds between toxic and
clean documents reach ``MIN_WEIGHT``, in at least ``MIN_DOCS`` toxic documents. Exception
phrases: two-word phrases around a lexicon word that are about as common in clean
documents; a match inside one does not count. All of both are kept; the sample bounds them.

Score: the matches' weights relative to the number of words (per ``LENGTH`` words, so
that a long text needs more) and to the strongest single match, through a logistic
curve fitted on the training rows. Without a match the score is the curve's at zero.

The lexicon is learned from at most about ``SAMPLE`` labelled rows (those of smallest
id hash); texts are scored whole.

Cases: null and empty texts have no match; a null id keeps its row and is held out;
repeated rows keep theirs; several labels of an id all count; without labels of both
kinds every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import materialise

SAMPLE = 20_000
MIN_DOCS, MIN_WEIGHT = 5, 1.5
LENGTH = 200
# Look-alikes of Latin letters (fixed values): Cyrillic, Greek, then digits and signs inside words.
_GLYPHS = dict(zip("аеорсухівкмнтьјѕԁɡոαβεικνορτυχ", "aeopcyxibkmhtbjsdgnabeiknoptux", strict=True))
_SIGNS = dict(zip("013457@$!|", "oieastasil", strict=True))
# Tried at the start of a run of letters and digits only, so that the time stays linear in the run's length.
_SIGNED = re.compile(r"(?<![^\W_])[^\W_]*[013457@$!|]+[^\s]*")
_WIDE = re.compile(r"[^\x00-\x7f]+")
_PLAIN = re.compile(r"[^a-z]+")


class _Folded(dict):
    """Code point -> its compatibility letters without accents, look-alikes replaced; filled as characters appear."""

    def __missing__(self, code: int) -> str:
        plain = (c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        self[code] = "".join(_GLYPHS.get(c, c) for c in plain)
        return self[code]


_FOLDED = _Folded()


def fold(text: str) -> str:
    """Words of folded Latin letters, each between single spaces."""
    t = text.lower()
    if not t.isascii():
        t = _WIDE.sub(lambda m: m.group().translate(_FOLDED), t)

    def letters(m: re.Match) -> str:
        w = m.group().rstrip("!|")
        if sum(c.isalpha() for c in w) < 2:
            return m.group()
        return "".join(_SIGNS.get(c, c) for c in w)

    return f" {_PLAIN.sub(' ', _SIGNED.sub(letters, t)).strip()} "


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _log_odds(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Per-document counts (bad, good) of a term, and its smoothed log odds."""
    rate = lambda c, n: (F.col(c) + 0.5) / F.lit(n + 1.0)
    return counts.withColumn("weight", F.log(rate("bad", toxic) / rate("good", clean)))


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Lexicon, exception phrases and curve from labelled rows that are not held out."""
    given = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    given = given.where(~held_out()).distinct()
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    given = given.where(unit * F.lit(max(1, given.count())) < F.lit(SAMPLE << 30))

    def folded(batches):
        for b in batches:
            text = pa.array([fold(t) for t in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), text], names=["doc_id", "toxic", "text"])

    # Folded once; it stays as it is when folded again.
    rows = given.join(docs.where("text is not null").select("doc_id", "text"), "doc_id").select("doc_id", "toxic", "text")
    rows = materialise(rows.mapInArrow(folded, rows.schema), "toxicity-sample")

    def terms(batches):
        for b in batches:
            out: dict = {}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for w in set(text.split()):
                    c = out.setdefault(w, [0, 0])
                    c[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.keys(), pa.string()), pa.array([c[0] for c in out.values()], pa.int64()),
                 pa.array([c[1] for c in out.values()], pa.int64())], names=["term", "bad", "good"])

    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    model = {"weights": {}, "phrases": [], "curve": [0.0, 0.0, 0.0], "empty": True}
    if not size.get(1) or not size.get(0):
        return model
    total = rows.mapInArrow(terms, "term string, bad long, good long").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    top = _log_odds(total, size[1], size[0]).where((F.col("bad") >= MIN_DOCS) & (F.col("weight") >= MIN_WEIGHT))
    weights = {r["term"]: float(r["weight"]) for r in top.collect()}

    def phrases(batches):
        for b in batches:
            out: dict = {}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                w = text.split()
                seen = {f"{x} {y}" for x, y in zip(w, w[1:], strict=False) if x in weights or y in weights}
                for x in seen:
                    c = out.setdefault(x, [0, 0])
                    c[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.keys(), pa.string()), pa.array([c[0] for c in out.values()], pa.int64()),
                 pa.array([c[1] for c in out.values()], pa.int64())], names=["term", "bad", "good"])

    pairs = rows.mapInArrow(phrases, "term string, bad long, good long").groupBy("term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    harmless = _log_odds(pairs, size[1], size[0]).where((F.col("good") >= 3) & (F.col("weight") <= 0))
    model |= {"weights": weights, "phrases": [r["term"] for r in harmless.select("term").collect()], "empty": False}
    # The curve: two features and a label per sampled row.
    x = measure(rows.select("doc_id", "text", "toxic"), model).select("rate", "peak", "toxic").toPandas()
    model["curve"] = fit_curve(x[["rate", "peak"]].to_numpy(float), x["toxic"].to_numpy(float)).tolist()
    return model


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, classes weighted equally."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)),
                               x.T @ (w * (p - y)) + ridge * b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return b


def automaton(model: dict):
    import ahocorasick
    a = ahocorasick.Automaton()
    for w, x in model["weights"].items():
        a.add_word(f" {w} ", (x, len(w) + 2))
    for p in model["phrases"]:
        a.add_word(f" {p} ", (None, len(p) + 2))
    a.make_automaton()
    return a


def matches(text: str, auto) -> tuple[float, float, int, int]:
    """Sum of weights, largest weight, number of matches and of words of a text; matches inside exceptions don't count."""
    t = fold(text)
    found = list(auto.iter(t)) if len(auto) else []
    spared = sorted((e - n + 1, e) for e, (w, n) in found if w is None)
    starts, ends = [lo for lo, _ in spared], list(accumulate((e for _, e in spared), max))
    hits = []
    for e, (w, n) in found:
        i = 0 if w is None else bisect_right(starts, e - n + 1)      # phrases that start no later
        if w is not None and not (i and e <= ends[i - 1]):
            hits.append(w)
    return sum(hits), max(hits, default=0.0), len(hits), t.count(" ") - 1


def measure(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` plus ``rate`` (weight per LENGTH words), ``peak`` (largest weight) and ``n_matches``."""
    docs = docs.drop("rate", "peak", "n_matches")
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType
    schema = StructType([*docs.schema.fields, StructField("rate", DoubleType()), StructField("peak", DoubleType()),
                         StructField("n_matches", LongType())])
    packed = json.dumps(model)

    def run(batches):
        auto = automaton(json.loads(packed))
        for b in batches:
            got = [matches(t or "", auto) for t in b.column("text").to_pylist()]
            rate = [float(np.log1p(s * LENGTH / max(LENGTH, n))) for s, _, _, n in got]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(rate, pa.float64()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.int64())], names=[*b.schema.names, "rate", "peak", "n_matches"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1), ``predicted``, ``rate``, ``peak`` and ``n_matches``."""
    b0, b1, b2 = model["curve"]
    curve = 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * F.col("rate") + F.lit(b2) * F.col("peak"))))
    s = F.lit(0.0) if model["empty"] else curve
    return measure(docs, model).withColumn("score", s).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
