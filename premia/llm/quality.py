"""Operator 1: quality by ordinal cumulative-link regression on hashed text.

A text's features are its characters' 2- and 4-grams (lower case), hashed into ``CHARS``
places, and the 1- to 3-grams of its characters' shape (letters by case, digits, white
space and each sign apart), hashed into ``SHAPES`` places; each kind counts half, as
square roots of relative frequencies. The model has one weight vector
for all grades and ordered thresholds: P(grade <= k) = logistic(t_k - w.x). It gives the
expected grade and the tail probability P(grade >= ``tail``) for selection.

It is fitted by gradient steps on at most about ``SAMPLE`` rated rows (those of smallest id
hash): each step sums the gradient over the sample's partitions in Spark. Rows whose
crc32(doc_id) mod 5 is 0 are held out. Texts count whole.

Cases: null and empty texts have no features, so thresholds alone decide; null ids and
ratings are not learned from; several ratings of an id all count; rows are kept one to
one; fewer than two grades give that grade (0 without any) and tail 0 or 1.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import materialise

SHAPES = 1 << 11
CHARS = 1 << 12
DIMS = SHAPES + CHARS
GRAMS = (2, 4)
PIECE = 1 << 20
SAMPLE = 12_000
STEPS = 30
RIDGE = 1e-4


def _codes() -> np.ndarray:
    """Class of a byte: lower, upper, digit, white space, non-ASCII, or the sign itself."""
    out = np.arange(256, dtype=np.int64)
    out[128:] = 4
    for c in range(128):
        ch = chr(c)
        out[c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch.isspace() else c
    return out


_CLASS = _codes()


def _shapes(raw: np.ndarray) -> np.ndarray:
    total = np.zeros(SHAPES)
    for i in range(0, len(raw), PIECE):
        part = raw[max(0, i - 2):i + PIECE]
        c = _CLASS[part]
        codes = [c + 1]
        if len(c) > 1:
            codes.append((c[:-1] * 131 + c[1:]) * 7 + 2)
        if len(c) > 2:
            codes.append(((c[:-2] * 131 + c[1:-1]) * 131 + c[2:]) * 7 + 3)
        for x in codes:
            total += np.bincount((x * 0x9E3779B1 >> 7) % SHAPES, minlength=SHAPES)
    return total


def _chars(text: str) -> np.ndarray:
    total = np.zeros(CHARS)
    back = max(GRAMS) - 1
    for i in range(0, len(text), PIECE):
        before = min(i, back)
        c = np.frombuffer(text[i - before:i + PIECE].encode("utf-32-le"), np.uint32).astype(np.uint64)
        for n in GRAMS:
            part = c[max(0, before - n + 1):]
            if len(part) < n:
                continue
            h = np.full(len(part) - n + 1, n, np.uint64)
            for j in range(n):
                h *= np.uint64(0x100000001B3)
                h += part[j:len(part) - n + 1 + j]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h >>= np.uint64(64 - CHARS.bit_length() + 1)
            total += np.bincount(h.view(np.int64), minlength=CHARS)
    return total


def features(text: str | None) -> np.ndarray:
    """Dense vector of a whole text, counted piece by piece."""
    text = text or ""
    parts = [_shapes(np.frombuffer(text.encode(), np.uint8)), _chars(text.lower())]
    return np.concatenate([np.sqrt(x / (2 * n)) if (n := x.sum()) else x for x in parts])


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def gradient(w: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of grades y (0..K) and its gradients by weights and thresholds."""
    z = x @ w
    cuts = np.concatenate([[-np.inf], t, [np.inf]])
    hi, lo = _sigmoid(cuts[y + 1] - z), _sigmoid(cuts[y] - z)
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
    gw = x.T @ (dhi - dlo)
    gt = np.bincount(y, -dhi, len(t) + 1)[:len(t)] + np.bincount(y, dlo, len(t) + 1)[1:]
    return float(-np.log(p).sum()), gw, gt


def fit(rows: DataFrame, steps: int = STEPS) -> dict:
    """Model from ``rows(text, rating)``, ratings being any ordered numbers."""
    grades = sorted(r[0] for r in rows.select("rating").distinct().limit(101).collect())
    if len(grades) > 100:
        raise ValueError("more than 100 grades")
    if len(grades) < 2:
        return {"grades": [float(g) for g in grades] or [0.0], "w": np.zeros(DIMS), "t": np.zeros(0)}
    place = {g: i for i, g in enumerate(grades)}

    def vectors(batches):
        for b in batches:
            x = [features(t).astype(np.float32).tobytes() for t in b.column("text").to_pylist()]
            y = [place[r] for r in b.column("rating").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.int64())], names=["x", "y"])

    data = materialise(rows.select("text", "rating").mapInArrow(vectors, "x binary, y long"), "quality-features")
    counts = {r["y"]: r["count"] for r in data.groupBy("y").count().collect()}
    n = sum(counts.values())
    share = np.cumsum([counts[i] for i in range(len(grades))])[:-1] / n
    w, t = np.zeros(DIMS), np.log(share / (1 - share))
    mean, square = np.zeros(DIMS + len(t)), np.zeros(DIMS + len(t))
    for step in range(1, steps + 1):
        def part(batches, w=w, t=t):
            gw, gt = np.zeros(DIMS), np.zeros(len(t))
            for b in batches:
                if b.num_rows:
                    x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(-1, DIMS)
                    _, a, c = gradient(w, t, x, b.column("y").to_numpy())
                    gw, gt = gw + a, gt + c
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gw, gt]).tobytes()], pa.binary())], names=["g"])

        parts = data.mapInArrow(part, "g binary").collect()      # one vector a partition of the bounded sample
        g = sum(np.frombuffer(r["g"]) for r in parts) / n
        g[:DIMS] += RIDGE * w
        mean, square = 0.8 * mean + 0.2 * g, 0.95 * square + 0.05 * g * g
        move = 0.6 * (mean / (1 - 0.8 ** step)) / (np.sqrt(square / (1 - 0.95 ** step)) + 1e-8) / np.sqrt(step)
        w, t = w - move[:DIMS], np.maximum.accumulate(t - move[DIMS:])
    return {"grades": [float(g) for g in grades], "w": w, "t": t}


def predict(docs: DataFrame, model: dict, tail: float) -> DataFrame:
    """``docs`` plus ``expected_grade`` and ``tail_probability`` (of a grade of ``tail`` or more)."""
    docs = docs.drop("expected_grade", "tail_probability")
    from pyspark.sql.types import DoubleType, StructField, StructType
    schema = StructType([*docs.schema.fields, StructField("expected_grade", DoubleType()),
                         StructField("tail_probability", DoubleType())])
    w, t, grades = model["w"], model["t"], np.array(model["grades"])

    def run(batches):
        for b in batches:
            z = np.array([features(x) @ w for x in b.column("text").to_pylist()])
            below = np.column_stack([_sigmoid(t[None, :] - z[:, None]), np.ones(len(z))])
            p = np.diff(np.column_stack([np.zeros(len(z)), below]), axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p @ grades), pa.array(p[:, grades >= tail].sum(axis=1))],
                                             names=[*b.schema.names, "expected_grade", "tail_probability"])

    return docs.mapInArrow(run, schema)


def rated_sample(docs: DataFrame, labels: DataFrame, rating: str) -> DataFrame:
    """At most about SAMPLE rated texts that are not held out."""
    given = labels.where(F.col(rating).isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(rating).cast("double").alias("rating")).where(~held_out()).distinct()
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    given = given.where(unit * F.lit(max(1, given.count())) < F.lit(SAMPLE << 30))
    return docs.select("doc_id", "text").join(F.broadcast(given), "doc_id").select("text", "rating")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(rated_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality"))
    return predict(docs.select("doc_id", "text"), model, tail=1).select(
        "doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability",
        (F.col("tail_probability") >= 0.5).alias("keep"))
