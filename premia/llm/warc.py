"""Operator 5: WARC archives, written by all tasks and read back by boundary-chain verification.

Writing. Each record is one row of Spark's text sink: headers, an empty line and the
payload, closed by the sink's separator CRLF CRLF. Of pages with equal payloads of at
least ``min_bytes`` bytes, the one with the largest id is a response and the others
revisit it (no payload, WARC-Refers-To); smaller payloads are all responses.

Reading. Files are cut into byte ranges by Spark's text source with ``WARC/1.0 CRLF`` as
separator, so every magic, also one inside a payload, starts a candidate record.

1. Each range emits its candidates with their successor offsets (from
   Content-Length), followed within the range to the first offset beyond it.
2. Pointer jumping over ranges: from offset 0 of each file, reached offsets are
   joined with pointers whose length doubles every round, until none is new.
3. Each range walks its chain from its first reached offset. Candidates that the
   chain does not meet are payload text. A record cut by a false magic or a range's
   end is emitted in fragments under its end offset and put together again.
   Both passes cut files alike, whatever executors come or go; a range that the first
   pass did not see is an error.

A record without a valid Content-Length ends its file's chain; what follows is not read.

Cases: a null html is an empty payload; a null id or url has no header and reads back
as null; rows that repeat an id are records of their own; line ends inside a url are
percent-coded; no pages give no records. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from premia.llm.common import bounded, materialise, shared_path

MAGIC = "WARC/1.0\r\n"
RANGES = 500_000          # byte ranges whose entry offsets go to every task at once
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data):
    """Upper-case base32 of the SHA-1 of a binary column, by built-in functions."""
    hexed, out = F.sha1(data), []
    for i in range(8):
        v = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"))
    base = base.withColumn("size", F.octet_length("html")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    keys = materialise(base.select("page_id", "size", "digest").where("page_id is not null"), "warc-keys")
    groups = keys.where(F.col("size") >= min_bytes).groupBy("size", "digest").agg(
        F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    # An id that stands for two payloads may be a revisit of one and a response of the other.
    revisits = materialise(keys.join(groups, ["size", "digest"]).where("page_id < refers_to").select(
        "page_id", "digest", "refers_to").distinct(), "warc-revisits")
    r = base.join(bounded(revisits), ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Target-URI", url),
        line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n")).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(again, 0).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"), F.when(again, "").otherwise(F.col("html")))
    r.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 100_000).text(path)


def _fixed_splits(spark: SparkSession) -> SparkSession:
    """A copy of the session whose text scans cut files alike at any later number of cores."""
    fixed = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    parallel = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
    key = "spark.sql.files.minPartitionNum"
    fixed.conf.set(key, spark.conf.get(key, None) or str(parallel))
    return fixed


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_block(batches, columns: list[str]):
    """Rows of each byte range in reading order: ((file, block), list of column lists)."""
    key, held = None, [[] for _ in columns]
    for b in batches:
        files, blocks = b.column("file").to_pylist(), b.column("block").to_pylist()
        cols = [b.column(c).to_pylist() for c in columns]
        for i, k in enumerate(zip(files, blocks, strict=True)):
            if k != key:
                if key is not None:
                    yield key, held
                key, held = k, [[] for _ in columns]
            for h, c in zip(held, cols, strict=True):
                h.append(c[i])
    if key is not None:
        yield key, held


_CANDIDATES = "file string, block long, total long, at long, leaves long"


def candidates(lines: DataFrame) -> DataFrame:
    """Per candidate: its place in its range and the first offset beyond the range that its chain meets (-1: none).

    Places are relative to the range's first line; a row with null ``at`` gives a range's length alone.
    """
    head = F.substring_index("value", "\r\n\r\n", 1)
    size = F.octet_length("value").cast("long")
    headed = F.octet_length(head).cast("long")
    length = F.regexp_extract(head, r"(?:^|\r\n)Content-Length: (\d{1,18})(?:\r\n|$)", 1).try_cast("long")
    step = F.when(headed < size, headed + len(MAGIC) + 4 + length + 4)
    rows = lines.select("file", "block", size.alias("size"), F.coalesce(step, F.lit(-1)).alias("step"))

    def run(batches):
        for (file, block), (sizes, steps) in _by_block(batches, ["size", "step"]):
            start = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + len(MAGIC))])
            total, at = int(start[-1]), start[:-1] - len(MAGIC)      # a record starts at its magic
            steps = np.array(steps, np.int64)
            to = np.where(steps >= 0, at + steps, -1)
            # Pointer jumping inside the range: follow successors that are candidates of it.
            n = len(at)
            slot = np.minimum(np.searchsorted(at, to), n - 1)
            inside = (to >= 0) & (to <= at[-1])
            nxt = np.where(inside & (at[slot] == to), slot, np.arange(n))
            leaves = np.where(inside, -1, to)
            while (jump := nxt[nxt]).tolist() != nxt.tolist():
                nxt = jump
            leaves = leaves[nxt]
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * (n + 1)), pa.array([block] * (n + 1), pa.int64()), pa.array([total] * (n + 1), pa.int64()),
                 pa.array([*at.tolist(), None], pa.int64()), pa.array([*leaves.tolist(), None], pa.int64())],
                names=["file", "block", "total", "at", "leaves"])

    return rows.mapInArrow(run, _CANDIDATES)


def entries(lines: DataFrame) -> DataFrame:
    """``(file, block, base, entry)``: offset of each range's first line, and the first true record start from there.

    The entry is null in ranges after the end of their file's chain.
    """
    cand = materialise(candidates(lines), "warc-candidates")
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialise(cand.where("at is null").select("file", "block", "total").withColumn(
        "base", F.coalesce(F.sum("total").over(order), F.lit(0))), "warc-blocks")
    jump = cand.where("at is not null").join(bounded(blocks.select("file", "block", "base")), ["file", "block"]).select(
        "file", (F.col("base") + F.col("at")).alias("off"),
        F.when(F.col("leaves") >= 0, F.col("base") + F.col("leaves")).alias("to")).where("off >= 0 and to is not null")
    jump = materialise(jump, "warc-jump")
    reach = materialise(blocks.select("file", F.lit(0).cast("long").alias("off")).distinct(), "warc-reach")
    targets = jump.select("file", F.col("to").alias("off")).union(reach).distinct()
    jump = materialise(jump.join(targets, ["file", "off"], "left_semi").distinct(), "warc-jump")
    seen = reach.count()
    while True:
        reach = materialise(reach.union(reach.join(jump, ["file", "off"]).select("file", "to")).distinct(), "warc-reach")
        now = reach.count()
        if now == seen:
            break
        seen = now
        twice = jump.select("file", F.col("off").alias("to"), F.col("to").alias("far"))
        jump = materialise(jump.join(twice, ["file", "to"], "left").select(
            "file", "off", F.coalesce("far", "to").alias("to")), "warc-jump")
    # A record that starts in a range is one magic before its first line.
    later = F.when(F.col("off") >= F.col("base") - len(MAGIC), F.col("off"))
    return blocks.join(reach, "file").groupBy("file", "block", "base").agg(F.min(later).alias("entry"))


_PARTS = "file string, ends long, at long, whole boolean, data binary"


def _successor(line: bytes) -> int:
    """Bytes from a record's magic to its successor's, -1 without a valid header."""
    head, sep, _ = line.partition(b"\r\n\r\n")
    for h in head.split(b"\r\n"):
        if h.startswith(b"Content-Length: ") and h[16:].isdigit() and sep:
            return len(MAGIC) + len(head) + 4 + int(h[16:]) + 4
    return -1


def _parse(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n") if ": " in x)
    urn = lambda x: int(x[len("<urn:page:"):-1]) if x else None
    return (urn(h.get("WARC-Record-ID")), h.get("WARC-Target-URI"), h.get("WARC-Type"),
            urn(h.get("WARC-Refers-To")), h.get("WARC-Payload-Digest"), rest[:int(h["Content-Length"])])


_RECORDS = "page_id long, url string, record_type string, refers_to long, declared_digest string, payload binary"
_RECORD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``; payloads as stored (empty for revisits)."""
    lines = _lines(_fixed_splits(spark), path)
    start = materialise(entries(lines), "warc-entries")
    slices = max(1, -(-start.count() // RANGES))
    of = F.pmod(F.xxhash64("file"), F.lit(slices))
    out = None
    for k in range(slices):
        known = {(r["file"], r["block"]): (r["base"], -1 if r["entry"] is None else r["entry"]) for r in start.where(of == k).collect()}
        shared = spark.sparkContext.broadcast(known)

        def run(batches, shared=shared):
            key = None
            for b in batches:
                rows = []
                for file, block, line in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
                    if (file, block) != key:
                        key = (file, block)
                        if key not in shared.value:
                            raise ValueError(f"{file} was cut at {block}, which the pass for entries did not see")
                        base, ends = shared.value[key]
                        at, starts = base - len(MAGIC), -1
                    if at == ends:
                        step = _successor(line)
                        starts, ends = at, at + step if step >= 0 else -1
                    if 0 <= at < ends:
                        rows.append((file, ends, at, at == starts and ends - at == len(line) + len(MAGIC), line))
                    at += len(line) + len(MAGIC)
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()),
                                                    strict=True)], names=["file", "ends", "at", "whole", "data"])

        some = lines.where(of == k).select("file", "block", F.col("value").cast("binary").alias("value"))
        parts = some.mapInArrow(run, _PARTS)
        out = parts if out is None else out.unionByName(parts)
    joined = out.where("not whole").groupBy("file", "ends").agg(
        F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts")).select(
        F.expr("aggregate(slice(parts, 2, size(parts)), parts[0].data, "
               f"(x, y) -> concat(x, cast('{MAGIC[:-2]}\\r\\n' as binary), y.data))").alias("data"))

    def parse(batches):
        for b in batches:
            rows = [_parse(x) for x in b.column("data").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _RECORD_TYPES, strict=True)],
                                             names=[x.split()[0] for x in _RECORDS.split(", ")])

    return out.where("whole").select("data").unionByName(joined).mapInArrow(parse, _RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """One row per record with size and digest of its full payload; revisits take those of the record they refer to."""
    own = materialise(records.select("page_id", "record_type", "refers_to", "declared_digest",
                                     F.octet_length("payload").cast("long").alias("payload_bytes"),
                                     base32_sha1(F.col("payload")).alias("payload_digest")), "warc-records")
    first = own.where("record_type = 'response'")
    target = first.select(F.col("page_id").alias("refers_to"), F.concat(F.lit("sha1:"), "payload_digest").alias(
        "declared_digest"), "payload_bytes", "payload_digest").distinct()
    again = own.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(
        target, ["refers_to", "declared_digest"], "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return first.select(*names).unionByName(again.select(*names))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve(read_archives(spark, path))


def _oracle_sql() -> str:
    digits = " || ".join(f"substr('{_BASE32}', ((('0x' || substr(hexed, {5 * i + 1}, 5))::INT >> {s}) & 31) + 1, 1)"
                         for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (
    SELECT page_id::BIGINT AS page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
    SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hexed,
           max(page_id) OVER (PARTITION BY payload) AS latest
    FROM p
)
SELECT page_id, payload_bytes, {digits} AS payload_digest,
       CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < latest THEN latest END AS refers_to
FROM d
"""


ORACLE_SQL = _oracle_sql()
