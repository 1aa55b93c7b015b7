"""Who else has this fingerprint?  A question that chunks of documents put to each other through Spark shuffles.

Documents are dealt to chunks by a hash of their id and text.  Each chunk sends its distinct fingerprints, sorted, to
the buckets of their leading bits; a bucket answers each chunk with one byte for each of them, in the same order.
A fingerprint that very many documents share is sent once by each chunk, so that no bucket gets a hot key's rows.
What only a filter asks has 64 bits or fewer; what decides has a second, independent hash of 64 bits beside each key.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import release

ASK = "bucket int, chunk long, keys binary, extra binary"
ANSWER = "chunk long, bucket int, answer binary"
CHUNK_BYTES = 4 << 20


_own_folder: list[str] = []
#: Staged tables that still stand, oldest first.
_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own where none is named, which only a local master allows."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        import tempfile

        _own_folder.append(tempfile.mkdtemp(prefix="strandline-"))
    return _own_folder[0]


def staged(df: DataFrame) -> DataFrame:
    """df written to a table in the shared folder and read again: what follows survives lost executors without it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_remove_from, spark, 0)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """staged(make()), after which the tables that make() itself staged are removed; none of them may be in use elsewhere."""
    first = len(_tables)
    out = staged(make())
    mine = _tables.pop()
    _remove_from(spark, first)
    _tables.append(mine)
    return out


def _remove_from(spark: SparkSession, first: int) -> None:
    while len(_tables) > first:
        path = _tables.pop()
        with contextlib.suppress(Exception):
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of as few bytes as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[0] = 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return int(keys[0]).to_bytes(8, "little") + bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width = data[8]
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(width, -1)
    steps = np.zeros((raw.shape[1], 8), np.uint8)
    steps[:, :width] = raw.T
    keys = steps.reshape(-1).view(np.uint64)
    keys[0] = int.from_bytes(data[:8], "little")
    return np.cumsum(keys, dtype=np.uint64)


class Layout:
    """How many chunks and buckets a corpus of so many bytes gets, and how many bits a filter's keys have."""

    def __init__(self, spark: SparkSession, n_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> None:
        self.bytes = n_bytes
        # a chunk sends a row to each bucket: beyond 32 GB both grow with the corpus' cube root, at most 16 times, or rows would hold a key each
        grown = 2 ** min(4, max(0, (n_bytes >> 35).bit_length() // 3))
        chunk_bytes *= grown
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n_bytes // (64 << 20))
        #: Both follow the bytes alone: a chunk sends a row to each bucket, and small inputs in many partitions would send only such rows.
        self.chunks = max(min(self.parts, 1 + n_bytes // (chunk_bytes // 8)), 1 + n_bytes // chunk_bytes)
        #: The leading bits of a key that name its bucket.
        self.bucket_bits = max(4, (n_bytes // (grown << 22)).bit_length())
        #: A key of a filter has 14 bits more than a count of all words takes: one in 16,000 is taken for another.
        self.filter_bits = min(64, max(32, (n_bytes // 5).bit_length() + 14))


def measure(docs: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def chunked(docs: DataFrame, doc_id: str, text: str, layout: Layout) -> DataFrame:
    """chunk, doc_id, text: rows of equal id and text are in one chunk, others of an id (or without one) spread."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(layout.chunks))).repartition(layout.parts, "chunk")


def in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows by id and text, nulls first: the same at each reading."""
    if table.num_rows < 2:
        return table
    import pyarrow.compute as pc

    order = pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
    return table.take(order)


def questions(chunk: int, keys: np.ndarray, bucket_bits: int, bits: int = 64, extra: np.ndarray | None = None) -> pa.Table:
    """Rows of ASK for a chunk's sorted keys, distinct or with distinct checks in extra, which has one item for each key."""
    cut = np.searchsorted(keys >> np.uint64(bits - bucket_bits), np.arange((1 << bucket_bits) + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cut))
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "chunk": pa.array(np.full(len(full), chunk), pa.int64()),
            "keys": pa.array([pack(keys[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
            "extra": pa.array([b"" if extra is None else extra[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()),
        }
    )


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints of two halves: the order that sorts them (equal ones as they stand), the first of each in it, each one's number, and how often each occurs."""
    order = np.lexsort((checks, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return order, order[first], number, np.diff(np.append(first, len(order)))


def answered(asked: DataFrame, decide: Callable[[np.ndarray, np.ndarray], np.ndarray], extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """decide(group, extras) gives a byte for each key: group numbers equal keys alike, extras is an array of the type `extra`.

    An extra named check is the second half of its key.
    """
    kind = np.dtype(extra or [])

    def of_bucket(table: pa.Table) -> pa.Table:
        lists = [unpack(x) for x in table["keys"].to_pylist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        keys = np.concatenate(lists)
        extras = np.frombuffer(b"".join(table["extra"].to_pylist()), kind) if extra else np.zeros(len(keys), kind)
        if extra and "check" in kind.names:
            group = distinct(keys, extras["check"])[2]
        else:
            order = np.argsort(keys, kind="stable")
            ranked = keys[order]
            group = np.empty(len(keys), np.int64)
            group[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
        out = decide(group, extras).astype(np.uint8)
        release()
        cut = np.concatenate([[0], np.cumsum(sizes)])
        return pa.table({"chunk": table["chunk"].cast(pa.int64()), "bucket": table["bucket"].cast(pa.int32()), "answer": pa.array([out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(of_bucket, ANSWER)


def answers(table: pa.Table) -> np.ndarray:
    """A chunk's answers as one array in the order of its sorted keys."""
    if not table.num_rows:
        return np.zeros(0, np.uint8)
    order = np.argsort(table["bucket"].to_numpy())
    parts = table["answer"].to_pylist()
    return np.frombuffer(b"".join(parts[k] for k in order), np.uint8)


def with_answers(docs: DataFrame, replies: list[DataFrame], f: Callable[[int, pa.Table, list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """f(chunk, its documents, its answers to each round of questions) for each chunk of documents."""
    import pyarrow.compute as pc

    both, n = reduce(DataFrame.unionByName, [reply.withColumn("turn", F.lit(k)) for k, reply in enumerate(replies)]), len(replies)

    def of_chunk(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        given = [answers(theirs.filter(pc.equal(theirs["turn"], k))) for k in range(n)]
        out = f(mine["chunk"][0].as_py() if mine.num_rows else -1, in_order(mine), given)
        release()
        return out

    return docs.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(of_chunk, schema)


def per_chunk(docs: DataFrame, f: Callable[[int, pa.Table], pa.Table], schema: str = ASK) -> DataFrame:
    def of_chunk(table: pa.Table) -> pa.Table:
        out = f(table["chunk"][0].as_py(), in_order(table))
        release()
        return out

    return docs.groupBy("chunk").applyInArrow(of_chunk, schema)
