"""Token-ID output: independent Zstandard frames with a seek table and per-frame checksums.

Documents are range-partitioned by doc_id, then by a hash of the text and a draw, so that rows without a doc_id are
divided, too (text moves once), and sorted within a partition; each task encodes its documents, appends the end id and writes one file of frames (see frames.py), ids as 16-bit numbers where the
vocabulary allows and else 32-bit. Files of lost attempts are never listed: a file has a fresh name, and the manifest (a row for each
file) holds only what finished tasks report. Starts come from sums over the manifest. Readers open a file's
footer and decompress the frames of the documents they want.

Tables of chunks (bpe.py, 256 MB at most for each Python worker) outlive a task here, since most chunks come again.

Defined cases: a null text is empty and has the end id only; a null doc_id sorts first and comes back null;
repeated rows each have their place, ordered by a hash of the text; very long texts are encoded whole, in frames of
their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import groups, held
from .common import partitions, scratch, trimmed
from .frames import Reader, Writer

NULL_ID = -(1 << 63)
MANIFEST = "part int, uri string, docs long, tokens long, bytes long, kind string"


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end: int = 2, encoder: str = "library") -> list[dict]:
    """Write ids in ascending doc_id order; the manifest, in order, with each file's first position."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("th"), F.rand(5).alias("draw"))
    rows = rows.repartitionByRange(partitions(docs), "doc_id", "th", "draw").sortWithinPartitions("doc_id", "th").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chunks = held(encoder, sent.value)
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
        kind = "<u2" if vocabulary_size(sent.value) <= 1 << 16 else "<u4"
        out, docs_, tokens = None, 0, 0
        for b in batches:
            ids_of = b.column(0).to_pylist()
            at = 0
            for texts in groups(b.column(1)):
                for ids in chunks.encode(texts):
                    out = out or Writer(uri)
                    x = np.append(np.frombuffer(ids, "<u4"), np.uint32(end)).astype(kind)
                    out.add(ids_of[at], x.tobytes())
                    at, docs_, tokens = at + 1, docs_ + 1, tokens + len(x)
        if out:
            n = out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "docs": [docs_], "tokens": [tokens], "bytes": [n], "kind": [kind]})

    files = sorted((r.asDict() for r in rows.mapInArrow(trimmed(run), MANIFEST).collect()), key=lambda r: r["part"])
    start = 0
    for f in files:
        f["start"] = start
        start += f["tokens"]
    return files


def vocabulary_size(vocabulary: str) -> int:
    import json

    spec = json.loads(vocabulary)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


def read_tokens(spark: SparkSession, files: list[dict], keys: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents in the files, or of some of them; a task for each file."""
    wanted = None if keys is None else sorted(keys)
    schema = "doc_id long, start long, n_tokens long, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, start, x in _documents(batches, wanted):
            yield pa.RecordBatch.from_arrays([pa.array([None if key == NULL_ID else key], pa.int64()), pa.array([start]), pa.array([len(x)]), pa.array([x.astype("<i4")], pa.list_(pa.int32()))], ["doc_id", "start", "n_tokens", "ids"])

    return _listed(spark, files).mapInArrow(run, schema)


def _documents(batches: Iterator[pa.RecordBatch], wanted: list[int] | None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start, ids) from listed files. A file's starts follow from its index alone."""
    for b in batches:
        for uri, base, kind in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            reader = Reader(uri)
            key, _, _, length = reader.index
            n = length // np.dtype(kind).itemsize
            starts = base + np.concatenate([[0], np.cumsum(n)])[:-1]
            chosen = np.arange(len(key)) if wanted is None else np.flatnonzero(np.isin(key, wanted))
            for r, (k, data) in zip(chosen.tolist(), reader.pieces(wanted), strict=True):
                yield k, int(starts[r]), np.frombuffer(data, kind)
            reader.close()


def _listed(spark: SparkSession, files: list[dict]) -> DataFrame:
    rows = [(f["uri"], f["start"], f["kind"]) for f in files]
    return spark.createDataFrame(rows, "uri string, start long, kind string").repartition(max(1, len(rows)), "uri")


def token_files(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """Write, read back: doc_id, start, n_tokens, ids_crc32 (of all ids as little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    files = write_tokens(docs, vocabulary, scratch(spark, "tokens"), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, start, x in _documents(batches, None):
            out.append((None if key == NULL_ID else key, start, len(x), zlib.crc32(x.astype("<u4").tobytes())))
            if len(out) == 5000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return _listed(spark, files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
