"""Token ids as Simple-8b block files, in the order of the documents."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanveil.llm import simple8b
from spanveil.llm.common import text_of
from spanveil.llm.tokens import encoder

IDS_PER_FILE = 1 << 20  # a file closes when it holds so many ids; one long document may make it longer
FILES = "part int, file int, docs array<{0}>, lengths array<long>, n_ids long, data binary"


def _writer(path: str, end_id: int | None, kind: pa.DataType):
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    types = (pa.int32(), pa.int32(), pa.list_(kind), pa.list_(pa.int64()), pa.int64(), pa.binary())

    def run(batches):
        part, file, docs, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            flat = np.frombuffer(b"".join(ids), "<u4")
            row = (part, file, docs, [len(x) // 4 for x in ids], len(flat), simple8b.encode(flat))
            arrays = [pa.array([x], t) for x, t in zip(row, types)]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "file", "docs", "lengths", "n_ids", "data"])

        for batch in batches:
            for doc, found in zip(batch.column("doc_id").to_pylist(), encoder(path).ids(batch.column("body").to_pylist())):
                docs.append(doc)
                ids.append(found + end)
                held += len(ids[-1]) // 4
                if held >= IDS_PER_FILE:
                    yield close()
                    file, docs, ids, held = file + 1, [], [], 0
        if docs:
            yield close()

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode whole texts and write block files under ``path``, ascending by id.

    The texts are ranged by id over the tasks and sorted there; each task
    encodes and writes what it has, about a million ids to a file: the file's
    documents, their numbers of ids, and the packed ids. The files are rows of
    a Parquet table, so that Spark commits whole tasks only and any store will do.

    NULL and empty texts have the end id alone. NULL ids come first. Rows with
    equal ids are all kept, ordered by text. Other columns are not read. An
    empty table makes an empty set of files.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("body"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("body")).sortWithinPartitions("doc_id", F.xxhash64("body"), "body")
    from pyspark.sql.pandas.types import to_arrow_type

    made = rows.mapInArrow(_writer(tokenizer, end_id, to_arrow_type(kind)), FILES.format(kind.simpleString()))
    made.write.option("compression", "zstd").parquet(path)


def _reader(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            docs, lengths = batch.column("docs").slice(k, 1).flatten(), batch.column("lengths").slice(k, 1).flatten()
            ids = simple8b.decode(batch.column("data")[k].as_py()).astype("<u4")
            n = lengths.to_numpy()
            ends = np.cumsum(n)
            base = batch.column("base")[k].as_py()
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - n).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(base + ends - n), lengths, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the files.

    ``start`` counts the ids of all documents before it: a sum over the parts,
    of which there are as many as writing tasks, and one over the files of each part.
    """
    files = spark.read.parquet(path)
    kind = files.schema["docs"].dataType.elementType.simpleString()
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    spots = files.select("part", "file", "n_ids").withColumn("in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    spots = spots.join(parts, "part").select("part", "file", (F.col("part_base") + F.col("in_part")).alias("base"))
    placed = files.join(F.broadcast(spots) if _few(spots) else spots, ["part", "file"])
    return placed.select("docs", "lengths", "data", "base").mapInArrow(
        _reader, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"
    )


def _few(spots: DataFrame, most: int = 1_000_000) -> bool:
    """Whether the places of all files are small enough to be sent to each task (24 bytes a file)."""
    return spots.count() <= most
