"""SimHash near-dedup with BK-trees."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.bktree import Groups, near
from spanveil.llm.common import free_name, sent_if_small
from spanveil.llm.components import components
from spanveil.plans.tables import stored

SEED = 42
LARGE = 4096  # fingerprints of a bucket beyond which it is split further
TREE_ROWS = 200_000  # fingerprints whose trees are built at once, if no single tree has more


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included."""
    found = (text or b"").lower().split()  # of bytes: A-Z, and the six ASCII spaces
    if not found:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[k:] for k in range(words)))) if len(found) >= words else [b" ".join(found)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def print_of(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, words: int) -> int:
    """A bit is 1 if set in over half the XXH64 hashes of the word shingles, repeats included."""
    return print_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, print) of whole texts; where the rows lie."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            prints = [fingerprint(x, words) for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body"))
    return rows.mapInArrow(run, f"doc_id {kind}, print long")


def _forests(radius: int):
    """Links that connect what is connected within each bucket; whole buckets arrive one after another."""

    def links(prints, bucket):
        groups = Groups(len(prints))
        for a, b in near(prints, bucket, radius):
            groups.join(a, b)
        root = np.fromiter(map(groups.root, range(len(prints))), np.int64, len(prints))
        mine = np.flatnonzero(root != np.arange(len(prints)))
        return pa.RecordBatch.from_arrays(
            [pa.array(prints[mine].view(np.int64)), pa.array(prints[root[mine]].view(np.int64))], names=["a", "b"]
        )

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column("print").to_numpy().view(np.uint64), batch.column("bucket").to_numpy()))
            rows += batch.num_rows
            if rows < TREE_ROWS:
                continue
            prints, bucket = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(bucket == bucket[-1], True))  # the last bucket may go on
            if cut:
                yield links(prints[:cut], bucket[:cut])
            held, rows = [(prints[cut:], bucket[cut:])], len(prints) - cut
        if rows:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def _field(col, start: int, bits: int):
    return F.shiftrightunsigned(col, start).bitwiseAND(F.lit((1 << bits) - 1))


def print_links(prints: DataFrame, radius: int = 3, large: int = LARGE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``print`` within ``radius`` bits.

    The 64 bits are cut into radius + 1 bands; two fingerprints within the
    radius agree in one at least, so each goes to the bucket of each of its
    band values, and a BK-tree is built for each bucket. A bucket with over
    ``large`` fingerprints is dealt out again by the bands of its other bits,
    which loses no link either. Buckets are counted on the map side; there
    are at most (radius + 1) * 2^ceil(64 / (radius + 1)) of them, whatever the
    number of fingerprints.
    """
    bands = radius + 1
    cuts = [64 * k // bands for k in range(bands + 1)]
    value = [_field(F.col("print"), cuts[k], cuts[k + 1] - cuts[k]) for k in range(bands)]
    rows = prints.select("print", F.posexplode(F.array(*value)).alias("band", "value"))
    big = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("band", "value", F.lit(True).alias("big"))
    rows = rows.join(big, ["band", "value"], "left")
    # the bits without the band, as one number of 64 - width bits, cut once more
    other = []
    for k in range(bands):
        low = _field(F.col("print"), 0, cuts[k]) if cuts[k] else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned("print", cuts[k + 1]), cuts[k]) if cuts[k + 1] < 64 else F.lit(0).cast("long")
        rest = 64 - (cuts[k + 1] - cuts[k])
        parts = [rest * j // bands for j in range(bands + 1)]
        both = low.bitwiseOR(high)
        other.append(F.array(*[F.struct(F.lit(j).alias("part"), _field(both, parts[j], parts[j + 1] - parts[j]).alias("more")) for j in range(bands)]))
    again = F.element_at(F.array(*other), F.col("band") + 1)
    once = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("more")))
    rows = rows.select("print", "band", "value", F.explode(F.when(F.col("big"), again).otherwise(once)).alias("x"))
    rows = rows.select("print", F.xxhash64("band", "value", "x.part", "x.more").alias("bucket"))
    # a chance agreement of two bucket numbers only adds candidates, which are measured like all others
    return rows.repartition("bucket").sortWithinPartitions("bucket", "print").mapInArrow(_forests(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 3, large: int = LARGE
) -> DataFrame:
    """(id, ``fingerprint`` as 16 hex digits, ``component_id``) for each row of ``docs``.

    Texts are lower-cased (A-Z), cut into words at ASCII spaces and into
    shingles of ``words`` words; a shorter text is one shingle, one without
    words has fingerprint zero and is linked like any other, NULL too.
    Fingerprints within ``radius`` bits are linked; the component of a row is
    the smallest id that can be reached, its own included.

    Equal fingerprints are reduced to one before anything is compared, so
    copies cost nothing, however many; links are found per bucket and reduced
    to what keeps the bucket connected, so no pairs of a group are listed.
    Rows with a NULL id are linked, but are nobody's smallest id; a component
    of such rows alone has a NULL one. Repeated rows are returned as often.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    nodes = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    stars = components(print_links(nodes.select("print"), radius, large))
    roots = nodes.join(stars, nodes["print"] == stars["a"], "left").select("print", "least", F.coalesce("b", "print").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "root_")
    named = stored(roots.join(ids, roots["root"] == ids["root_"]).select(F.col("print").alias("print_"), "component_id"), "components")
    named = rows.join(named, rows["print"] == named["print_"])
    return named.select(F.col("doc_id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, that of its smallest id, with all columns.

    Where several rows have that id, the text of least hash stays, once. Rows with a NULL id stay.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = near_duplicates(docs, **options).select(id_col, "component_id").where(F.col(id_col).isNotNull())
    return first_of_each(docs, found, id_col, text_col)


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each ``component_id`` of ``found``, that of its smallest id; rows with a NULL id stay."""
    key, mark = free_name(docs, "id_"), free_name(docs, "mark_")
    found = stored(found, "near-duplicates")
    ids = found.groupBy(F.col(id_col).alias(key)).agg(F.max(F.col(id_col) == F.col("component_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    ids = stored(ids.where(~F.col("first") | (F.col("n") > 1)), "not-alone")
    # what goes is far less than what stays, and texts stay where they are if it is few
    gone = stored(ids.where(~F.col("first")).select(key), "copies")
    kept = docs.join(sent_if_small(gone), docs[id_col] == gone[key], "left_anti")
    again = ids.where("first").select(key)
    if again.isEmpty():
        return kept
    twice = kept.join(again, kept[id_col] == again[key], "left_semi")
    one = twice.withColumn(mark, F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col))).where(F.col(mark) == 1)
    return kept.join(again, kept[id_col] == again[key], "left_anti").union(one.drop(mark))
