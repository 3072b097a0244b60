"""Line dedup: lines that many documents share stay in one of them.

Each long enough line becomes a row (128-bit hash of its normalised form, document, position); no text is
shuffled for the decision. The rows are range-partitioned by hash and document, so that even one line of
every third document is spread over partitions, and sorted by hash, then document (largest first), then
position. Each partition streams through its runs: the first document of a run is the one that keeps the
line. A run that touches a partition's edge may go on next door; such runs, two a partition at most, are
summed up in a table whose size is bound by the number of partitions. What comes back is one compressed
bitmap of kept lines for each document that loses any.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from webloom.llm.common import unused
from webloom.workspace import partitions, written

#: Code points from which a normalised line counts; documents from which it is dropped.
LEAST_LENGTH, LEAST_DOCS = 40, 5
#: Rows that a range should hold at most; their number follows from it.
PARTITION_ROWS = 400_000

_WHITE = " \t\n\x0b\x0c\r"
_NULL_ID = -(1 << 63)


def _id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(_NULL_ID))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(_WHITE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def candidates(docs: DataFrame, least_length: int) -> DataFrame:
    """``h1, h2, doc, row, n_lines, pos`` for each line that is long enough; ``row`` tells texts with one id apart."""
    lines = docs.where("text is not null").select(_id().alias("doc"), F.xxhash64("text").alias("row"), F.split("text", "\n").alias("_lines"))
    each = lines.select("doc", "row", F.size("_lines").alias("n_lines"), F.posexplode("_lines").alias("pos", "_line")).withColumn("_key", line_key(F.col("_line")))
    return each.where(F.length("_key") >= least_length).select(F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"), "doc", "row", "n_lines", "pos")


_STREAMED = "kind byte, h1 long, h2 long, doc long, row long, n_lines int, pos int"
DROPPED, PENDING, SUMMARY = 0, 1, 2


def _stream(least_docs: int):
    names = ["h1", "h2", "doc", "row", "n_lines", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(b.column(c)) for c in names] for b in batches if b.num_rows]
        if not parts:
            return
        h1, h2, doc, row, n_lines, pos = (np.concatenate(x) for x in zip(*parts))
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        of = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        other = np.ones(len(h1), dtype=bool)  # a document's first line of a run
        other[1:] = new[1:] | (doc[1:] != doc[:-1])
        docs = np.add.reduceat(other, first)
        top = doc[first]
        last = len(first) - 1
        # the first run may have begun in the range before; the last may go on in the next one
        pending = (of == 0) | ((of == last) & (docs[last] < least_docs))
        dropped = ~pending & (docs[of] >= least_docs) & (doc != top[of])
        zero = np.zeros(2, np.int32)
        ends = np.unique([0, last])
        for kind, at in ((DROPPED, np.flatnonzero(dropped)), (PENDING, np.flatnonzero(pending))):
            for k in range(0, len(at), 10_000):
                i = at[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind, np.int8)), *(pa.array(x[i]) for x in (h1, h2, doc, row, n_lines, pos))], names=["kind", *names])
        z = zero[: len(ends)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), SUMMARY, np.int8)), *(pa.array(x) for x in (h1[first[ends]], h2[first[ends]], top[ends], z.astype(np.int64), docs[ends].astype(np.int32), z))], names=["kind", *names])

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for n, dropped in zip(b.column("n_lines").to_pylist(), b.column("dropped")):
            keep = np.ones(n, dtype=bool)
            keep[np.asarray(dropped.values)] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("row"), b.column("n_lines"), pa.array(out, pa.binary())], names=["doc", "row", "n_lines", "keep"])


def keep_bitmaps(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc, row, n_lines, keep`` for each document that loses a line: its id (the least long if null), the
    hash of its text, its lines, and a compressed bitmap with a 1 for every line that stays."""
    rows = written(candidates(docs, least_length), "lines")
    parts = max(partitions(docs.sparkSession), -(-rows.count() // PARTITION_ROWS))
    largest_first = ["h1", "h2", F.desc("doc")]
    ordered = rows.repartitionByRange(parts, *largest_first).sortWithinPartitions(*largest_first, "row", "pos")
    streamed = written(ordered.mapInArrow(_stream(least_docs), _STREAMED), "lines-streamed")
    edges = streamed.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n_lines").alias("_docs"), F.max("doc").alias("_top"))
    edges = edges.where(F.col("_docs") >= least_docs)
    # at most two rows a partition, so this side may be broadcast
    late = streamed.where(F.col("kind") == PENDING).join(F.broadcast(edges), ["h1", "h2"]).where(F.col("doc") < F.col("_top"))
    gone = streamed.where(F.col("kind") == DROPPED).unionByName(late.select(*streamed.columns))
    of_doc = gone.groupBy("doc", "row", "n_lines").agg(F.collect_set("pos").alias("dropped"))
    return written(of_doc.mapInArrow(_bitmaps, "doc long, row long, n_lines int, keep binary"), "lines-keep")


def kept_lines(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """(text of the lines that stay, lines before, lines dropped)."""
    if keep is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(compress(lines, stays.tolist())), len(lines), int(len(lines) - stays.sum())


def _joined(docs: DataFrame, **settings) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("_row"), _id().alias("_doc"), F.xxhash64("text").alias("_text"))
    keep = keep_bitmaps(docs, **settings).select(F.col("doc").alias("_doc"), F.col("row").alias("_text"), "keep")
    # bitmaps grow with the corpus, so they are never broadcast: one plan at every size
    return keyed.join(keep.hint("merge"), ["_doc", "_text"], "left")


def line_report(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for every row of ``docs``.

    A null or empty text is one empty line. Rows with one id count as one document; rows with a null id
    together as one, smaller than any other. Lines within one document never count twice. Other columns do
    no harm; no rows give no rows. Whole texts are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kept_lines(t or "", k) for t, k in zip(b.column("text").to_pylist(), b.column("keep").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for _, n, _ in found], pa.int64()), pa.array([d for *_, d in found], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t, *_ in found], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    joined = _joined(docs.select("doc_id", "text"), **settings).select("_row.doc_id", "_row.text", "keep")
    return joined.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def without_shared_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the lines that stay as ``text``; a null text stays null. All rows and columns stay."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if k is None or t is None else kept_lines(t, k)[0] for t, k in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())]
            columns = [pa.array(texts, b.column(at).type) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _joined(docs, **settings).select("_row.*", F.col("keep").alias(unused(docs, "_keep"))).mapInArrow(run, docs.schema)
