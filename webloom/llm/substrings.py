"""Substring dedup: runs of words that an earlier document also has are cut out.

A window is ``WINDOW`` consecutive words. Most windows occur once, so a count-min sketch comes first and
exact keys are exchanged only for windows that it estimates to be repeated; as it never underestimates, none
is lost.

Documents are dealt into parts by hash, packed, compressed and written, once; the three passes below read that. Windows are dealt into slices by the leading bits of their hash, and every slice has its own cut of
the sketch, so that no sketch grows with the corpus:

1. Each part fills a partition sketch of two rows and sends each slice its cells (with one bit for "more
   than once") as sorted, delta-coded bytes. The slice adds the partition sketches up and answers each part
   with one bit a cell: estimated at two or more, or not.
2. A window both of whose cells are so estimated may be repeated. Its exact 96-bit key goes to its slice,
   once a part, with the smallest document that has it there. The slice groups keys exactly and answers with
   one bit a key: some smaller document elsewhere, or not.
3. Each part cuts the covered words out of its documents.

A window that a third of all documents share is one cell and one key a part; nothing is ever grouped by it
but those.

Parts and slices both grow with the corpus. So that no part sends more than ``ROUTES`` messages, beyond that
many slices the exchange has two hops: a part sends to groups of slices; there the cells (keys) of ``FAN`` parts
are merged into those of one super-part, which go on to the slices, and the answers come back the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webloom.llm.textvec import mix64, pieces, utf8, word_hashes, word_marks, words
from webloom.workspace import partitions, written

#: Words of a window; bytes of text in a part and windows in a slice, at most; sketch columns for a window.
WINDOW, PART_BYTES, SLICE_WINDOWS, COLUMNS = 13, 16 << 20, 8 << 20, 4
#: Messages of a part at most; parts whose messages to one group of slices are merged.
ROUTES, FAN = 1024, 256
#: A null id counts as larger than any other.
NULL_ID = (1 << 63) - 1

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# sorted whole numbers as bytes


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers, as differences, a plane a byte, compressed."""
    import zstandard

    if not len(values):
        return b""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    steps = np.zeros((raw.shape[1], 8), np.uint8)
    steps[:, : data[0]] = raw.T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def pack_any(values: np.ndarray) -> bytes:
    """Numbers in any order, a plane a byte, compressed."""
    import zstandard

    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_any(data: bytes, dtype) -> np.ndarray:
    import zstandard

    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


class Shape:
    """How windows are dealt: 2**slice_bits slices, each with two sketch rows of 2**cell_bits columns.

    A part addresses them in 2**route_bits groups, which are the slices themselves unless those are too many.
    """

    def __init__(self, slice_bits: int, cell_bits: int, window: int, route_bits: int):
        self.slice_bits, self.cell_bits, self.window, self.route_bits = slice_bits, cell_bits, window, route_bits
        #: Bits of a column within a group of slices, and of a slice within its group.
        self.rest_bits, self.inner_bits = slice_bits - route_bits + cell_bits, slice_bits - route_bits

    def columns(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns of the windows in both rows, with the slice in front."""
        low = np.uint64((1 << self.cell_bits) - 1)
        return h >> np.uint64(64 - self.slice_bits - self.cell_bits), (_top(h, self.slice_bits) << np.uint64(self.cell_bits)) | (h & low)


def _top(h: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits."""
    return h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)


def _cuts(groups: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 2**bits groups begins among ascending group numbers, and the end."""
    return np.searchsorted(groups, np.arange((1 << bits) + 1, dtype=np.uint64))


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, 32 more bits, first word, text) of all windows, and the words of each text."""
    h1, h2, at, text, count, base = [], [], [], [], np.zeros(len(offsets) - 1, np.int64), 0
    for i, j, part, begins in pieces(data, offsets):
        starts, ends, own = words(part, begins)
        count[i:j] = np.bincount(own, minlength=j - i)
        n = len(starts) - window + 1
        if n > 0:
            w = word_hashes(part, starts, ends)
            v = word_marks(part, starts, ends)
            a, b = w[:n], v[:n]
            for k in range(1, window):
                a = a * _B1 + w[k : n + k]
                b = b * _B2 + v[k : n + k]
            ok = np.flatnonzero(own[window - 1 :] == own[:n])
            h1.append(mix64(a[ok]))
            h2.append((mix64(b[ok]) >> np.uint64(32)).astype(np.uint32))
            at.append(ok + base)
            text.append(own[ok] + i)
        base += len(starts)
    if not h1:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint32), z, z, count
    return np.concatenate(h1), np.concatenate(h2), np.concatenate(at), np.concatenate(text), count


# the packed parts


def _deal(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            if not b.num_rows:
                continue
            part = np.asarray(b.column("part"))
            order = np.argsort(part, kind="stable")
            text = b.column("text").take(pa.array(order))
            data, offsets = utf8(text)
            ids = np.asarray(b.column("doc"))[order]
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cut))
            packer = zstandard.ZstdCompressor(level=3)
            for p in full:
                i, j = cut[p], cut[p + 1]
                sizes = np.diff(offsets[i : j + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.array([pack_any(ids[i:j])], pa.binary()), pa.array([pack_any(sizes)], pa.binary()), pa.array([packer.compress(data[offsets[i] : offsets[j]].tobytes())], pa.binary())],
                    names=["part", "ids", "sizes", "texts"],
                )

    return run


def _packs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    import zstandard

    for ids, sizes, texts in zip(table["ids"], table["sizes"], table["texts"]):
        offsets = np.concatenate([[0], np.cumsum(unpack_any(sizes.as_py(), np.int64))]).astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(texts.as_py(), max_output_size=max(1, int(offsets[-1])))
        yield unpack_any(ids.as_py(), np.int64), np.frombuffer(raw, np.uint8), offsets


class Part:
    """All windows of a part, ordered by hash."""

    def __init__(self, table: pa.Table, shape: Shape):
        h1, h2, at, doc, self.packs, word = [], [], [], [], [], 0
        for ids, data, offsets in _packs(table):
            a, b, c, d, n = window_hashes(data, offsets, shape.window)
            h1.append(a)
            h2.append(b)
            at.append(c + word)
            doc.append(ids[d])
            self.packs.append((ids, data, offsets, n))
            word += int(n.sum())
        self.n_words = word
        self.h1 = np.concatenate(h1) if h1 else np.zeros(0, np.uint64)
        order = np.argsort(self.h1)
        self.h1 = self.h1[order]
        self.h2, self.at, self.doc = (np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (h2, at, doc))
        self.shape = shape
        self.part = int(table["part"][0].as_py()) if table.num_rows else -1

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For both sketch rows: (order of the windows, their run of equal columns, each run's column)."""
        for column in self.shape.columns(self.h1):
            order = np.argsort(column, kind="stable") if (column[1:] < column[:-1]).any() else np.arange(len(column))
            own = column[order]
            new = np.ones(len(own), dtype=bool)
            new[1:] = own[1:] != own[:-1]
            yield order, np.cumsum(new) - 1, own[new]

    def estimated(self, masks: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
        """Windows that the merged sketch estimates to be repeated (indices)."""
        maybe = np.ones(len(self.h1), dtype=bool)
        for k, (order, run, column) in enumerate(self.rows()):
            hot = np.zeros(len(column), dtype=bool)
            cut = _cuts(column >> np.uint64(self.shape.rest_bits), self.shape.route_bits)
            for s, m in masks.items():
                hot[cut[s] : cut[s + 1]] = np.unpackbits(np.frombuffer(m[k], np.uint8), count=cut[s + 1] - cut[s])
            flags = np.zeros(len(maybe), dtype=bool)
            flags[order] = hot[run]
            maybe &= flags
        return np.flatnonzero(maybe)

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the chosen windows: (their order by key, run of equal keys, first of each run, least document of each run)."""
        order = chosen[np.lexsort((self.h2[chosen], self.h1[chosen]))]
        a, b = self.h1[order], self.h2[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.doc[order], first) if len(first) else np.zeros(0, np.int64)
        return order, np.cumsum(new) - 1, first, least


def _table(part: int, kind: int, rows: list[tuple]) -> pa.Table:
    """(part, slice, kind, a, b, c) rows."""
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    n = len(rows)
    return pa.table(
        {"part": pa.array([part] * n, pa.int32()), "slice": pa.array(cols[0], pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "a": pa.array(cols[1], pa.binary()), "b": pa.array(cols[2], pa.binary()), "c": pa.array(cols[3], pa.binary())}
    )


_ROWS = "part int, slice int, kind int, a binary, b binary, c binary"
SKETCH, KEYS = 1, 2


def _sketch(shape: Shape):
    def run(table: pa.Table) -> pa.Table:
        p = Part(table, shape)
        both = []
        for _, run_, column in p.rows():
            more = np.bincount(run_, minlength=len(column)) > 1
            cut = _cuts(column >> np.uint64(shape.rest_bits), shape.route_bits)
            cells = (column & np.uint64((1 << shape.rest_bits) - 1)) << np.uint64(1) | more.astype(np.uint64)
            both.append([pack(cells[i:j]) for i, j in zip(cut[:-1], cut[1:])])
        return _table(p.part, SKETCH, [(s, a, b, None) for s, (a, b) in enumerate(zip(*both)) if a])

    return run


def _merge_sketches(shape: Shape):
    def run(table: pa.Table) -> pa.Table:
        own = table["slice"][0].as_py()
        masks = []
        for name in ("a", "b"):
            count, cells = np.zeros(1 << shape.cell_bits, np.uint8), []
            for x in table[name]:
                c = unpack(x.as_py())
                column = (c >> np.uint64(1)).astype(np.int64)
                count[column] = np.minimum(2, count[column] + 1 + (c & np.uint64(1)).astype(np.uint8))
            for x in table[name]:  # unpacked again: a slice's cells are not kept unpacked
                cells.append(np.packbits(count[(unpack(x.as_py()) >> np.uint64(1)).astype(np.int64)] >= 2).tobytes())
            masks.append(cells)
        rows = [(own, a, b, None) for a, b in zip(*masks)]
        return _table(0, SKETCH, rows).set_column(0, "part", table["part"].cast(pa.int32()))

    return run


def _answers(table: pa.Table, kind: int) -> dict[int, tuple[bytes, bytes]]:
    return {s: (a, b) for s, k, a, b in zip(table["slice"].to_pylist(), table["kind"].to_pylist(), table["a"].to_pylist(), table["b"].to_pylist()) if k == kind}


def _keys(shape: Shape):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        p = Part(table, shape)
        if not len(p.h1):
            return _table(p.part, KEYS, [])
        order, _, first, least = p.keys(p.estimated(_answers(answers, SKETCH)))
        h1, h2 = p.h1[order[first]], p.h2[order[first]]
        cut = _cuts(_top(h1, shape.route_bits), shape.route_bits)
        rows = [(s, pack(h1[i:j]), pack_any(h2[i:j]), pack_any(least[i:j])) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]
        return _table(p.part, KEYS, rows)

    return run


def _unpacked_keys(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h1 of each row of a table of keys; of all: order by key, run of equal keys in it, h1, h2 and document in it; each run's least document)."""
    h1 = [unpack(x.as_py()) for x in table["a"]]
    both, doc = np.concatenate([unpack_any(x.as_py(), np.uint32) for x in table["b"]]), np.concatenate([unpack_any(x.as_py(), np.int64) for x in table["c"]])
    all1 = np.concatenate(h1)
    order = np.lexsort((both, all1))
    a, b, d = all1[order], both[order], doc[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return h1, order, np.cumsum(new) - 1, a, b, d, np.minimum.reduceat(d, np.flatnonzero(new))


def _parted(bits: np.ndarray, sizes: list[int]) -> list[bytes]:
    """One bit an entry, packed for each of the rows that the entries came in."""
    ends = np.cumsum(sizes)
    return [np.packbits(bits[e - n : e]).tobytes() for n, e in zip(sizes, ends)]


def _merge_keys(table: pa.Table) -> pa.Table:
    h1, order, run_, _, _, doc, least = _unpacked_keys(table)
    later = np.zeros(len(order), dtype=bool)
    later[order] = doc > least[run_]
    own = table["slice"][0].as_py()
    rows = [(own, m, None, None) for m in _parted(later, list(map(len, h1)))]
    return _table(0, KEYS, rows).set_column(0, "part", table["part"].cast(pa.int32()))


# the two hops: messages of FAN parts to one group of slices become those of a super-part


def _merged_cells(table: pa.Table, name: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns of each row; all distinct columns, with whether they are met more than once)."""
    cells = [unpack(x.as_py()) for x in table[name]]
    joined = np.concatenate(cells)
    columns, at = np.unique(joined >> np.uint64(1), return_inverse=True)
    count = np.bincount(at, 1 + (joined & np.uint64(1)).astype(np.int64), len(columns))
    return [c >> np.uint64(1) for c in cells], columns, count > 1


def _up(shape: Shape, kind: int):
    def run(table: pa.Table) -> pa.Table:
        group, top = table["slice"][0].as_py() << shape.inner_bits, table["part"][0].as_py() // FAN
        if kind == SKETCH:
            both = []
            for name in ("a", "b"):
                _, columns, more = _merged_cells(table, name)
                cut = _cuts(columns >> np.uint64(shape.cell_bits), shape.inner_bits)
                cells = (columns & np.uint64((1 << shape.cell_bits) - 1)) << np.uint64(1) | more.astype(np.uint64)
                both.append([pack(cells[i:j]) for i, j in zip(cut[:-1], cut[1:])])
            return _table(top, kind, [(group + s, a, b, None) for s, (a, b) in enumerate(zip(*both)) if a])
        _, _, run_, h1, h2, _, least = _unpacked_keys(table)
        first = np.flatnonzero(np.diff(run_, prepend=-1))
        h1, h2 = h1[first], h2[first]
        cut = _cuts(_top(h1, shape.slice_bits) - np.uint64(group), shape.inner_bits)
        return _table(top, kind, [(group + s, pack(h1[i:j]), pack_any(h2[i:j]), pack_any(least[i:j])) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i])

    return run


def _down(shape: Shape, kind: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(0, kind, [])
        group, found, masks = table["slice"][0].as_py(), _answers(answers, kind), []

        def whole(slices: np.ndarray, k: int) -> np.ndarray:
            """The answers to a super-part's entries, given in order of their slices."""
            out, cut = np.zeros(len(slices), dtype=bool), _cuts(slices, shape.inner_bits)
            for s, m in found.items():
                i, j = cut[s - (group << shape.inner_bits)], cut[s + 1 - (group << shape.inner_bits)]
                out[i:j] = np.unpackbits(np.frombuffer(m[k], np.uint8), count=j - i)
            return out

        if kind == SKETCH:
            for k, name in enumerate(("a", "b")):
                cells, columns, _ = _merged_cells(table, name)
                hot = whole(columns >> np.uint64(shape.cell_bits), k)
                masks.append([np.packbits(hot[np.searchsorted(columns, c)]).tobytes() for c in cells])
            rows = [(group, a, b, None) for a, b in zip(*masks)]
        else:
            h1, order, run_, a, _, doc, least = _unpacked_keys(table)
            first = np.flatnonzero(np.diff(run_, prepend=-1))
            slices = _top(a[first], shape.slice_bits) - np.uint64(group << shape.inner_bits)
            later = np.zeros(len(order), dtype=bool)
            later[order] = whole(slices, 0)[run_] | (doc > least[run_])
            rows = [(group, m, None, None) for m in _parted(later, list(map(len, h1)))]
        return _table(0, kind, rows).set_column(0, "part", table["part"].cast(pa.int32()))

    return run


def _asked(messages: DataFrame, shape: Shape, kind: int) -> DataFrame:
    """The slices' answers to the parts' messages."""
    merge = _merge_sketches(shape) if kind == SKETCH else _merge_keys
    if shape.route_bits == shape.slice_bits:
        return messages.groupBy("slice").applyInArrow(merge, _ROWS)
    top = F.floor(F.col("part") / FAN).cast("int")
    answers = messages.groupBy("slice", top.alias("top")).applyInArrow(_up(shape, kind), _ROWS).groupBy("slice").applyInArrow(merge, _ROWS)
    of_group = answers.groupBy(F.shiftright("slice", shape.inner_bits).alias("slice"), F.col("part").alias("top"))
    return messages.groupBy("slice", top.alias("top")).cogroup(of_group).applyInArrow(_down(shape, kind), _ROWS)


_RESULT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def _cut(shape: Shape, texts: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        p = Part(table, shape)
        cover = np.zeros(p.n_words + 1, np.int64)
        if len(p.h1):
            order, run_, first, least = p.keys(p.estimated(_answers(answers, SKETCH)))
            later, found = np.zeros(len(first), dtype=bool), _answers(answers, KEYS)
            cut = _cuts(_top(p.h1[order[first]], shape.route_bits), shape.route_bits)
            for s, (m, _) in found.items():
                later[cut[s] : cut[s + 1]] = np.unpackbits(np.frombuffer(m, np.uint8), count=cut[s + 1] - cut[s])
            gone = order[later[run_] | (p.doc[order] > least[run_])] if len(first) else order
            np.add.at(cover, p.at[gone], 1)
            np.add.at(cover, p.at[gone] + shape.window, -1)
        keep = np.cumsum(cover[:-1]) == 0
        out, word = [], 0
        for ids, data, offsets, n in p.packs:
            for k, doc in enumerate(ids.tolist()):
                own = data[offsets[k] : offsets[k + 1]].tobytes().split()
                stays = keep[word : word + len(own)]
                word += len(own)
                removed = len(own) - int(stays.sum())
                kept = b" ".join(compress(own, stays.tolist()) if removed else own)
                out.append((None if doc == NULL_ID else doc, len(own), removed, kept.decode() if texts else None, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) if out else [[], [], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("doc_id", "n_words", "n_removed", "kept", "kept_sha256"), cols, kinds)})

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True, part_bytes: int = PART_BYTES, slice_windows: int = SLICE_WINDOWS, columns: int = COLUMNS, routes: int = ROUTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256`` for every row of ``docs`` (kept only if ``texts``).

    A word goes if a window that covers it also starts in a document with a smaller id. Kept words are
    joined by single spaces. A null text has no words. A null id counts as larger than any other; rows with
    one id, or with null ids, take nothing from each other. Extra columns do no harm; no rows give no rows.
    Windows count as equal when 96 bits of their hashes are, of which 32 rest on other hashes of the words.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = partitions(docs.sparkSession)
    parts = max(-(-total // part_bytes), min(dealt, -(-total // (part_bytes >> 4))), 1)
    windows = total // 6 + 1
    slice_bits = max(-(-windows // slice_windows), min(dealt, -(-windows // max(1, slice_windows >> 6)))).bit_length()
    cell_bits = max(6, (columns * windows >> slice_bits).bit_length())
    shape = Shape(slice_bits, cell_bits, window, min(slice_bits, routes.bit_length() - 1))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    # rows that repeat one document are dealt apart by the task that reads them
    part = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(parts)).cast("int")
    rows = docs.select(part.alias("part"), doc.alias("doc"), "text")
    # written, so that all passes, and tasks that are run again, find the same rows in a part
    packed = written(rows.mapInArrow(_deal(parts), "part int, ids binary, sizes binary, texts binary"), "substring-parts", compression="none")
    repeated = _asked(packed.groupBy("part").applyInArrow(_sketch(shape), _ROWS), shape, SKETCH)
    later = _asked(packed.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(_keys(shape), _ROWS), shape, KEYS)
    return packed.groupBy("part").cogroup(repeated.unionByName(later).groupBy("part")).applyInArrow(_cut(shape, texts), _RESULT)
