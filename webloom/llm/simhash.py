"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles. Two fingerprints
link when at most four bits differ. Candidates come from the perfect binary Golay code (23 bits, 12 of
them free): every 23-bit word lies within three bits of exactly one codeword. The keys of a word are the
codewords nearest to the words of the ball of radius one around it (never more than six); two words that
differ in at most two bits have the middle between them in both balls and so share a key.

The 64 bits fall into three segments (22, 21, 21 bits; filled up with zeros). Four differing bits leave
these cases, and each has its tables:

* a segment has none, and then another has two at most: the first exactly, with a Golay key of the second;
* every segment has at least one, and then two have exactly one and the third at most two: in each of the
  two, one half is equal; both halves exactly, with a Golay key of the third.

Rows with equal keys meet in one partition, and every candidate is verified on its fingerprints. A bucket
is never expanded into pairs: a walk over it takes from the unlinked rest all that link to a member, so a
bucket of one cluster costs one comparison a member, and yields one link a member. A large bucket of unlike
fingerprints is split again: the bits that vary in it are dealt into six groups, and two fingerprints within
four bits agree in two whole groups at least, so each pair of groups gives sub-buckets, which are split in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from webloom.llm.components import components
from webloom.workspace import partitions, written

#: Bits that may differ; words of a shingle; seed of XXH64.
RADIUS, SHINGLE, SEED = 4, 4, 42
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Entries that a partition of the buckets should hold at most; their number follows from it.
PARTITION_ENTRIES = 1_000_000
#: Fingerprints of a bucket that are compared without splitting it.
WALK = 4096

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_POLYNOMIAL = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the Golay code


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text in UTF-8; 0 if it has no word."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        parts = [joined[a:b] for a, b in zip((ends - size)[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
        hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    lanes = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    ones = (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(_WEIGHT[2 * ones > len(hashes)].sum(dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        fps = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (a signed long holding the 64 bits) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 4,096 messages, and the error pattern of each of the 2,048 syndromes; by the code's rule."""

    def rest(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= _POLYNOMIAL << (k - 11)
        return v

    remainder = np.array([rest(m << 11) for m in range(4096)], dtype=np.uint32)
    error = np.zeros(2048, dtype=np.uint32)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            error[rest(e)] = e
    return remainder, error


_REMAINDER, _ERROR = _tables()


def nearest(v: np.ndarray) -> np.ndarray:
    """The index (0 to 4095) of the codeword nearest to each 23-bit word."""
    return (v ^ _ERROR[_REMAINDER[v >> np.uint32(11)] ^ (v & np.uint32(0x7FF))]) >> np.uint32(11)


def golay_keys(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all distinct keys of each word of ``bits`` bits."""
    ball = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(bits, dtype=np.uint32)])
    found = np.sort(nearest(v[:, None] ^ ball[None, :]), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, at = np.nonzero(new)
    return row, found[row, at]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all buckets of each fingerprint; any two within ``RADIUS`` bits share one."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)) for at, bits in SEGMENTS]
    golay = [golay_keys(p.astype(np.uint32), bits) for p, (_, bits) in zip(parts, SEGMENTS)]
    halves = [(p & np.uint64(0x7FF), p >> np.uint64(11)) for p in parts]
    rows, keys, table = [], [], 0
    for k in range(3):
        row, code = golay[k]
        code = code.astype(np.uint64)
        a, b = (i for i in range(3) if i != k)
        exact = [parts[a], parts[b], *((x | y << np.uint64(11)) for x in halves[a] for y in halves[b])]
        for x in exact:
            rows.append(row)
            keys.append(code | x[row] << np.uint64(12) | np.uint64(table) << np.uint64(40))
            table += 1
    return np.concatenate(rows), np.concatenate(keys)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _spread(parts: int):
    from webloom.llm.textvec import mix64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                fps = np.asarray(b.column("fp").slice(k, 4096)).view(np.uint64)
                row, key = bucket_keys(fps)
                to = (mix64(key) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(parts + 1))
                key, own = key[order], fps[row[order]]
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full.astype(np.int32)), pa.array([key[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary()), pa.array([own[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary())],
                    names=["part", "keys", "fps"],
                )

    return run


def _walk(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(member, where it was reached from) within one bucket of distinct fingerprints."""
    rest = fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = _popcount(rest ^ x) <= RADIUS
            if near.any():
                got, rest = rest[near], rest[~near]
                yield got, np.full(len(got), x)
                todo.extend(got)


def _bucket(fps: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(member, one it links to) that connect what links within one bucket of distinct fingerprints.

    Beyond ``most`` of them the bucket is split as long as that saves comparisons; no link is lost either way.
    """
    most = WALK if most is None else most
    split = _split(fps) if len(fps) > most else []
    if not split or sum(int((size * size).sum()) for _, _, size in split) > len(fps) ** 2 // 2:
        yield from _walk(fps)
        return
    for order, starts, size in split:
        own = fps[order]
        for s, n in zip(starts[size > 1].tolist(), size[size > 1].tolist()):
            yield from _bucket(own[s : s + n], most)


def _split(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(order, starts, sizes) of the sub-buckets for each two of six groups of the bits that vary; none if fewer vary."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    ones = np.array([np.count_nonzero(fps & b) for b in bits])
    even = np.minimum(ones, len(fps) - ones)
    varying = np.flatnonzero(even)
    varying = varying[np.argsort(-even[varying], kind="stable")]  # each group gets some that tell much
    groups = [np.bitwise_or.reduce(bits[varying[k :: RADIUS + 2]], initial=np.uint64(0)) for k in range(RADIUS + 2)]
    out = []
    for a, b in combinations(groups, 2) if len(varying) >= RADIUS + 2 else ():
        key = fps & (a | b)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        out.append((order, starts, np.diff(np.append(starts, len(key)))))
    return out


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components as the links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:  # jump to the root
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, fps = [], []
    for b in batches:
        keys += [np.frombuffer(x.as_py(), np.uint64) for x in b.column("keys")]
        fps += [np.frombuffer(x.as_py(), np.uint64) for x in b.column("fps")]
    if not keys:
        return
    key, fp = np.concatenate(keys), np.concatenate(fps)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    us, vs = [], []
    two = starts[size == 2]
    near = _popcount(fp[two] ^ fp[two + 1]) <= RADIUS
    us.append(fp[two][near])
    vs.append(fp[two + 1][near])
    for s, n in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
        held = len(us)
        for got, x in _bucket(fp[s : s + n]):
            us.append(got)
            vs.append(x)
            if len(us) - held > 100_000:  # sub-buckets repeat links
                us[held:], vs[held:] = ([w] for w in _forest(np.concatenate(us[held:]), np.concatenate(vs[held:])))
    u, v = _forest(np.concatenate(us), np.concatenate(vs))
    for k in range(0, len(u), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 10_000].view(np.int64)), pa.array(v[k : k + 10_000].view(np.int64))], names=["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fp`` that connect what links at ``RADIUS`` bits or fewer."""
    n = distinct.count()
    parts = max(partitions(distinct.sparkSession), -(-n * 100 // PARTITION_ENTRIES))
    spread = distinct.select("fp").mapInArrow(_spread(parts), "part int, keys binary, fps binary")
    return spread.repartitionById(parts, "part").mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, root: bool = False) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``; the component is named by its smallest doc_id.

    Rows with one fingerprint (exact copies among them) are one node, whatever their number. A null or
    wordless text has fingerprint 0 and links like any other. A null doc_id names no component; a component
    of such rows alone has a null id. Repeated ids and extra columns do no harm; no rows give no rows.
    With ``root`` a column of that name tells components apart that an id shared by unlike texts names alike.
    """
    more = ["root"] if root else []
    own = written(fingerprints(docs), "simhash-fp")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    member = components(links(nodes)).select(F.col("node").alias("fp"), "root")
    rooted = written(nodes.join(member, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(written(named, "simhash-named"), "root").select("fp", "component_id", *more), "simhash-components")
    return own.join(named, "fp").select("doc_id", "fp", "component_id", *more)
