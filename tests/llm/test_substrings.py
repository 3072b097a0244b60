import hashlib
import random

import numpy as np

from webloom.llm import substrings, textvec


def brute(rows, window=13):
    ident = lambda d: substrings.NULL_ID if d is None else d
    white = " \t\n\x0b\x0c\r"
    least, split = {}, []
    for d, t, *_ in rows:
        w = "".join(" " if c in white else c for c in t or "").split(" ")
        w = [x for x in w if x]
        split.append(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(ident(d), least.get(k, ident(d)))
    out = []
    for (d, *_), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < ident(d):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for high in (3, 1 << 20, 1 << 63):
        v = np.unique(rng.integers(0, high, 1000, dtype=np.uint64))
        assert (substrings.unpack(substrings.pack(v)) == v).all()
    v = rng.integers(-5, 1 << 40, 77)
    assert (substrings.unpack_any(substrings.pack_any(v), np.int64) == v).all()
    assert len(substrings.unpack(substrings.pack(v[:0]))) == 0


def rows_of(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "naïve", "a\xa0b", " ", "##"]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(13, 60))] for _ in range(8)]
    rows = []
    for i in range(70):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(passages)
        if i % 2:
            w += passages[0]
        rows.append((rnd.randint(0, 1 << 40), rnd.choice([" ", "\n", " \t", "\x0b"]).join(w), i))
    rows += [(5, None, 0), (6, "", 0), (7, " ".join(passages[1][:12]), 0), (None, " ".join(passages[0]), 0), (None, " ".join(passages[0]), 1), (None, "x " * 40, 2)]
    rows += [rows[3], (rows[4][0], rows[9][1], 1), (8, "ab " * 60_000 + " ".join(passages[2]), 1), (9, "ab " * 20, 1)]
    return rows


def test_against_brute_force(spark):
    for seed, settings in ((1, {}), (2, {"part_bytes": 4096, "slice_windows": 512}), (3, {"columns": 0, "part_bytes": 8192, "slice_windows": 256})):
        rows = rows_of(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
        got = substrings.without_repeats(df, **settings).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows))), settings


def test_two_hops_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FAN", 3)
    ups = []
    up = substrings._up
    monkeypatch.setattr(substrings, "_up", lambda shape, kind: ups.append((kind, shape.slice_bits, shape.route_bits)) or up(shape, kind))
    rows = rows_of(4)
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    for settings in ({"part_bytes": 4096, "slice_windows": 2048, "routes": 4}, {"columns": 0, "part_bytes": 8192, "slice_windows": 1024, "routes": 1}):
        got = substrings.without_repeats(df, **settings).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows))), settings
    assert [(k, r) for k, _, r in ups] == [(1, 2), (2, 2), (1, 0), (2, 0)] and all(s > r for _, s, r in ups)


def test_words_whose_polynomials_collide_stay_apart():
    bits = [bin(i).count("1") & 1 for i in range(1 << 12)]  # Thue and Morse: equal sums under any odd base modulo 2^64
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    data = np.frombuffer((a + b).encode(), np.uint8)
    starts, ends = np.array([0, len(a)]), np.array([len(a), 2 * len(a)])
    assert len(set(textvec.word_hashes(data, starts, ends).tolist())) == 1
    assert len(set(textvec.word_marks(data, starts, ends).tolist())) == 2
    _, h2, _, _, _ = substrings.window_hashes(np.frombuffer((a + " x " + b + " x").encode(), np.uint8), np.array([0, 2 * len(a) + 5]), 2)
    assert h2[0] != h2[2]


def test_repeats_of_one_row_are_dealt_apart(spark):
    df = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string").crossJoin(spark.range(400)).repartition(8).drop("id")
    seen = []
    real = substrings.written
    try:
        substrings.written = lambda table, *a, **b: seen.append(real(table, *a, **b)) or seen[-1]
        got = substrings.without_repeats(df, part_bytes=2000).collect()
    finally:
        substrings.written = real
    assert len(got) == 400 and {r.n_removed for r in got} == {0} and seen[0].select("part").distinct().count() > 3


def test_no_rows(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
