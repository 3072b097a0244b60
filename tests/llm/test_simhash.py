import random

import numpy as np
import xxhash

from webloom.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_golay_code_is_perfect():
    v = np.arange(1 << 23, dtype=np.uint32)
    assert (np.bincount(simhash.nearest(v)) == 2048).all()


def test_keys_meet_within_radius_two_and_are_six_at_most():
    rng = np.random.default_rng(1)
    for bits in (23, 22, 21):
        v = rng.integers(0, 1 << bits, 300, dtype=np.uint32)
        row, key = simhash.golay_keys(v, bits)
        own = [set(key[row == i]) for i in range(len(v))]
        assert max(map(len, own)) <= 6
        for i in range(len(v)):
            a, b = rng.choice(bits, 2, replace=False)
            _, other = simhash.golay_keys(v[i : i + 1] ^ np.uint32(1 << a | 1 << b), bits)
            assert own[i] & set(other)


def test_bucket_keys_lose_no_link():
    rnd = random.Random(2)
    for _ in range(400):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.randint(0, 4)):
            y ^= 1 << b
        _, a = simhash.bucket_keys(np.array([x], np.uint64))
        _, b = simhash.bucket_keys(np.array([y], np.uint64))
        assert set(a) & set(b)


def test_components_against_brute_force_on_fingerprints(spark):
    rnd = random.Random(3)
    fps = []
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 5, 40])):
            fps.append(x)
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
    fps = list(dict.fromkeys(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3))
    root = {r.node: r.root for r in simhash.components(links).collect()}
    got, want = {}, {}
    for s, w in zip(signed, brute_components(fps)):
        got.setdefault(root.get(s, s), set()).add(s)
        want.setdefault(w, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def forest_of(pairs, fps):
    label = {int(x): int(x) for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for got, x in pairs:
        for a, b in zip(got.tolist(), x.tolist()):
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    return {x: root(x) for x in label}


def test_a_split_bucket_loses_no_link():
    rng = np.random.default_rng(5)
    for varying, n, groups in ((40, 3000, 300), (14, 3000, 30), (5, 30, 3), (64, 2000, 0)):
        bits = np.uint64(1) << rng.choice(64, varying, replace=False).astype(np.uint64)
        fps = [np.uint64(sum(int(b) for b in bits[rng.random(varying) < 0.5])) for _ in range(n - groups)]
        for _ in range(groups):  # chains within the radius
            x = fps[rng.integers(len(fps))]
            fps.append(x ^ np.bitwise_or.reduce(rng.choice(bits, rng.integers(1, 5), replace=False)))
        fps = rng.permutation(np.unique(np.array(fps, np.uint64)))
        for most in (1, 16, 500):
            found = list(simhash._bucket(fps, most))
            assert all((np.bitwise_count(a ^ b) <= 4).all() for a, b in found)
            assert forest_of(found, fps) == forest_of(simhash._walk(fps), fps)


def test_a_large_bucket_of_unlike_fingerprints_is_not_compared_in_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 1 << 42, 60_000, dtype=np.uint64))
    compared = []
    popcount = simhash._popcount
    monkeypatch.setattr(simhash, "_popcount", lambda x: compared.append(len(x)) or popcount(x))
    near = fps[:1] ^ np.uint64(0b1111)
    linked = [(a, b) for a, b in simhash._bucket(np.append(fps, near))]
    assert {int(near[0]), int(fps[0])} <= {int(x) for pair in linked for w in pair for x in w}
    assert sum(compared) < len(fps) ** 2 / 50


def test_documents_against_brute_force(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 300))] for _ in range(20)]
    texts = [None, "", " \n\t", "One", "a b\x0bC\rd", "é É ü"]
    for b in base:
        texts += [" ".join(b), " ".join(b).upper(), "\n".join(b[:-1] + ["x"])]
    texts += ["long " * 20_000, " ".join(base[0])]
    rows = [(i if i != 5 else None, t, "clash", 1.5) for i, t in enumerate(texts)] + [(3, "One", "again", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id double")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [brute_fp(t) for _, t, *_ in rows]
    comp = brute_components(fps)
    least = {}
    for (d, *_), c in zip(rows, comp):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    assert got == sorted(((d is None, d or 0, f, least.get(c)) for (d, *_), f, c in zip(rows, signed, comp)), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
