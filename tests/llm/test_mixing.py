import hashlib
import random

from webloom.llm import mixing


def key(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def brute(rows, weights=(1, 2, 3)):
    size = [len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]) for _, t, *_ in rows]
    total = {}
    for (_, _, s, *_), n in zip(rows, size):
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size))
    while True:
        share = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * share >= 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * share for s in open_}
    return size, total, target


def rows_of(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["a", "a", "a", "b", "é", "Z", "", None])
        rows.append((i, " \n".join("w" * rnd.randint(1, 5) for _ in range(rnd.choice([0, 1, 5, 30]))), source, "clash", 1))
    return rows + [(None, "x y", "a", "", 0), (None, None, None, "", 0), (3, "again and again", "b", "", 0), (n, "word " * 20_000, "long", "", 0), (n + 1, None, "empty", "", 0)]


def test_against_brute_force(spark):
    for n, seed in ((300, 1), (12, 2)):
        rows = rows_of(n, seed)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, _src int").repartition(3)
        got = mixing.mix(df).collect()
        size, total, target = brute(rows)
        assert len(got) == len(rows)
        want = {}
        for r, n_ in zip(rows, size):
            want.setdefault((r[0], n_), []).append((total[r[2]], target[r[2]]))
        words = {}
        for g in got:
            assert any(g.source_size == s and abs(g.target - t) < 1e-6 for s, t in want[g.doc_id, g.size])
            assert g.taken == g.size * g.copies and 0 <= g.copies <= 3
            words[g.source_size, g.target] = words.get((g.source_size, g.target), 0) + g.taken
        groups = {}  # by source and hash: what stays together
        for r, n_ in zip(rows, size):
            groups[r[2], key(r[0])] = groups.get((r[2], key(r[0])), 0) + n_
        for s in total:
            largest = max(v for (q, _), v in groups.items() if q == s)
            if sum(1 for q in total if (total[q], target[q]) == (total[s], target[s])) == 1:
                assert abs(words[total[s], [g.target for g in got if g.source_size == total[s] and abs(g.target - target[s]) < 1e-6][0]] - target[s]) <= largest / 2 + 1e-6
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
        mixed = mixing.mixed(df)
        assert mixed.columns == df.columns and mixed.count() == sum(g.copies for g in got)


def test_a_smaller_share_takes_a_subset(spark):
    df = spark.createDataFrame(rows_of(200, 3), "doc_id long, text string, source string, a string, b int")
    small = {r.doc_id: r.copies for r in mixing.mix(df, share=0.3, weights=(1,)).collect() if r.doc_id is not None and r.doc_id != 3}
    large = {r.doc_id: r.copies for r in mixing.mix(df, share=0.6, weights=(1,)).collect() if r.doc_id is not None and r.doc_id != 3}
    assert all(small[d] <= large[d] for d in small) and sum(small.values()) < sum(large.values())


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mixed(df).count() == 0
