import hashlib
import random

from webloom.llm import lines

SHARED = ["This line is certainly longer than forty code points, No. %d" % i for i in range(6)]


def brute(rows):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    ident = lambda d: -(1 << 63) if d is None else d
    holders = {}
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(ident(d))
    out = []
    for d, t, *_ in rows:
        own = (t or "").split("\n")
        keep = [x for x in own if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == ident(d)]
        out.append((d, len(own), len(own) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest(), "\n".join(keep)))
    return out


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        own = [rnd.choice(SHARED) if rnd.random() < 0.5 else f"own line {i} {rnd.random()} " + "x" * rnd.randint(0, 40) for _ in range(rnd.randint(1, 12))]
        if i % 3 == 0:
            own.append(" \t" + SHARED[0].upper() + "\r")
        if i % 7 == 0:
            own += ["", own[0], own[0]]
        rows.append((i, "\n".join(own), "a", 1, 2))
    rows += [(n, None, "b", 0, 0), (n + 1, "", "c", 0, 0), (None, SHARED[1] + "\n" + SHARED[2], "n", 0, 0), (None, "other\n" + SHARED[1], "n", 0, 0)]
    rows += [(3, SHARED[3] + "\n" + "é" * 39 + "\n" + "é" * 40, "again", 0, 0), rows[5], (n + 2, (SHARED[4] + "\n") * 3000, "long", 0, 0)]
    return rows + [(n + 10 + i, "é" * 39 + "\n" + "é" * 40, "edge", 0, 0) for i in range(6)]


def test_against_brute_force_over_many_ranges(spark):
    rows = rows_of(60)
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, pos long, keep long").repartition(5)
    want = brute(rows)
    for parts in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = lines.line_report(df).collect()
            text = lines.without_shared_lines(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(map(str, map(tuple, got))) == sorted(str(w[:4]) for w in want)
        assert sorted((str(r.doc_id), r.text or "") for r in text) == sorted((str(w[0]), w[4]) for w in want)
        assert {r.text for r in text if r.row == "b"} == {None} and text[0].asDict().keys() == {"doc_id", "text", "row", "pos", "keep"}


def test_no_rows(spark):
    assert lines.line_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
