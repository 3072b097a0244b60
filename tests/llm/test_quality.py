import random

from webloom.llm import quality

WHITE = " \t\n\x0b\x0c\r"


def words_of(t):
    return [w for w in "".join(" " if c in WHITE else c for c in t or "").split(" ") if w]


def brute(t):
    w = words_of(t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines), len(lines) - len(set(lines)), len(covered))


def texts():
    rnd = random.Random(1)
    phrase = "one two three four five six seven eight nine"
    out = [None, "", " \t\n", "a", "é" * 30, phrase, f"{phrase} {phrase}", f"{phrase}\n{phrase}\n\n{phrase}", "a " * 100, "# * $ %&|<> x", "a\x0bb\x0cc\rd\xa0e", "w " * 60_000]
    for _ in range(150):
        out.append(rnd.choice([" ", "\n", "  \n"]).join(rnd.choice([phrase, "x", "##", "line", "é ü"]) for _ in range(rnd.randint(0, 30))))
    return out


def test_ledger_against_brute_force(spark):
    rows = [(i if i != 4 else None, t, 9, "clash") for i, t in enumerate(texts())]
    rows.append(rows[6])
    got = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string, n_words int, failed string")).collect()
    want = sorted(str((d, *brute(t))) for d, t, *_ in rows)
    assert sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    judged = quality.apply_policy(quality.ledger(spark.createDataFrame(rows, "doc_id long, text string, n_words int, failed string")), "web-2").collect()
    for r in judged:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept == (r.failed == 0)


def test_ablations_against_counting(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    own = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    masks = [r.failed & quality.mask("web-1") for r in own.collect()]
    for r in quality.ablations(own, "web-1").collect():
        assert r.n_failed == sum(m & quality.BIT[r.rule] != 0 for m in masks) and r.n_only == sum(m == quality.BIT[r.rule] for m in masks)


def test_lone_failures_against_counting(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    own = quality.stored(spark.createDataFrame(rows, "doc_id long, text string"))
    masks = [r.failed & quality.mask("web-1") for r in own.collect()]
    names = {b: n for n, b in quality.BIT.items()}
    for r in quality.lone_failures(own, "web-1").collect():
        bits = r.failed & quality.mask("web-1")
        assert (r.lone_rule, r.lone_docs) == ((names[bits], masks.count(bits)) if bits in names else (None, 0))


def test_no_rows(spark):
    own = quality.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert own.count() == 0 and {r.n_failed for r in quality.ablations(own, "web-2").collect()} == {0}
