import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import language, queries
from webloom.llm.common import bucket_of_id

SF = "/root/testdata/sf0.01"


def test_counts_do_not_depend_on_stretches(monkeypatch):
    text = "Été, hello  WORLD ñandú 你好 x" * 20
    whole = language.counts(text)
    for size in (1, 2, 7):
        monkeypatch.setattr(language, "STRETCH", size)
        assert (language.counts(text) == whole).all()
    assert language.counts(" 12 !") is None and language.counts("") is None


def test_document_frequencies_against_brute_force(spark):
    rows = [("ab ab",), ("b",), ("",), (None,), ("b",)]
    n, df = language.document_frequencies(spark.createDataFrame(rows, "text string").repartition(3))
    want = sum((language.counts(t) > 0).astype(int) for t in ("ab ab", "b", "b"))
    assert n == 3 and (df == want).all()


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op7_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == truth.keys() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].lang_pred == truth[d] for d in held]) >= 0.95


def plain_fit(rows, idf, epochs, alpha, beta, l1, l2, seed, aside):
    """FTRL-Proximal one weight at a time, from its published rule, over dictionaries."""
    languages = sorted({y for *_, y in rows})
    data = []
    for at, n, y in rows:
        x = [float(a) * idf[f] for f, a in zip(at, n)]
        size = math.sqrt(sum(v * v for v in x))
        data.append(({int(f): np.float32(v / size) for f, v in zip(at, x)}, languages.index(y)))
    z, sums = {}, {}

    def weight(f, k):
        v, n = z.get((f, k), 0.0), sums.get((f, k), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n)) / alpha + l2)

    kept = [d for i, d in enumerate(data) if i % aside]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(kept)):
            x, y = kept[i]
            x = x | {"bias": 1.0}
            w = {(f, k): weight(f, k) for f in x for k in range(len(languages))}
            logits = [sum(v * w[f, k] for f, v in x.items()) for k in range(len(languages))]
            total = sum(math.exp(v) for v in logits)
            for k, v in enumerate(logits):
                error = math.exp(v) / total - (k == y)
                for f, v in x.items():
                    g, n = error * float(v), sums.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / alpha * w[f, k]
                    sums[f, k] = n + g * g
    return weight, [d for i, d in enumerate(data) if not i % aside], languages


def test_fit_against_one_weight_at_a_time():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(90):
        y = "abc"[i % 3]
        at = np.unique(np.concatenate([rng.integers(0, 32, 5), rng.integers(8 * (i % 3), 8 * (i % 3) + 8, 3)]))
        rows.append((at.astype(np.int32), rng.integers(1, 4, len(at)).astype(np.float32), y))
    idf = rng.uniform(1, 3, 32)
    settings = dict(epochs=3, alpha=0.5, beta=1.0, l1=0.3, l2=0.05, seed=5, aside=5)
    weight, held, languages = plain_fit(rows, idf, **settings)
    model = language.fit(rows, idf, bits=5, **settings)
    want = np.array([[weight(f, k) for k in range(3)] for f in range(32)])
    assert np.allclose(model.weights[model.rows], want, atol=1e-5) and np.allclose(model.bias, [weight("bias", k) for k in range(3)], atol=1e-5)
    assert 4 < (want == 0).sum() < 80  # the L1 penalty leaves zeros

    def loss(t):
        total = 0.0
        for x, y in held:
            s = [(sum(float(v) * want[f, k] for f, v in x.items()) + weight("bias", k)) / t for k in range(3)]
            total += math.log(sum(map(math.exp, s))) - s[y]
        return total / len(held)

    assert loss(model.temperature) <= min(loss(math.exp(k / 50)) for k in range(-195, 149)) + 1e-6


def test_clashing_columns_are_replaced_and_null_ids_train(spark):
    rows = [(None, ("the cat and the dog " if i % 2 else "der Hund und die Katze ") + chr(97 + i % 26), "en" if i % 2 else "de", "old", "old") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, Lang_Pred string")
    got = language.predict(df, language.train(df, F.lit(True)))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and all(r.lang == r.lang_pred for r in got.collect())


def test_sampled_features_are_bounded(spark, monkeypatch):
    rows = [(i, " ".join(f"{x}{chr(97 + i % 26)}{chr(97 + i // 26)}" for x in ("alpha", "beta", "gamma")), "xy"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "MOST_VALUES", 3000)
    monkeypatch.setattr(language, "fit", lambda rows, *_, **__: seen.extend(rows))
    language.train(df, F.lit(True))
    assert 20 < len(seen) and sum(len(at) for at, *_ in seen) <= 3000 and {y for *_, y in seen} == {"x", "y"}


def test_edges(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der Hund und die Katze ") * 5, "en" if i % 2 else "de", "x", 0.5) for i in range(40)]
    rows += [(100, None, "en", "", 0.0), (101, "", "en", "", 0.0), (102, "12 !?", None, "", 0.0), (None, "the dog", None, "", 0.0), (3, "der " * 90_000, "de", "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n double")
    model = language.train(df, bucket_of_id("doc_id", 4) != 2)
    got = {(r.doc_id, r.n): r for r in language.predict(df, model).collect()}
    assert [got[d, 0.0].lang_pred for d in (100, 101, 102)] == ["und"] * 3 and got[None, 0.0].lang_pred == "en" and got[3, 0.0].lang_pred == "de"
    assert language.predict(df.limit(0), model).count() == 0
    nothing = language.train(df.where("doc_id < 0"), F.lit(True))
    assert {r.lang_pred for r in language.predict(df, nothing).collect()} == {"und"}


def test_every_language_is_learned(spark, monkeypatch):
    def word(k):
        return "".join(chr(0x4E00 + 3 * k + j) for j in range(3))

    names = [f"l{k:03}" for k in range(420)]
    rows = [(k * 10 + i, word(k), y) for k, y in enumerate(names) for i in range(2 if y == "l419" else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, F.lit(True))
    assert model.languages == names
    got = [names[int(model.probabilities(word(k)).argmax())] for k in range(len(names))]
    assert got == names
    monkeypatch.setattr(language, "MOST_STATE", 1000)
    with pytest.raises(ValueError, match="420 languages"):
        language.train(df, F.lit(True))
