"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything that isn't a letter becomes a gap, and the n-grams of one to three
characters are hashed into ``2**FEATURE_BITS`` features. Document frequencies are counted over all training
rows in Spark. The weights are fitted on a bounded sample of them (about ``TRAIN_ROWS`` texts of each language,
those with the smallest hashes; fewer of each beyond ``MANY_LANGUAGES`` or where their features are more than
``MOST_VALUES``) by follow-the-regularised-leader, whose elastic-net penalties leave most at zero; a temperature
is then fitted on the part of the sample kept aside. The driver receives the features of sampled texts, never
the texts.
Every language is learned; if their number is beyond what the driver can hold, that is an error. What is
sent to the executors is at most one number a feature and one a feature and language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from webloom.llm.common import hash_sample
from webloom.workspace import written

#: Texts of each language to fit on, about; bits of a feature's index; longest n-gram.
TRAIN_ROWS, FEATURE_BITS, LONGEST = 600, 15, 3
#: Beyond so many languages each has fewer rows, since a row costs as much as there are languages, but ``LEAST_ROWS``.
MANY_LANGUAGES, LEAST_ROWS = 400, 5
#: What the driver holds at most: features that occur times languages (16 bytes each while fitting).
MOST_STATE = 1 << 25
#: Non-zero features of all sampled texts, at most (8 bytes each).
MOST_VALUES = 1 << 24
#: What a text without a letter gets.
UNKNOWN = "und"

_FACTOR, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: Characters of a text that are hashed at once; n-grams reach over from one stretch to the next.
STRETCH = 1 << 18


def _letters() -> np.ndarray:
    """For every code point, itself if it is a letter, else 0."""
    from sys import maxunicode

    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(maxunicode + 1)), np.uint32, maxunicode + 1)


_table: np.ndarray | None = None


def counts(text: str, bits: int = FEATURE_BITS) -> np.ndarray | None:
    """How often each feature occurs in a text; None if it has no letter."""
    global _table
    if _table is None:
        _table = _letters()
    low, before, found, any_ = text.lower(), np.zeros(1, np.uint32), np.zeros(1 << bits), False
    for k in range(0, len(low), STRETCH):
        own = _table[np.frombuffer(low[k : k + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)]
        any_ = any_ or bool(own.any())
        line = np.concatenate([before[-1:], own, np.zeros(int(k + STRETCH >= len(low)), np.uint32)])
        own = line[1:][(line[1:] | line[:-1]) > 0]  # of a run of gaps one stays
        line = np.concatenate([before, own])
        grams, h = [], np.zeros(len(own), np.uint32)
        for n in range(LONGEST):  # h: of the n + 1 characters that end at each of ``own``
            h = h[max(0, len(h) - (len(line) - n)) :]
            h = h * _FACTOR + line[len(line) - n - len(h) : len(line) - n] + np.uint32(n + 1)
            mixed = (h ^ (h >> np.uint32(15))) * _SPREAD
            grams.append((mixed ^ (mixed >> np.uint32(13))) * _FACTOR >> np.uint32(32 - bits))
        found += np.bincount(np.concatenate(grams), minlength=1 << bits)
        before = line[1 - LONGEST :]
    return found if any_ else None


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, rows: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float, bits: int):
        """``rows``: which of ``weights`` is a feature's; those of all zeros share the last."""
        self.languages, self.idf, self.rows, self.weights, self.bias, self.temperature, self.bits = languages, idf, rows, weights, bias, temperature, bits

    def probabilities(self, text: str | None) -> np.ndarray | None:
        found = None if text is None or not self.languages else counts(text, self.bits)
        if found is None:
            return None
        at = np.flatnonzero(found)
        x = found[at] * self.idf[at]
        z = (np.einsum("i,ij->j", x, self.weights[self.rows[at]]) / max(np.sqrt((x * x).sum()), 1e-12) + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def document_frequencies(training: DataFrame, bits: int = FEATURE_BITS) -> tuple[int, np.ndarray]:
    """(texts with a letter, in how many of them each feature occurs), over all rows of ``training``.

    Every task adds up its own rows and passes on one vector of fixed size; these are summed in Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            for t in b.column("text"):
                found = counts(t.as_py(), bits) if t.is_valid else None
                if found is not None:
                    total += found > 0
                    n += 1
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["feature", "n"])

    summed = training.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out, n = np.zeros(1 << bits), 0
    for f, v in zip(summed["feature"].to_pylist(), summed["n"].to_pylist()):
        if f < 0:
            n = v
        else:
            out[f] = v
    return n, out


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, bits: int = FEATURE_BITS, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, aside: int = 5, seed: int = 5) -> Model:
    """FTRL-Proximal over single texts (their features, how often each occurs, the language); every ``aside``-th
    row is kept for the temperature."""
    languages = sorted({y for *_, y in rows})
    place = {y: i for i, y in enumerate(languages)}
    data = []
    for at, n_at, y in rows:
        x = n_at * idf[at]
        data.append((at, (x / max(np.sqrt(x @ x), 1e-12)).astype(np.float32), place[y]))
    occurs = np.zeros(1 << bits, dtype=bool)
    for at, *_ in data:
        occurs[at] = True
    rows_of = np.cumsum(occurs) - 1
    data = [(rows_of[at], x, y) for at, x, y in data]
    size, k = int(occurs.sum()), len(languages)
    if size * k > MOST_STATE:
        raise ValueError(f"{k} languages by {size} features are more than the driver holds ({MOST_STATE}): use fewer bits or languages")
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights_of(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0, w)

    rng = np.random.default_rng(seed)
    kept, held = [d for i, d in enumerate(data) if i % aside], [d for i, d in enumerate(data) if not i % aside]
    known = {y for *_, y in kept}  # a language whose rows are all aside would not be learned
    kept, held = kept + [d for d in held if d[2] not in known], [d for d in held if d[2] in known]
    for _ in range(epochs if k > 1 else 0):
        for i in rng.permutation(len(kept)):
            at, x, y = kept[i]
            at, x = np.append(at, size), np.append(x, 1.0)  # the last is the bias
            w = weights_of(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights_of(np.arange(size + 1))
    model = Model(languages, idf, np.where(occurs, rows_of, size), np.append(w[:-1], np.zeros((1, k)), 0), w[-1], 1.0, bits)
    if held and k > 1:
        logits = np.array([x @ w[at] + w[-1] for at, x, _ in held])
        truth = np.array([y for *_, y in held])

        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]))

        low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
        for _ in range(60):  # golden section: the loss has one minimum in the temperature
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def train(docs: DataFrame, allowed: Column, per_language: int = TRAIN_ROWS, bits: int = FEATURE_BITS, **settings) -> Model:
    """A model of the rows that ``allowed`` holds for and whose ``lang`` and text aren't null, whatever their id.

    A language none of whose texts has a letter can't be learned. Equal texts of one language count once."""
    training = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    n, df = document_frequencies(training, bits)
    languages = training.select("lang").distinct().count()
    if languages * LEAST_ROWS > TRAIN_ROWS * MANY_LANGUAGES:
        raise ValueError(f"{languages} languages are more than the driver can learn ({TRAIN_ROWS * MANY_LANGUAGES // LEAST_ROWS})")
    if languages > MANY_LANGUAGES:
        per_language = min(per_language, max(LEAST_ROWS, int(per_language * (MANY_LANGUAGES / languages) ** 2)))
    place = F.xxhash64("text")
    sampled = hash_sample(training.select("lang", "text"), "lang", per_language, place).distinct()
    vectors = written(sampled.mapInArrow(_vectors(bits), "lang string, place long, feature array<int>, times array<float>"), "language-sample")
    few, k = vectors, per_language
    while (total := few.agg(F.sum(F.size("feature"))).first()[0] or 0) > MOST_VALUES and k > LEAST_ROWS:
        k = max(LEAST_ROWS, int(min(k, few.count() / languages) * MOST_VALUES / total * 0.9))
        few = hash_sample(vectors, "lang", k, F.col("place"))
    got = few.toArrow().sort_by([("place", "ascending"), ("lang", "ascending")])  # not the order of arrival
    lists = [[np.asarray(x.values) for x in got[c].combine_chunks()] if got.num_rows else [] for c in ("feature", "times")]
    return fit(list(zip(*lists, got["lang"].to_pylist())), np.log((1 + n) / (1 + df)) + 1.0, bits, **settings)


def _vectors(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows = []
                for y, t in zip(b.column("lang").slice(k, 256).to_pylist(), b.column("text").slice(k, 256)):
                    found = counts(t.as_py(), bits)
                    if found is not None:
                        at = np.flatnonzero(found)
                        rows.append((y, xxh64_intdigest(t.as_buffer()) - (1 << 63), at.astype(np.int32), found[at].astype(np.float32)))
                names, places, features, times = zip(*rows) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(features, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.float32()))],
                    names=["lang", "place", "feature", "times"],
                )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` (a language of the model; ``und`` for a null text or one without a letter)
    and ``score``, its calibrated probability (1 for ``und``).

    Whole texts are read. Columns of these names that ``docs`` has are replaced; repeated rows and ids are judged
    one by one; no rows give no rows."""
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            names, scores = [], []
            for t in b.column("text"):
                p = m.probabilities(t.as_py())
                k = -1 if p is None else int(p.argmax())
                names.append(UNKNOWN if p is None else m.languages[k])
                scores.append(1.0 if p is None else min(1.0, float(p[k])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema)
