"""Toxicity by multiple-instance learning.

Only documents carry labels, but it is a sentence that offends. A sentence's probability is logistic in
its hashed words and their first letters (so inflected forms of a stem count as one); a document's is the
noisy-or of its sentences, 1 - prod(1 - p): it is toxic if any sentence is. A sentence without a telling word counts as 0. Training the document's likelihood therefore hands each label to the sentences that
explain it, and afterwards the same sentence scores say where a document offends.

The model is fitted on a bounded sample of labelled rows: about ``TRAIN_ROWS`` of each label, those with the
smallest hashes, none longer than ``ROW_BYTES``, fewer of them if they have more than ``TRAIN_BYTES`` together
(that is what the driver receives at most). It is a vector of ``2**FEATURE_BITS`` numbers, so what is sent to
the executors has a fixed size. Scoring reads whole texts, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from webloom.llm.common import hash_sample
from webloom.llm.textvec import mix64, pieces, spans, utf8, word_hashes
from webloom.workspace import written

#: Labelled rows of each label used for fitting, about; bits of a feature's index.
TRAIN_ROWS, FEATURE_BITS = 4000, 18
#: Bytes of text used for fitting at most, in one row and in all.
ROW_BYTES, TRAIN_BYTES = 1 << 20, 64 << 20
#: Steps of the bias, against those of the weights.
BIAS_RATE = 0.3
#: Bytes of the beginnings of words that are features besides the word.
BEGINNINGS = (3, 4, 5, 6, 7, 8)

# bytes that belong to a word: letters and digits of ASCII, and every byte of a longer code point
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?\n")] = True


def features(data: np.ndarray, offsets: np.ndarray, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, its sentence, text of each sentence, first byte and end of each sentence), for texts in UTF-8.

    A sentence ends at a full stop, an exclamation or question mark, or a line's end. A text without a word
    has no sentence; a word repeated at once counts once.
    """
    lower = _LOWER[data]
    starts, ends, text = spans(_LETTER[lower], offsets)
    word = word_hashes(lower, starts, ends)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
    starts, ends, text, word = starts[fresh], ends[fresh], text[fresh], word[fresh]
    n = len(starts)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_STOP[data], out=stops[1:])
    new = np.ones(n, dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    sentence = np.cumsum(new) - 1
    found, at = [word], [sentence]
    padded = np.concatenate([lower, np.zeros(8, np.uint8)])
    head = np.zeros(n, np.uint64)
    for k in range(max(BEGINNINGS)):
        head |= padded[starts + k].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in BEGINNINGS:
            longer = np.flatnonzero(ends - starts > k + 1)
            found.append(mix64(head[longer] ^ mix64(np.array([k + 1], np.uint64))))
            at.append(sentence[longer])
    feature, at = (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(at)
    first = np.flatnonzero(new)
    return feature, at, text[first], starts[first], ends[np.append(first[1:], n) - 1]


class Model:
    """Weights of the features, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int):
        self.weights, self.bias, self.bits = weights, bias, bits

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(probability, text, first byte, end) of each sentence."""
        feature, at, text, first, end = features(data, offsets, self.bits)
        told = np.bincount(at, self.weights[feature], len(text))
        # a sentence without a telling word counts as 0, so that no length of text adds up to toxicity
        return np.where(told > 0, 1 / (1 + np.exp(-np.clip(self.bias + told, -30, 30))), 0.0), text, first, end

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        p, text, *_ = self.sentences(data, offsets)
        return -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-9)), len(offsets) - 1))


def slopes(z: np.ndarray, doc: np.ndarray, labels: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How the documents' mean log loss, each weighted by its share, changes with each sentence's logit ``z``.

    With none = prod(1 - p) the loss is -log(none) for a clean document and -log(1 - none) for a toxic one; so
    the slope is p, or -p * none / (1 - none).
    """
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    none = np.clip(np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(labels))), 1e-9, 1 - 1e-9)
    return (share * np.where(labels == 1, -none / (1 - none), 1.0))[doc] * p / len(labels)


def fit(texts: pa.Array | list[str], labels: np.ndarray, bits: int = FEATURE_BITS, rounds: int = 20, steps: int = 1500, l1: float = 1e-4, least_docs: int = 8, evidence: float = 4.0, weight: float = 2.0, seed: int = 7) -> Model:
    """Minimises the noisy-or log loss with an L1 penalty, by AdaGrad over batches of documents; weights are
    averaged over the last half of the rounds.

    Weights are not negative: words can make a sentence toxic, but no other word makes up for them. So
    features found in fewer than ``least_docs`` texts, or in toxic ones not by ``evidence`` standard deviations
    more than chance would have it (rare words that the fit would learn by heart), keep weight 0. In the loss
    toxic texts together weigh ``weight`` times what clean ones do; without one of the labels the model scores
    0 for everything.
    """
    size = 1 << bits
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(size), -30.0, bits)
    data, offsets = utf8(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    n, df = len(labels), np.zeros((2, size))
    for i, j, part, begins in pieces(data, offsets):
        feature, at, text, *_ = features(part, begins, bits)
        pair = np.unique(text[at] * size + feature)
        for y in (0, 1):
            df[y] += np.bincount(pair[labels[i + pair // size] == y] % size, minlength=size)
    # toxic texts among those with a feature, in standard deviations above what chance would give
    toxic, found = labels.mean(), df.sum(0)
    common = (found >= least_docs) & (df[1] - found * toxic >= evidence * np.sqrt(found * toxic * (1 - toxic)))
    parts, counted = [], 0
    owners = []
    for i, j, part, begins in pieces(data, offsets):
        feature, at, text, *_ = features(part, begins, bits)
        keep = common[feature]
        some, own = np.unique(at[keep], return_inverse=True)  # other sentences can't offend
        parts.append((feature[keep], own + counted))
        owners.append(text[some] + i)
        counted += len(some)
    text = np.concatenate(owners)
    feature, at = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(at, kind="stable")
    feature, at = feature[order], at[order]
    scut = np.searchsorted(text, np.arange(n + 1))
    cut = np.searchsorted(at, scut)
    share = np.where(labels == 1, weight / labels.mean(), 1 / (1 - labels.mean())) / (1 + weight)
    weights, bias, gained, gained_bias = np.zeros(size), -10.0, np.full(size, 1e-3), 1e-3
    mean, mean_bias, taken = np.zeros(size), 0.0, 0
    rng = np.random.default_rng(seed)
    rounds = max(rounds, -(-steps * 64 // n))  # small samples are gone through more often
    for r in range(rounds):
        rate = 1.0 / (1 + 10 * r / rounds / 5)
        for part in np.array_split(rng.permutation(n), max(1, n // 64)):
            lens, slens = cut[part + 1] - cut[part], scut[part + 1] - scut[part]
            if not slens.sum():
                continue
            pick = np.repeat(cut[part] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            base = np.cumsum(slens) - slens
            f = feature[pick]
            local = at[pick] - np.repeat(scut[part], lens) + np.repeat(base, lens)
            doc = np.repeat(np.arange(len(part)), slens)
            z = bias + np.bincount(local, weights[f], int(slens.sum()))
            slope = slopes(z, doc, labels[part], share[part])
            grad = np.bincount(f, slope[local], size)
            moved = np.flatnonzero(grad)
            gained[moved] += grad[moved] ** 2
            step = rate / np.sqrt(gained[moved])
            w = weights[moved] - step * grad[moved]
            weights[moved] = np.maximum(0, w - l1 * step)
            gained_bias += slope.sum() ** 2
            bias -= BIAS_RATE * rate / np.sqrt(gained_bias) * slope.sum()
        if 2 * r >= rounds:  # what single batches do to the weights at the end is averaged out
            mean, mean_bias, taken = mean + weights, mean_bias + bias, taken + 1
    return Model(mean / taken, float(mean_bias / taken), bits)


def sample(docs: DataFrame, labels: DataFrame, allowed, per_label: int = TRAIN_ROWS, label: str = "toxic", row_bytes: int = ROW_BYTES, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``text, label`` of about ``per_label`` ids of each label (0 and 1) among those that ``allowed`` holds for.

    Those with the smallest hashes of the id are taken; of an id's rows one, the least text. An id with both
    labels counts as toxic. Texts of over ``row_bytes`` bytes are not fitted on, and where all have more than
    ``train_bytes``, only those with still smaller hashes are.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    place = F.xxhash64("doc_id")
    # the chosen ids are bounded (2 * per_label or so), so they may be broadcast
    chosen = F.broadcast(hash_sample(known.where(allowed), "label", per_label, place))
    texts = docs.where(allowed & F.col("text").isNotNull() & (F.octet_length("text") <= row_bytes)).select("doc_id", "text")
    rows = written(texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxicity-sample")
    few, n = rows, per_label
    while (total := few.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > train_bytes and n > 1:
        n = max(1, int(min(n, few.count() / 2) * train_bytes / total * 0.9))
        few = hash_sample(rows, "label", n, place)
    return few.select("text", "label")


def train(docs: DataFrame, labels: DataFrame, allowed, per_label: int = TRAIN_ROWS, label: str = "toxic", **settings) -> Model:
    rows = sample(docs, labels, allowed, per_label, label).toArrow()
    text = rows["text"].combine_chunks()
    label = np.asarray(rows["label"]).astype(np.int64)
    order = np.lexsort((label, [xxh64_intdigest(t.as_buffer()) for t in text]))  # not that of arrival
    return fit(text.take(pa.array(order)), label[order], **settings)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row; a null or wordless text scores 0. Whole texts are read.

    A column of that name that ``docs`` has is replaced. Repeated rows and ids are scored one by one; no rows
    give no rows.
    """
    docs = docs.drop(column)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            data, offsets = utf8(b.column("text"))
            out = np.zeros(b.num_rows)
            for i, j, part, at in pieces(data, offsets):
                out[i:j] = m.documents(part, at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.clip(out, 0, 1))], names=[*b.schema.names, column])

    return docs.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, sentence, begin, end, score`` for sentences that score ``least`` or more: character spans of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, _, part, at in pieces(data, offsets):
                p, text, first, end = m.sentences(part, at)
                hit = np.flatnonzero(p >= least)
                chars = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
                rows = text[hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(rows + i)),
                        pa.array([bytes(part[x:y]).decode() for x, y in zip(first[hit], end[hit])], pa.string()),
                        pa.array(chars[first[hit]] - chars[at[rows]]),
                        pa.array(chars[end[hit]] - chars[at[rows]]),
                        pa.array(p[hit]),
                    ],
                    names=["doc_id", "sentence", "begin", "end", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sentence string, begin long, end long, score double")
