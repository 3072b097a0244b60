import hashlib
import random

import numpy as np
import pytest

from webloom.llm import sentencepiece as sp

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "hello world", "  two  spaces   x", "a\nb\tc", "▁x", "é" * 40, "日本語テキスト", "😀😀 ok", "-" * 40, "a" * 90, " " * 100, "\n" * 60, "xxx" + " " * 17 + "y"]


@pytest.fixture(scope="module")
def vocabulary():
    return sp.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(vocabulary, n=300):
    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz   \n▁éß中=-#/*0123456789ABC😀"
    pieces = [vocabulary.texts[i] for i in sorted(vocabulary.texts) if i < vocabulary.n]
    out = list(ODD)
    out += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120))) for _ in range(n)]
    return out + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 40))).replace("▁", " ") for _ in range(n)]


def test_batches_against_the_library(vocabulary, library):
    own = texts(vocabulary)
    ids, at = vocabulary.encode(own)
    want = library.encode(own)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == want
    assert vocabulary.decode(ids, at) == [library.decode(w) for w in want]


def test_lanes_and_pieces_of_any_size_against_the_library(library, monkeypatch):
    own = texts(sp.Vocabulary(PATH), 12)
    want = library.encode(own)
    for whole, stretch, piece in ((False, 3, 1 << 20), (True, 64, 1 << 20), (True, 7, 50), (False, 64, 50), (True, 1, 11), (False, 5, 1)):
        v = sp.Vocabulary(PATH)
        v.separable = v.separable and not whole  # whole texts as one lane
        monkeypatch.setattr(sp, "STRETCH", stretch)
        monkeypatch.setattr(sp, "PIECE_CHARS", piece)
        some = own if piece > 1 else own[:20]
        ids, at = v.encode(some)
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == want[: len(some)], (whole, stretch, piece)
        assert v.decode(ids, at) == [library.decode(w) for w in want[: len(some)]]


def test_memory_does_not_grow_with_a_text(vocabulary, library, monkeypatch):
    import tracemalloc

    monkeypatch.setattr(sp, "PIECE_CHARS", 1 << 14)
    peaks = []
    for n in (50_000, 400_000):
        text = ("the house of xyzzy " * (n // 19 + 1))[:n]
        tracemalloc.start()
        size = sum(len(ids) for ids in vocabulary._long(text))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert size == len(library.encode(text))
    assert peaks[1] < 1.3 * peaks[0]


def test_a_segment_of_any_length_commits_as_it_goes(vocabulary, library, monkeypatch):
    monkeypatch.setattr(sp, "PIECE_CHARS", 500)
    seen = []
    some = sp.Vocabulary._some
    monkeypatch.setattr(sp.Vocabulary, "_some", lambda self, ready, *a: seen.append(len(ready[0])) or some(self, ready, *a))
    text = "".join(random.Random(2).choice("abcdefghij") for _ in range(6000))
    got = np.concatenate(list(vocabulary._long(text)))
    assert got.tolist() == library.encode(text) and max(seen) < 500 + 4 * vocabulary.longest


def test_unigram_against_a_full_viterbi(vocabulary, monkeypatch):
    v = sp.Vocabulary(PATH)
    v.bpe = False
    v.scores = np.where(np.isfinite(v.scores), np.maximum(v.scores, -40_000.0) / 1000, 0) - 9
    v.scores[v.n :] = -60.0
    v._tables()
    rnd = random.Random(3)
    for r in range(200):
        monkeypatch.setattr(sp, "STRETCH", (64, 5, 1)[r % 3])
        t = "▁" + "".join(rnd.choice(["the", "in", "er", "ation", "x", "q", "é", "中", "😀", "▁a", "▁"]) for _ in range(rnd.randint(1, 25)))
        best = {0: (0.0, [])}
        for i in range(1, len(t) + 1):
            ways = []
            for j in range(max(0, i - v.longest), i):
                p = v.ids.get(t[j:i], v.unknown if i - j == 1 else None)
                if p is not None:
                    ways.append((best[j][0] + v.scores[p], best[j][1] + [p]))
            best[i] = max(ways, key=lambda x: x[0])
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        got, count, done, _ = v._lanes(codes, np.array([0]), np.array([len(t)]), np.array([sp._NONE]), np.array([True]))
        assert count[0] == len(got) and done[0] == len(t)
        assert abs(sum(v.scores[p] for p in got) - best[len(t)][0]) < 1e-6
        ids, _ = v.encode([t[1:].replace("▁", " ")])
        plain = [p for p in ids.tolist()]
        want = []
        for p, c in zip(got, np.cumsum([0] + [int(v.length[p]) for p in got])):
            want += [p] if p < v.n else [int(v.byte_ids[b]) for b in t[c].encode()]
        assert plain == want


def test_clashing_columns_are_replaced(spark, vocabulary):
    df = spark.createDataFrame([(1, "hello world", "old", 3)], "doc_id long, text string, IDS string, n_ids int")
    both = sp.encode(df, vocabulary)
    assert both.columns == ["doc_id", "text", "n_ids", "ids"]
    assert [r.text for r in sp.decode(both, vocabulary).collect()] == ["hello world"]


def test_frames(spark, vocabulary, library):
    rows = [(i, t, [7]) for i, t in enumerate(ODD)] + [(None, None, None), (101, "again", None), (2, "long " * 30_000, None), (3, "x" * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 array<int>")
    got = {(r.doc_id, r.n_ids): r for r in sp.encoding_report(df, vocabulary).collect()}
    for d, t, _ in rows:
        want = library.encode(t or "")
        r = got[d, len(want)]
        back = library.decode(want) if want else ""
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<i4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest() and r.round_trip == (back == (t or ""))
    both = sp.decode(sp.encode(df, vocabulary), vocabulary, column="back").collect()
    assert all(r.back == r.text or "▁" in r.text for r in both if r.text is not None) and [r.ids for r in both if r.text is None] == [None]
    assert sp.encoding_report(df.limit(0), vocabulary).count() == 0
