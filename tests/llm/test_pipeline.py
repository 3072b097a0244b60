import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tests.llm.test_lines import brute as brute_lines  # noqa: E402
from tests.llm.test_simhash import brute_components, brute_fp  # noqa: E402
from webloom.llm.textvec import utf8  # noqa: E402


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in out.collect()}
        out = stage(spark, out, sf).cache()
        assert out.columns == columns, name
        after = out.collect()
        if name == "toxicity":
            model = corpus_pipeline.toxicity_model(spark, sf)
            scores = {d: model.documents(*utf8(pa.array([r.text]))) for d, r in before.items()}
            assert {r.doc_id for r in after} == {d for d, s in scores.items() if s < corpus_pipeline.TOXIC}
            assert 0.75 * len(before) <= len(after) < len(before)
        elif name == "line_dedup":
            want = {w[0]: w[4] for w in brute_lines([(r.doc_id, r.text) for r in before.values()])}
            assert {r.doc_id: r.text for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "simhash_near_dedup":
            rows = sorted(before.values(), key=lambda r: r.doc_id)
            roots = brute_components([brute_fp(r.text) for r in rows])
            assert sorted(r.doc_id for r in after) == [rows[i].doc_id for i in sorted(set(roots))]
        else:
            from webloom.llm import mixing

            times = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(list(before.values()), docs.schema)).collect()}
            got = {}
            for r in after:
                got[r.doc_id] = got.get(r.doc_id, 0) + 1
                assert r.text == before[r.doc_id].text
            assert got == {d: n for d, n in times.items() if n}
    ids = corpus_pipeline.STAGES[-1][1](spark, out, sf)
    from webloom.llm import sentencepiece as sp

    back = sp.decode(ids, sp.Vocabulary(sp.vocabulary_path(spark))).groupBy("doc_id", F.md5("text").alias("h")).count()
    want = out.groupBy("doc_id", F.md5("text").alias("h")).count()
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13)] * 3 + [(2, "a b c d e f g", "en", "s", 13), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None"]


def test_one_id_on_unlike_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in ("alpha", "bread", "cloud"))
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "x"), (3, c, "x"), (5, c, "x"), (5, c + " z", "x"), (5, "quite another text of few words", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == sorted([(1, a), (1, b), (3, c), (5, "quite another text of few words")])


ODD = "doc_id long, text string, lang string, source string, n_chars long, _n int, n int, names string, row string, fp long, root string, _toxicity double, _keep binary, component_id long, label string, score string"


def odd_rows():
    line = "a line of more than forty characters that many documents share"
    copy = " ".join(f"word{k}" for k in range(30))
    texts = [None, "", "one", "x " * 40_000 + "end", *[f"{line}\nown text of document number {i} and some more words {i}" for i in range(6)], copy, copy, copy]
    tail = (7, 7, "names", "row", 7, "root", 0.9, b"k", 7, "label", "score")
    rows = [(i, t, "en", "s", len(t or "")) + tail for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, copy, None, None, None) + tail, (None, None, None, None, None) + (None,) * 11, (2, "other text of a repeated id", None, None, 27) + tail]
    return rows


def test_stages_take_nulls_repeats_long_texts_and_clashing_names(spark, sf):
    docs = spark.createDataFrame(odd_rows(), ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = docs, stage(spark, docs, sf)
        assert after.columns == before.columns, name
        docs = corpus_pipeline.written(after, "test-odd")
        rest = {c for c in docs.columns if c not in ("text", "n_chars")}
        assert docs.select(*rest).exceptAll(before.select(*rest).unionAll(before.select(*rest)).unionAll(before.select(*rest))).isEmpty(), name  # mixing takes a row three times at most
        if name == "simhash_near_dedup":
            got = sorted((str(r.doc_id), str(r.text)) for r in docs.select("doc_id", "text").collect())
            assert [d for d, _ in got].count("None") == 2 and [d for d, _ in got].count("2") == 2 and [d for d, _ in got].count("5") == 1
            assert {d for d, _ in got} >= {"0", "2", "3", "5", "10"} and not {"1", "11", "12"} & {d for d, _ in got}
    ids = corpus_pipeline.encode(spark, docs, sf)
    assert ids.columns == ["doc_id", "lang", "source", "n_ids", "ids"] and ids.count() == docs.count()


def test_no_rows_give_no_rows(spark, sf):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
