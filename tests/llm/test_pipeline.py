"""The pipeline over a small folder of documents."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    from voxfield.llm.common import store
    from tests.llm.test_langid import DE, EN

    def sentence(i):
        rng, words = random.Random(i), EN if i % 2 else DE
        return " ".join(rng.choice(words) + rng.choice(words) for _ in range(80))

    rows = [(i, sentence(i), "en" if i % 2 else "de", f"src{i % 3}", 5) for i in range(40)]
    rows += [(100, rows[0][1], "de", "src1", 5), (101, rows[1][1] + " more", "en", "src2", 5), (102, "12 34", "en", "src0", 5), (103, None, None, None, 0), (104, rows[3][1] + " token = abcdefgh1234 " + " ".join(DE), "en", "src0", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in pipeline.STAGES:
        docs = store(stage(spark, docs, str(tmp_path)))
        kept.append(docs)
    ids = [{r[0] for r in x.select("doc_id").collect()} for x in kept]
    assert {102, 103} & ids[0] == set() and ids[0] == {r[0] for r in rows} - {102, 103}
    assert ids[0] - ids[1] == {100, 101}
    texts = {r["doc_id"]: r for r in kept[2].collect()}
    assert "[SECRET]" in texts[104]["text"] and "abcdefgh1234" not in texts[104]["text"] and texts[104]["n_chars"] == len(texts[104]["text"])
    assert all(x.columns == ["doc_id", "text", "lang", "source", "n_chars"] for x in kept[:4])
    assert kept[4].count() == kept[3].count() > 0 and kept[4].where("not exact").count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == kept[4].count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return pipeline.run(spark, str(folder))


def test_nothing_and_nulls(spark, tmp_path):
    assert through(spark, tmp_path, []).count() == 0
    assert through(spark, tmp_path, [(None, None, None, None, None), (1, "", "en", None, 0)]).count() == 0


def test_clashing_columns_ties_and_repeats(spark, tmp_path):
    from tests.llm.test_langid import EN

    words = list(EN)
    text = lambda k: " ".join(words[(k * 31 + j * j * (k + 3)) % len(words)] + words[(k + j) % len(words)] for j in range(60))
    rows = [(i, text(i), "en", None if i % 3 else "s", 9, "a", 1, "b") for i in range(30)]
    rows += [rows[4], rows[4], (4, text(40), "en", "s", 9, "a", 1, "b"), (None, text(50), "en", "s", 9, "a", 1, "b")]
    out = through(spark, tmp_path, rows, SCHEMA + ", id string, same int, _times string")
    got = out.collect()
    assert out.columns == ["doc_id", "n_tokens", "ids", "exact"] and all(r["exact"] for r in got)
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] == 4}) <= 2 and len(got) > 10
