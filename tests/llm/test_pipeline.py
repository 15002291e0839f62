"""The pipeline over a planted corpus, stage by stage against plain Python."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    pick = random.Random(11)
    folder = str(tmp_path_factory.mktemp("corpus"))
    word = lambda: "".join(pick.choice("aeionrstl") for _ in range(pick.randint(2, 8)))
    prose = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(8)) + "."
    rows = []
    for i in range(300):
        text = prose() if i % 5 else " | ".join([word()] * 60)
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    leak = " ".join(word() for _ in range(30))
    add = lambda t: rows.append((len(rows), t, "en", "src0", len(t)))
    add(rows[1][1])
    add(rows[2][1].replace(".", " x", 1))
    add(rows[3][1] + " " + leak)
    add(rows[4][1][:200] + " Mail jo.doe@mail.example.com now. " + prose())
    labels = [(i, int(i % 5 > 0), 0) for i in range(0, 300, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_each_stage_takes_effect(spark, corpus):
    import corpus_pipeline
    from skyloom.llm import pieces

    folder, rows = corpus
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [{r[0] for r in rows}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    junk = {i for i in range(0, 300, 5)}
    assert seen[0] - seen[1] == junk
    assert seen[1] - seen[2] == {300, 301}
    assert seen[2] - seen[3] == {302}
    assert seen[3] == seen[4] == seen[5]
    model = pieces.Model(pieces.public_model())
    final = {r["doc_id"]: r for r in docs.collect()}
    assert "[EMAIL]" in final[303]["text"] and "jo.doe" not in final[303]["text"]
    for i in (1, 7, 303):
        assert final[i]["token_ids"] == model.processor.encode(final[i]["text"]) and final[i]["lossless"]
    assert all(final[i]["text"] == rows[i][1] for i in final if i != 303)


def test_registered_with_ten_operators():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_run_on_an_empty_table(spark, corpus, tmp_path):
    import corpus_pipeline

    folder, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
