import random

import corpus_pipeline
from tests.llm.test_models import speak


def write(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_each_decision_takes_effect(spark, tmp_path):
    rng = random.Random(8)
    item = speak(rng, "en", 20)
    docs, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        text = speak(rng, "en", 80) + (" you fiesling mistvieh grob." if toxic else "")
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    copy = next(d for d in docs if d[0] == 5)
    docs += [(500, copy[1], "en", "src1", 1), (501, speak(rng, "de", 30) + " " + item, "de", "src2", 1), (502, None, "en", None, None), (503, "", None, "src1", 0), (None, "loose", "fr", "src1", 5)]
    write(spark, str(tmp_path), docs, labels, [(1, item)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {i for i in range(300) if i % 6 == 0} and not ids & {500, 501, 503}
    assert len(out) == len(ids) and len(ids) > 0.75 * 250
    assert {r._version for r in out} != {None}


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_and_give_columns_of_documents(spark, tmp_path):
    docs = [(i, f"word{i} " * 40, "en", "src1", 5) for i in range(20)]
    write(spark, str(tmp_path), docs, [(0, 1, 0)], [(1, "nothing of this")])
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]


def test_whole_texts_are_joined_without_a_sort(spark):
    from corpusloom.llm import decontaminate, simhash

    docs = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, "other words here")], "doc_id bigint, text string")
    items = spark.createDataFrame([("i", "other words here")], "item_id string, text string")
    for kept, kind, ids in ((simhash.keep_one(docs), "LeftSemi", [1, 3]), (decontaminate.drop_contaminated(docs, items), "LeftAnti", [1, 2])):
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert any("ShuffledHashJoin" in line and kind in line for line in plan.split("\n"))
        assert sorted(r.doc_id for r in kept.collect()) == ids
