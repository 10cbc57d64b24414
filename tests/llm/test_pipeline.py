import shutil

import pytest

import corpus_pipeline

from .samples import DOCS, changed, prose, vocabulary

BENCH = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    words = {k: vocabulary(50 + i, 200) for i, k in enumerate(("en", "fr"))}
    rows, labels = [], []
    for i in range(400):
        lang = ("en", "fr")[i % 2]
        text = prose(1000 + i, 60, words[lang])
        if i % 5 == 0:
            text = text[:100] + " idiot " + text[100:] + " worthless"
        rows.append((i, text, lang, "s", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    base, item = prose(1, 80, words["en"]), prose(2, 40, words["en"])
    for i, text in ((1000, base), (1001, base), (1002, changed(base, 1)),
                    (1003, prose(3, 50, words["en"]) + " " + item), (1004, None), (1005, "12 !!"),
                    (1006, prose(4, 3000, words["fr"]))):
        rows.append((i, text, "en", "s", 1))
    path = str(tmp_path_factory.mktemp("tables"))
    for name, data, schema in (("documents", rows, DOCS), ("labels", labels, LABELS),
                               ("benchmark", [(1, item)], BENCH)):
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    yield path
    shutil.rmtree(path)


def test_stages_take_effect(spark, tables, monkeypatch):
    seen, stages = {}, []
    for name, f in corpus_pipeline.STAGES:
        def watched(s, docs, d, f=f, name=name):
            out = f(s, docs, d)
            if name != "packing":
                assert out.columns == docs.columns
                seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
            return out
        stages.append((name, watched))
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    packed = {r.doc_id for r in corpus_pipeline.run(spark, tables).select("doc_id").collect()}
    everything = set(range(400)) | set(range(1000, 1007))
    assert everything - seen["language"] == {1004, 1005}
    gone = seen["language"] - seen["toxicity"]
    assert gone <= set(range(0, 400, 5)) and len(gone) >= 70
    assert seen["toxicity"] - seen["near_duplicates"] == {1001, 1002}
    assert seen["near_duplicates"] - seen["decontamination"] == {1003}
    assert packed == seen["decontamination"]


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "toxicity", "near_duplicates", "decontamination", "packing"]
