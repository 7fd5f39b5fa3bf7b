"""The pipeline against its stages over what each predecessor kept, and what each must do with planted rows."""

import corpus_pipeline
from rulestone.llm import linededup, toxicity
from rulestone.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = found.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        kept[name] = {r.doc_id: r for r in rows}
        docs = spark.createDataFrame(rows, found.schema)
    names = list(kept)
    assert all(kept[b].keys() <= kept[a].keys() for a, b in zip(names, names[1:], strict=False))
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    good = [i for i, r in labels.items() if r.quality and not r.toxic]
    assert sum(i in kept["quality"] for i in good) >= 0.98 * len(good)
    assert sum(i in kept["quality"] for i, r in labels.items() if not r.quality) <= 0.03 * len(labels)
    assert len(kept["near_dedup"]) < len(kept["line_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept["near_dedup"].keys()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        (r.doc_id, r.start, r.length, r.ids_crc32) for r in packed
    )


def test_line_stage_drops_documents_of_which_nothing_is_left(spark):
    passage = "one\ntwo\nthree"
    rows = [(1, passage, 13, 5), (2, passage, 13, 5), (3, f"{passage}\nmore", 18, 5), (4, None, None, 5), (5, "", 0, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, n_removed int").drop("n_removed")
    found = linededup.cut_documents(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == [(1, passage, 13), (3, "more", 4), (4, None, None), (5, "", 0)]


def test_threshold_is_the_stage_s():
    assert toxicity.THRESHOLD == 0.7
