"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline as cp
from sketchloom.llm import toxic_passages
from tests.llm import helpers as h

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "sentencepiece"]
    kept = []
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append((before.collect(), docs.collect()))
        assert docs.columns == columns or name == "sentencepiece"
    before, after = kept[0]
    model = toxic_passages.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if model.score(r.text)[0] < 0.3}
    before, after = kept[1]
    assert sorted(r.doc_id for r in after) == sorted(set(h.near_components([(r.doc_id, r.text) for r in before]).values()))
    before, after = kept[2]
    all_, gone = h.repeats([r.text for r in before], 35)
    want = {r.doc_id: b" ".join(x for x, y in zip(w, g) if not y).decode() for r, w, g in zip(before, all_, gone)}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    before, after = kept[3]
    times = {}
    for r in after:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times.values()) <= {1, 2} and set(times) <= {r.doc_id for r in before}
    total = sum(len(h.words(r.text)) for r in before)
    assert abs(sum(len(h.words(r.text)) for r in after) - 1.5 * total) <= 0.1 * total
    before, after = kept[4]
    assert len(before) == len(after) and sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, after))
