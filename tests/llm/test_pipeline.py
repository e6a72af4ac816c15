import corpus_pipeline
from llm_helpers import prose

from timberline.llm import secrets, toxicity


def write(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    passage = prose(900, 60)
    rows = [(k, prose(k, 90)) for k in range(400)]
    rows = [(i, t + (" vile nasty horrid vile" if i % 4 == 0 else "")) for i, t in rows]
    rows += [(500, prose(1, 90)), (501, prose(1, 90)), (502, prose(600, 40) + "\n" + passage + "\n" + prose(601, 40)), (503, prose(602, 40) + "\n" + passage + "\n" + prose(603, 40))]
    rows += [(504, prose(700, 80) + " password=b7db7aa4a5fcc78305 " + prose(701, 10)), (505, None), (506, "")]
    write(spark, str(tmp_path), rows, [(k, 1, int(k % 4 == 0)) for k in range(400)])
    docs, text = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(rows)
    out = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            assert set(kept) == {i for i, _ in rows if i >= 400 or i % 4}
        if name == "simhash":
            assert not {500, 501} & set(kept) and {1, 502, 503, 504} <= set(kept) and len({505, 506} & set(kept)) == 1
        if name == "substring":
            assert kept[502].text == text[502] and passage not in kept[503].text and kept[503].n_chars == len(kept[503].text)
            assert all(kept[i].text == text[i] for i in kept if i < 500)
        if name == "secrets":
            assert "b7db7aa4a5fcc78305" not in kept[504].text and secrets.REDACTED in kept[504].text
    packed = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(kept)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert toxicity.BITS == 22


def test_repeated_ids_near_copies_and_nulls(spark, tmp_path):
    """No text is lost because another one has its doc_id, in the stage of near-duplicates and through all stages."""
    a, b, c = prose(31, 120), prose(32, 120), prose(33, 120)
    near = " ".join(w if k != 60 else "changed" for k, w in enumerate(c.split()))
    rows = [(3, a), (5, a), (5, b), (9, b), (11, c), (12, near), (None, c), (None, prose(34, 90)), (7, None), (8, ""), (5, b)]
    write(spark, str(tmp_path), rows, [(1000 + k, 1, k % 2) for k in range(50)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.simhash_stage(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(3, a), (5, b), (11, c), (None, prose(34, 90)), (7, None)], key=repr)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in packed) == [(False, 3), (False, 5), (False, 7), (False, 11), (True, None)]


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [], [])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() == 0 and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed.columns)
