import corpus_pipeline
from presswork.llm import packing

from .test_debruijn import WORD
from .test_simhash_gray import slow_components, slow_fingerprint


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "substring_dedup", "secret_scans", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(3)
        after = {r.doc_id: r for r in docs.collect()}
        kept[name] = after
        if name == "simhash_near_dedup":
            least = slow_components([(r.doc_id, slow_fingerprint(r.text)) for r in before])
            assert set(after) == set(least.values())
        if name == "substring_dedup":
            first = {}
            words = {r.doc_id: WORD.findall(r.text) for r in before}
            for i in sorted(words):
                for k in range(len(words[i]) - 12):
                    first.setdefault(tuple(words[i][k : k + 13]), i)
            for r in before:
                w = words[r.doc_id]
                gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r.doc_id for j in range(13)}
                want = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r.text
                assert after[r.doc_id].text == want and after[r.doc_id].n_chars == len(want)
    assert 0 < len(kept["quality_rules"]) < 200
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(kept["secret_scans"]) and max(r.offset + r.length for r in rows) <= packing.SIZE
    again = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    piece = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(piece, rows)) == sorted(map(piece, again))


def test_empty_and_odd_tables_pass_all_stages(spark, tmp_path):
    docs = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "short text", "en", "s", 10), (2, " ".join(f"w{k}" for k in range(80)), "en", "s", 300)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("odd", docs), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert [r.doc_id for r in got] == ([2] if rows else [])
