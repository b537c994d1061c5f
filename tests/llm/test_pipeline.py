import __spark_entry__ as entry
import corpus_pipeline
from vecloom.llm import language_id, minhash_dedup, packing, suffix_dedup

from test_exact_and_suffix import brute_exact, brute_spans
from test_near import brute_classes


def test_pipeline_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    profiles = language_id.fit(docs.select("doc_id", "text", "lang"))
    told = {r["doc_id"] for r in language_id.predict(docs, profiles).where("lang_pred <> 'und'").collect()}
    one = [(i, rows[i]["text"]) for i in sorted(told)]
    two = [(i, rows[i]["text"]) for i, _, _, kept, _ in brute_exact(one) if kept]
    three = [(i, rows[i]["text"]) for i, c in brute_classes(two) if i == c]
    spans = brute_spans([(i, t.encode()) for i, t in three])
    out = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, d)
        if k < 4:
            assert out.columns == docs.columns
        got = out.collect()
        if k in (0, 1, 2):
            assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((one, two, three)[k])
        if k == 3:
            assert {r["doc_id"] for r in got} == {i for i, _ in three}
            for r in got:
                n_bytes, removed, _, _ = spans[r["doc_id"]][0]
                assert len(r["text"].encode()) <= n_bytes - removed and n_bytes - removed - len(r["text"].encode()) < 4 * 50
                assert r["n_chars"] == len(r["text"])
                assert removed or r["text"] == rows[r["doc_id"]]["text"]
    final = corpus_pipeline.run(spark, d)
    assert sorted(tuple(r)[:5] for r in final.collect()) == sorted(tuple(r)[:5] for r in got)


def test_stages_take_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f g", None, None, 13), (3, "a b c d e f g", None, None, 13), (None, "a b c d e f g", "en", "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.where("doc_id < 0")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, "").count() <= 5


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert packing and minhash_dedup and suffix_dedup
