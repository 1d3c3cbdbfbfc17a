import public_tokenizers
from oracle import connect
from tokenizers import Tokenizer

import corpus_pipeline as cp
from dagwright.llm import jaccard, langid, line_dedup, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_name_their_operators():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_duplicates", "source_mix", "bpe"] and cp.ORACLE_SQL is None


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.columns == columns and out.schema == docs.schema
        seen[name] = out = cp.written(out, "test")
        docs = out
    first = spark.read.parquet(f"{sf}/documents.parquet")
    # every stage against its operator or SQL on its own input
    assert seen["language_id"].count() >= 0.99 * first.count()
    con = connect(sf)
    con.register("lang_in", seen["language_id"].toPandas())
    want = con.execute(line_dedup.OP4_SQL.replace("documents", "lang_in")).df().set_index("doc_id")["text"].to_dict()
    assert {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].collect())
    classes = jaccard.near_duplicates(seen["line_dedup"]).toPandas()
    kept = sorted(r["doc_id"] for r in seen["near_duplicates"].collect())
    assert kept == sorted(classes[(classes["doc_id"] == classes["component_id"])]["doc_id"])
    report = {r["doc_id"]: r for r in mixing.mix_report(seen["near_duplicates"]).collect()}
    times = seen["source_mix"].groupBy("doc_id").count().collect()
    assert all(r["count"] * report[r["doc_id"]]["size"] == report[r["doc_id"]]["taken"] for r in times)
    lib = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    text = {r["doc_id"]: r["text"] for r in seen["source_mix"].collect()}
    for r in seen["bpe"].collect():
        assert r["ids"] == lib.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    whole = cp.run(spark, sf)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in whole.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in seen["bpe"].collect())


def test_odd_tables(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the cat and the dog", "en", None, 19), (3, "the cat and the dog", "en", None, 19), (None, "le chien et le chat", "fr", "b", 5), (5, "12 34", "en", "a", 5), (6, "the " * 50_000, None, "a", 7)]
    t = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as score", "'q' as h", "2 as n", "3 as fp")
    for start in (t, t.limit(0)):
        docs = start
        for name, stage in cp.STAGES:
            out = cp.written(stage(spark, docs, ""), "odd")
            if name != "bpe":
                assert out.columns == t.columns
                docs = out
    kept = cp.identify_language(spark, t, "").select("doc_id").collect()
    assert sorted((r[0] for r in kept), key=str) == sorted([3, 3, None, 6], key=str)
    assert {r["score"] for r in cp.identify_language(spark, t, "").collect()} == {1}
    assert langid.UNKNOWN == "und"
