import hashlib
from collections import Counter

import corpus_pipeline as p
from rasterloom.llm.common import write_table
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_classes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = write_table(p.toxicity_stage(spark, docs, SF))
    assert kept.columns == columns
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids) > 0.9 * docs.count() - len(toxic) and len(ids & toxic) <= 0.5 * len(toxic)

    some = write_table(kept.orderBy("n_chars").limit(60))
    lines = write_table(p.line_dedup_stage(spark, some, SF))
    assert lines.columns == columns
    assert {r.doc_id: r.text for r in lines.collect()} == brute_lines([(r.doc_id, r.text) for r in some.collect()])

    joined = write_table(p.ngram_join_stage(spark, kept, SF))
    assert joined.columns == columns
    want = {d for d, _, c in brute_classes([(r.doc_id, r.text) for r in kept.collect()]) if d == c}
    assert {r.doc_id for r in joined.collect()} == want

    mixed = write_table(p.mixing_stage(spark, joined, SF))
    assert mixed.columns == columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3 and set(copies) <= want

    out = p.bpe_stage(spark, joined, SF).collect()
    t = Tokenizer.from_file(p.bpe.tokenizer_path())
    texts = {r.doc_id: r.text for r in joined.collect()}
    for r in out:
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_take_nulls_and_empty_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "a b c", "en", None, 5), (3, "a b c", "en", "s", 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in p.STAGES:
            docs = write_table(stage(spark, docs, SF))
        assert docs.count() <= 3 * len(data)
