"""The pipeline end to end: every stage against what its rule says of the rows it was given."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import bpe, common, decontaminate, passages, simhash

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = common.table(spark, DATA, "documents")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == columns
    clean, one_each, cut, unleaked, encoded = kept

    prints = {i: simhash.fingerprint(r.text) for i, r in clean.items()}
    root = {i: i for i in prints}
    for _ in prints:
        new = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == root:
            break
        root = new
    assert set(one_each) == {i for i in root if root[i] == i}

    for i, r in cut.items():
        assert r.n_chars == (len(r.text) if r.text != one_each[i].text else one_each[i].n_chars)
        assert len(passages._word.findall(r.text)) <= len(passages._word.findall(one_each[i].text))
    assert set(cut) <= set(one_each) and sum(r.text != one_each[i].text for i, r in cut.items()) < len(cut) / 3

    items = decontaminate.Items([(r.item_id, r.text) for r in common.table(spark, DATA, "benchmark").collect()])
    leaking = set()
    for i, r in cut.items():
        seq = np.array([items.number.get(w, -1) for w in decontaminate.item_words(r.text)], np.int64)
        if len(seq) and any(decontaminate.align(own, seq)[0] >= len(own) and len(own) > 2 for own in items.seqs):
            leaking.add(i)
    assert set(cut) - set(unleaked) <= leaking and len(leaking - (set(cut) - set(unleaked))) <= 0.02 * len(cut)

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    assert set(encoded) == set(unleaked)
    for i, r in encoded.items():
        e = lib.encode(unleaked[i].text, add_special_tokens=False)
        assert np.frombuffer(r.token_ids, "<u4").tolist() == e.ids and r.decoded == lib.decode(e.ids, skip_special_tokens=False)
    again = corpus_pipeline.run(spark, DATA).select("doc_id", F.sha2("token_ids", 256).alias("d")).collect()
    assert {(r.doc_id, r.d) for r in again} == {(r.doc_id, r.d) for r in docs.select("doc_id", F.sha2("token_ids", 256).alias("d")).collect()}
