import public_tokenizers
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from contract.check import compare, database
from logloom.llm import decontaminate, mixing, quality, simhash
from logloom.llm.oracles import ORACLES
from logloom.llm.queries import QUERIES
from tests.llm.helpers import LONG, clashing

import pytest


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    assert compare(QUERIES[name](spark, small), database(small), ORACLES[name]) == ""


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def near(docs):
    """Smallest ids of the groups linked by fingerprints or by shingles, by comparing all texts."""
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
    prints = [simhash.fingerprint(t) for _, t in rows]
    sets = [set(simhash.hashes(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 3 or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return [rows[k][0] for k in sorted(set(root))]


def test_stages(spark, small):
    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small).persist()
        assert after.schema.fieldNames() == docs.columns
        seen.append(after)
        docs = after
    good, distinct, clean, mixed = seen
    whole = spark.read.parquet(f"{small}/documents.parquet")
    scores = quality.score(whole, quality.fit(whole, spark.read.parquet(f"{small}/labels.parquet")))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == ids(scores.filter("score >= 0.3"))
    assert ids(distinct) == near(good)
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    assert ids(clean) == ids(decontaminate.decontaminate(distinct, items).filter("not contaminated"))
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    rows = {(r.start, r.doc_id): r for r in corpus_pipeline.STAGES[-1][1](spark, mixed, small).collect()}
    for doc in mixed.orderBy("doc_id").collect():
        encoded = np.array([*plain.encode(doc.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        row = rows.pop((start, doc.doc_id))
        assert (row.n_tokens, row.ids_crc32) == (len(encoded), zlib.crc32(encoded.tobytes()))
        start += len(encoded)
    assert not rows


def test_awkward_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(30)
    odd = spark.createDataFrame(
        [(1, None, "en", None, None), (1, None, "en", None, None), (None, "no id here", "en", "a", 1), (10**9, "", "en", "b", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(10**9 + 1, LONG, "en", "b", 0)], docs.schema))
    docs = clashing(docs)
    for name in ("_row_text", "_mix_source", "_mix_turn", "row", "mark", "_text"):
        docs = docs.withColumn(name, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, small)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert after.columns == docs.columns
            docs = after.persist()
        assert after.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_one_row_of_repeated_ids_stays(spark, small):
    rows = [(1, "some words to compare here", "en", "a", 1)] * 3 + [(2, "quite another text of words", "en", "a", 2), (1, "third text with the first id", "en", "a", 3)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{small}/documents.parquet").schema)
    kept = corpus_pipeline.distinct(spark, docs, small)
    assert sorted((r.doc_id, r.n_chars) for r in kept.collect()) == [(1, 1), (1, 3), (2, 2)]


def test_unlike_texts_of_one_id_stay(spark, small):
    rows = [
        (3, "one long enough text of some words", 1), (5, "one long enough text of some words", 2), (5, "unique text beside a copy", 3),
        (7, "first of two unlike texts here", 4), (7, "second one shares nothing but id", 5), (7, "second one shares nothing but id", 6),
        (None, "a text nobody has numbered yet", 7), (None, "another without any number at all", 8), (None, "one long enough text of some words", 9),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", n) for i, t, n in rows], spark.read.parquet(f"{small}/documents.parquet").schema)
    kept = corpus_pipeline.distinct(spark, docs, small).collect()
    assert sorted(r.n_chars for r in kept) == [1, 3, 4, 5, 7, 8]
    assert {(r.doc_id, r.text) for r in kept} == {(i, t) for i, t, n in rows if n not in (2, 9)}
