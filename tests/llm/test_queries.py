"""Registered queries against their SQL, and the pipeline against brute force, on the smallest tables."""

import hashlib
import itertools
import os

import pytest

from tests.compare import agree

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_sql(spark):
    from ledgerloom.llm import queries

    for name, sql in queries.SQL.items():
        agree(spark, SF, name, queries.QUERIES[name], sql)


@pytest.mark.parametrize("name", ["documents", "benchmark", "labels", "embeddings", "pages"])
def test_empty_tables(spark, tmp_path, name):
    """Each query over tables of which one is empty, and over none but empty ones."""
    from ledgerloom.llm import queries

    for t in ("documents", "benchmark", "labels", "embeddings", "pages"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.limit(0) if t == name or name == "documents" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    reads = {"documents": queries.QUERIES, "benchmark": ["op3_decontamination"], "labels": ["op10_toxicity"], "embeddings": ["op6_nearest_neighbours"], "pages": ["op5_warc_archive"]}[name]
    for q in reads:
        n = queries.QUERIES[q](spark, str(tmp_path)).count()
        assert (n == 0) == (name not in ("benchmark", "labels")), q


def test_pipeline(spark):
    import tiktoken

    public_tokenizers = pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p
    from ledgerloom.llm import bpe, simhash
    from tests.llm.test_operators import brute_hits, brute_lines, union

    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(p.STAGES):
        got = stage(spark, docs, sf)
        rows = got.collect()
        out.append(rows)
        if k < 4:
            assert got.columns == p.COLUMNS
            docs = spark.createDataFrame(rows, got.schema)
    toxic, line, near, clean, last = out
    kept = {r.doc_id for r in toxic}
    assert 800 < len(kept) < 1000
    want = {d: left for d, _, _, _, left in brute_lines([(r.doc_id, r.text) for r in toxic])}
    assert {r.doc_id: r.text for r in line} == want and all(r.n_chars == len(r.text) for r in line)
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in line}
    part = union([(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 4], prints)
    assert sorted(r.doc_id for r in near) == sorted(set(part.values()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in clean) == [x[0] for x in brute_hits([(r.doc_id, r.text) for r in near], items) if not x[5]]
    ranks = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    ref, text = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), {r.doc_id: r.text for r in clean}
    assert {r.doc_id: (list(r.ids), r.decoded_sha256) for r in last} == {d: (ref.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in text.items()}


def test_pipeline_on_messy_and_empty_rows(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four five " * 9, "en", "s", 9), (3, "one two three four five " * 9, "en", "s", 9), (4, "one two three four five " * 9, "en", "s", 9), (None, "other words entirely here", "en", "s", 1)]
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in p.run(spark, str(tmp_path)).collect())
    assert got == [(False, 1), (False, 3), (True, 0)]
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_of_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    texts = [" ".join(f"{w}{k}" for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta") * 3) for k in range(6)]
    pairs = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[4]), (9, texts[5]), (None, texts[5]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.text) for r in p.drop_near_duplicates(spark, docs, SF).collect())
    assert got == sorted([(0, texts[0]), (0, texts[1]), (0, texts[2]), (7, texts[3]), (7, texts[4]), (0, texts[5])])
