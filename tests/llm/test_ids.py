"""Ids above 2**53 beside null ids come out of every operator as they went in; folders that tasks write to."""

import pytest
from pyspark.sql import functions as F
from tests.llm.cases import SCHEMA, prose

from civicgrid.llm import common, decontaminate, embedding_dedup, language_id, ngram_join, packing, suffix_dedup, token_frames, toxicity, warc

BIG = [2**60 + 1, 2**60 + 3, -(2**62) - 1]


def texts(spark):
    data = [(d, prose(k, 60), "en" if k % 2 else "de", "s", 1) for k, d in enumerate([*BIG, None, None])]
    return spark.createDataFrame(data, SCHEMA).coalesce(1)


def ids(df, column="doc_id"):
    return sorted({r[column] for r in df.collect() if r[column] is not None})


def test_ids_of_documents(spark):
    import public_tokenizers

    docs, want = texts(spark), sorted(BIG)
    labels = spark.createDataFrame([(BIG[0], 1), (BIG[1], 0), (None, 1)], "doc_id long, toxic int")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert ids(language_id.identify(docs, F.lit(True))) == want
    assert ids(decontaminate.contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))) == want
    assert ids(toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)))) == want
    assert ids(packing.pack_documents(docs, path, 1, 64)) == want
    assert ids(token_frames.token_digest(docs, path, 2)) == want
    assert ids(suffix_dedup.without_repeats(docs)) == want
    joined = ngram_join.similarity_classes(docs)
    assert ids(joined) == want == ids(joined, "class_id")


def test_ids_of_vectors_and_pages(spark):
    vectors = spark.createDataFrame([(d, [float(k), 1.0], "a") for k, d in enumerate([*BIG, None])], "vec_id long, embedding array<double>, label string").coalesce(1)
    out = embedding_dedup.vector_classes(vectors)
    assert ids(out, "vec_id") == sorted(BIG) and set(ids(out, "component_id")) <= set(BIG)
    assert ids(embedding_dedup.vector_classes(vectors.withColumn("label", F.lit("other"))), "vec_id") == sorted(BIG)
    pages = spark.createDataFrame([(d, "http://a/", "<p>x</p>") for d in [*BIG, None, 1]], "page_id long, url string, html string")
    records = [sorted(map(repr, warc.build_derivatives(warc.responses_from_pages(pages.repartition(n))).collect())) for n in (1, 5)]
    assert records[0] == records[1] and str(BIG[0]) in "".join(records[0])


def test_documents_of_one_id_keep_one_order(spark, tmp_path):
    import public_tokenizers

    data = [(7, prose(k, 30), "en", "s", 1) for k in range(40)]
    out = [sorted(map(tuple, token_frames.token_digest(spark.createDataFrame(data, SCHEMA).repartition(n), public_tokenizers.path("byte_bpe_50k.json"), 2).collect())) for n in (1, 6)]
    assert out[0] == out[1]


def test_shared_folders(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"
        environment: dict = {}
        getCheckpointDir = staticmethod(lambda: None)

    class Unset:
        get = staticmethod(lambda key, default=None: default)
        set = staticmethod(lambda key, value: None)

    class Session:
        conf = Unset
        sparkContext = Elsewhere()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    assert common.shared_dir(spark).startswith("file:/")
    assert common.open_store("file:/tmp/x")[1] == "/tmp/x" == common.open_store("file:///tmp/x")[1]
    for bad in ("/tmp/x", "nosuch://host/x"):
        with pytest.raises(ValueError):
            common.open_store(bad)
