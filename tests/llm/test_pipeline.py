import re
from collections import Counter
from hashlib import sha256

import corpus_pipeline
from conftest import DATA
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing
from plumbline.llm.common import read


def test_pipeline(spark):
    docs = read(spark, DATA, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept, DATA)
        assert out.columns == docs.columns and out.join(kept, "doc_id", "left_anti").count() == 0, name
        kept = out.cache()
    assert kept.count() == kept.select("doc_id").distinct().count() > 0
    mixed = corpus_pipeline.mix(spark, kept, DATA)
    want = {r.doc_id: r.copies for r in mixing.mixed(kept).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    last = corpus_pipeline.encode(spark, mixed, DATA)
    assert last.count() == sum(want.values())
    assert sorted(r.ids_sha256 for r in last.collect()) == sorted(r.ids_sha256 for r in bpe.encode_documents(mixed, bpe.default_vocabulary()).collect())


#: Extra columns with names that stages use themselves.
CLASHING = ["key", "n", "size", "score", "row", "copies", "bucket", "tokens", "node", "place", "kept", "word", "rank", "target", "id", "part", "component"]


def stored(spark, folder, docs, labels):
    """A data folder with the two tables that the pipeline reads."""
    extra = [F.lit("x").alias(c) for c in CLASHING]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).select("*", *extra).write.parquet(f"{folder}/documents.parquet")
    read(spark, DATA, "labels").limit(0).unionByName(labels, allowMissingColumns=True).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns with clashing names, from end to end.

    Without labels nothing is learnt, so that the classifier's answer is the same for every text.
    """
    long = " ".join(f"w{i}" for i in range(60_000))
    one = "the quick brown fox jumps over the lazy dog and runs far away from all of the noisy hounds of the old town today"
    docs = [
        (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n", None, None, 3), (None, one, "en", None, 9), (4, one, "en", "s", 9), (4, one, "en", "s", 9),
        (5, one + " again", "en", "s", 9), (6, long, "en", "t", 1), (7, long + " end", "en", "t", 1), (8, "word " * 30_000, None, "t", 1), (9, "a", "xx", "u", 1),
    ]
    folder = stored(spark, tmp_path, docs, read(spark, DATA, "labels").limit(0))
    out = corpus_pipeline.run(spark, folder).collect()
    texts = {sha256(t.encode()).hexdigest(): re.sub(r"[\x20\x09-\x0D]", "", t) for _, t, *_ in docs if t}
    assert all(r.decoded_sha256 in texts for r in out if r.n_tokens)
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, kept, folder).checkpoint()
        assert after.columns == kept.columns, name
        kept = after
    # a row of each text is left, and of each group of near copies
    left = Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect())
    assert max(left.values()) == 1
    assert len([t for t in left if t.startswith("w0")]) <= 1 and len([t for t in left if t.startswith("thequick")]) <= 1
    assert {texts[r.decoded_sha256] for r in out if r.n_tokens} <= set(left)


def test_pipeline_of_odd_rows_with_labels(spark, tmp_path):
    """With labels of both kinds, clean documents stay, whatever rows surround them."""
    given = read(spark, DATA, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long")).collect()
    odd = [(None, None, None, None, None), (-1, "", "en", "s", 0), (-1, "", "en", "s", 0), (None, "a", None, None, 1)]
    folder = stored(spark, tmp_path, [tuple(r) for r in given] + odd, read(spark, DATA, "labels"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, folder)
    assert good.columns == docs.columns
    plain = {r.doc_id for r in corpus_pipeline.quality(spark, read(spark, DATA, "documents"), DATA).select("doc_id").collect()}
    assert {r.doc_id for r in good.where("doc_id >= 0").select("doc_id").collect()} == plain
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.where("doc_id >= 0").select("doc_id").distinct().collect()} <= plain and out.count() > 0


def test_pipeline_of_empty_tables(spark, tmp_path):
    folder = stored(spark, tmp_path, [], read(spark, DATA, "labels").limit(0))
    assert corpus_pipeline.run(spark, folder).count() == 0
