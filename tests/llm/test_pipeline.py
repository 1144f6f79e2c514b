"""The pipeline's stages against what each operator decides on the same input, on a small table."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
pytest.importorskip("public_tokenizers")

import pyarrow as pa
import corpus_pipeline
from depthkit.llm import base, components, minhash, pii, quality, toxicity
from depthkit.llm.queries import word_vocabulary
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows=160):
    rng = random.Random(9)
    plain = ["".join(rng.choices("aeionrstl", k=rng.randint(2, 8))) for _ in range(600)]
    texts = [" ".join(rng.choices(plain, k=rng.randint(60, 140))) for _ in range(rows)]
    for i in range(0, rows, 5):
        words = texts[i].split()
        for _ in range(5):
            words[rng.randrange(len(words))] = rng.choice(["grumbog", "skarnish"])
        texts[i] = " ".join(words)
    texts[11], texts[13] = texts[1], texts[3] + " more"  # copies
    texts[21] = "too short"
    own = " ".join(random.Random(22).choices(plain, k=100))
    texts[22] = own[:200] + " write to a.b@c.org or 10.0.0.1 " + own[200:]
    texts += [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], COLUMNS)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(rows)], "doc_id long, toxic int")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    docs, labels = tables(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        ids = {r[0] for r in before.select("doc_id").collect()}
        kept = {r[0] for r in docs.select("doc_id").distinct().collect()}
        if name == "packing":
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.dtypes == before.dtypes
        if name == "quality":
            assert kept == {r.doc_id for r in quality.assess(before).collect() if r.kept} and not kept & {21, 160, 161}
        elif name == "toxicity":
            assert kept == {r.doc_id for r in toxicity.score(before, labels).collect() if not r.predicted}
            assert len(kept & set(range(0, 160, 5))) <= 3
        elif name == "near_duplicates":
            assert kept == {r.doc_id for r in minhash.near_duplicates(before, fold_copies=True).collect() if r.kept} and not {11, 13} & kept
        else:
            assert kept == ids
            spans = {r.doc_id: r.spans for r in pii.find(before).collect()}
            new = {r.doc_id: r for r in docs.collect()}
            for r in before.collect():
                assert (new[r.doc_id].text == r.text) == (not spans[r.doc_id]) and new[r.doc_id].n_chars == len(new[r.doc_id].text)
            assert "<email> or <ip>" in new[22].text
    library = Tokenizer.from_file(word_vocabulary())
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    got = {r.doc_id: r.n for r in docs.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert got == want
    assert sorted((r.doc_id, r.length) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.length) for r in docs.collect())


def test_batches_are_bounded_by_bytes(spark):
    """30 MB of text in one partition: Spark's own bounds would make one batch of it."""
    base.ship(spark)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes], "rows": [batch.num_rows]})

    seen = docs.mapInArrow(sizes, "n long, rows long").collect()
    assert sum(r.rows for r in seen) == 3000 and max(r.n for r in seen) < 2 * base.BATCH_BYTES


def test_redaction_starts_no_python_worker(spark):
    """Its small frame of patterns is made from Arrow: workers of a second kind stayed beside those of the other stages."""
    docs = spark.createDataFrame([(i, f"write to me{i}@x.org or call, secret: key{i}abc") for i in range(20)], "doc_id long, text string")
    seen, make = [], type(spark).createDataFrame
    try:
        type(spark).createDataFrame = lambda self, data, *a, **b: (seen.append(type(data)), make(self, data, *a, **b))[1]
        assert pii.redact(docs).count() == 20
    finally:
        type(spark).createDataFrame = make
    assert seen and set(seen) == {pa.Table}


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    """As many files as the links need, not one for each shuffle partition, and the same components."""
    files, cut = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df, name: (out := cut(df, name), files.append(len(out.inputFiles())))[0])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 10 != 9], "a long, b long")
        got = {r.node: r.component for r in components.components(links).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {i: i // 10 * 10 for i in range(300)}
    assert len(files) > 2 and max(files[1:]) <= components.TASKS, files
