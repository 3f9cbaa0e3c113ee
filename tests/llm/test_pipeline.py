"""The pipeline against its operators called one by one on collected rows."""

from __future__ import annotations

import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import CLASHES, MIDDLE, odd_documents, plain_components, plain_fingerprint
from tidewater.llm import mixing, quality, toxicity
from tidewater.llm._labelled import remainder


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows, _ = quality.with_statistics(docs)
    good = rows.where(quality.train(docs, labels, remainder(F.col("doc_id"), 5) == 0).score() >= 0.3).select(docs.columns)
    kept = {r.doc_id: r for r in good.collect()}
    model = toxicity.train(good, labels, remainder(F.col("doc_id"), 3) == 1)
    scale = toxicity.Scale(model.base, model.toxic)
    kept = {i: r for i, r in kept.items() if model.scores([scale.savings(r.text)])[0] < 0.7}
    groups = plain_components([(i, plain_fingerprint(r.text)) for i, r in kept.items()], corpus_pipeline.RADIUS)
    kept = {i: r for i, r in kept.items() if groups[i] == i}
    frame = spark.createDataFrame(list(kept.values()), docs.schema)
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix(frame).collect() if r["size"]}
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, r in kept.items():
        ids = processor.encode(r.text, add_eos=True)
        want += [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] * times.get(i, 0)
    assert sorted(tuple(r)[:3] for r in corpus_pipeline.run(spark, MIDDLE).collect()) == sorted(want)


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("doc_id is not null").selectExpr("doc_id", "1 as quality", "0 as toxic").distinct().write.parquet(f"{tmp_path}/labels.parquet")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and set(CLASHES) < set(out.columns)
        found = out.count()
        # Labels call every row clean: the filters keep them all.
        assert found == docs.count() if number < 2 else found > 0
        if name == "near_dedup":
            # Both texts of id 3 stay; the rows without an id are copies of rows with one.
            assert out.where("doc_id is null").count() == 0 and out.where("doc_id = 105").count() == 0
            assert {r.text for r in out.where("doc_id = 3").collect()} == {"other", docs.where("doc_id = 105").first().text}


def test_near_dedup_keeps_one_row_of_every_group(spark):
    """Different texts with one id stay; copies without an id go, the last one doesn't."""
    odd = odd_documents(spark)
    alone = "a text that stands here without any id and is no copy of another"
    docs = odd.union(odd.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.explode(F.array(*[F.lit(t) for t in (alone, alone, alone.upper())]))}))
    rows = docs.collect()
    groups = plain_components([(i, plain_fingerprint(r.text)) for i, r in enumerate(rows)], corpus_pipeline.RADIUS)
    ids: dict[int, list] = {}
    for i, r in enumerate(rows):
        ids.setdefault(groups[i], []).append((r.doc_id is None, r.doc_id or 0))
    group_of = {r.text: groups[i] for i, r in enumerate(rows)}
    out = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((group_of[r.text], (r.doc_id is None, r.doc_id or 0)) for r in out) == sorted((g, min(of)) for g, of in ids.items())
    assert {rows[3].text, "other"} == {r.text for r in out if r.doc_id == 3} and sum(r.doc_id is None for r in out) == 1
    assert corpus_pipeline.near_dedup(spark, docs.where("doc_id is null and text = 'none'"), "").count() == 0
