"""What the corpus operators hold in memory."""

import os

from tessera.llm import common, packing, queries, toxicity


def test_packing_shuffles_ids_once_and_starts_no_other_workers(spark, tmp_path):
    """The pieces stay where the window left them, and the plan's table is not made by Python workers."""
    rows = [(i, 0, 1 + i % 7, i, 1 + i % 7, b"0000") for i in range(50)]
    spark.createDataFrame(rows, packing.PIECES).write.parquet(f"{tmp_path}/p")
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")  # as for tables of many pieces
    try:
        out = packing.pack_pieces(spark.read.parquet(f"{tmp_path}/p"), 16)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(broadcast, before)
    # The pieces by length and bucket, the counts by them, the totals by length, and the totals by both.
    assert plan.count("Exchange hashpartitioning") == 4 and "ExistingRDD" not in plan
    places = {}
    for r in out.collect():
        places.setdefault(r["sequence_id"], []).extend(range(r["offset"], r["offset"] + r["length"]))
    assert sum(map(len, places.values())) == sum(r[2] for r in rows)
    assert all(sorted(p) == list(range(len(p))) and len(p) <= 16 for p in places.values())


def test_encoder_makes_the_librarys_tokenizer_only_when_a_text_needs_it(monkeypatch):
    import tokenizers

    vocabulary = open(queries.vocabulary_path(), "rb").read()  # noqa: SIM115
    made, slow = [], tokenizers.Tokenizer.from_str(vocabulary.decode())
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Seen", (), {"from_str": staticmethod(lambda s: made.append(1) or slow)}))
    encode = packing.encoder(vocabulary)
    assert encode("plain words").tolist() == slow.encode("plain words", add_special_tokens=False).ids and not made
    for _ in range(2):
        assert encode("a <|endoftext|> b").tolist() == slow.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert made == [1]


def test_arrow_batches_are_bounded_by_bytes_too(spark):
    """A job that bounds the rows of its batches bounds their bytes as well, and gives the session its settings back."""
    df = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1000000) AS text")
    before = [spark.conf.get(k) for k in (common.BATCH, common.BYTES)]

    def sizes(batches):
        for b in batches:
            yield b[["id"]].head(1).assign(id=b["text"].str.len().sum())

    seen = common.Scratch(spark, "bytes").write(df.mapInPandas(sizes, "id long"), rows=400)
    assert max(r["id"] for r in seen.collect()) <= common.BATCH_BYTES + 1_000_000
    assert [spark.conf.get(k) for k in (common.BATCH, common.BYTES)] == before


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    """The driver gets the model and never holds the training texts; an empty table has a model, too."""
    docs = spark.createDataFrame([(i, f"word{i} more") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen, scorer = [], toxicity.scorer
    monkeypatch.setattr(toxicity, "scorer", lambda model: seen.append(model.value) or scorer(model))
    monkeypatch.setattr(toxicity, "fit", lambda rows, seed: {"prior": float(rows["toxic"].mean()) if len(rows) else 0.0, "pid": os.getpid()})
    toxicity.with_score(docs, docs, labels)
    assert seen[0]["pid"] != os.getpid() and 0.3 < seen[0]["prior"] < 0.7
    assert toxicity.with_score(docs.where("false"), docs.where("false"), labels)[0].count() == 0 and seen[1]["prior"] == 0.0
