import random

import corpus_pipeline


def test_rows_without_an_id_pass_the_near_copies_stage(spark, docs):
    text = " ".join(f"v{k}" for k in range(120))
    other = " ".join(f"u{k}" for k in range(120))
    frame = docs([text, text, other, text], ids=[3, 4, None, None])
    got = corpus_pipeline.drop_near_copies(spark, frame, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(3, text), (0, other), (0, text)])


def test_each_stage_on_odd_rows_keeps_columns_and_clean_rows(spark, docs, tmp_path):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = fresh(60)
    texts = [fresh(90), f"{fresh(30)} {passage} {fresh(30)}", f"{passage} {fresh(50)}", None, "", fresh(90), fresh(20_000)]
    texts.append(texts[0])
    frame = docs(texts, ids=[1, 2, 3, 4, 5, None, 7, 8], lang=["en"] * 8, source=["src1"] * 8)
    spark.createDataFrame([(k, 0, 1) for k in range(1, 9)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    count = lambda f: {r.doc_id: len((r.text or "").split()) for r in f.collect()}
    every = count(frame)
    toxic = corpus_pipeline.drop_toxic(spark, frame, str(tmp_path))
    assert toxic.columns == frame.columns and count(toxic) == every  # no row is marked, so all are clean
    near = corpus_pipeline.drop_near_copies(spark, toxic, "")
    assert near.columns == frame.columns and count(near) == {k: n for k, n in every.items() if k not in (5, 8)}  # 4 and 5 are both without a word, 8 a copy
    less = corpus_pipeline.drop_passages(spark, near, "")
    assert less.columns == frame.columns and count(less) == {k: 50 if k == 3 else n for k, n in count(near).items()}
    mixed = corpus_pipeline.mix_sources(spark, less, "")
    assert mixed.columns == frame.columns and set(count(mixed)) <= set(every)
    ids = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode(spark, less, "").collect()}
    assert set(ids) == set(count(less)) and ids[4] == 0 and ids[7] > 20_000
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.drop_passages, corpus_pipeline.mix_sources, corpus_pipeline.encode):
        assert stage(spark, docs([], lang=[], source=[]), "").count() == 0
