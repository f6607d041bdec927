"""Stages of the pipeline judge rows, not ids: ids may repeat or be missing."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def kept(df):
    return sorted(r["n_chars"] for r in df.collect())


def say(rng, n=30):
    return " ".join(rng.choice(["the", "river", "water", "stone", "garden", "letter", "window", "idle", "moral"]) for _ in range(n))


def test_toxic_rows(spark):
    from fiscora.llm.op8_toxicity import clean_documents

    rng = random.Random(1)
    bad = " you idiot moron"
    taught = [(i, say(rng) + bad * (i % 4 == 0)) for i in range(400)]
    rows = [*taught, (None, say(rng) + bad), (None, say(rng)), (None, None), (900, say(rng) + bad), (900, say(rng))]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = clean_documents(table(spark, rows), labels)
    assert kept(out) == [i for i in range(400) if i % 4] + [401, 402, 404]


def test_near_rows(spark):
    from fiscora.llm.op5_near_dedup import first_of_groups

    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(7, a), (7, a), (7, a + " more"), (None, b), (None, b), (None, b + " more"), (3, c), (5, c), (5, d), (None, c), (None, None), (None, None), (9, ""), (None, e)]
    out = kept(first_of_groups(table(spark, rows)))
    of = lambda *places: len(set(places) & set(out))
    assert of(0, 1, 2) == 1 and of(3, 4, 5) == 1
    assert [n for n in out if n >= 6] == [6, 8, 10, 11, 12, 13]


def test_contaminated_rows(spark, tmp_path):
    from corpus_pipeline import decontamination

    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = text(20)
    leak = lambda: f"{text(9)} {passage} {text(9)}"
    rows = [(None, leak()), (None, text(30)), (4, leak()), (4, text(30)), (5, text(30)), (None, None), (6, leak())]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, rows).withColumn("words", F.lit("own"))
    out = decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and kept(out) == [1, 3, 4, 5]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    table(spark, [(1, "a")]).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_repeated_rows_apart(spark, tmp_path):
    """Extra columns with clashing names pass all stages; repeated clean rows are near duplicates of each
    other, so one of them stays."""
    import corpus_pipeline

    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b = text(), text()
    rows = table(spark, [(1, a), (1, a), (1, b), (None, text()), (None, None), (None, None)])
    spark.createDataFrame([(1, text())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        rows = corpus_pipeline.written(stage(spark, rows, str(tmp_path)), name)
    out = kept(rows)
    assert len({0, 1} & set(out)) == 1 and [n for n in out if n > 1] == [2, 3, 4, 5]
