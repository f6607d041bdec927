"""What a task may hold at a time."""

import random
import tracemalloc


def test_near_dedup_holds_one_worker_and_small_batches(spark, monkeypatch):
    from fiscora.llm import components, op5_near_dedup as op

    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, written = spark.conf.get(name, None), op.written

    def watched(df, to):
        seen.append((to, df._jdf.queryExecution().executedPlan().toString().count("MapInArrow"), spark.conf.get(name)))
        return written(df, to)

    monkeypatch.setattr(op, "BLOCK", 8)  # so that groups are dealt into blocks
    monkeypatch.setattr(op, "written", watched)
    monkeypatch.setattr(components, "written", watched)
    rng = random.Random(7)
    base, texts = [f"w{i}" for i in range(60)], []
    for _ in range(40):
        base[rng.randrange(60)] = f"n{rng.randrange(99)}"
        texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert op.near_duplicates(docs).count() == 40
    assert {"roots", "links", "parted"} <= {to for to, _, _ in seen}
    assert max(n for _, n, _ in seen) == 1, seen
    assert {most for _, _, most in seen} == {"4m"}
    assert spark.conf.get(name, None) == before


def test_shingling_holds_small_arrays():
    from fiscora.llm import op5_near_dedup as op

    texts = [(f"word{i} and others of it, " * 40).encode() for i in range(4000)]
    tracemalloc.start()
    held = sum(len(s) for a, b in op.pieces(texts) for s in op.shingle_sets(texts[a:b], 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held and most < 24 << 20


def test_stored_planes_give_the_whole_tensors(spark):
    """Half of the tensors' bytes are stored, and every one of them comes back."""
    from fiscora.llm import op4_jpeg_media as op

    rng = random.Random(4)
    texts = [None, "", "a", "é世" * 700, *("".join(chr(rng.randrange(32, 127)) for _ in range(rng.randrange(4000))) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    media = op.encode_media(docs).cache()
    key = lambda r: r["doc_id"]
    whole = sorted(op.decode_media(media).collect(), key=key)
    stored = sorted(op.decode_planes(media).collect(), key=key)
    assert sorted(op.tensors_of(op.decode_planes(media)).collect(), key=key) == whole and len(whole) == len(texts)
    assert all(2 * len(a["planes"]) == len(b["tensor"]) == 3 * b["height"] * b["width"] for a, b in zip(stored, whole, strict=True))
    assert sorted(op.op4_jpeg_media(docs).collect(), key=key) == sorted(op.decode_media(media).drop("tensor").collect(), key=key)
    media.unpersist()
