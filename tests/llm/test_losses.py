"""Rows and texts that must not be lost: articles with doubtful names, sources and copies without ids."""

import random

import pytest
from pyspark.sql import functions as F

BODY = "".join(f"<p>Paragraph {i} of the article says something, at some length, about rivers and stones.</p>" for i in range(8))
TEXT = " ".join(f"Paragraph {i} of the article says something, at some length, about rivers and stones." for i in range(8))
NAV = "<nav><a href=/>Home</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{NAV}<article id='post-1' class='post comments-open'>{BODY}</article><div>Some other block of the page, not short at all, with a comma.</div></body>",
        f"<body>{NAV}<main class='page has-comments'>{BODY}</main></body>",
        f"<body>{NAV}<article class='post related-posts-enabled'>{BODY}</article><footer>All rights</footer></body>",
        f"<body><form action='/x'>{NAV}<div>{BODY}</div></form></body>",
        f"<body>{NAV}<div>{BODY}</div><form><p>Leave your name, your mail and a word.</p></form></body>",
        f"<body>{NAV}<article>{BODY}<p style='display:none'>Hidden words that no reader sees, ever.</p></article></body>",
        f"<body>{NAV}<article>{BODY}</article><section><article class='comment'><p>I liked this, a lot, thank you so much.</p></article></section></body>",
    ],
)
def test_articles_with_doubtful_names(page):
    from fiscora.llm.op3_main_text import main_text

    assert main_text(page) == TEXT


def test_sources_without_ids_keep_their_share(spark):
    from fiscora.llm.op10_mixture import Target, mix_documents

    rng = random.Random(3)
    say = lambda i: f"{i} " + " ".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 12)))
    rows = [(None, say(i), "big") for i in range(1000)] + [(i, say(i), "small") for i in range(400)] + [(7, say(i), "same") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    whole = mix_documents(docs, Target()).groupBy("source").count().collect()
    assert {r["source"] for r in whole} == {"big", "small", "same"}
    half = mix_documents(docs, Target(budget=4000.0)).select("source", F.size(F.split("text", " ")).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    got = {r["source"]: r["n"] for r in half.collect()}
    from fiscora.llm.op10_mixture import op10_mixture

    weight = {r["source"]: r["weight"] for r in op10_mixture(docs, Target(budget=4000.0)).select("source", "weight").distinct().collect()}
    assert abs(sum(got.values()) - 4000) < 40
    assert all(abs(got[s] / 4000 - w) < 0.02 for s, w in weight.items())


def test_links_of_rows_without_ids(spark):
    from fiscora.llm.op5_near_dedup import op5_near_dedup

    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(5, a), (None, a), (None, a + " more"), (None, b), (None, b + " more"), (None, c), (9, c + " more"), (None, None), (3, text())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = op5_near_dedup(docs).select("doc_id", "component_id", "kept", "n_shingles").collect()
    found = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"], r["n_shingles"]) for r in out)
    assert found == sorted([("5", "5", True, 78), ("None", "5", False, 78), ("None", "5", False, 79), ("None", "None", True, 78), ("None", "None", True, 79), ("None", "9", False, 78), ("9", "9", True, 79), ("None", "None", True, 0), ("3", "3", True, 78)])


def test_many_blank_lines_cost_a_row_each(spark):
    from fiscora.llm import op9_line_runs as op

    blank = "\n" * 3000
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{blank}{passage}\nend one"), (2, f"{blank}{passage}\nend two"), (3, "other\n" + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in op.op9_line_runs(docs).collect()}
    assert got == {1: (0, rows[0][1]), 2: (3001, "end two"), 3: (1, "other")}
    windows = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 1, 5), (1, 0, 6, 2), (1, 0, 9, 1), (2, 0, 4, 4), (2, 0, 4, 2)], "d long, t long, pos int, m int")
    assert sorted((r["d"], r["start"], r["stop"]) for r in op.merged(windows).collect()) == [(1, 0, 7), (1, 9, 9), (2, 4, 7)]
