"""The toxicity model keeps every significant term, not the first thousand."""

import random
import zlib

import numpy as np


def test_terms_beyond_a_thousand(spark):
    from fiscora.llm import op8_toxicity as op

    rng = random.Random(4)
    # Twelve groups of a hundred words; the last letters rank behind the first thousand terms.
    groups = [[f"{g}{a}{b}" for a in "bdfghjkmpr" for b in "aeiouvwxyz"] for g in "abcdefghijkl"]
    plain = ["the", "river", "water", "stone", "garden", "letter", "window"]
    say = lambda: " ".join(rng.choice(plain) for _ in range(20))
    taught = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"{say()} {' '.join(groups[n % 48])}" if n % 48 < 12 else say(), int(n % 48 < 12)) for n, i in enumerate(taught[:480])]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    asked = [(5000 + n, f"{say()} {' '.join(g)}", 1) for n, g in enumerate(groups)] + [(6000, say(), 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + asked], "doc_id long, text string")
    found = {r["doc_id"]: r["predicted"] for r in op.op8_toxicity(docs, labels).collect()}
    assert [found[i] for i, _, _ in asked] == [y for _, _, y in asked]


def test_plain_words():
    """Words that need no reading are told apart as the expressions would, and do not fill the cache."""
    from fiscora.llm.op8_toxicity import BACK, DOUBLED, ENDS, FRONT, SOFT_ENDS, Restorer, plain_words

    tokens = {"abc", "abba", "été", "a1", "abc,", "x", "aa", "zz", "za", "(abc)", "[abc]!"}
    assert plain_words(tokens) == {"abc", "x", "za"} and plain_words(set()) == set()
    for front in ("", *FRONT, "...", "[("[:1]):
        for back in ("", *BACK, "!!", ")."):
            token = front + "word" + back
            assert ENDS.sub("", token) == SOFT_ENDS.sub("", token) == "word" == token.lstrip(FRONT).rstrip(BACK)
    own = Restorer(np.ones(27**3, np.int64), frozenset({"loser", "idiot"}))
    assert own.terms("un loser, looser! i d i o t (idiot) ïdiot") >= {"loser", "looser", "idiot", "ïdiot"}
    assert own.terms_of("looser!") == ("looser", "loser") and own.features("looser! nada, loser", {"loser": 0}) == ([0], np.log1p(1))
    assert "nada," not in own.seen and DOUBLED.search("looser")
    assert own.occurrences("a b") == ["a", "b"] and own.occurrences("x a b c y z") == ["x", "a", "b", "c", "y", "z", " xabcyz"]
