"""Fill-in-middle, permutation index and Merkle manifest against brute force, on odd rows as well."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

LONG = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20_000))
ODD = [None, "", " ", "\n", "\n\n\n", "one", "one\n", "a\nb", "a\r\nb\r\n", LONG, "y" * 9000, "x <P> y\nz", "<S>", "a<M>", "<<\n<\nP>\n", "é\n\U0001f600ß\n", "same\ntext\n", "same\ntext\n", "<", ">\n<"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, output string, form string, i long, grp string, hash string, path string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, n, "o", "f", 1, "g", "h", "p") for i, t, lang, source, n in rows], SCHEMA).repartition(3)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# 11 ------------------------------------------------------------------------------------------------


def filled(doc_id, text, percent=100, spm=50):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = [int(sha(f"7:{'' if doc_id is None else doc_id}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(u), "plain", None, None, t
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    from fiscora.llm import op11_fill_in_middle as op

    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["a", "bb c", "\n", "\n\n", "<", "é"]) for _ in range(rng.randrange(4000))) for _ in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "a\nb\nc", "en", "s", 0), (5, "other\nrow\n", "en", "s", 0), (-7, "k\nl", "en", "s", 0)]
    table = docs(spark, rows)
    for percent, spm in ((100, 50), (60, 0), (0, 50), (100, 100)):
        out = op.unfilled(op.fill_in_middle(table, percent=percent, spm_percent=spm)).collect()
        wanted = sorted((str(i), *map(str, filled(i, t, percent, spm)), t or "") for i, t, *_ in rows)
        assert sorted((str(r["doc_id"]), *map(str, (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])), r["restored"]) for r in out) == wanted
    got = op.op11_fill_in_middle(table).collect()
    assert sorted((str(r["doc_id"]), r["output_sha256"], r["restored_sha256"]) for r in got) == sorted((str(i), sha(filled(i, t)[4]), sha(t or "")) for i, t, *_ in rows)
    assert not op.op11_fill_in_middle(table.where("false")).count()


def test_rope():
    from fiscora.llm.op11_fill_in_middle import Rope, joined

    text = "".join(f"{'z' * (i * 37 % 300)}\n" for i in range(3000)) + "end"
    rope, lines = Rope.of(text), text.splitlines(keepends=True)
    assert rope.lines() == 3001 and rope.chars == len(text) and rope.ends == 3000 and str(rope) == text
    for k in (0, 1, 2, 17, 2999, 3000, 3001, 4000):
        a, b = rope.at_line(k)
        assert (str(a), str(b)) == ("".join(lines[:k]), "".join(lines[k:])) and a.chars + b.chars == len(text)
    for k in (0, 1, 2047, 2048, 100_000, len(text) - 1, len(text)):
        a, b = rope.at_char(k)
        assert (str(a), str(b)) == (text[:k], text[k:])
    assert str(joined(rope, Rope(), Rope("x"))) == text + "x" and not joined().chars


# 12 ------------------------------------------------------------------------------------------------


def exact(rows, k, step=20):
    by_id = {}
    dims = [len(v) for _, v in rows if good(v)]
    dim = max(sorted(set(dims)), key=dims.count) if dims else 0
    for i, v in rows:
        if good(v) and len(v) == dim and i is not None:
            by_id[i] = min(by_id.get(i, v), v)
    every = [*by_id.items(), *[(None, v) for i, v in rows if i is None and good(v) and len(v) == dim]]
    out = {}
    for q, v in by_id.items():
        if q % step == 0:
            scored = sorted((-float((np.array(x, float) * np.array(v, float)).sum()), i is None, i or 0) for i, x in every if i != q)
            out[q] = [(None if none else i, -s) for s, none, i in scored[:k]]
    return out


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q, rows in a.items():
        assert [i for i, _ in rows] == [i for i, _ in b[q]]
        assert np.allclose([s for _, s in rows], [s for _, s in b[q]], rtol=1e-12)


def test_nearest(spark):
    from fiscora.llm import op12_permutation_index as op

    rng = np.random.default_rng(4)
    vector = lambda scale=1.0: [float(np.float32(x)) for x in rng.normal(size=8) * scale]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else vector(1 + i % 4)) for i in range(900)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [1.0, float("nan")] + [0.0] * 6), (2080, [1.0, None] + [0.0] * 6), (2100, [float("inf")] + [1.0] * 7), (2120, vector()[:5]), (None, vector()), (None, hot), (40, vector()), (41, vector())]
    table = spark.createDataFrame([(i, v, 1, 2, "h", 3) for i, v in rows], "vec_id long, embedding array<float>, shard int, block int, v string, part int").repartition(4)
    query = F.col("vec_id") % 20 == 0
    every = exact(rows, 20)
    same(found(op.nearest(table, query, 20, share=1.0)), every)
    few = found(op.nearest(table, query, 20, share=0.3, pivots=64, places=16))
    hits = [len({i for i, _ in few[q]} & {i for i, _ in every[q]}) for q in every]
    assert few.keys() == every.keys() and all(len(x) == 20 for x in few.values()) and sum(hits) / (20 * len(hits)) > 0.9
    small = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    same(found(op.op12_permutation_index(small)), {0: [(2, 1.0), (3, 1.0), (20, 0.5)], 20: [(0, 0.5), (2, 0.5), (3, 0.5)]})
    assert not op.op12_permutation_index(small.where("vec_id = 0")).count()
    assert not op.op12_permutation_index(table.where("false")).count()


def test_many_shards(spark, monkeypatch):
    from fiscora.llm import op12_permutation_index as op

    monkeypatch.setattr(op, "SHARD_VALUES", 100)
    monkeypatch.setattr(op, "BLOCK", 10)
    monkeypatch.setattr(op, "TOGETHER", 3)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(found(op.nearest(table, F.col("vec_id") % 20 == 0, 7, share=1.0, pivots=16, places=4)), exact(rows, 7))


def test_recall(spark):
    from fiscora.llm import op12_permutation_index as op

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got, every = found(op.op12_permutation_index(table)), exact(rows, 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in every[q]}) for q in every) >= 0.95 * 20 * len(every)


def test_footrule():
    from fiscora.llm.op12_permutation_index import shared_places

    rng = np.random.default_rng(8)
    queries, points = (np.array([rng.permutation(12)[:5] for _ in range(n)]) for n in (7, 30))
    order = np.argsort(points, axis=None, kind="stable")
    starts = np.searchsorted(points.reshape(-1)[order], np.arange(13))
    sums = shared_places(queries, starts, order // 5, order % 5, 30)
    place = lambda row, p: list(row).index(p) if p in row else 5
    wanted = [[sum(abs(place(q, p) - place(x, p)) for p in range(12)) for x in points] for q in queries]
    assert (30 - 2 * sums == wanted).all()


# 13 ------------------------------------------------------------------------------------------------


def manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t, lang, source, n: sha("".join(map(field, (i, source, lang, n, t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))

    def tree(level):
        paths, under = [[] for _ in level], [[k] for k in range(len(level))]
        while len(level) > 1:
            for k, leaves in enumerate(under):
                for x in leaves:
                    paths[x].append((level[k ^ 1] if k ^ 1 < len(level) else "", k & 1))
            level = [sha("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
            under = [sum(under[k : k + 2], []) for k in range(0, len(under), 2)]
        return level[0], paths

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = tree([own[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for n, (_, _, x, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = own[g][1][n] + above[k]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            h = leaf(*r[:4], r[4] + 1) if bad else x
            for sibling, first in path:
                h = sha(sibling + h if first else h + sibling)
            out.append((str(r[0]), x, own[g][0], root, sha("".join(s for s, _ in path)), h, h == root))
    return sorted(out)


COLUMNS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_merkle(spark):
    from fiscora.llm import op13_merkle_manifest as op

    rng = random.Random(9)
    rows = [(i, t, rng.choice(["de", "en", "en", "en", None, "", "é"]), rng.choice(["a", None, "bé"]), rng.choice([None, i, 2**63 - 1])) for i, t in enumerate(ODD + ["x"] * 180)]
    rows += [(None, "n", "en", "a", 1), (None, None, None, None, None), (5, "again", "en", "a", 2), (5, "again", "en", "a", 2), (77, "alone", "zz", "a", 3), (-3, "first", "en", "a", 4)]
    table, wanted = docs(spark, rows), manifest(rows)
    for height, top in ((10, 4096), (3, 4096), (2, 7), (1, 6), (2, 3)):
        got = sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS]) for r in op.op13_merkle_manifest(table, height, top).collect())
        assert got == wanted, (height, top)
    assert {r[-1] for r in wanted} == {True, False}


def test_small_manifests(spark):
    from fiscora.llm import op13_merkle_manifest as op

    for rows in ([], [(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, "b", "de", "s", 1)], [(2, "a", "en", "s", 1), (1, "b", "en", "s", 1), (3, None, "en", None, None)]):
        got = sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS]) for r in op.op13_merkle_manifest(docs(spark, rows)).collect())
        assert got == (manifest(rows) if rows else [])
