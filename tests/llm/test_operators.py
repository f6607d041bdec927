"""Each operator on small tables with nulls, empty and very long texts, ties, repeated rows, extra
columns with clashing names, and empty tables; and against brute force."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, grp long, words string, src string, term string"


def docs(spark, texts, source=None):
    rows = [(i, t, "en", source(i) if source else "s", 0, "fp", 1, "words", "src", "term") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


ODD = [None, "", " ", "\n\n", "one", "one two", LONG, "é ß ñ  x\t", "same text here", "same text here"]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# 1 -------------------------------------------------------------------------------------------------


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from fiscora.llm import op1_token_planes as op
    from fiscora.llm.common import scratch

    texts = [*ODD, " lead", "trail ", "two  spaces", "a \n b", "don't stop<|endoftext|>now", " no-break x"]
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    wanted, at = {}, 0
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        wanted[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert by_id(op.op1_token_planes(spark, docs(spark, texts)), "start", "n_tokens", "ids_crc32") == wanted
    path = scratch(spark, "t")
    op.write_tokens(docs(spark, texts), path, str(public_tokenizers.path("byte_bpe_50k.json")), 2, block_ids=64, chunk_ids=500)
    read = op.read_tokens(spark, path).collect()
    assert {r["doc_id"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in read} == {i: w[2] for i, w in wanted.items()}
    every = [i for r in sorted(read, key=lambda r: r["doc_id"]) for i in r["ids"]]
    for start, n in ((0, 10), (495, 20), (700, 1500), (len(every) - 3, 50), (len(every), 5)):
        got = [i for r in sorted(op.read_range(spark, path, start, n).collect(), key=lambda r: r["start"]) for i in r["ids"]]
        assert got == every[start : start + n]
    assert not op.op1_token_planes(spark, docs(spark, ODD).where("false")).count()
    repeated = spark.createDataFrame([(4, "a b"), (4, "a b"), (4, "c"), (None, "d e"), (None, None)], "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["n_tokens"]) for r in op.op1_token_planes(spark, repeated).collect())
    assert found == [("4", 2), ("4", 3), ("4", 3), ("None", 1), ("None", 3)]


def test_planes_round_trip():
    import zstandard

    from fiscora.llm.op1_token_planes import from_planes, to_planes

    for n, width in ((0, 2), (1, 2), (1000, 2), (4097, 3), (300, 4)):
        ids = np.random.default_rng(n).integers(0, 256**width, n).astype("<u4")
        planes = to_planes(ids, width, 256, zstandard.ZstdCompressor())
        assert (from_planes(planes, n, width, 256, zstandard.ZstdDecompressor()) == ids).all()
    with pytest.raises(ValueError):
        to_planes(np.array([70_000], "<u4"), 2, 256, zstandard.ZstdCompressor())


# 2 -------------------------------------------------------------------------------------------------


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(text, items):
    w, hit, found = words(text), set(), set()
    for item, x in items:
        v = words(x)
        n = min(10, len(v))
        for s in range(len(v) - n + 1) if v else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    from fiscora.llm import op2_decontaminate as op

    rng = random.Random(5)
    vocabulary = [f"{c}{d}" for c in "abcdé" for d in "xyz"] + ["the"] * 10
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(25)), (2, say(10)), (3, "rare pair"), (4, None), (5, ""), (6, "the"), (20, say(14)), (20, say(14)), (None, "x y")]
    texts = [*ODD, *[say(60) + " " + rng.choice(items[:3])[1].upper() + ", " + say(5) if i % 3 else say(80) for i in range(1, 40) if items[i % 3][1]], "rare-pair!", items[0][1][3:]]
    items_df = spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, pattern int")
    wanted = {i: leaks(t, [x for x in items if x[0] is not None]) for i, t in enumerate(texts)}
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(op.op2_decontaminate(docs(spark, texts), items_df), *columns) == wanted
    assert not op.op2_decontaminate(docs(spark, texts), items_df.where("false")).where("contaminated").count()
    assert not op.op2_decontaminate(docs(spark, texts).where("false"), items_df).count()
    index = op.build_index(docs(spark, ["a b c d", "a x b", "b a"]).select("doc_id", op.words(F.col("text")).alias("words")))
    patterns = spark.sql("SELECT 1L AS pattern, array(named_struct('term', 'a', 'offset', 0), named_struct('term', 'b', 'offset', 1)) AS terms")
    assert [(r["doc_id"], r["starts"]) for r in op.phrase_matches(index, patterns).collect()] == [(0, [0])]
    assert sorted(r["doc_id"] for r in op.proximity_matches(index, patterns, 1).collect()) == [0, 2]


# 3 -------------------------------------------------------------------------------------------------


def test_main_text(spark):
    from fiscora.llm.op3_main_text import main_text, op3_main_text

    story = "<p>Sentences with commas, many of them, and long enough to count as text.</p><p>More &amp; more, <a href=x>linked</a>, and so on, to the end of it.</p>"
    page = f"<html><head><title>T</title><script>var t='</p>';</script></head><body class=has-sidebar><nav><ul><li>Home</ul></nav><div id=cookie-notice><p>We use cookies, many of them, so please, accept them all, thanks.</div><div class=content><h1>Head</h1>{story}<p>Short.</div><aside><p>Other things, of no use, which are long enough, to be counted, too.</aside><section id=comments><p>I liked this, a lot, really, it was good, and so on.</section><footer>&copy; us</footer>"
    wanted = "Head Sentences with commas, many of them, and long enough to count as text. More & more, linked, and so on, to the end of it. Short."
    assert main_text(page) == wanted
    assert main_text(page.replace("div class=content", "article").replace("Short.</div>", "Short.</article>")) == wanted
    odd = [None, "", "plain", "<p>cut <b>off", "<<<>>", "<p>a</p>" * 5000, page, page]
    rows = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in op3_main_text(rows).collect()}
    assert found[0] == found[1] == ("", 0) and found[2] == ("plain", 5) and found[3] == ("cut off", 7)
    assert found[5][0] == " ".join("a" * 5000) and found[6] == found[7] == (wanted, len(wanted))
    assert not op3_main_text(rows.where("false")).count()
    assert html.unescape("&amp;") == "&"


def test_main_text_of_many_layouts():
    """Precision and recall of words over layouts whose text is known; names that speak against the
    article itself; markup that must not cost more than linear time."""
    import time

    from fiscora.llm.op3_main_text import main_text

    rng = random.Random(3)
    say = lambda n, mark="": " ".join(f"{mark}{rng.choice('abcdefgh')}{rng.randrange(90)}{',' * (k % 7 == 3)}" for k in range(n)) + "."
    paragraphs = lambda mark="": "".join(f"<p>{say(rng.randrange(8, 60), mark)}</p>" for _ in range(4))
    menu = lambda: "<ul>" + "".join(f"<li><a href=/{k}>{say(2, 'x')}</a></li>" for k in range(8)) + "</ul>"
    layouts = [
        lambda a: f"<nav>{menu()}</nav><article><h1>{say(4)}</h1>{a}</article><footer>{say(20, 'x')}</footer>",
        lambda a: f"<div id=menu>{menu()}</div><div class=content>{a}</div><div class=sidebar>{menu()}<p>{say(15, 'x')}</p></div>",
        lambda a: f"<div class='legal-text'>{a}</div><div class=footer>{say(9, 'x')}</div>",
        lambda a: f"<div class='notice-body'>{a}</div><div class=nav>{menu()}</div>",
        lambda a: f"<main>{a}<section class=comments>{paragraphs('x')}</section></main>",
        lambda a: f"<table><tr><td>{menu()}</td><td>{a}</td></tr></table>",
        lambda a: f"<div class=cookie-banner><p>{say(30, 'x')}</p></div><div><div>{a}</div></div>",
        lambda a: f"<header><h2>{say(5, 'x')}</h2>{menu()}</header><section class=post-body>{a}</section><aside>{paragraphs('x')}</aside>",
        lambda a: f"<div class=wrap><div class=entry>{a}</div><form><p>{say(12, 'x')}</p><input></form></div>",
        lambda a: f"<body class='no-sidebar'><div role=navigation>{menu()}</div><div role=main>{a}</div><div class='ad ad-top'>{say(25, 'x')}</div>",
        lambda a: f"<div class=story>{a.replace('</p>', '')}</div><div class=related>{menu()}</div>",
        lambda a: f"<article><header><h1>{say(5)}</h1></header>{a}</article><div class=newsletter-signup><p>{say(20, 'x')}</p></div>",
    ]
    right = wrong = missed = 0
    for layout in layouts * 5:
        page = layout(paragraphs())
        wanted = [w for w in re.sub(r"<[^>]*>", " ", page).split() if w[0] != "x"]
        found = main_text(page).split()
        right += len([w for w in found if w[0] != "x"])
        wrong += len([w for w in found if w[0] == "x"])
        missed += len(wanted) - len([w for w in found if w[0] != "x"])
    assert right / (right + wrong) >= 0.99 and right / (right + missed) >= 0.99, (right, wrong, missed)
    assert main_text("<p>First one, which is long enough.</p><p data-x=\"unclosed>second one, as long as the first</p>") == "First one, which is long enough. second one, as long as the first"
    for hard in ("<a " * 340_000, "<div>x" * 170_000, "<div>" * 200_000, '<p x="' * 150_000, "<span class=ad>" * 60_000, "<" * 1_000_000, "<!--" * 250_000):
        began = time.process_time()
        main_text(hard)
        assert time.process_time() - began < 4


# 4 -------------------------------------------------------------------------------------------------


def test_media(spark):
    from fiscora.llm import op4_jpeg_media as op
    from fiscora.llm.progressive_jpeg import decode, rgb

    rng = np.random.default_rng(4)
    payloads = [b"", b"a", bytes(range(256)) * 3, rng.bytes(1000), bytes(5000) + b"\1" + bytes(100) + b"\xff", bytes(rng.choice([0, 0, 0, 0, 0, 1, 255, 2], 20_000).tolist())]
    files = op.to_images(payloads)
    for payload, image in zip(payloads, decode(files), strict=True):
        assert op.payload_of(image) == (len(payload), op.padded(payload))
    alone = [rgb(decode([f])[0]) for f in files]
    assert all((a == rgb(b)).all() for a, b in zip(alone, decode(files), strict=True))
    assert op.to_images(payloads[2:3])[0] == files[2]
    rows = op.op4_jpeg_media(docs(spark, ODD)).collect()
    for r in rows:
        raw = (ODD[r["doc_id"]] or "").encode()
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(op.padded(raw)))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(op.padded(raw)).hexdigest(), zlib.crc32(op.padded(raw)[-64:]))
    same = [tuple(r)[1:] for r in rows if r["doc_id"] in (8, 9)]
    assert same[0] == same[1]
    shown = op.decode_media(op.encode_media(docs(spark, ["abc"]))).first()
    assert len(shown["tensor"]) == shown["height"] * shown["width"] * 3
    assert not op.op4_jpeg_media(docs(spark, ODD).where("false")).count()


def test_other_restart_intervals_and_transform():
    """One restart interval for a whole scan must give what one for each block does, and pixels must
    be those of the textbook transform."""
    from fiscora.llm import progressive_jpeg as j

    rng = np.random.default_rng(1)
    coefs = np.where(rng.random((24, 64)) < 0.3, rng.integers(-128, 128, (24, 64)), 0).astype(np.int16)
    image = j.decode(j.encode([(2, 2, coefs)], [b""]))[0]
    assert (image.coefs == coefs).all()
    part = image.parts[1]
    block = np.zeros(64)
    block[j.ZIGZAG] = coefs[16]
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    plain = np.clip(basis.T @ block.reshape(8, 8) @ basis + 128, 0, 255)
    assert np.abs(j.pixels(image, part, image.coefs)[:8, :8] - plain).max() <= 1


# 5 -------------------------------------------------------------------------------------------------


def brute_groups(texts, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_near_duplicates(spark, monkeypatch):
    from fiscora.llm import op5_near_dedup as op

    monkeypatch.setattr(op, "BLOCK", 8)  # so that groups are dealt into blocks
    rng = random.Random(2)
    base = [f"w{rng.randrange(60)}" for _ in range(90)]
    texts = [*ODD]
    for _ in range(40):
        other = list(base)
        for _ in range(rng.randrange(1, 5)):
            other[rng.randrange(90)] = f"n{rng.randrange(9)}"
        base = other if rng.random() < 0.3 else base
        texts.append(" ".join(other).upper() if rng.random() < 0.2 else " ".join(other))
    for k, percent in ((3, 85), (5, 80)):
        found = op.near_duplicates(docs(spark, texts), k, percent)
        assert by_id(found, "n_shingles", "component_id") == brute_groups(texts, k, percent)
    kept = op.first_of_groups(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute_groups(texts, 5, 80).items() if i == c}
    assert not op.op5_near_dedup(docs(spark, texts).where("false")).count()


def test_components(spark):
    from fiscora.llm.components import components

    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 200), (5, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 120)} | {200: 200, 201: 200}


# 6 -------------------------------------------------------------------------------------------------


def test_secrets(spark):
    from fiscora.llm import op6_secrets as op

    parts = ["password", "=", " ", "SECRET", ":", "token", "AKIA", "ABCD1234", "deadbeef", "0123", '"', "'", "é", "api_key", "ghp_", "A" * 9, "-----BEGIN PRIVATE KEY-----", "\n"]
    rng = random.Random(6)
    texts = [*ODD, *["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(300)], "x" * 2000 + "deadbeef" * 300]
    base = {"assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    wanted = {}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(base.items()) for m in re.finditer(p, t or "", re.ASCII) if (len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= (18 if kind == "access" else 16)))
        told = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        wanted[i] = (*[sum(s[3] == kind for s in spans) for kind in base], hashlib.sha256(told.encode()).hexdigest())
    more = {"private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/= \t\n\r]*-----END [A-Z ]*PRIVATE KEY-----)?", "forge_token": r"gh[pousr]_[A-Za-z0-9]{36,}", "chat_token": r"xox[abprs]-[0-9A-Za-z-]{10,}", "map_key": r"AIza[0-9A-Za-z_-]{35,}", "web_token": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*)?"}
    parts += ["xoxb-", "AIza", "eyJ", "eyJabcdefgh.", "b" * 30, "-----END PRIVATE KEY-----", "_", "-"]
    mixed = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    spans = op.Scanner(op.compiled(op.RULES), op.RULES).spans([t.encode() for t in mixed])
    for t, own in zip(mixed, spans, strict=True):
        assert [x for x in own if x[1] > 2] == sorted((m.start(), k, m.end()) for k, p in enumerate(more.values(), 3) for m in re.finditer(p, t, re.ASCII))
    found = op.op6_secrets(docs(spark, texts))
    assert by_id(found, "n_assign", "n_access", "n_hex", "base_sha256") == wanted
    assert not op.op6_secrets(docs(spark, texts).where("false")).count()


def test_automaton_against_expressions():
    from fiscora.llm.automaton import compile_rules, scan

    rules = ["ab+c", "(?i:xy?z)|q{2,3}w", "[a-c]{4}", "a(b|cd)*e"]
    automaton, rng = compile_rules(rules), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices("abcdexXyYzZqw", k=rng.randrange(60)))
        ends, masks = scan(automaton, text.encode(), lane=7)
        wanted = {}
        for k, rule in enumerate(rules):
            for e in range(1, len(text) + 1):
                if any(re.fullmatch(rule, text[s:e]) for s in range(e)):
                    wanted[e] = wanted.get(e, 0) | 1 << k
        assert dict(zip(ends.tolist(), masks.tolist(), strict=True)) == wanted


# 7 -------------------------------------------------------------------------------------------------


def test_surrogates(spark):
    from fiscora.llm.op7_surrogates import op7_surrogates, replace_personal_data

    texts = [*ODD, "Mail anna.berg@mail.example.com, 10.1.2.3 or 81.82.83.84.", "Mrs Anna Berg met Mr Carl Berg; Mrs Berg left. +1 (787) 555-1710", "4111111111111111 and 4111111111111112", "anna.berg@mail.example.com again", "господин Иван Петров"]
    found = by_id(op7_surrogates(docs(spark, texts)), "text", "n_entities")
    assert found[0] == (None, 0) or found[0][0] is None
    assert all(found[i] == (texts[i], 0) for i in range(1, 10))
    n = len(ODD)
    mail = re.search(r"\S+@[a-z.]+\.com", found[n][0])[0]
    assert mail != "anna.berg@mail.example.com" and re.fullmatch(r"[a-z]{4}\.[a-z]{4}@[a-z]{4}\.[a-z]{7}\.com", mail) and found[n + 3][0] == f"{mail} again"
    assert re.search(r" 10\.\d+\.\d+\.\d+ or \d+\.\d+\.\d+\.\d+\.$", found[n][0]) and "81.82.83.84" not in found[n][0]
    named = re.match(r"Mrs (\w+) (\w+) met Mr (\w+) (\w+); Mrs (\w+) left\. \+1 \(\d{3}\) \d{3}-\d{4}$", found[n + 1][0])
    assert named[2] == named[4] == named[5] != "Berg" and named[1].endswith("a") and named[3].endswith("n") and named[1] != named[3]
    luhn = lambda s: sum(int(c) if (len(s) - i) % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s)) % 10
    a, b = found[n + 2][0].split(" and ")
    assert a != b and luhn(a) == 0 and luhn(b) == luhn("4111111111111112") and "4111111111111111" not in (a, b)
    assert re.fullmatch(r"господин [А-Я][а-я]+н [А-Я][а-я]+", found[n + 4][0]) and "Иван" not in found[n + 4][0]
    assert not op7_surrogates(docs(spark, texts).where("false")).count()
    same = [
        "Dr Anna Berg came. Mrs Anna Berg spoke; Anna Berg left, and BERG slept. Mrs Anna, too.",
        "Call +1 (787) 555-7713 or +1-787-555-7713, pay 4111 1111 1111 1111 or 4111111111111111.",
        "Write to A.Berg@Mail.example.com or a.berg@mail.example.com.",
        "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000, not DE88370400440532013000.",
        "Anna walks by the Berg.",
    ]
    rows = spark.createDataFrame([(3, same[0]), (3, same[0]), (3, same[1]), (None, same[2]), (None, same[3]), (8, same[4]), (9, None)], "doc_id long, text string")
    out = {}
    for r in op7_surrogates(rows).collect():
        out.setdefault((r["doc_id"], r["n_entities"]), []).append(r["text"])
    assert out[(8, 0)] == [same[4]] and out[(9, 0)] == [None]
    (name, again), (number,), (mail,), (iban,) = out[(3, 6)], out[(3, 4)], out[(None, 2)], out[(None, 3)]
    assert name == again
    m = re.fullmatch(r"Dr (\w+) (\w+) came\. Mrs (\w+) (\w+) spoke; (\w+) (\w+) left, and (\w+) slept\. Mrs (\w+), too\.", name).groups()
    assert m[0] == m[2] == m[4] == m[7] != "Anna" and m[0].endswith("a") and m[1] == m[3] == m[5] != "Berg" and m[6] == m[1].upper()
    a, b, c, d = re.fullmatch(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1-\d{3}-\d{3}-\d{4}), pay (4\d{3} \d{4} \d{4} \d{4}) or (4\d{15})\.", number).groups()
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(a) == digits(b) != "17875557713" and digits(c) == d != "4" + "1" * 15 and luhn(d) == 0
    a, b = re.fullmatch(r"Write to ([A-Z]\.[A-Z][a-z]{3}@[A-Z][a-z]{3}\.[a-z]{7}\.com) or ([a-z.]+@[a-z.]+\.com)\.", mail).groups()
    assert a.lower() == b != "a.berg@mail.example.com"
    right = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    a, b, c = re.fullmatch(r"IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) or (DE\d{20}), not (DE\d{20})\.", iban).groups()
    assert a.replace(" ", "") == b != "DE89370400440532013000" and right(b) and not right(c)
    with pytest.raises(TypeError):
        replace_personal_data(rows)


# 8 -------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    from fiscora.llm import op8_toxicity as op

    rng = random.Random(8)
    plain = ["the", "river", "water", "stone", "garden", "letter", "window", "idle", "moral"]
    say = lambda bad: " ".join(rng.choice(plain) for _ in range(30)) + (" you idiot moron" if bad else "")
    noisy = ["you 1d10t m0r0n the river", "i d i o t and m o r o n by the water", "idiooot mooooron garden", "he is a i d i o t and a m o r o n", "y o u 1 d 1 0 t by the stone", "the iidiioott moorroonn river", "x 1 " * 3000 + "1" * 9000]
    texts = [say(i % 4 == 0) for i in range(400)] + noisy + ODD
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0) if i % 9 else None) for i in range(400)], "doc_id long, quality int, toxic int")
    found = by_id(op.op8_toxicity(docs(spark, texts), labels), "held_out", "score", "predicted")
    assert all(found[i][0] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(len(texts)))
    assert all(found[i][2] == (i % 4 == 0) for i in range(400))
    assert [found[400 + i][2] for i in range(7)] == [1, 1, 1, 1, 1, 1, 0]
    assert all(found[407 + i][2] == 0 and 0 <= found[407 + i][1] <= 1 for i in range(len(ODD)))
    kept = op.clean_documents(docs(spark, texts), labels)
    assert kept.columns == docs(spark, texts).columns and kept.count() == sum(1 - f[2] for f in found.values())
    none = by_id(op.op8_toxicity(docs(spark, texts[:5]), labels.where("false")), "predicted")
    assert set(none.values()) == {(0,)}
    assert not op.op8_toxicity(docs(spark, texts).where("false"), labels).count()


# 9 -------------------------------------------------------------------------------------------------


def brute_runs(texts, least):
    lines = [t.split("\n") if t is not None else [] for t in texts]
    gone = defaultdict(set)
    for d, own in enumerate(lines):
        for p in range(len(own)):
            best = 0
            for e in range(d + 1):
                for q in range(p if e == d else len(lines[e])):
                    n = 0
                    while p + n < len(own) and q + n < len(lines[e]) and own[p + n] == lines[e][q + n]:
                        n += 1
                    best = max(best, n)
            if sum(len(x.split()) for x in own[p : p + best]) >= least:
                gone[d].update(range(p, p + best))
    return {d: sorted(gone[d]) for d in range(len(texts))}


def test_line_runs(spark):
    from fiscora.llm import op9_line_runs as op

    rng = random.Random(9)
    pool = [" ".join(rng.choices("abcdefg", k=n)) for n in (1, 2, 3, 5, 8, 0, 12)]
    texts = [t for t in ODD if t != LONG] + ["\n".join(rng.choices(pool, k=rng.randrange(1, 14))) for _ in range(25)]
    texts += [texts[-1] + "\nmore", "x\n" + texts[-2]]
    for least in (4, 9, 20):
        out = op.drop_repeated_runs(docs(spark, texts), least)
        assert {i: v[0] for i, v in by_id(out, "deleted").items()} == brute_runs(texts, least)
    # Rows that are the same in id and text are one place, and each of them keeps its result.
    again = op.drop_repeated_runs(docs(spark, texts).unionByName(docs(spark, texts).where("doc_id % 3 = 0")), least).collect()
    single = by_id(out, "deleted", "text")
    assert len(again) == len(texts) + len(range(0, len(texts), 3)) and all(single[r["doc_id"]] == (r["deleted"], r["text"]) for r in again)
    # Ids that are missing, or repeat with other texts, are places of their own.
    run = "\n".join(" ".join("abcdefgh"[:k]) + f" {k}" for k in range(1, 8))
    rows = spark.createDataFrame([(None, run), (5, "x\n" + run), (5, "y z"), (7, run + "\nend"), (7, run + "\nend")], "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["text"], len(r["deleted"])) for r in op.drop_repeated_runs(rows, 20).collect())
    assert found == [("5", "x", 7), ("5", "y z", 0), ("7", "end", 7), ("7", "end", 7), ("None", run, 0)]
    kept = by_id(out, "text", "deleted")
    assert all(kept[i][0] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in kept[i][1])) for i, t in enumerate(texts))
    assert not op.op9_line_runs(docs(spark, texts).where("false")).count()


# 10 ------------------------------------------------------------------------------------------------


def test_mixture(spark):
    from fiscora.llm import op10_mixture as op

    rng = random.Random(10)
    texts = [*ODD, *[" ".join("w" for _ in range(rng.randrange(1, 40))) for _ in range(2000)]]
    table = docs(spark, texts, lambda i: None if i % 50 == 0 else "big" if i % 3 else f"s{i % 4}")
    found = op.op10_mixture(table).collect()
    assert {r["doc_id"] for r in found} == set(range(len(texts)))
    tokens, weights = defaultdict(int), {}
    for r in found:
        tokens[r["source"]] += r["n_tokens"]
        weights[r["source"]] = r["weight"]
    total = sum(tokens.values())
    assert abs(sum(weights.values()) - 1) < 1e-9 and max(r["epoch"] for r in found) <= 4 + 1
    # Partial epochs fall short by less than a document.
    assert all(abs(tokens[s] - weights[s] * total) < 60 + 0.01 * total * weights[s] for s in weights)
    share = [w for w in weights.values() if w]
    assert -sum(w * np.log(w) for w in share) >= 0.95 * np.log(len(share)) or max(r["epoch"] for r in found) >= 4
    mixed = op.mix_documents(table)
    assert mixed.columns == table.columns and mixed.count() == len(found)
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in found)
    assert not op.op10_mixture(table.where("false")).count()
    small = op.op10_mixture(table, op.Target(budget=5000.0)).agg(F.sum("n_tokens")).first()[0]
    assert 0 < small <= 5000


# pipeline ------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [say(60) for _ in range(60)]
    bench = say(30)
    texts += [texts[0], texts[1] + " more", say(20) + " " + bench + " " + say(20), say(30) + " you idiot moron", None, ""]
    texts += [say(30) + (" you idiot moron" if i % 2 else "") for i in range(200)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(66 + i, i % 2) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixture", "tokens"]
    found = {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    clean = (set(range(60)) | {64, 65} | {66 + i for i in range(200) if not i % 2})
    assert found == clean
