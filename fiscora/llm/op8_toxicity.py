"""Toxicity by noisy-channel deobfuscation.

Written tokens are seen as noisy forms of hidden words: letters replaced by look-alikes, separators
between letters, letters drawn out, and words spelt with spaces. Each suspicious token (or run of
single characters) becomes a lattice of the letters that its characters may stand for; a Viterbi
search keeps the best readings by last two letters under a character trigram model of the whole
corpus. The restored terms are scored by a logistic model.

What is learnt: trigram counts from all documents; document frequencies of restored terms from all
labelled training rows; the weights of all terms that pass the test of telling_terms, however many,
from FIT_ROWS of these rows (but for the chance of a hash), taken by a hash of their numbers, so
that repeated rows count one by one (a bounded sample, as the parameters say). Labelled rows are joined by one plan at every size, and
stored; no other text is shuffled twice. Rows held out by the caller are never learnt from. Scores
use the text alone.

Defined results: null and empty texts have no terms and get the model's base rate; without any
labels, or with labels of one kind only, all scores are that kind's share (0 without labels);
repeated rows are scored alike; labels without a value are ignored; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscora.llm.common import kept, written

#: Labelled rows that fit the model, and readings kept for each pair of last letters.
FIT_ROWS, READINGS = 60_000, 6
THRESHOLD = 0.7
#: Characters whose trigrams are counted at once.
PIECE = 1 << 18
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: What a character may stand for, besides itself.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ο": "o", "α": "a", "ι": "i", "à": "a", "á": "a", "â": "a", "ä": "a", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ò": "o", "ó": "o", "ô": "o", "ö": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u"}
#: Costs in nats: reading a look-alike, dropping a separator, reading a letter again as drawn out.
SWAP, DROP, AGAIN = 1.0, 1.0, 0.5

#: What marks a run of single characters among tokens, and the characters of a token that are read
#: at once; parts of a longer one overlap by half.
RUN, PART = " ", 64
#: Accented and foreign look-alikes of one letter, as a translation.
FOLD = {ord(c): x for c, x in LOOKS.items() if c.isalpha()}

DOUBLED = re.compile(r"([^\W\d_])\1+")
SPELT = re.compile(r"(?<!\S)[^\s](?:[ \t]{1,3}[^\s]){2,}(?!\S)")
DRAWN = re.compile(r"([^\W\d_])\1\1")
ENDS = re.compile(r"^[\W_]+|[\W_]+$")
#: A token may begin or end with look-alikes, but a longer row of signs is ornament.
SOFT_ENDS = re.compile(r"^[^\w@$!|+(<€£¡]+|[^\w@$|+€£]+$|^[\W_]{3,}|[\W_]{3,}$|!+$")
#: Signs that both of these take from the front and from the end of a token.
FRONT, BACK = "\"'.,;:-)[]{}*#/\\?&%=~^`>", "\"'.,;:-)[]{}*#/\\?&%=~^`>(<!"


def gram_codes(text: str | None) -> Iterator[np.ndarray]:
    """Codes of the letter trigrams of a text, a piece at a time; what is no letter a-z is a border (0)."""
    low = (text or "").lower()
    for at in range(0, len(low), PIECE):
        # Two characters of the piece before come along, so that no trigram is lost or counted twice.
        data = np.frombuffer((low[max(at - 2, 0) : at + PIECE]).encode("ascii", "replace"), np.uint8)
        code = np.where((data >= 97) & (data <= 122), data - 96, 0).astype(np.int32)
        code = np.concatenate([[0, 0] if at == 0 else [], code, [0] if at + PIECE >= len(low) else []]).astype(np.int32)
        yield (code[:-2] * 27 + code[1:-1]) * 27 + code[2:]


class Model:
    """log P(letter | two before), from trigram counts, smoothed by bigrams and letters."""

    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(27, 27, 27).astype(float)
        n3[:, 0, 0] = 0
        p1 = (n3.sum((0, 1)) + 1) / (n3.sum() + 27)
        n2 = n3.sum(0)
        p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2[None]) / (n3.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).tolist()

    def readings(self, token: str) -> list[str]:
        """Likely hidden words of a token, the best first."""
        best: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
        for c in token:
            options = [(ord(x) - 96, x, SWAP) for x in LOOKS.get(c, "")]
            if c in LETTERS:
                options = [(ord(c) - 96, c, 0.0)]
            grown: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), held in best.items():
                costs = self.cost[a][b]
                for k, x, swap in options:
                    step = costs[k] + swap
                    grown.setdefault((b, k), []).extend((cost + step, word + x) for cost, word in held)
                    if k == b:
                        grown.setdefault((a, b), []).extend((cost + AGAIN + swap, word) for cost, word in held)
                if c not in LETTERS:
                    drop = DROP if not c.isalnum() else 8 * DROP
                    grown.setdefault((a, b), []).extend((cost + drop, word) for cost, word in held)
            best = {k: sorted(set(v))[:READINGS] for k, v in grown.items()}
        ended = sorted((cost + self.cost[a][b][0], word) for (a, b), held in best.items() for cost, word in held if word)
        return [word for _, word in ended[: 4 * READINGS]]


def plain_words(tokens: set[str]) -> set[str]:
    """The tokens of a-z alone in which no letter is doubled: each is its own only term."""
    words = [t for t in tokens if t.isascii() and t.isalpha()]
    codes = np.frombuffer(" ".join(words).encode(), np.uint8)
    doubled = np.cumsum(codes == 32)[:-1][codes[1:] == codes[:-1]]
    return set(words).difference([words[i] for i in doubled.tolist()])


def parts(token: str) -> list[str]:
    return [token[a : a + PART] for a in range(0, max(len(token) - PART // 2, 1), PART // 2)]


class Restorer:
    """Restored terms of texts. known: terms that win over likelier readings outside of them."""

    def __init__(self, counts: np.ndarray, known: frozenset[str] = frozenset(), cache: int = 80_000):
        self.model, self.known, self.cache = Model(counts), known, cache
        self.thin = {DOUBLED.sub(r"\1", x): x for x in sorted(known)}
        self.longest = max(map(len, known), default=0)
        self.seen: dict[str, tuple[str, ...]] = {}

    def reading(self, token: str) -> tuple[str, ...]:
        found = [words for part in parts(token) if (words := self.model.readings(part))]
        return tuple(next((w for w in words if w in self.known), words[0]) for words in found)

    def inside(self, run: str) -> set[str]:
        """Known terms in a row of letters whose word boundaries are not known."""
        return {w for a in range(len(run)) for b in range(a + 3, min(len(run), a + self.longest) + 1) if (w := run[a:b]) in self.known}

    def word_terms(self, word: str) -> tuple[str, ...] | None:
        """Terms of a row of letters, or None if one of them is drawn out."""
        found: tuple[str, ...] = (word,)
        if not word.isascii() and (folded := word.translate(FOLD)) in self.known:
            found += (folded,)
        if DOUBLED.search(word):
            if DRAWN.search(word):
                return None
            if word not in self.known and (thick := self.thin.get(DOUBLED.sub(r"\1", word))):
                found += (thick,)
        return found

    def terms_of(self, token: str) -> tuple[str, ...]:
        # Words are quicker told than looked up, and so many that they would push out all others.
        word = token if token.isalpha() else token.lstrip(FRONT).rstrip(BACK)
        if word.isalpha() and (found := self.word_terms(word)):
            return found
        if (found := self.seen.get(token)) is not None:
            return found
        if token[0] == RUN:
            run = token[1:]
            own = self.terms_of(run)
            found = {*own, *self.inside(run), *(w for part in parts(run) if not part.isalpha() for x in self.model.readings(part)[:READINGS] for w in self.inside(x))}
            return self.keep(token, tuple(sorted(found)))
        core, soft = ENDS.sub("", token), SOFT_ENDS.sub("", token)
        found = (core,) if core else ()
        if not core.isascii() and (folded := core.translate(FOLD)) in self.known:
            found += (folded,)
        if core not in self.known and DOUBLED.search(core) and (thick := self.thin.get(DOUBLED.sub(r"\1", core))):
            found += (thick,)
        if core and not core.isalpha() or DRAWN.search(core):
            if any(c.isalpha() for c in core):
                found += self.reading(core)
        if soft != core and any(c.isalpha() for c in soft):
            found += self.reading(soft)
        return self.keep(token, found)

    def keep(self, token: str, found: tuple[str, ...]) -> tuple[str, ...]:
        if len(self.seen) >= self.cache:
            self.seen.clear()
        if len(token) <= PART:
            self.seen[token] = found
        return found

    def occurrences(self, text: str | None) -> list[str]:
        """Tokens of a text and its spelt-out runs, each as it is written."""
        if not text:
            return []
        low = text.lower()
        tokens = low.split()
        single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
        if not (single[2:] & single[1:-1] & single[:-2]).any():  # three in a row are the shortest run
            return tokens
        return tokens + [RUN + "".join(m.group().split()) for m in SPELT.finditer(low)]

    def terms(self, text: str | None) -> set[str]:
        tokens = set(self.occurrences(text))
        found = plain_words(tokens)
        for token in tokens - found:
            found.update(self.terms_of(token))
        return found

    def features(self, text: str | None, place: dict[str, int]) -> tuple[list[int], float]:
        """Numbers of the model's terms in a text, and how often they recur, as a logarithm."""
        tokens = self.occurrences(text)
        different = set(tokens)
        plain = plain_words(different)
        hits = {t: {place[t]} for t in plain & place.keys()}
        for token in different - plain:
            if own := {place[t] for t in self.terms_of(token) if t in place}:
                hits[token] = own
        if not hits:
            return [], 0.0
        found = set().union(*hits.values())
        return sorted(found), math.log1p(max(0, sum(t in hits for t in tokens) - len(found)))


def restorer(counts: bytes, known: frozenset[str]) -> Restorer:
    return kept(("restorer", counts, known), lambda: Restorer(np.frombuffer(counts, np.int64), known))


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts: 27^3 numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for codes in gram_codes(text.as_py()):
                    total += np.bincount(codes, minlength=27**3)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(total[kept])], names=["code", "n"])

    rows = docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(27**3, np.int64)
    out[rows["code"]] = rows["n"]
    return out


def telling_terms(labelled: DataFrame, counts: bytes) -> list[str]:
    """All terms whose presence goes with label 1 (log-likelihood ratio), the surest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = restorer(counts, frozenset())
        for batch in batches:
            terms = [sorted(own.terms(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["y", "terms"])

    rows = labelled.select("y", "text").mapInArrow(run, "y int, terms array<string>")
    totals = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n1")).first()
    n, n1 = float(totals["n"]), float(totals["n1"])
    if not 0 < n1 < n:
        return []
    by_term = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("d"))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    a, b = F.col("a"), F.col("d") - F.col("a")
    ratio = part(a, F.col("d") * (n1 / n)) + part(b, F.col("d") * (1 - n1 / n)) + part(F.lit(n1) - a, (F.lit(n) - F.col("d")) * (n1 / n)) + part(F.lit(n - n1) - b, (F.lit(n) - F.col("d")) * (1 - n1 / n))
    strong = by_term.where((F.col("a") >= 4) & (F.col("a") * n > 2 * F.col("d") * n1)).select("term", ratio.alias("ratio")).where("ratio > 8")
    return [r["term"] for r in strong.orderBy(F.desc("ratio"), "term").collect()]


def fit(labels: np.ndarray, places: list[np.ndarray], recur: np.ndarray, n_terms: int, steps: int = 400) -> np.ndarray:
    """Weights of a logistic model: terms, recurrence, bias. Penalised, by accelerated gradient."""
    row = np.repeat(np.arange(len(labels)), [len(p) for p in places])
    col = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
    w, m, v = np.zeros(n_terms + 2), np.zeros(n_terms + 2), np.zeros(n_terms + 2)
    share = labels.mean()
    w[-1] = math.log(share / (1 - share))
    for t in range(1, steps + 1):
        z = w[-1] + w[-2] * recur + np.bincount(row, w[col], len(labels))
        error = (1 / (1 + np.exp(-z)) - labels) / len(labels)
        g = np.concatenate([np.bincount(col, error[row], n_terms), [(error * recur).sum(), error.sum()]])
        g[:-1] += 2e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scorer(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Callable[[], Callable[[pa.Array], np.ndarray]]:
    """What makes, in a worker, the function from texts to scores, learnt from docs (doc_id, text)
    and labels (doc_id, toxic)."""
    taught = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y"))
    # The same plan whatever the number of labels: texts that may be learnt from meet them in a shuffle.
    labelled = docs.where(~held_out(F.col("doc_id"))).join(taught.hint("merge"), "doc_id").select("doc_id", "text", "y")
    labelled = written(labelled.withColumn("row", F.monotonically_increasing_id()), "labelled")
    counts = gram_counts(docs).tobytes()
    terms = telling_terms(labelled, counts)
    place, known = {t: i for i, t in enumerate(terms)}, frozenset(terms)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = restorer(counts, known)
        for batch in batches:
            found = [own.features(t.as_py(), place) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "y", "places", "recur"])

    part = min(1.0, fit_rows / max(labelled.count(), 1))
    chosen = labelled.where(F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < int(part * (1 << 40)))
    shown = chosen.select("doc_id", "y", "text").mapInArrow(features, "doc_id long, y int, places array<int>, recur double")
    sample = shown.select("y", "places", "recur").toPandas()
    y = sample["y"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        w = fit(y, [np.asarray(p) for p in sample["places"]], sample["recur"].to_numpy(float), len(terms))
    else:
        share = float(y.mean()) if len(y) else 0.0
        w = np.append(np.zeros(len(terms) + 1), math.log((share + 1e-6) / (1 - share + 1e-6)))

    def made() -> Callable[[pa.Array], np.ndarray]:
        own = restorer(counts, known)

        def score(texts: pa.Array) -> np.ndarray:
            found = [own.features(t.as_py(), place) for t in texts]
            z = np.array([w[-1] + w[-2] * r + sum(w[p] for p in ps) for ps, r in found], float)
            return 1 / (1 + np.exp(-z))

        return score

    return made


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text), learnt from labels (doc_id, toxic)."""
    docs = docs.select("doc_id", "text")
    score = scorer(docs, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = score()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(judge(batch.column(1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those whose text is predicted toxic; all columns stay. Each row is judged as it
    passes, so neither repeated nor missing ids matter."""
    score = scorer(docs.select("doc_id", "text"), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = score()
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
