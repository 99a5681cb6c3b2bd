"""Toxicity by a weighted finite-state grammar of clauses.

1. Words become symbols with weights. Targets, negations and reporting verbs are fixed lists; insults and threats start from
   short lists, and labels add what they show: words and stems (first letters of words) that documents labelled toxic hold far
   more often than others. A stem counts if its excess would happen by chance in less than one of all stems counted
   (exp(-n KL) times their number below 1); its weight is its log odds against those of all documents. Of stems that begin
   each other, the one with the largest excess stays.
2. ``transducers.grammar`` composes negation, reported speech, target, insult and threat into one transducer, which reads a
   document's symbols once and gives a pattern for each clause. A clause weighs what its insults and threats do together.
3. The weights of a document's clauses are added up by pattern; a logistic function of these sums is the score. Its
   coefficients are fitted to the labels from those that the grammar starts with (a Gaussian prior), so a pattern that labels
   don't show, such as reported insults, keeps its meaning.

Labels are read only of rows whose crc32(doc_id as text) mod 5 isn't 0. At most LABELLED labelled documents (those with the
smallest hashes of their ids) are fitted to, and of near copies with one label one only, since they aren't independent; at most MAX_STEMS stems are sent to tasks. Everything else covers all rows and
whole texts. The score reads the text alone.

A null or empty text has no clauses and gets the score of no clauses. Very long texts are read whole, in one pass. Rows with a
null doc_id are scored and never learned from; rows that repeat a doc_id are scored one by one, and one of their texts (the
smallest) is learned from. A doc_id with different labels counts as toxic; null labels don't count. Without labels of both
kinds the first coefficients hold. An empty table gives no rows. Other columns are carried along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm import storage, transducers

LABELLED, MAX_STEMS, LEAST_DOCS = 20_000, 4_096, 3
#: Letters of a stem, least and most; a whole word ends with a blank.
STEM = (3, 12)
#: Sums of weights count in units of this, up to so many.
UNIT, MOST = 5.0, 8.0
SEED_WEIGHT, LEAST_WEIGHT = 8.0, 1.5
#: A stem whose toxic documents one longer stem holds to this share isn't taken: the longer one says the same of fewer words.
SAME = 0.95
#: A longer stem is taken beside one that begins it where its documents are toxic more often, by so much beyond chance.
DIFFERENT = 3.0
FOLDS = 5

# Words of English, German, French and Spanish.
TARGETS = "you your yours you're youre u yourself he she they them him her these those this that's du dich dir euch euer dein deine sie ihr tu toi vous ton ta votre il elle tú usted ustedes vosotros tus él ella".split()
NEGATIONS = "not no never none don't doesn't didn't isn't aren't wasn't weren't won't can't cannot nobody without nicht kein keine keinen nie niemals niemand ohne pas jamais aucun aucune sans nunca jamás ningún ninguna tampoco sin".split()
REPORTING = "said says say saying wrote writes called calls claimed claims told shouted quoted quotes according sagte sagt schrieb schreibt nannte nennt behauptet behauptete dit disait écrit appelé traité affirme dijo dice escribió llamó afirmó afirma".split()
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown clowns imbecile bastard bastards idioten trottel dummkopf abschaum imbécile crétin connard idiota idiotas imbécil estúpido basura".split()
THREATS = "kill murder strangle stab behead töten umbringen erschießen erwürgen égorger étrangler assassiner matarte asesinar degollar".split()

TOKEN = re.compile(r"[^\W_]+(?:['’@$][^\W_]+)*|[\"“”„«»]|[.!?;:,]|\n+")
QUOTES, CLAUSES = set('"“”„«»'), set(".!?;:,")
LEET = str.maketrans("013457", "oieast")
#: bias, then by pattern
PRIOR = dict(zip(("", *transducers.PATTERNS), (-2.0, 2.5, 2.0, 2.5, 1.2, 0.2, 0.4), strict=True))
SPREAD = {"": 25.0, **dict.fromkeys(transducers.PATTERNS, 1.0)}


@dataclass
class Lexicon:
    """Stems with weights; a whole word is a stem that ends with a blank."""

    insults: dict[str, float] = field(default_factory=lambda: {f"{w} ": SEED_WEIGHT for w in INSULTS})
    threats: dict[str, float] = field(default_factory=lambda: {f"{w} ": SEED_WEIGHT for w in THREATS})

    def symbol(self, token: str) -> tuple[str, float]:
        if token[0] == "\n":
            return ("P" if len(token) > 1 else "|"), 0.0
        if token in QUOTES or token in CLAUSES:
            return ("Q" if token in QUOTES else "|"), 0.0
        word = normal(token)
        for symbol, stems in (("T", self.threats), ("I", self.insults)):
            longest = next((s for s in reversed(stems_of(word)) if s in stems), None)
            if longest:
                return symbol, stems[longest]
        return ("Y" if word in _TARGETS else "N" if word in _NEGATIONS else "R" if word in _REPORTING else "o"), 0.0


_TARGETS, _NEGATIONS, _REPORTING = frozenset(TARGETS), frozenset(NEGATIONS), frozenset(REPORTING)


@dataclass
class Model:
    lexicon: Lexicon = field(default_factory=Lexicon)
    coefficients: dict[str, float] = field(default_factory=lambda: dict(PRIOR))


def normal(token: str) -> str:
    """Lower case; digits among letters are the letters that they stand for."""
    word = token.lower().replace("’", "'")
    return word.translate(LEET) if not word.isalpha() and any(c.isalpha() for c in word) else word


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in range(STEM[0], min(STEM[1], len(word)) + 1)] + [f"{word} "]


class Reader:
    """Reads texts with one lexicon; remembers words, a bounded number of them."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.known, self.grammar = lexicon, {}, transducers.grammar().arcs

    def symbols(self, tokens: list[str]) -> list[tuple[str, float]]:
        if len(self.known) > 200_000:
            self.known = {}
        known, out = self.known, []
        for t in tokens:
            got = known.get(t)
            if got is None:
                got = known[t] = self.lexicon.symbol(t)
            out.append(got)
        return out

    def clauses(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """start, end (code points), pattern and weight of the clauses that match a pattern, in their order."""
        if not text:
            return []
        symbols = self.symbols(TOKEN.findall(text))
        if not any(weight for _, weight in symbols):
            return []
        out, state, weight, start, end = [], 0, 0.0, None, 0
        for (symbol, w), m in zip(symbols, TOKEN.finditer(text), strict=True):
            if start is None and symbol not in "|P":
                start = m.start()
            state, got = self.grammar[state][symbol]
            if symbol in "|P":
                if got:
                    out.append((start, end, got, weight))
                weight, start = 0.0, None
            else:
                weight, end = weight + w, m.end()
        _, got = self.grammar[state]["P"]
        return [*out, (start, end, got, weight)] if got else out


def sums(clauses: list[tuple[int, int, str, float]]) -> list[float]:
    """1, then the sum of weights by pattern, in units."""
    total = dict.fromkeys(transducers.PATTERNS, 0.0)
    for _, _, pattern, weight in clauses:
        total[pattern] += weight
    return [1.0, *(min(v / UNIT, MOST) for v in total.values())]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """text, toxic: of a bounded sample of the labels outside the held-out fold, one row for each doc_id and sketch."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = storage.hashed_sample(known, "doc_id", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most LABELLED rows of two numbers
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = pa.array([smallest_shingle(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, sketch], names=["doc_id", "text", "toxic", "sketch"])

    rows = rows.mapInArrow(sketched, "doc_id bigint, text string, toxic int, sketch bigint")
    return storage.written(rows.groupBy("sketch", "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic"), "toxicity-rows")


def smallest_shingle(text: str | None) -> int:
    """The smallest hash of a run of five words: equal, most often, for near copies."""
    words = (text or "").split()
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))) - (1 << 63)


def _tally(found: dict[str, list[int]], stems: set[str], toxic: int) -> None:
    for stem in stems:
        both = found.setdefault(stem, [0, 0])
        both[0] += 1
        both[1] += toxic


def counted_stems(rows: DataFrame, chosen: frozenset[str] | None = None) -> DataFrame:
    """stem, n, t: how many documents, and how many toxic ones, hold it; of ``chosen`` stems, as the longest of a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {normal(t) for t in set(TOKEN.findall(text or "")) if t[0] not in QUOTES and t[0] not in CLAUSES and t[0] != "\n"}
                if chosen is None:
                    _tally(found, {s for w in words for s in stems_of(w)}, toxic)
                else:
                    _tally(found, {next((s for s in reversed(stems_of(w)) if s in chosen), "") for w in words} - {""}, toxic)
            n, t = (pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), n, t], names=["stem", "n", "t"])

    return rows.select("text", "toxic").mapInArrow(count, "stem string, n bigint, t bigint").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where(F.col("n") >= LEAST_DOCS)


def excess(n: int, t: int, base: float) -> float:
    """n KL(t / n, base): how far so many toxic documents are beyond chance."""
    return sum(seen * math.log(seen / (n * share)) for seen, share in ((t, base), (n - t, 1 - base)) if seen)


def learn_lexicon(rows: DataFrame, n_docs: int, n_toxic: int) -> Lexicon:
    counts = storage.written(counted_stems(rows), "toxicity-stems")
    tried, base = max(counts.count(), 1), n_toxic / n_docs
    part = lambda seen, share: F.when(seen > 0, seen * F.ln(seen / (F.col("n") * share))).otherwise(0.0)
    beyond = part(F.col("t"), base) + part(F.col("n") - F.col("t"), 1 - base)
    scored = counts.where(F.col("t") > F.col("n") * base).withColumn("excess", beyond).where(F.col("excess") > math.log(tried))
    best = {r["stem"]: (r["n"], r["t"]) for r in scored.orderBy(F.desc("excess"), "stem").limit(4 * MAX_STEMS).collect()}
    longer: dict[str, int] = {}  # the most toxic documents of a stem with one letter more
    for stem, (_, t) in best.items():
        longer[stem[:-1]] = max(t, longer.get(stem[:-1], 0))
    chosen: dict[str, float] = {}  # with the share of toxic documents
    for stem in sorted((s for s, (_, t) in best.items() if longer.get(s, 0) < SAME * t), key=len):  # those that begin others first
        n, t = best[stem]
        shorter = next((stem[:i] for i in range(len(stem) - 1, 0, -1) if stem[:i] in chosen), None)
        if shorter is None or excess(n, t, chosen[shorter]) > DIFFERENT:
            chosen[stem] = (t + 0.5) / (n + 1)
    chosen = dict(list(chosen.items())[:MAX_STEMS])
    lexicon = Lexicon()
    seeds = {*lexicon.insults, *lexicon.threats}
    recounted = {r["stem"]: (r["n"], r["t"]) for r in counted_stems(rows, frozenset(chosen) | seeds).collect()}  # at most MAX_STEMS and the seeds
    odds = lambda n, t: math.log((t + 0.5) / (n - t + 0.5)) - math.log(base / (1 - base))
    for stems in (lexicon.insults, lexicon.threats):  # the labels know better
        for stem in [s for s in stems if recounted.get(s, (0, 0))[0] >= 2 * LEAST_DOCS]:
            stems[stem] = odds(*recounted[stem])
            if stems[stem] < LEAST_WEIGHT:
                del stems[stem]
    for stem in chosen:
        n, t = recounted.get(stem, (0, 0))
        if stem not in seeds and n and odds(n, t) >= LEAST_WEIGHT and excess(n, t, base) > math.log(len(chosen)):
            lexicon.insults[stem] = odds(n, t)
    return lexicon


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic coefficients with the largest posterior, by Newton's steps."""
    mean, precision = np.array(list(PRIOR.values())), 1 / np.array(list(SPREAD.values()))
    b = mean.copy()

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - y * z).sum() + ((b - mean) ** 2 * precision).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        slope = x.T @ (p - y) + (b - mean) * precision
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(precision), slope)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    storage.ship(docs.sparkSession)
    rows = training_rows(docs, labels, most)
    n_docs, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n_docs:
        return Model()
    lexicon = learn_lexicon(rows, n_docs, n_toxic)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            x = [sums(reader.clauses(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.float64())], names=["x", "y"])

    found = rows.mapInArrow(features, "x array<double>, y double").toPandas()  # at most LABELLED rows
    order = found.assign(key=found["x"].map(tuple)).sort_values(["key", "y"])  # sums don't depend on the order of tasks
    b = fitted(np.array(order["x"].tolist()), order["y"].to_numpy())
    return Model(lexicon, dict(zip(PRIOR, b.tolist(), strict=True)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The given columns, score (double), clauses (start, end, pattern, weight of each that matched)."""
    storage.ship(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() not in ("score", "clauses")]
    clause = "array<struct<start:int,end:int,pattern:string,weight:double>>"
    schema = docs.select(*columns, F.lit(0.0).alias("score"), F.lit(None).cast(clause).alias("clauses")).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("weight", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_STEMS stems

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, b = Reader(shared.value.lexicon), np.array(list(shared.value.coefficients.values()))
        for batch in batches:
            found = [reader.clauses(t) for t in batch.column("text").to_pylist()]
            z = np.array([sums(f) for f in found]).reshape(len(found), len(b)) @ b
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            clauses = pa.array([[dict(zip(("start", "end", "pattern", "weight"), c, strict=True)) for c in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores), clauses], names=[*columns, "score", "clauses"])

    return docs.select(*columns).mapInArrow(apply, schema)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
