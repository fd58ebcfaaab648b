"""Toxicity of texts, with disguised words restored first.

Noisy channel: a writer meant letters, the channel turned some into look-alikes, put
separators between them or repeated them. The lattice of readings of a suspicious token
is decoded by Viterbi under a character model (pairs of letters before, trained on the
labelled words, words that speak for toxicity weighing more). A logistic model over
words and word beginnings, learned from all labelled rows, then scores the words of the
text and the restored ones. Counts and the regression are Spark jobs; the driver holds
the chosen features and the triples of letters.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Matrices, Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm.common import free_memory, in_parts
from liftlake.session import materialize

#: Labels up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Features that a task counts before it hands them on.
HELD_FEATURES = 300_000
FEATURES = 4_096
LEAST_SIGNAL = 3.0
THRESHOLD = 0.7
BOOST = 20
STEPS = 600
ITERATIONS = 60
RIDGE = 3e-4
# What a character may stand for besides itself.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
SEPARATORS = " .-_*~'"
_LOOK, _DROP, _REPEAT = -1.5, -0.2, -1.5

_WORD = re.compile(r"[^\W\d_]+")
_SUSPECT = re.compile(r"[^\W\d_].*[0-9@$!|+€(*._~-].*[^\W_]|[0-9@$!|+€(].*[^\W\d_]|[^\W\d_].*[0-9@$!|+€(]|([^\W\d_])\1\1")
#: All that ``_SUSPECT`` can find in a token of letters alone.
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\w)(?:[^\W_@$!]|[@$!])(?:[ .\-_*~](?:[^\W_]|[@$!])){2,}(?!\w)")
_EDGE = ".,;:!?\"'%&#*)]}"
_EDGES = _EDGE + "([{"


def word_features(word: str) -> tuple[str, ...]:
    return tuple({word, "^" + word[:4], "^" + word[:5]} if len(word) > 4 else {word})


class CharModel:
    """Probability of a letter behind two others, smoothed; ``^`` starts and ``$`` ends a word."""

    def __init__(self, words: Counter):
        self.three, self.two, self.one = Counter(), Counter(), Counter()
        for word, n in words.items():
            for a, b, c in zip("^^" + word, "^" + word + "$", word + "$"):
                self.three[a + b + c] += n
                self.two[a + b] += n
                self.one[c] += n
        self.total = sum(self.one.values()) + len(self.one) + 1

    @classmethod
    def of_triples(cls, triples: dict[str, int], words: Counter) -> CharModel:
        """The model of words counted elsewhere, given as their triples of letters, and of further ``words``."""
        model = cls(words)
        for triple, n in triples.items():
            model.three[triple] += n
            model.two[triple[:2]] += n
            model.one[triple[2]] += n
        model.total = sum(model.one.values()) + len(model.one) + 1
        return model

    def log(self, before: str, letter: str) -> float:
        base = (self.one[letter] + 1) / self.total
        return math.log((self.three[before + letter] + 2 * base) / (self.two[before] + 2))


def restore(token: str, model: CharModel) -> str:
    """The likeliest word behind a token: the best path through its lattice of readings."""
    return _decoded(token, model)[1]


def restored_edges(token: str, edges: tuple[str, str], model: CharModel) -> str:
    """The word behind a token with marks before and behind it that may be letters or punctuation: the likeliest reading."""
    readings = []
    for before in {"", edges[0]}:
        for behind in {"", edges[1]}:
            cost, word = _decoded(before + token + behind, model)
            readings.append((cost + _DROP * (len(edges[0]) - len(before) + len(edges[1]) - len(behind)), word))
    return max(readings)[1]


def _decoded(token: str, model: CharModel) -> tuple[float, str]:
    paths: dict[tuple[str, str], tuple[float, tuple]] = {("^^", ""): (0.0, ())}
    for char in token.lower():
        options = [(c, _LOOK) for c in LOOKS_LIKE.get(char, "")]
        if char.isalpha():
            options.append((char, 0.0))
        grown: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (before, last), (cost, word) in paths.items():
            moves = [((before[-1] + c, char), cost + own + model.log(before, c), (word, c)) for c, own in options]
            if char == last:
                moves.append(((before, last), cost + _REPEAT, word))
            if not options or char in SEPARATORS:
                moves.append(((before, last), cost + _DROP, word))
            for state, value, path in moves:
                if state not in grown or grown[state][0] < value:
                    grown[state] = (value, path)
        paths = grown or paths
    state, (cost, best) = max(paths.items(), key=lambda p: (p[1][0] + model.log(p[0][0], "$"), p[0]))
    letters = []
    while best:
        best, c = best
        letters.append(c)
    return cost + model.log(state[0], "$"), "".join(reversed(letters))


def suspects(text: str) -> set[str]:
    """Tokens that may be disguised words: look-alikes among or beside letters, letters spaced out, letters repeated."""
    found = {m.group() for m in _SPACED.finditer(text)}
    found = {run for run in found if len(run) > 5 or not run.replace(run[1], "").isdigit()}  # three digits alone are numbers
    repeated = _REPEATED.search(text) is not None  # else no token has letters repeated

    def suspicious(token: str) -> bool:
        if token.isalpha():
            return repeated and _REPEATED.search(token) is not None
        return _SUSPECT.search(token) is not None

    for token in set(text.split()):
        if not token.isalpha():
            core = token.strip(_EDGE)
            cores = (core, core.strip(_EDGES)) if core and (core[0] in "([{" or core[-1] in "([{") else (core,)
            found.update(core for core in cores if suspicious(core))
        elif suspicious(token):
            found.add(token)
    return found


def edged(text: str) -> set[tuple[str, str, str]]:
    """(mark before, token, mark behind) of the tokens with a stripped mark beside them that is a look-alike."""
    found = set()
    for token in {token for token in text.split() if "!" in token or "(" in token}:  # stripped marks that are look-alikes
        core = token.strip(_EDGES)
        if core and core != token:
            start = token.index(core)
            before, behind = (c if c in LOOKS_LIKE else "" for c in (token[start - 1 : start], token[start + len(core) :][:1]))
            if before or behind:
                found.add((before, core, behind))
    return found


class ToxicityModel:
    """Weights of features, a bias and the character model; small enough to travel with a task."""

    def __init__(self, weights: dict[str, float], bias: float, chars: CharModel):
        self.weights, self.bias, self.chars = weights, bias, chars
        self._lengths = sorted({len(f) for f in weights if len(f) > 2 and f[0] != "^"})
        self._hits = functools.lru_cache(maxsize=1 << 18)(lambda word: tuple(f for f in word_features(word) if f in weights))
        self._restored = functools.lru_cache(maxsize=1 << 16)(lambda token: restore(token, chars))
        self._edged = functools.lru_cache(maxsize=1 << 16)(lambda before, token, behind: restored_edges(token, (before, behind), chars))

    def __reduce__(self):
        return ToxicityModel, (self.weights, self.bias, self.chars)

    def forget(self) -> None:
        """Drop what was remembered of words and tokens, at the end of a task."""
        for cached in (self._hits, self._restored, self._edged):
            cached.cache_clear()
        free_memory()

    def score(self, text: str | None) -> float:
        text = (text or "").lower()
        words = set(_WORD.findall(text))
        for token in suspects(text):
            word = self._restored(token)
            words.add(word)
            if any(s in token for s in SEPARATORS):  # letters apart may be several words
                least = 3 if _SPACED.fullmatch(token) else 4
                words.update(word[i : i + n] for n in self._lengths if n >= least for i in range(len(word) - n + 1) if word[i : i + n] in self.weights)
        words.update(self._edged(*token) for token in edged(text))
        hits = {f for word in words for f in self._hits(word)}
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(self.weights[f] for f in sorted(hits))))))


def fit(texts: list[str], labels: list[int]) -> ToxicityModel:
    """Features whose share among toxic texts stands out, then a ridge logistic regression on them, with weights of 0 or more."""
    y = np.array(labels, float)
    n1, n0 = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    shared: dict[str, str] = {}  # one string a word, whatever the number of texts that have it
    words = [tuple({shared.setdefault(w, w) for w in _WORD.findall((t or "").lower())}) for t in texts]
    seen = [Counter(), Counter()]
    plain: Counter = Counter()
    for own, label in zip(words, labels):
        seen[label].update({f for w in own for f in word_features(w)})
        plain.update(own)
    signal = {}
    for f, a in seen[1].items():
        if a >= 2:
            p = (a + seen[0][f]) / (n1 + n0)
            z = (a / n1 - seen[0][f] / n0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
            if z >= LEAST_SIGNAL:
                signal[f] = z
    chosen = sorted(signal, key=lambda f: (-signal[f], f))[:FEATURES]
    number = {f: i for i, f in enumerate(chosen)}
    pairs = [(row, number[f]) for row, own in enumerate(words) for f in sorted({f for w in own for f in word_features(w)} & number.keys())]
    rows, columns = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    w, bias = np.zeros(len(chosen)), -1.0
    per_class = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    mean, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):  # Adam; weights stay evidence for toxicity, never against it
        margin = bias + np.bincount(rows, w[columns], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * per_class
        slope = np.append(np.bincount(columns, error[rows], minlength=len(w)) + RIDGE * w, error.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, bias = np.maximum(w - move[:-1], 0.0), bias - move[-1]
    for f in chosen:
        if not f.startswith("^"):
            plain[f] += BOOST * seen[1][f]
    return ToxicityModel({f: float(w[number[f]]) for f in chosen}, float(bias), CharModel(plain))


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _feature_counts(labelled: DataFrame) -> DataFrame:
    """feature, toxic, other: how many texts of either class have it. A word is a feature of its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def send() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            columns = [pa.array(names, pa.string()), *[pa.array([held[k][f] for f in names], pa.int64()) for k in (1, 0)]]
            for counter in held:
                counter.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "toxic", "other"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[label].update({f for w in _words(text) for f in word_features(w)})
                if len(held[0]) + len(held[1]) > HELD_FEATURES:
                    yield send()
        yield send()
        free_memory()

    counted = labelled.select("text", "toxic").mapInArrow(count, "feature string, toxic long, other long")
    return materialize(counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))


def _regression(labelled: DataFrame, chosen: list[str], n1: float, n0: float) -> tuple[list[float], float]:
    """Ridge logistic regression of all rows, both classes weighing the same, with weights of 0 or more."""
    number = {f: i for i, f in enumerate(chosen)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted({number[f] for w in _words(text) for f in word_features(w) if f in number}) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1)], names=["hits", "toxic"])
        free_memory()

    rows = materialize(labelled.select("text", "toxic").mapInArrow(place, "hits array<int>, toxic int"))
    sparse = F.udf(lambda hits: Vectors.sparse(len(chosen), hits, [1.0] * len(hits)), VectorUDT())
    weight = F.when(F.col("toxic") == 1, 0.5 / n1).otherwise(0.5 / n0)
    ready = rows.select(sparse("hits").alias("features"), F.col("toxic").cast("double").alias("label"), weight.alias("weight"))
    model = LogisticRegression(
        maxIter=ITERATIONS, regParam=RIDGE, standardization=False, weightCol="weight", lowerBoundsOnCoefficients=Matrices.dense(1, len(chosen), [0.0] * len(chosen))
    ).fit(ready)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The models, from all labelled documents whose crc32 remainder is not 1."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    few = usable.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    labelled = docs.select("doc_id", "text").join(F.broadcast(usable) if few else usable, "doc_id").select("text", "toxic")
    sizes = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = (float(max(1, sizes.get(k, 0))) for k in (1, 0))
    counts = _feature_counts(labelled)
    a, b = F.col("toxic"), F.col("other")
    p = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    found = counts.where(a >= 2).withColumn("z", z).where(F.col("z") >= LEAST_SIGNAL).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    chosen = [r.feature for r in found]
    if chosen:
        weights, bias = _regression(labelled, chosen, n1, n0)
    else:
        weights, bias = [], -1.0 if not sizes else 0.0 if len(sizes) == 2 else 30.0 if 1 in sizes else -30.0
    padded = F.concat(F.lit("^^"), "feature", F.lit("$"))
    triples = counts.where(~F.col("feature").startswith("^")).select(
        (a + b).alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.length("feature") + 1), lambda i: F.substring(padded, i, F.lit(3)))).alias("triple")
    )
    triples = {r.triple: r.n for r in triples.groupBy("triple").agg(F.sum("n").alias("n")).collect()}
    boosted = Counter({r.feature: BOOST * r.toxic for r in found if not r.feature.startswith("^")})
    return ToxicityModel(dict(zip(chosen, weights)), bias, CharModel.of_triples(triples, boosted))


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row. Null text: as the empty one. Repeated rows: each returned."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            values = [model.score(text) for text in batch.column(2).to_pylist()]
            hit = pa.array([int(v >= threshold) for v in values], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), hit], names=["doc_id", "held_out", "score", "predicted"])
        model.forget()

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def accepted_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (text, any other columns) whose own text scores below the threshold."""
    place = docs.columns.index("text")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, "text"):
            yield batch.filter(pa.array([model.score(text) < threshold for text in batch.column(place).to_pylist()], pa.bool_()))
        model.forget()

    return docs.mapInArrow(accept, docs.schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, train(docs, labels))
