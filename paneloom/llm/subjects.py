"""Subject areas of documents, by classifier chains over term, source and structure features.

A document is about a subject if enough of its sentences are, so evidence is gathered sentence by sentence. Training, on a
bounded sample of labelled documents, has three parts:

* a mixture model of the sentences' terms (words and word pairs): every sentence has one hidden class, a subject of its
  document's labels or "none" (notices, addresses, figures of speech), learnt by expectation maximisation;
* features of a document for each subject: its share of the sentences on any subject, its term score, its strongest and
  its confident sentences; and for the document its source, length and the share of sentences on no subject;
* a chain of logistic regressions, one per subject, each seeing the features and the subjects decided before it, with
  a Platt calibration. Features of training documents come from models fitted without them (two folds).

Decoding searches the chain with a beam for the most probable non-empty combination. The model is a few MB whatever the
size of the corpus; applying it is one map over the whole texts without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.columns import fresh
from paneloom.llm.mixing import source_name
from paneloom.session import discard, materialize

# Each branch starts with a fixed character, which lets the search skip to it.
_BREAK = re.compile(r"\.\s+|!\s+|\?\s+|\n\s*\n|<[^<>]{0,200}>")
_MARK = "\x00"
SMOOTH = 0.05
STRETCH = 15
BLOCK = 2000


def subject_name(label: Column | str) -> Column:
    """A label however it is written: lower case, blanks and hyphens as ``_``."""
    c = F.col(label) if isinstance(label, str) else label
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


class _Letters(dict):
    """For ``str.translate``: whatever is no letter becomes a blank; looked up once per character and worker."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = code if c.isalnum() and not c.isdecimal() or c == _MARK else 32
        return self[code]


_LETTERS = _Letters()


def words_and_breaks(text: str) -> list[str]:
    """Lower-case words of the text in order, with a mark wherever a sentence ends."""
    return _BREAK.sub(f" {_MARK} ", html.unescape(text).lower().replace(_MARK, " ")).translate(_LETTERS).split()


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence that has any; where a text has lost its full stops, of stretches of ``STRETCH`` words."""
    words = words_and_breaks(text)
    owner = _sentence_of(np.array([w == _MARK for w in words], bool), np.zeros(len(words), np.int64))
    out: list[list[str]] = [[] for _ in range(int(owner.max(initial=-1)) + 1)]
    for w, i in zip(words, owner):
        if i >= 0:
            out[i].append(w)
    return out


def _sentence_of(is_break: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Number of the sentence of each word, -1 for a break: sentences end at breaks and documents, one of more than three stretches
    is cut into stretches; only sentences with words are numbered."""
    out = np.full(len(is_break), -1)
    word = np.flatnonzero(~is_break)
    if not len(word):
        return out
    at = np.cumsum(is_break)[word]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (document[word][1:] != document[word][:-1])])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(word)))
    inside = np.arange(len(word)) - np.repeat(start, size)
    new |= (np.repeat(size, size) > 3 * STRETCH) & (inside % STRETCH == 0)
    out[word] = np.cumsum(new) - 1
    return out


@dataclass
class Terms:
    """Words and word pairs with ids; pairs are kept as sorted numbers, so that looking them up is one binary search."""

    words: dict[str, int]  # with the mark as -1
    pairs: np.ndarray

    @property
    def base(self) -> int:
        return len(self.words)

    @property
    def size(self) -> int:
        return self.base + len(self.pairs)

    @classmethod
    def learn(cls, documents: Sequence[list[str]], max_words: int, max_pairs: int) -> Terms:
        """Words and pairs that neither a break nor the end of a stretch keeps apart, most frequent first."""
        seen = Counter(w for d in documents for w in d if w != _MARK)
        kept = sorted(((-n, w) for w, n in seen.items() if n >= 2))[:max_words]
        words = {_MARK: -1} | {w: i + 1 for i, (_, w) in enumerate(kept)}
        pairs: Counter[int] = Counter()
        base = len(words)
        for d in documents:
            ids = np.fromiter(map(words.get, d, repeat(0)), np.int64, len(d))
            row = _sentence_of(ids < 0, np.zeros(len(ids), np.int64))
            beside = (ids[:-1] > 0) & (ids[1:] > 0) & (row[:-1] == row[1:])
            pairs.update((ids[:-1] * base + ids[1:])[beside].tolist())
        often = sorted((-n, p) for p, n in pairs.items() if n >= 3)[:max_pairs]
        return cls(words, np.array(sorted(p for _, p in often), np.int64))

    def matrix(self, documents: Sequence[list[str]]) -> Rows:
        """All sentences of documents, given as :func:`words_and_breaks`, as one ragged matrix of term ids."""
        base = self.base
        ids = np.fromiter(map(self.words.get, chain.from_iterable(documents), repeat(0)), np.int64)
        document = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        row = _sentence_of(ids < 0, document)
        ids, document, row = ids[row >= 0], document[row >= 0], row[row >= 0]
        n = np.bincount(row)
        term, at = ids[ids > 0], row[ids > 0]
        if len(self.pairs) and len(ids) > 1:
            together = (ids[:-1] > 0) & (ids[1:] > 0) & (row[:-1] == row[1:])
            key = (ids[:-1] * base + ids[1:])[together]
            spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[spot] == key
            term, at = np.concatenate([term, base + spot[hit]]), np.concatenate([at, row[:-1][together][hit]])
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(row, np.arange(len(n)))
        return Rows(term[order], np.searchsorted(at[order], np.arange(len(n) + 1)), document[first], len(documents), n)


@dataclass
class Rows:
    term: np.ndarray
    start: np.ndarray
    document: np.ndarray
    documents: int
    words: np.ndarray

    @property
    def count(self) -> int:
        return len(self.start) - 1

    def scores(self, weight: np.ndarray) -> np.ndarray:
        """Sum of the terms' rows of ``weight`` for each sentence."""
        out = np.zeros((self.count, weight.shape[1]))
        by_class = np.ascontiguousarray(weight.T)
        for a in range(0, self.count, BLOCK):  # in blocks, so that memory does not grow with the sample
            start = self.start[a : a + BLOCK + 1]
            term, row = self.term[start[0] : start[-1]], np.repeat(np.arange(len(start) - 1), np.diff(start))
            for c, w in enumerate(by_class):
                out[a : a + BLOCK, c] = np.bincount(row, w[term], minlength=len(start) - 1)
        return out

    def per_document(self, values: np.ndarray) -> np.ndarray:
        edge = np.searchsorted(self.document, np.arange(self.documents + 1))
        total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
        return total[edge[1:]] - total[edge[:-1]]


def _softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_sentences(rows: Rows, labels: np.ndarray, size: int, rounds: int = 15) -> np.ndarray:
    """Weights of terms by class (subjects, then "none"), from log probabilities learnt by expectation maximisation. ``labels`` (documents x
    subjects, 0 to 1) says which classes a document's sentences can have; others keep a small chance, as labels err."""
    k = labels.shape[1] + 1
    allowed = np.concatenate([labels + 0.002, np.full((len(labels), 1), 0.5)], 1)
    prior = np.log(allowed / allowed.sum(1, keepdims=True))[rows.document]
    belief = _softmax(prior)
    repeat = np.diff(rows.start)
    for _ in range(rounds):
        mass = np.stack([np.bincount(rows.term, np.repeat(belief[:, c], repeat), minlength=size) for c in range(k)], 1)
        common = mass.sum(1, keepdims=True)
        # Towards the terms' overall frequency, so that rare terms tell little.
        smoothed = mass + SMOOTH + 0.5 * common / max(common.sum(), 1.0)
        weight = np.log(smoothed / smoothed.sum(0, keepdims=True))
        # A term counts by how unevenly it is spread over the classes: the phrases that all subjects (or all texts of one
        # language) share say next to nothing, however many of them a sentence has.
        weight -= weight.mean(1, keepdims=True)
        spread_over = np.exp(weight - weight.max(1, keepdims=True))
        spread_over /= spread_over.sum(1, keepdims=True)
        weight *= 1 + (spread_over * np.log(np.maximum(spread_over, 1e-12))).sum(1, keepdims=True) / np.log(k)
        mix = rows.per_document(belief) + allowed
        score = rows.scores(weight) + np.log(mix / mix.sum(1, keepdims=True) * allowed)[rows.document]
        belief = _softmax(score)
    return weight


def document_features(rows: Rows, weight: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(documents x subjects x features, documents x features): the evidence of the sentences, without any labels."""
    k = weight.shape[1]
    score = rows.scores(weight)
    mix = np.full((rows.documents, k), 1.0 / k)
    belief = _softmax(score)
    for _ in range(rounds):  # sentences of a document support each other
        belief = _softmax(score + np.log(mix)[rows.document])
        mix = rows.per_document(belief) + 0.05
        mix /= mix.sum(1, keepdims=True)
    total = rows.per_document(belief)
    sure = rows.per_document((belief > 0.9).astype(float))
    subject = total[:, :-1].sum(1, keepdims=True)
    share = total[:, :-1] / np.maximum(subject, 0.5)
    sure_share = sure[:, :-1] / np.maximum(sure[:, :-1].sum(1, keepdims=True), 1.0)
    n = rows.per_document(np.ones((rows.count, 1)))
    term = rows.per_document(score - score.max(1, keepdims=True))[:, :-1] / np.maximum(n, 1.0) if rows.count else np.zeros((rows.documents, k - 1))
    ranked = (-share).argsort(1).argsort(1)
    per = np.stack([share, sure_share, np.clip(share / 0.2, 0, 1), np.clip((share - 0.1) / 0.2, 0, 1), np.clip((sure_share - 0.1) / 0.2, 0, 1), np.log1p(total[:, :-1]), np.clip(term, -30, 0) / 10, (ranked == 0).astype(float), (ranked == 1).astype(float)], 2)
    whole = np.concatenate([np.log1p(n), np.log1p(subject), total[:, -1:] / np.maximum(n, 1.0), share.max(1, keepdims=True)], 1)
    return per, whole


def logistic(x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 1.0, center: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Weights (the last one the constant) of a logistic regression on labels from 0 to 1, by Newton steps. The penalty
    ``ridge`` draws the weights towards ``center`` (0 by default); the constant is free."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    middle = np.zeros(x.shape[1])
    if center is not None:
        middle[:-1] = center
    w = middle.copy()
    penalty = np.append(np.broadcast_to(ridge, x.shape[1] - 1), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * (w - middle)
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """``base`` scores a subject of a document from its evidence alone, with the same weights for all subjects, which many
    examples support; each step of the ``chain`` starts from that score and adds what the subject itself, the source,
    the structure and the subjects decided before tell; ``platt`` calibrates each step."""

    subjects: list[str]
    terms: Terms
    weight: np.ndarray
    sources: list[str]
    order: list[int]
    base: np.ndarray = field(default_factory=lambda: np.empty(0))
    chain: list[np.ndarray] = field(default_factory=list)
    platt: list[tuple[float, float]] = field(default_factory=list)

    def context(self, whole: np.ndarray, sources: Sequence[str | None]) -> np.ndarray:
        """Structure and source of each document."""
        origin = np.array([[s == known for known in self.sources] for s in sources], float).reshape(len(whole), len(self.sources))
        return np.concatenate([whole, origin], 1)

    def score(self, per: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.clip(per @ self.base[: per.shape[2]] + (whole @ self.base[per.shape[2] : -1])[:, None] + self.base[-1], -12, 12)

    def probability(self, step: int, score: np.ndarray, context: np.ndarray, before: np.ndarray) -> np.ndarray:
        """P(subject ``order[step]`` | score, context, subjects decided before)."""
        x = np.concatenate([score[:, [self.order[step]]], context, before], 1)
        w, (a, b) = self.chain[step], self.platt[step]
        return 1 / (1 + np.exp(-np.clip(a * (x @ w[:-1] + w[-1]) + b, -30, 30)))

    def decode(self, score: np.ndarray, context: np.ndarray, beam: int = 6) -> np.ndarray:
        """The most probable non-empty combination of each document (documents x subjects, 0 or 1), by beam search. The beam
        always keeps the best empty prefix apart, so that a non-empty one can still grow out of it."""
        n, k = len(score), len(self.subjects)
        labels, logp = np.zeros((n, 1, k)), np.zeros((n, 1))
        for step, j in enumerate(self.order):
            width = labels.shape[1]
            before = labels[:, :, self.order[:step]].reshape(n * width, step)
            p = self.probability(step, np.repeat(score, width, 0), np.repeat(context, width, 0), before).reshape(n, width)
            with_it = labels.copy()
            with_it[:, :, j] = 1
            labels = np.concatenate([labels, with_it], 1)
            logp = np.concatenate([logp + np.log(np.maximum(1 - p, 1e-12)), logp + np.log(np.maximum(p, 1e-12))], 1)
            if labels.shape[1] > beam + 1:
                empty = labels.sum(2) == 0
                keep = np.argsort(-(logp + 1e6 * empty), axis=1, kind="stable")[:, : beam + 1]
                labels, logp = np.take_along_axis(labels, keep[:, :, None], 1), np.take_along_axis(logp, keep, 1)
        logp = np.where(labels.sum(2) == 0, -np.inf, logp)
        return labels[np.arange(n), logp.argmax(1)]

    def assign(self, texts: Sequence[str], sources: Sequence[str | None]) -> np.ndarray:
        rows = self.terms.matrix([words_and_breaks(t) for t in texts])
        per, whole = document_features(rows, self.weight)
        return self.decode(self.score(per, whole), self.context(whole, sources))


def train(texts: Sequence[str], sources: Sequence[str | None], labels: np.ndarray, subjects: list[str], max_words: int = 60_000, max_pairs: int = 120_000, ridge: float = 1.0) -> Model:
    """The model from labelled documents; ``labels`` is documents x subjects, the share of annotators who gave the subject."""
    documents = [words_and_breaks(t) for t in texts]
    terms = Terms.learn(documents, max_words, max_pairs)
    known = sorted({s for s in sources if s})  # at most as many as there are documents in the sample
    order = [int(i) for i in np.argsort(-labels.sum(0), kind="stable")]
    model = Model(subjects, terms, fit_sentences(terms.matrix(documents), labels, terms.size), known, order)
    fold = np.arange(len(documents)) % 2
    per = whole = None
    for f in (0, 1):
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        weight = fit_sentences(terms.matrix([documents[i] for i in inside]), labels[inside], terms.size) if len(inside) else model.weight
        a, b = document_features(terms.matrix([documents[i] for i in outside]), weight)
        if per is None:
            per, whole = np.zeros((len(documents), *a.shape[1:])), np.zeros((len(documents), b.shape[1]))
        per[outside], whole[outside] = a, b
    k = len(subjects)
    model.base = logistic(np.concatenate([per.reshape(len(per) * k, -1), np.repeat(whole, k, 0)], 1), labels.reshape(-1), ridge)
    score, context = model.score(per, whole), model.context(whole, sources)
    for step, j in enumerate(order):
        x = np.concatenate([score[:, [j]], context, (labels[:, order[:step]] >= 0.5).astype(float)], 1)
        center = np.zeros(x.shape[1])
        center[0] = 1.0
        reach = np.append(ridge, np.full(x.shape[1] - 1, 10 * ridge))
        held = np.zeros(len(x))
        for f in (0, 1):  # calibration from scores of documents that the regression has not seen
            w = logistic(x[fold != f], labels[fold != f, j], reach, center)
            held[fold == f] = x[fold == f] @ w[:-1] + w[-1]
        a, b = logistic(held[:, None], labels[:, j], ridge, np.ones(1))
        model.chain.append(logistic(x, labels[:, j], reach, center))
        model.platt.append((float(a), float(b)) if a > 0 else (1.0, 0.0))
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, areas: DataFrame, max_documents: int = 4000, max_chars: int = 50_000_000, seed: int = 42):
    """Texts, sources, label shares and subjects of at most ``max_documents`` labelled documents, those of smallest seeded hash, as
    long as their whole texts have at most ``max_chars`` characters together. The bounds keep training on the driver; every count
    and decision on the corpus itself covers all documents."""
    subjects = sorted(r[0] for r in areas.select(subject_name("subject")).distinct().collect() if r[0])
    given = labels.select("doc_id", subject_name("subject").alias("subject"), F.coalesce("annotator", F.lit("")).alias("annotator")).where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).distinct()
    by = given.groupBy("doc_id").agg(F.countDistinct("annotator").alias("people"), F.collect_list("subject").alias("given"))
    chosen = by.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_documents)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", source_name("source").alias("source"))
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    kept = materialize(texts.join(F.broadcast(chosen), "doc_id"), "sample")
    held, inside = 0, []
    for r in kept.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars")).orderBy(*order).collect():
        held += r["chars"]
        if held > max_chars:
            break
        inside.append(r["doc_id"])
    rows = kept.where(F.col("doc_id").isin(inside)).orderBy(*order, "text").collect()
    discard(kept)
    y = np.zeros((len(rows), len(subjects)))
    for i, r in enumerate(rows):
        for s, n in Counter(r["given"]).items():
            y[i, subjects.index(s)] = n / r["people"]
    return [r["text"] for r in rows], [r["source"] for r in rows], y, subjects


def assign_subjects(documents: DataFrame, model: Model, text: str = "text", source: str = "source", into: str = "subjects") -> DataFrame:
    """``documents`` without the text, with the array ``into`` of its subjects in alphabetical order: one or more for each text that has
    a word, none for a null or blank one. One map over whole texts; repeated rows are kept. If ``into`` is taken, it gets a leading
    underscore."""
    (into,) = fresh(documents, into)
    kept = [f for f in documents.schema if f.name != text]
    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.StringType()))])
    ready = documents.select(text, source_name(source).alias("_source"), *[F.col(f.name) for f in kept])
    names = np.array(model.subjects, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(0).to_pylist()]
                chosen = model.assign(texts, batch.column(1).to_pylist()) > 0
                made = [list(names[row]) if t.strip() else [] for t, row in zip(texts, chosen)]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(made, pa.list_(pa.string()))], names=[f.name for f in schema])

    return ready.mapInArrow(run, schema)
