"""Reading level of documents: sentence classifiers, then calibrated document difficulty.

``prose`` leaves the text a reader reads: no comments, preamble, formulas, references,
bibliography or commands.  ``fit_on`` trains on a bounded sample of labelled documents,
parted into two halves:

1. Every sentence takes its document's rating.  For each half two multinomial logistic
   models with L2 penalty are fitted, one on words, one on character n-grams within words,
   both with sentence length and word length.
2. The two models' probabilities are averaged into a distribution over levels per sentence.
3. Per document the mean distribution, the shares of sentences by likeliest level and the
   spread are features of a ridge regression on the rating.  Each document's features come
   from the half that did not see it, and cut points turn the value into levels.

A document is judged by both halves' models, each through that regression, and gets the
mean: every label serves, and the models that are applied are those that were calibrated.
The fits run as tasks of the cluster.  For the held-out report the whole procedure runs
once more on four fifths of the sample.

Applying is a single pass over whole texts in Arrow batches.  A model is linear in words,
so a worker works out the scores of each distinct word once and sums table rows.

Defined results: a document without prose (null, empty, markup only) has no sentences and
gets the mean rating of the labels as difficulty; several ratings of a document are
averaged; ratings that are null are ignored; labels of missing documents are ignored; with
fewer than 10 labelled documents that have prose, every document gets the mean rating (3
without any); repeated ids are scored each; very long texts and words are read whole;
an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itinera.session import cut

LEVELS = 5
#: Most labelled documents used for fitting, and most sentences of each; the sample is by hash of the id.
MOST_LABELLED, MOST_SENTENCES = 3000, 60
#: Most bytes of that sample's compressed prose, which the driver and every fit hold.
MOST_BYTES = 48 << 20
#: Character n-grams of 2 to 4 letters are hashed to this many columns.
GRAMS = 1 << 14
#: Words seen in fewer training sentences than this count as unknown to the word model.
LEAST_SEEN = 2

# Environments that hold no prose.
_ENVIRONMENTS = "equation align gather multline eqnarray displaymath math array tabular tabularx table verbatim lstlisting comment tikzpicture thebibliography algorithm algorithmic filecontents".split()
# Commands whose argument is no prose.
_ARGUMENTS = (
    "[cC]ite\\w*|nocite|ref|eqref|autoref|cref|pageref|label|input|include|subfile|includegraphics|bibliography|bibliographystyle|usepackage|documentclass|"
    "url|href|vspace|hspace|newcommand|renewcommand|providecommand|DeclareMathOperator|setlength|graphicspath|hypersetup|pagestyle|thispagestyle|import|subimport|author|date|thanks|affiliation|email|ensuremath"
)
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_MARKUP = re.compile(
    r"\\begin\{(" + "|".join(_ENVIRONMENTS) + r")\*?\}.*?(?:\\end\{\1\*?\}|\Z)"
    r"|\\iffalse\b.*?(?:\\fi\b|\Z)"
    r"|\$\$.*?\$\$|\$(?:[^$\n]|\n(?![ \t]*\n))*\$|\\\(.*?\\\)|\\\[.*?\\\]"
    r"|\\(?:" + _ARGUMENTS + r")\*?(?:\[[^\]]*\])*(?:\{[^{}]*\})*"
    r"|\\def\\\w+[^\n]*"
    r"|\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?"
    r"|\\[a-zA-Z]+\*?(?:\[[^\]]*\])?|\\.",
    re.S,
)
_TABLE = bytes(46 if chr(i) in ".!?" else i if chr(i).isalpha() and i < 128 or i >= 128 else 39 if i == 39 else 32 for i in range(256))


def prose(text: str) -> str:
    """The text without markup and drafts, for tokenizing; ends of paragraphs become full stops.

    A formula within a line runs to the next dollar sign of its paragraph, however far that is.
    """
    if "%" in text:
        text = _COMMENT.sub("", text)
    at = text.find("\\begin{document}")
    if at >= 0:
        text = text[at + 16 :]
    at = text.find("\\end{document}")
    if at >= 0:
        text = text[:at]
    text = _MARKUP.sub(" ", text)
    return re.sub(r"\n[ \t]*\n", " . ", text)


def words_of(text: str) -> list[bytes]:
    """Lower-case words and ``b"."`` for every end of a sentence."""
    return prose(text).lower().encode("utf-8", "replace").translate(_TABLE).replace(b".", b" . ").split()


def grams_of(word: bytes) -> np.ndarray:
    """Hashed columns of the character n-grams of the whole word (FNV-1a over its characters)."""
    chars = np.frombuffer(f"<{word.decode('utf-8', 'replace')}>".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    for n in (2, 3, 4):
        count = len(chars) - n + 1
        if count > 0:
            h = np.full(count, 2166136261, np.uint64)
            for j in range(n):
                h = ((h ^ chars[j : j + count]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
            out.append(h % np.uint64(GRAMS))
    return np.concatenate(out).astype(np.int32)


@dataclass
class Sentences:
    """Sentences of many documents as runs of word numbers."""

    words: np.ndarray
    starts: np.ndarray
    doc: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.words)))


def sentences(docs: list[list[bytes]], number: dict[bytes, int], most: int | None = None) -> Sentences:
    """Numbers the words (``number`` grows or answers by __missing__); sentences of one word are left out."""
    words, starts, owner, at = [], [], [], 0
    for k, toks in enumerate(docs):
        ids = np.fromiter(map(number.__getitem__, toks), np.int64, len(toks))
        ends = np.flatnonzero(ids == 0)
        first = np.concatenate(([0], ends + 1))
        last = np.append(ends, len(ids))
        keep = last - first >= 2
        first, last = first[keep], last[keep]
        if most is not None and len(first) > most:
            pick = np.linspace(0, len(first) - 1, most).astype(int)
            first, last = first[pick], last[pick]
        if not len(first):
            continue
        size = last - first
        inside = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        words.append(ids[inside])
        starts.append(at + np.concatenate(([0], np.cumsum(size)[:-1])))
        owner.append(np.full(len(first), k))
        at += int(size.sum())
    if not words:
        return Sentences(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Sentences(np.concatenate(words), np.concatenate(starts), np.concatenate(owner))


class Numbering(dict):
    """Word -> number in order of appearance; the full stop is 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mean_rows(table: np.ndarray, s: Sentences) -> np.ndarray:
    """Mean over each sentence of the table's rows of its words."""
    return np.add.reduceat(table[s.words], s.starts, axis=0) / s.sizes[:, None]


def _length_features(s: Sentences, letters: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(s.starts)), np.log1p(s.sizes) / 4, np.add.reduceat(letters[s.words], s.starts) / s.sizes / 10], axis=1)


def _transpose_mean(residual: np.ndarray, s: Sentences, n_words: int) -> np.ndarray:
    """Gradient per word of a mean-of-words model."""
    each = np.repeat(residual / s.sizes[:, None], s.sizes, axis=0)
    return np.stack([np.bincount(s.words, each[:, k], n_words) for k in range(each.shape[1])], axis=1)


def _fit_softmax(forward, backward, shapes, y: np.ndarray, l2: float, rounds: int) -> list[np.ndarray]:
    """Multinomial logistic regression by full-batch Adam; forward gives scores, backward the gradients."""
    w = [np.zeros(x) for x in shapes]
    m, v = [np.zeros(x) for x in shapes], [np.zeros(x) for x in shapes]
    for t in range(1, rounds + 1):
        g = backward((_softmax(forward(w)) - y) / len(y))
        for i in range(len(w)):
            g[i] = g[i] + l2 * w[i] * (i < len(w) - 1)
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.99 * v[i] + 0.01 * g[i] ** 2
            w[i] = w[i] - 0.3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8) * (1 - t / (rounds + 1))
    return w


@dataclass
class SentenceModel:
    """Word rows by word, character rows by hashed n-gram, and dense weights of both models."""

    word: dict[bytes, int]
    word_rows: np.ndarray
    word_dense: np.ndarray
    gram: np.ndarray
    gram_dense: np.ndarray

    def row(self, w: bytes, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.word.get(w)
        return (np.zeros(LEVELS) if known is None else self.word_rows[known]), self.gram[grams].mean(axis=0)


def fit_sentences(s: Sentences, vocabulary: list[bytes], y: np.ndarray, rounds: int = 60, l2: float = 1e-6) -> SentenceModel:
    """Both models on sentences with level distributions ``y``."""
    n = len(vocabulary)
    letters = np.array([len(w) for w in vocabulary], float)
    dense = _length_features(s, letters)
    seen = np.bincount(s.words, minlength=n) >= LEAST_SEEN
    keep = seen[:, None]

    def word_forward(w):
        return _mean_rows(w[0] * keep, s) + dense @ w[1]

    def word_backward(r):
        return [_transpose_mean(r, s, n) * keep, dense.T @ r]

    word, word_dense = _fit_softmax(word_forward, word_backward, [(n, LEVELS), (3, LEVELS)], y, l2, rounds)
    grams = [grams_of(w) for w in vocabulary]
    sizes = np.array([len(g) for g in grams])
    flat, cuts = np.concatenate(grams), np.concatenate(([0], np.cumsum(sizes)[:-1]))

    def rows(c):
        return np.add.reduceat(c[flat], cuts, axis=0) / sizes[:, None]

    def gram_forward(w):
        return _mean_rows(rows(w[0]), s) + dense @ w[1]

    def gram_backward(r):
        each = np.repeat(_transpose_mean(r, s, n) / sizes[:, None], sizes, axis=0)
        return [np.stack([np.bincount(flat, each[:, k], GRAMS) for k in range(LEVELS)], axis=1), dense.T @ r]

    gram, gram_dense = _fit_softmax(gram_forward, gram_backward, [(GRAMS, LEVELS), (3, LEVELS)], y, l2, rounds)
    known = np.flatnonzero(seen)
    return SentenceModel({vocabulary[i]: k for k, i in enumerate(known)}, word[known].astype(np.float32), word_dense, gram.astype(np.float32), gram_dense)


class Scorer(Numbering):
    """Numbers words and keeps their rows of all models, worked out at first sight."""

    #: Words a worker remembers before it starts anew.
    MOST = 400_000

    def __init__(self, models: list[SentenceModel]) -> None:
        super().__init__()
        self.models = models
        self.table = np.zeros((1024, 2 * LEVELS * len(models) + 1), np.float32)

    def __missing__(self, word: bytes) -> int:
        n = super().__missing__(word)
        if n >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if self.models:
            grams = grams_of(word)
            self.table[n, :-1] = np.concatenate([x for m in self.models for x in m.row(word, grams)])
        self.table[n, -1] = len(word)
        return n

    def distributions(self, docs: list[list[bytes]]) -> tuple[list[np.ndarray], Sentences]:
        """Per model the distribution over levels of every sentence, and the sentences."""
        if len(self) > self.MOST:
            self.__init__(self.models)
        s = sentences(docs, self)
        if not len(s.starts):
            return [np.zeros((0, LEVELS)) for _ in self.models], s
        mean = _mean_rows(self.table, s)
        dense = np.stack([np.ones(len(s.starts)), np.log1p(s.sizes) / 4, mean[:, -1] / 10], axis=1)
        out = []
        for k, m in enumerate(self.models):
            own = mean[:, 2 * LEVELS * k :]
            out.append((_softmax(own[:, :LEVELS] + dense @ m.word_dense) + _softmax(own[:, LEVELS : 2 * LEVELS] + dense @ m.gram_dense)) / 2)
        return out, s


def document_features(p: np.ndarray, s: Sentences, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, sentences per document): constant, mean distribution, shares by likeliest level, mean and spread of the expected level."""
    count = np.bincount(s.doc, minlength=n_docs).astype(float)
    some = np.maximum(count, 1)
    likeliest = np.eye(LEVELS)[p.argmax(axis=1)] if len(p) else np.zeros((0, LEVELS))
    level = p @ np.arange(1, LEVELS + 1)
    cols = [np.bincount(s.doc, x, n_docs) / some for x in (*p.T, *likeliest.T, level, level**2)]
    cols[-1] = np.sqrt(np.maximum(cols[-1] - cols[-2] ** 2, 0))
    return np.stack([np.ones(n_docs), *cols], axis=1), count


@dataclass
class ReadingModel:
    sentence: list[SentenceModel]
    ridge: np.ndarray
    cuts: np.ndarray
    prior: float
    #: Of held-out documents: how many, share of exact levels, share within one level, mean absolute error.
    held_out: tuple[int, float, float, float]

    def judge(self, features: list[np.ndarray], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(difficulty, level) per document from its features by each model."""
        value = np.mean([np.clip(x @ self.ridge, 1, LEVELS) for x in features], axis=0) if features else np.full(len(count), self.prior)
        value = np.where(count > 0, value, self.prior)
        return value, 1 + np.searchsorted(self.cuts, value, side="right")


def _ridge(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    a = x.T @ x + l2 * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    return np.linalg.solve(a, x.T @ y)


def _cut_points(value: np.ndarray, rating: np.ndarray) -> np.ndarray:
    """Increasing cut points of least absolute error in levels, by a sweep over the sorted values."""
    order = np.argsort(value)
    v, r = value[order], np.rint(rating[order])
    cuts, least = [], 0
    for k in range(1, LEVELS):
        # Below the cut levels up to k, above it levels from k + 1: the least misplaced, from the last cut on.
        wrong = np.cumsum(np.where(r > k, 1, -1))
        wrong = np.concatenate(([0], wrong))
        at = least + int(wrong[least:].argmin())
        cuts.append(-np.inf if at == 0 else np.inf if at == len(v) else (v[at - 1] + v[at]) / 2)
        least = at
    return np.array(cuts)


#: Of a fit: numbers of the documents it trains on, and the sets of documents whose features it answers.
Job = tuple[np.ndarray, list[np.ndarray]]


def trained(docs: list[list[bytes]], ratings: np.ndarray, rows: np.ndarray) -> SentenceModel:
    """The sentence models of some documents."""
    number = Numbering()
    s = sentences([docs[i] for i in rows], number, MOST_SENTENCES)
    r = ratings[rows][s.doc]
    low = np.clip(np.floor(r).astype(int), 1, LEVELS)
    y = np.zeros((len(r), LEVELS))
    y[np.arange(len(r)), low - 1] = 1 - (r - low)
    y[np.arange(len(r)), np.minimum(low, LEVELS - 1)] += r - low
    return fit_sentences(s, list(number), y)


def fitted(docs: list[list[bytes]], ratings: np.ndarray, job: Job) -> tuple[SentenceModel, list[np.ndarray]]:
    model = trained(docs, ratings, job[0])
    scorer, out = Scorer([model]), []
    for rows in job[1]:
        (p,), s = scorer.distributions([docs[i] for i in rows])
        out.append(document_features(p, s, len(rows))[0])
    return model, out


def fit(ratings: np.ndarray, run: Callable[[list[Job]], list], seed: int = 5) -> ReadingModel:
    """A model of documents with these mean ratings; ``run`` answers jobs as ``fitted`` does, in their order.

    Two jobs make the model that is returned, from all documents; two more make the report,
    from four fifths of them, judged on the rest.
    """
    prior = float(np.mean(ratings)) if len(ratings) else (1 + LEVELS) / 2
    if len(ratings) < 10:
        return ReadingModel([], np.zeros(0), np.arange(1.5, LEVELS), prior, (0, 0.0, 0.0, 0.0))
    part = np.random.default_rng(seed).permutation(len(ratings))
    held, rest = part[: len(part) // 5], part[len(part) // 5 :]
    a, b, c, d = part[::2], part[1::2], rest[::2], rest[1::2]
    (model_a, (on_b,)), (model_b, (on_a,)), (_, (on_d, held_c)), (_, (on_c, held_d)) = run([(a, [b]), (b, [a]), (c, [d, held]), (d, [c, held])])

    def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ridge = _ridge(x, y)
        return ridge, _cut_points(np.clip(x @ ridge, 1, LEVELS), y)

    tried = ReadingModel([], *calibrated(np.concatenate([on_c, on_d]), ratings[np.concatenate([c, d])]), prior, (0, 0.0, 0.0, 0.0))
    value, level = tried.judge([held_c, held_d], np.ones(len(held)))
    off = np.abs(level - ratings[held])
    report = (len(held), float((off <= 0.5).mean()), float((off <= 1).mean()), float(np.abs(value - ratings[held]).mean()))
    return ReadingModel([model_a, model_b], *calibrated(np.concatenate([on_a, on_b]), ratings[np.concatenate([a, b])]), prior, report)


def _prose_sample(documents: DataFrame, labels: DataFrame, row_id: str, text: str, rating: str, most: int, most_bytes: int) -> list[tuple[bytes, float]]:
    """(compressed words, mean rating) of the labelled documents of least hash of the id, within both bounds; null ids take no part."""
    mean = labels.where(F.col(rating).isNotNull() & F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("_id")).agg(F.avg(rating).alias("_rating"))
    chosen = F.broadcast(mean.orderBy(F.xxhash64("_id"), "_id").limit(most))
    rows = documents.select(F.col(row_id).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id").where("_text is not null")
    kind = dict(rows.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [zlib.compress(b" ".join(words_of(t.as_py()))) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_rating"), pa.array(packed, pa.binary())], names=["_id", "_rating", "_words"])

    sample = cut(rows.select("_id", "_rating", "_text").mapInArrow(run, f"_id {kind}, _rating double, _words binary"))
    order = [F.xxhash64("_id"), F.col("_id"), F.xxhash64("_words")]
    within = F.sum(F.octet_length("_words")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) <= most_bytes
    # At most ``most`` documents and copies of them: the window is small however large the tables.
    kept = sample.orderBy(*order).limit(most).withColumn("_in", within).where("_in").collect()
    return [(bytes(r["_words"]), r["_rating"]) for r in kept]


def fit_on(
    documents: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", rating: str = "reading_level", most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES
) -> ReadingModel:
    """Fits on at most ``most`` labelled documents of ``most_bytes`` compressed prose, whole texts each."""
    spark = documents.sparkSession
    sample = _prose_sample(documents, labels, row_id, text, rating, most, most_bytes)
    unpacked = lambda rows: [zlib.decompress(w).split() for w, _ in rows]
    usable = [r for r, words in zip(sample, unpacked(sample), strict=True) if len(words) > 2]
    ratings = np.array([r for _, r in (usable if len(usable) >= 10 else sample)], float)
    if len(usable) < 10:
        return ReadingModel([], np.zeros(0), np.arange(1.5, LEVELS), float(ratings.mean()) if len(ratings) else (1 + LEVELS) / 2, (0, 0.0, 0.0, 0.0))

    def run(jobs: list[Job]) -> list:
        shared = spark.sparkContext.broadcast((usable, ratings, jobs))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    own, r, todo = shared.value
                    docs = unpacked(own)
                    yield pd.DataFrame({"job": b["id"], "answer": [pickle.dumps(fitted(docs, r, todo[i])) for i in b["id"]]})

        # One task a fit: ranges are parted evenly and nothing is merged, as there is no shuffle.
        answers = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(work, "job bigint, answer binary").collect()
        shared.destroy()
        return [pickle.loads(r["answer"]) for r in sorted(answers, key=lambda r: r["job"])]

    return fit(ratings, run)


_SCORERS: dict[str, Scorer] = {}


def levels(documents: DataFrame, model: ReadingModel, row_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``row_id``, ``keep``, n_sentences, difficulty (1 to 5) and reading_level of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    columns = documents.select(row_id, *keep, text)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.drop(text).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value.sentence)
        scorer, judge = _SCORERS[key], shared.value.judge
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                docs = [words_of(t) if (t := x.as_py()) else [] for x in b.column(b.num_columns - 1)]
                by_model, s = scorer.distributions(docs)
                features = [document_features(p, s, len(docs))[0] for p in by_model]
                count = np.bincount(s.doc, minlength=len(docs))
                value, level = judge(features, count)
                out = [pa.array(count.astype(np.int64)), pa.array(np.round(value, 4)), pa.array(level.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=[*b.schema.names[:-1], "n_sentences", "difficulty", "reading_level"])

    return columns.mapInArrow(run, f"{head}, n_sentences bigint, difficulty double, reading_level int")
