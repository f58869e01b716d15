"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, which the forward algorithm gives; a text's is the product over its words (runs of letters,
lower-cased). Distributions are learned by expectation maximisation from words counted by language: Spark counts the
words, each round's expected counts are made where the words are, and only the sums, at most one row for each piece and
language, come to the driver. Texts are scored where they are read; workers keep the scores of a bounded number of words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import kept, tokenizer_path, written

VOCABULARY = "piece_bpe_32k.model"
#: Bound of the learning sample: documents of each language, chosen by hash, and rounds of learning.
TRAIN_DOCS, ROUNDS = 1000, 3
#: Languages that are learned at most: those of most documents.
LANGUAGES = 200
#: Letters up to which words are segmented many at a time; longer ones are segmented one by one, with equal results.
LONGEST = 32
#: Probability of a letter that no piece covers.
RARE = 1e-7
#: Words (of LONGEST letters at most) whose scores a worker keeps, some 300 bytes each; when half of them are taken it starts anew.
CACHE = 120_000
#: Rows of a batch that are taken at a time.
ROWS = 500
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True, eq=False)
class Model:
    languages: tuple[str, ...]
    pieces: dict[str, int]
    p: np.ndarray  # pieces x languages
    prior: np.ndarray  # log shares of the languages
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @cached_property
    def trie(self) -> Trie:
        return Trie(self.pieces)

    def __getstate__(self) -> dict:
        """Workers build the trie from the pieces."""
        return {k: v for k, v in self.__dict__.items() if k != "trie"}

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Model) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)


def vocabulary(path: str) -> dict[str, int]:
    """Numbers from 1 of the pieces of letters, lower-cased, with their word-start mark, and of their single letters; 0 for what only begins a piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {x for i in range(model.get_piece_size()) if (x := model.id_to_piece(i).lower()) and x.lstrip("▁").isalpha() and len(x) <= LONGEST}
    pieces |= {c for x in pieces for c in x.lstrip("▁")}
    return dict.fromkeys((x[:n] for x in pieces for n in range(1, len(x))), 0) | {x: k for k, x in enumerate(sorted(pieces), 1)}


def count_words(text: str | None) -> Counter:
    """Words of a text: runs of letters, lower-cased. Numbers that are no digits, as in ½ or ², part words."""
    out = Counter(_WORD.findall(text.lower())) if text else Counter()
    for x in [x for x in out if not x.isalpha()]:
        n = out.pop(x)
        for y in "".join(c if c.isalpha() else " " for c in x).split():
            out[y] += n
    return out


class Trie:
    """The vocabulary's pieces letter by letter, to be walked by arrays: one sorted number for each (node, letter)."""

    def __init__(self, pieces: dict[str, int]):
        node = {"": 0} | {x: k for k, x in enumerate(pieces, 1)}
        edges = np.array([node[x[:-1]] << 21 | ord(x[-1]) for x in pieces], np.int64)
        order = np.argsort(edges)
        self.edges, self.to = edges[order], order + 1
        self.piece = np.array([0, *pieces.values()], np.int64)
        self.marked = node.get("▁", -1)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Where each letter leads from each node; 0: nowhere."""
        key = nodes << 21 | letters
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.to[at], 0)


def _lattice(words: list[str], trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, from, to, piece) of every piece in every word, by to; a first piece may carry the word-start mark. Piece -1: no piece, one letter."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - first[word]
    left = size[word] - place
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def walk(at: np.ndarray, node: np.ndarray, marked: bool) -> None:
        n = 0
        while len(at):
            live = left[at] > n
            at, node = at[live], trie.step(node[live], letters[at[live] + n])
            piece = trie.piece[node]
            if n == 0 and not marked:
                alone = at[piece == 0]
                found.append((word[alone], place[alone], place[alone] + 1, np.full(len(alone), -1)))
            n += 1
            ends = at[piece > 0]
            found.append((word[ends], place[ends], place[ends] + n, piece[piece > 0] - 1))
            at, node = at[node > 0], node[node > 0]

    if len(trie.edges) and len(letters):
        walk(np.arange(len(letters)), np.zeros(len(letters), np.int64), False)
        if trie.marked > 0:
            begins = first[size > 0]
            walk(begins, np.full(len(begins), trie.marked), True)
    w, a, b, k = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    by = np.argsort(b, kind="stable")
    return w[by], a[by], b[by], k[by]


def _sum_into(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    for j in range(values.shape[1]):
        target[:, j] += np.bincount(rows, values[:, j], len(target))


def forward(words: list[str], model: Model) -> tuple[np.ndarray, tuple]:
    """Sums over segmentations at each place (words x places x languages), and the arcs with their probabilities."""
    w, a, b, k = _lattice(words, model.trie)
    p = np.where((k >= 0)[:, None], model.p[np.maximum(k, 0)], RARE)
    alpha = np.zeros((len(words), max(map(len, words), default=0) + 1, len(model.languages)))
    alpha[:, 0] = 1.0
    cuts = np.searchsorted(b, np.arange(LONGEST + 2))
    for to in range(1, alpha.shape[1]):
        s = slice(cuts[to], cuts[to + 1])
        if s.stop > s.start:
            _sum_into(alpha[:, to], w[s], alpha[w[s], a[s]] * p[s])
    return alpha, (w, a, b, k, p)


def expected_counts(words: list[str], counts: np.ndarray, model: Model) -> np.ndarray:
    """Pieces x languages: how often each piece is expected in the words, counted by language."""
    alpha, (w, a, b, k, p) = forward(words, model)
    size = np.fromiter(map(len, words), np.int64, len(words))
    total = alpha[np.arange(len(words)), size]
    beta = np.zeros_like(alpha)
    beta[np.arange(len(words)), size] = 1.0
    by = np.argsort(-a, kind="stable")
    w2, a2, b2, p2 = w[by], a[by], b[by], p[by]
    cuts = np.searchsorted(-a2, -np.arange(LONGEST), "left"), np.searchsorted(-a2, -np.arange(LONGEST), "right")
    for at in range(alpha.shape[1] - 2, -1, -1):
        s = slice(cuts[0][at], cuts[1][at])
        if s.stop > s.start:
            _sum_into(beta[:, at], w2[s], beta[w2[s], b2[s]] * p2[s])
    share = alpha[w, a] * p * beta[w, b] * (counts / np.maximum(total, 1e-300))[w]
    out = np.zeros_like(model.p)
    _sum_into(out, np.maximum(k, 0), share * (k >= 0)[:, None])
    return out


def _arcs(word: str, pieces: dict[str, int]) -> Iterator[list[tuple[int, int]]]:
    """For each place, from 1 on, the (place before, piece or -1) of the pieces that end there; as _lattice() has them, for a word of any length."""
    longest = max(map(len, pieces), default=1)
    marked = "▁" + word[:longest]
    for b in range(1, len(word) + 1):
        own = [(a, k - 1) for a in range(max(0, b - longest), b) if (k := pieces.get(word[a:b]))]
        if not own or own[-1][0] != b - 1:
            own.append((b - 1, -1))
        if b < longest and (k := pieces.get(marked[: b + 1])):
            own.append((0, k - 1))
        yield own


def long_word(word: str, model: Model, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log of the sum over segmentations for each language, and with counts (by language) the expected counts of pieces.

    As forward() and expected_counts(), but in logarithms, so that a word may have any length. Scoring keeps as many
    places as the longest piece has letters.
    """
    lp, rare = np.log(model.p), np.full(len(model.languages), np.log(RARE))
    longest = max(map(len, model.pieces), default=1)
    alpha, kept = {0: np.zeros(len(model.languages))}, []
    for b, own in enumerate(_arcs(word, model.pieces), 1):
        each = np.array([alpha[a] + (lp[k] if k >= 0 else rare) for a, k in own])
        top = each.max(0)
        alpha[b] = top + np.log(np.exp(each - top).sum(0))
        if counts is None:
            alpha.pop(b - longest, None)
        else:
            kept.append(own)
    total = alpha[len(word)]
    if counts is None:
        return total, None
    out, beta = np.zeros_like(model.p), np.full((len(word) + 1, len(model.languages)), -np.inf)
    beta[-1] = 0.0
    for b in range(len(word), 0, -1):
        for a, k in kept[b - 1]:
            onward = beta[b] + (lp[k] if k >= 0 else rare)
            beta[a] = np.logaddexp(beta[a], onward)
            if k >= 0:
                out[k] += counts * np.exp(alpha[a] + onward - total)
    return total, out


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _count_batches(languages: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for x, n in count_words(text).items():
                    seen[lang, x] += n
            if len(seen) > CACHE:
                yield _counted(seen)
                seen = Counter()
        yield _counted(seen)

    return run


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])


def _expected_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(model.p)
        for batch in batches:
            words = batch.column("word").to_pylist()
            counts = np.array([batch.column(f"n{j}").to_numpy(zero_copy_only=False) for j in range(len(model.languages))], float).T.reshape(len(words), -1)
            short = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) <= LONGEST)
            for at in range(0, len(short), 4000):
                own = short[at : at + 4000]
                total += expected_counts([words[k] for k in own], counts[own], model)
            for k, x in enumerate(words):
                if len(x) > LONGEST:
                    total += long_word(x, model, counts[k])[1]
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    return run


def learn(docs: DataFrame, path: str | None = None, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Learns from text and lang of rows that are not held out: of each language's, train_docs chosen by a hash of the id.

    Rows without text or lang teach nothing. Of more than LANGUAGES values of lang, those of most rows are learned.
    Without any language the model knows none.
    """
    pieces = vocabulary(path or tokenizer_path(VOCABULARY))
    rows = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), pieces, np.zeros((0, 0)), np.zeros(0))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, train_docs / n)))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("learn"), F.col("doc_id").cast("string")), F.lit(1 << 20)) < share * (1 << 20))
    counted = chosen.select("lang", "text").mapInArrow(_count_batches(languages), "lang string, word string, n long")
    words = written(counted.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("double").alias(f"n{j}") for j, x in enumerate(languages)]).repartition(docs.sparkSession.sparkContext.defaultParallelism), "words")
    p = np.tile(np.array([1.0 / (1 + len(x)) ** 3 for x, k in sorted(pieces.items(), key=lambda i: i[1]) if k])[:, None], (1, len(languages)))
    model = Model(languages, pieces, p / p.sum(0), np.log(np.array([sizes[x] for x in languages], float) / sum(sizes.values())))
    for _ in range(rounds):
        expected = words.mapInArrow(_expected_batches(model), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect()
        counts = np.full_like(model.p, 0.02)
        for r in expected:
            counts[r.piece, r.lang] += r.n
        model = Model(languages, pieces, counts / counts.sum(0), model.prior)
    return model


class _Places(dict):
    """Words and the rows of their scores; new words get rows as they are asked for. Long words have none."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST:
            return -1
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Scorer:
    """Scores texts and keeps the scores of short words it has seen, up to CACHE of them."""

    def __init__(self, model: Model):
        self.model, self.place = model, _Places()
        self.scores = np.zeros((CACHE, len(model.languages)))

    def _learn(self) -> None:
        new, self.place.new = self.place.new, []
        n = len(self.place) - len(new)
        if len(self.place) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((len(self.place), len(self.model.languages)))])
        order = sorted(range(len(new)), key=lambda k: len(new[k]))
        for at in range(0, len(order), 4000):
            rows = np.array(order[at : at + 4000])
            own = [new[k] for k in rows.tolist()]
            alpha, _ = forward(own, self.model)
            ends = alpha[np.arange(len(own)), np.fromiter(map(len, own), np.int64, len(own))]
            self.scores[n + rows] = np.log(np.maximum(ends, 1e-300))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and share of each text. New words are learned together, of a bounded number of texts."""
        langs, values, at = [], [], 0
        while at < len(texts):
            if len(self.place) > CACHE // 2:
                self.place, self.scores = _Places(), self.scores[:CACHE]
            place, some = self.place, []
            while at < len(texts) and len(place.new) < CACHE // 2:
                counts = count_words(texts[at])
                some.append((counts, [place[x] for x in counts] if self.model.languages else []))
                at += 1
            self._learn()
            for counts, rows in some:
                if not rows:
                    langs.append(UNKNOWN)
                    values.append(0.0)
                    continue
                n = np.fromiter(counts.values(), float, len(counts))
                if -1 in rows:
                    total = self.model.prior + sum(k * long_word(x, self.model)[0] for x, k in counts.items() if len(x) > LONGEST)
                    rows = np.array(rows)
                    total = total + n[rows >= 0] @ self.scores[rows[rows >= 0]]
                else:
                    total = self.model.prior + n @ self.scores[rows]
                best = int(total.argmax())
                langs.append(self.model.languages[best])
                values.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, values


def _scorer(model: Model) -> Scorer:
    """A worker keeps its scorer, with the words it has seen, for the tasks that follow."""
    return kept(model, lambda: Scorer(model))


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                langs, values = scorer(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(values, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def _keep_batches(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                langs, values = scorer(some.column("text").to_pylist())
                yield some.filter(pa.array([x != UNKNOWN and v >= least for x, v in zip(langs, values, strict=True)], pa.bool_()))

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: the likeliest language and its share, or und and 0 for a text that is null or has no letter. Of docs, doc_id and text are read, and the text alone decides."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score_batches(model), "doc_id long, lang_pred string, score double")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row, by a model learned from the rows that are not held out.

    Each row is judged by its own text, so repeated rows get equal results; a null doc_id isn't held out. Texts and
    words of any length are read whole. An empty table gives no rows. Other columns than doc_id, text and lang are not
    read, whatever their names. Of equally likely languages the first in alphabetical order is given.
    """
    return predict(docs, learn(docs, **options)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model | None = None, least: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows whose text is null or has no letter, or of which no language is likelier than not.

    A model without languages keeps all. Repeated rows are judged alike; an empty table stays empty.
    """
    model = model or learn(docs)
    return docs.mapInArrow(_keep_batches(model, least), docs.schema) if model.languages else docs
