"""Hidden Markov language model: Baum-Welch training, exact forward scores.

Every word has an emission probability of its own in every hidden state: its
expected count there, smoothed towards the base distribution, so a state is a
distribution over all words, the end of a text and a slot for words never
seen, and the model one over all token sequences.

Training covers all training texts in every pass.  Words are counted; the
co-occurrence of the most frequent ones over all texts (a matrix of fixed
size) tells the states apart at the start; then Baum-Welch rounds run until
the summed likelihood rises by less than ``GAIN`` of itself, at most ``ROUNDS``
and one last (more gain next to nothing, see README): each task sums the expected counts of its texts, one aggregate
adds them up, and each round's parameters go out as a broadcast of fixed size.
That is possible because the rounds update the words by turns: first the
``HEAD`` most frequent words, each by itself, with the states' share of all
other words; the last pass then gives each of the others its own expected
counts, as a distributed table with a row per word that never passes through
the driver.

Scoring looks frequent words up in a broadcast table of fixed size and joins
all others with the table: the words that a text asks for (equal texts ask
once) come back to the text in one row.

Texts are cut into segments of ``SEGMENT`` tokens that advance together; for
texts of several segments the scaled products of the transition and emission
matrices carry the exact forward and backward vectors across the borders, so
likelihoods and counts are those of the whole text.

Rows: a null text is empty and has its end token only; repeated rows are
scored each on its own; without training rows every count is 0 and all states
are the base distribution; an empty table gives an empty result; other columns
pass through, columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, drop_saved, mix, saved, slices, span_hashes, utf8, word_spans

STATES = 6
SEGMENT = 2048
#: Rounds at most before the last, and the relative gain in likelihood below which they end.
ROUNDS, GAIN = 2, 0.01
#: Words with emissions of their own in the rounds, words that a score looks
#: up without a join, and slots of the tables for them.
HEAD, FREQUENT, SLOTS = 1 << 15, 1 << 18, 1 << 20
#: Frequent words whose co-occurrence starts the states, and their weight.
SEEDS, SEED_WEIGHT = 256, 0.9
#: Weight of the base distribution in a state's emissions for each word the
#: state has (Witten-Bell), and pseudo-count of a transition.
EMIT_PRIOR, MOVE_PRIOR = 2.0, 0.5
ADD = 0.1
STEP = 4 << 20
#: Entries that a task gathers before it hands them on.
FLUSH = 2_000_000


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the first word of each text."""
    buf, off = utf8(col)
    starts, ends, first = word_spans(buf, off)
    return span_hashes(buf, starts, ends), first


def with_ends(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word among all tokens (every text has its end as a
    token), and each text's first token."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) + owner, np.concatenate([[0], np.cumsum(n + 1)])


class Table:
    """Words in a direct-mapped table; a word whose slot a more frequent one
    has is not in it.  ``words`` come by falling frequency."""

    def __init__(self, words: np.ndarray, most: int):
        slot = self._slot(words)
        slot, at = np.unique(slot, return_index=True)  # the first of a slot is its most frequent
        at = np.sort(at)[:most]
        self.words = words[at]
        self.keys, self.index = np.zeros(SLOTS, dtype=U64), np.full(SLOTS, -1, dtype=np.int32)
        self.keys[self._slot(self.words)] = self.words
        self.index[self._slot(self.words)] = np.arange(len(at))
        self.taken = at

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> U64(40) & U64(SLOTS - 1)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each word, -1 if it is not in the table."""
        slot = self._slot(h)
        return np.where(self.keys[slot] == h, self.index[slot], -1)


@dataclass
class Model:
    start: np.ndarray  # [K]
    move: np.ndarray   # [K, K]
    emit: np.ndarray   # [symbols, K]


class Segments:
    """Segments of all texts of a slice; ``order`` has the longest first."""

    def __init__(self, begin: np.ndarray):
        n = np.diff(begin)
        per = -(-n // SEGMENT)
        self.head = np.concatenate([[0], np.cumsum(per)])
        self.owner = np.repeat(np.arange(len(n)), per)
        nth = np.arange(len(self.owner)) - self.head[:-1][self.owner]
        self.at = begin[:-1][self.owner] + nth * SEGMENT
        self.size = np.minimum(n[self.owner] - nth * SEGMENT, SEGMENT)
        self.first = nth == 0
        self.order = np.argsort(-self.size, kind="stable")
        self.active = self._active(self.order)
        # all tokens by step: a step's tokens lie together, the longest segment's first
        self.step = np.concatenate([[0], np.cumsum(self.active, dtype=np.int64)])
        at = self.at[self.order]
        self.tokens = np.concatenate([at[:n] + t for t, n in enumerate(self.active)]) if self.active else self.at
        # segments of texts that have several, and those texts by number of segments
        self.several = self.order[per[self.owner[self.order]] > 1]
        texts = np.flatnonzero(per > 1)
        self.texts = texts[np.argsort(-per[texts], kind="stable")]
        most = int(per.max()) if len(per) else 0
        self.chains = np.searchsorted(-per[self.texts], -np.arange(1, most + 1), side="right").tolist()

    def _active(self, order: np.ndarray) -> list[int]:
        """How many segments have a token 0, 1, ..."""
        size = self.size[order]
        longest = int(size[0]) if len(size) else 0
        return np.searchsorted(-size, -np.arange(1, longest + 1), side="right").tolist()


def products(e: np.ndarray, g: Segments, move: np.ndarray) -> np.ndarray:
    """Scaled matrix product of each segment in ``g.several``."""
    k = move.shape[0]
    at = g.at[g.several]
    m = np.where(g.first[g.several][:, None, None], np.eye(k, dtype=np.float32), move)
    for t, n in enumerate(g._active(g.several)):
        if t:
            m[:n] = (m[:n].reshape(-1, k) @ move).reshape(n, k, k)
        m[:n] *= e[at[:n] + t][:, None, :]
        if t % 4 == 3:
            m[:n] /= m[:n].max(axis=(1, 2))[:, None, None]
    out = np.empty((len(g.at), k, k), dtype=np.float32)
    out[g.several] = m / m.max(axis=(1, 2))[:, None, None]
    return out


def borders(e: np.ndarray, g: Segments, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State distribution before each segment, and the scaled likelihood of
    all that follows it, by its last state."""
    before = np.tile(start, (len(g.at), 1))
    after = np.ones((len(g.at), len(start)), dtype=np.float32)
    if len(g.texts):
        m = products(e, g, move)
        v = np.tile(start, (len(g.texts), 1))
        for i, n in enumerate(g.chains):
            s = g.head[g.texts[:n]] + i
            before[s] = v[:n]
            w = np.einsum("ni,nij->nj", v[:n], m[s])
            v[:n] = w / w.sum(axis=1, keepdims=True)
        for i in range(len(g.chains) - 1, 0, -1):
            s = g.head[g.texts[:g.chains[i]]] + i
            w = np.einsum("nij,nj->ni", m[s], after[s])
            after[s - 1] = w / w.max(axis=1, keepdims=True)
    return before, after


def forward(e: np.ndarray, g: Segments, move: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text, and the state distributions after each
    token; ``e`` and these are [K, tokens], in the order of ``g.tokens``."""
    b = before[g.order]
    v = np.ascontiguousarray(np.where(g.first[g.order][:, None], b, b @ move).T)
    log, back, out = np.zeros(len(g.order)), np.ascontiguousarray(move.T), np.empty_like(e)
    for t, n in enumerate(g.active):
        now = slice(g.step[t], g.step[t + 1])
        v = (back @ v[:, :n] if t else v) * e[:, now]
        z = v.sum(axis=0)
        v /= z
        log[:n] += np.log(z)
        out[:, now] = v
    return np.bincount(g.owner[g.order], weights=log, minlength=len(g.head) - 1), out


def scaled(emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions relative to each symbol's largest, and the log of that."""
    top = emit.max(axis=1)
    return (emit / top[:, None]).astype(np.float32), np.log(top)


def log_likelihood(e: np.ndarray, top: np.ndarray, begin: np.ndarray, model: Model) -> np.ndarray:
    """Natural log probability of each text (scaled forward); ``e`` and
    ``top``: scaled emissions of each token."""
    move, start, g = model.move.astype(np.float32), model.start.astype(np.float32), Segments(begin)
    before, _ = borders(e, g, move, start)
    log, _ = forward(np.ascontiguousarray(e[g.tokens].T), g, move, before)
    return log + np.add.reduceat(top, begin[:-1]) if len(log) else log


def posteriors(e: np.ndarray, begin: np.ndarray, model: Model):
    """State posteriors [K, tokens] and the order of the tokens, expected
    starts [K] and moves [K, K], and each text's log likelihood (of the scaled
    emissions ``e`` [tokens, K])."""
    move, start, g = model.move.astype(np.float32), model.start.astype(np.float32), Segments(begin)
    before, after = borders(e, g, move, start)
    e = np.ascontiguousarray(e[g.tokens].T)
    log, gamma = forward(e, g, move, before)  # distributions first, posteriors in the end
    first, before, after = g.first[g.order], before[g.order], after[g.order].T
    moves = np.zeros(move.shape)
    follow = None  # emission times backward vector of the next token
    for t in range(len(g.active) - 1, -1, -1):
        now = slice(g.step[t], g.step[t + 1])
        alpha, beta = gamma[:, now], after[:, :g.active[t]].copy()
        if follow is not None:
            more = follow.shape[1]  # segments that go on
            beta[:, :more] = move @ follow
            z = (alpha[:, :more] * beta[:, :more]).sum(axis=0)
            moves += (alpha[:, :more] / z) @ follow.T
        follow = e[:, now] * beta
        alpha *= beta
        alpha /= alpha.sum(axis=0)
        follow /= follow.max(axis=0)
    joined = ~first  # moves across segment borders
    if joined.any():
        f, b = follow[:, joined].T, before[joined]
        z = (b * (f @ move.T)).sum(axis=1)
        moves += (b / z[:, None]).T @ f
    starts = gamma[:, :len(first)][:, first].sum(axis=1, dtype=np.float64)
    return gamma, g.tokens, starts, moves * move, log


def by_symbol(sym: np.ndarray, gamma: np.ndarray, symbols: int) -> np.ndarray:
    """Sums of the posteriors [K, tokens] of each symbol."""
    return np.stack([np.bincount(sym, weights=v, minlength=symbols) for v in gamma], axis=1)


def maximise(start: np.ndarray, moves: np.ndarray, counts: np.ndarray, prior: np.ndarray) -> Model:
    """Parameters from expected counts; ``prior``: base probability of each symbol."""
    move = moves + MOVE_PRIOR
    move += 1e-5 * move.sum(axis=1, keepdims=True)
    weight = EMIT_PRIOR * np.minimum(counts, 1).sum(axis=0) + 1e-9
    emit = (counts + weight * prior[:, None]) / (counts.sum(axis=0) + weight)
    s = start + 1e-3 * (start.sum() + 1)
    return Model(s / s.sum(), move / move.sum(axis=1, keepdims=True), emit)


def base_probability(n, tokens: int, kinds: int):
    """Of tokens that occur ``n`` times (0: any word never seen)."""
    return (n + ADD) / (tokens + ADD * (kinds + 1))


@dataclass
class Corpus:
    counts: DataFrame  # word (hash), n
    tokens: int        # N
    kinds: int         # V
    texts: int

    def base(self, n):
        return base_probability(n, self.tokens, self.kinds)


def _gathered(held: list[tuple], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums by word of (words, values [n, columns]), in batches."""
    w, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    values = np.concatenate([h[1] for h in held])
    sums = [np.bincount(inverse, weights=values[:, i], minlength=len(w)) for i in range(values.shape[1])]
    for i in range(0, len(w), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(w[i:i + 100_000].view(np.int64)),
                                          *(pa.array(s[i:i + 100_000]) for s in sums)], ["word", *columns])


def _sums_by_word(texts: DataFrame, text: str, part_of, columns: list[str]) -> DataFrame:
    """(word, columns): sums over all texts of what ``part_of(column of
    texts)`` gives: words and values.  Tasks add up what they gather."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for part in slices(b, text, STEP):
                held.append(part_of(part.column(text)))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield from _gathered(held, columns)
                    held, size = [], 0
        if size:
            yield from _gathered(held, columns)

    rows = texts.select(text).mapInArrow(run, "word long, " + ", ".join(f"{c} double" for c in columns))
    return rows.groupBy("word").agg(*(F.sum(c).alias(c) for c in columns))


def count_words(train: DataFrame, text: str) -> Corpus:
    def each(col: pa.Array):
        w, n = np.unique(tokens(col)[0], return_counts=True)
        return w, n[:, None].astype(np.float64)

    counts = saved(_sums_by_word(train, text, each, ["n"]).select("word", F.col("n").cast("long").alias("n")), "word-counts")
    t = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    texts = train.count()
    return Corpus(counts, (t["n"] or 0) + texts, t["v"] + int(texts > 0), texts)


def most_frequent(counts: DataFrame, most: int) -> tuple[Table, pa.Table]:
    """The table of the most frequent words, and their rows in its order.  How
    often a word must occur comes from a histogram of the counts, of a bounded
    number of classes, so that no more rows than asked for leave the tasks."""
    rank = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    steps = sorted(((r["r"], r["c"]) for r in counts.groupBy(rank.alias("r")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, 2**31 - 1
    for r, c in steps:
        total += c
        if total > most + most // 4:
            break
        least = r
    rows = counts.where(rank >= least).toArrow()
    word, n = rows["word"].to_numpy().view(U64), rows["n"].to_numpy()
    order = np.lexsort((word, -n))
    table = Table(word[order], most)
    return table, rows.take(pa.array(order[table.taken]))


def _totals(texts: DataFrame, text: str, total_of, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all texts of the matrix that ``total_of(column of texts)``
    gives; rows of zeros stay in the task."""
    columns = [f"e{i}" for i in range(shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for part in slices(b, text, STEP):
                total += total_of(part.column(text))
        at = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, i]) for i in range(shape[1]))], ["at", *columns])

    rows = texts.select(text).mapInArrow(run, ", ".join(["at int", *(f"{c} double" for c in columns)])).groupBy(
        "at").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros(shape)
    out[rows["at"].to_numpy()] = np.stack([rows[c].to_numpy() for c in columns], axis=1)
    return out


def clusters(together: np.ndarray, k: int) -> np.ndarray:
    """A cluster for each of some words from how often they stand in the same
    texts: the leading directions of the normalised matrix, then k-means from
    the points farthest from each other."""
    size = np.sqrt(np.maximum(np.diag(together), 1e-12))
    _, axes = np.linalg.eigh(together / size[:, None] / size[None, :])
    x = axes[:, -k:]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = [x[0]]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    centres = np.array(centres)
    for _ in range(20):
        label = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[label == c].sum(axis=0) if (label == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return label


def first_model(train: DataFrame, text: str, table: Table, prior: np.ndarray, states: int) -> Model:
    """States that differ in the most frequent words: each cluster of words
    that stand in the same texts is likelier in one state.  The matrix of
    their co-occurrence covers all training texts."""
    few = min(SEEDS, len(table))
    lift = np.ones((len(prior), states))
    if few >= states:
        sent = train.sparkSession.sparkContext.broadcast(table)

        def together(col: pa.Array) -> np.ndarray:
            h, first = tokens(col)
            at = sent.value.find(h)
            owner = np.repeat(np.arange(len(col)), np.diff(first))
            ok = (at >= 0) & (at < few)
            x = np.bincount(owner[ok] * few + at[ok], minlength=len(col) * few).reshape(len(col), few).astype(np.float64)
            x = np.sqrt(x)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            return x.T @ x

        label = clusters(_totals(train, text, together, (few, few)), states)
        lift[:few] = (1 - SEED_WEIGHT) / max(states - 1, 1)
        lift[np.arange(few), label] = SEED_WEIGHT
        lift[:few] *= states
        sent.unpersist()
    emit = prior[:, None] * lift
    move = np.full((states, states), 0.05 / max(states - 1, 1))
    np.fill_diagonal(move, 0.95)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0, keepdims=True))


@dataclass
class Trained:
    start: np.ndarray
    move: np.ndarray
    end: np.ndarray        # emission of a text's end, by state
    unseen: np.ndarray     # of a word never seen
    words: DataFrame       # word, n, e0, e1, ...: emissions by state
    rounds: list[float]    # summed log likelihood (of the scaled emissions) of each round


#: Spark's own switch: shuffle files go when the query that wrote them is done.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fit(train: DataFrame, text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> tuple[Corpus, Trained]:
    """Word counts and model of the training texts (nulls: empty)."""
    spark = train.sparkSession
    spark.conf.set(CLEAN_UP, "true")
    train = train.select(F.coalesce(F.col(text), F.lit("")).alias(text))
    corpus = count_words(train, text)
    table, rows = most_frequent(corpus.counts, HEAD)
    h = len(table)
    rest, end = h, h + 1  # symbols: the head's words, all other words, the end
    n = rows["n"].to_numpy().astype(np.float64)
    others = corpus.tokens - corpus.texts - n.sum()
    prior = np.concatenate([corpus.base(n), [max((others + ADD * (corpus.kinds - int(corpus.texts > 0) - h)), 0) / (
        corpus.tokens + ADD * (corpus.kinds + 1)) + 1e-12, corpus.base(corpus.texts)]])
    model = first_model(train, text, table, prior, states)
    sent = spark.sparkContext.broadcast(table)
    columns = [f"e{i}" for i in range(states)]

    def symbols(table: Table, col: pa.Array):
        words, first = tokens(col)
        place, begin = with_ends(first)
        sym = np.full(begin[-1], end, dtype=np.int32)
        at = table.find(words)
        sym[place] = np.where(at < 0, rest, at)
        return words, at, place, sym, begin

    def round_of(now):
        def total(col: pa.Array) -> np.ndarray:
            emit, top, model = now.value
            _, _, _, sym, begin = symbols(sent.value, col)
            gamma, order, starts, moves, log = posteriors(emit[sym], begin, model)
            like = np.zeros((1, states))
            like[0, 0] = log.sum() + top[sym].sum()
            return np.vstack([by_symbol(sym[order], gamma, h + 2), starts[None], moves, like])
        return total

    likelihoods = []
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((*scaled(model.emit), model))
        total = _totals(train, text, round_of(now), (h + 4 + states, states))
        likelihoods.append(float(total[-1, 0]))
        model = maximise(total[h + 2], total[h + 3:-1], total[:h + 2], prior)
        now.unpersist()
        if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < GAIN * abs(likelihoods[-2]):
            break

    # the others' turn: expected counts of every word, by the model so far
    now = spark.sparkContext.broadcast((*scaled(model.emit), model))

    def each(col: pa.Array):
        emit, _, model = now.value
        words, at, place, sym, begin = symbols(sent.value, col)
        gamma, order, *_ = posteriors(emit[sym], begin, model)
        own, inverse = np.unique(words, return_inverse=True)
        which = np.full(len(sym), len(own))  # an end is no word
        which[place] = inverse
        return own, np.hstack([np.bincount(inverse, minlength=len(own))[:, None], by_symbol(which[order], gamma, len(own) + 1)[:-1]])

    expected = saved(_sums_by_word(train, text, each, ["n", *columns]), "hmm-expected")
    s = expected.agg(*(F.sum(c).alias(c) for c in columns), *(F.sum(F.least(F.col(c), F.lit(1.0))).alias(f"k{c}") for c in columns)).first()
    ends = total[end] if likelihoods else np.full(states, corpus.texts / states)  # expected ends, by state
    mass = np.array([s[c] or 0.0 for c in columns]) + ends
    weight = EMIT_PRIOR * (np.array([s[f"k{c}"] or 0.0 for c in columns]) + np.minimum(ends, 1)) + 1e-9
    base = F.lit(1.0 / (corpus.tokens + ADD * (corpus.kinds + 1))) * (F.col("n") + ADD)
    words = saved(expected.select("word", F.col("n").cast("long").alias("n"), *(
        ((F.col(c) + base * float(weight[i])) / float(mass[i] + weight[i])).cast("float").alias(c)
        for i, c in enumerate(columns))), "hmm-words")
    drop_saved(expected)
    return corpus, Trained(model.start, model.move, (ends + weight * corpus.base(corpus.texts)) / (mass + weight),
                           weight * corpus.base(0) / (mass + weight), words, likelihoods)


def score(docs: DataFrame, corpus: Corpus, model: Trained, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score (log10)."""
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c not in (*new, text)]
    states = len(model.start)
    columns = [f"e{i}" for i in range(states)]
    table, rows = most_frequent(model.words, FREQUENT)
    known = (np.stack([rows[c].to_numpy() for c in columns], axis=1).astype(np.float32) if len(table) else
             np.zeros((0, states), np.float32), rows["n"].to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast((table, known))
    hidden, unseen, end = Model(model.start, model.move, None), model.unseen.astype(np.float32), model.end.astype(np.float32)
    total, kinds, texts = corpus.tokens, corpus.kinds, corpus.texts
    # input columns keep numbers instead of names, so that none can clash
    frame = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    frame = frame.withColumn("key", F.unhex(F.md5("text")))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", STEP):
                h, first = tokens(part.column("text"))
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                far = sent.value[0].find(h) < 0
                pair = np.unique(np.stack([owner[far].astype(U64), h[far]]), axis=1)
                off = np.searchsorted(pair[0], np.arange(part.num_rows + 1).astype(U64))
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(pair[1].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("key"), lists], ["key", "words"])

    wanted = frame.select("key", "text").mapInArrow(asked, "key binary, words array<long>").where(F.size("words") > 0)
    wanted = wanted.groupBy("key").agg(F.first("words").alias("words"))  # equal texts ask once
    found = wanted.select("key", F.explode("words").alias("word")).join(model.words, "word").groupBy("key").agg(
        F.collect_list(F.struct("word", "n", *columns)).alias("found"))
    schema = frame.drop("text", "key").withColumns({c: F.lit(0).cast(t) for c, t in zip(
        new, ("long", "long", "long", "double", "double"))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (vectors, counts) = sent.value
        for b in batches:
            for part in slices(b, "text", STEP):
                h, first = tokens(part.column("text"))
                place, begin = with_ends(first)
                owner = np.repeat(np.arange(part.num_rows).astype(U64), np.diff(first))
                at = table.find(h)
                emit, n = np.tile(unseen, (len(h), 1)), np.zeros(len(h), dtype=np.int64)
                near = at >= 0
                emit[near], n[near] = vectors[at[near]], counts[at[near]]
                got = part.column("found")
                rows = got.flatten()
                if len(rows):
                    whose = np.repeat(np.arange(part.num_rows).astype(U64), pa.compute.fill_null(got.value_lengths(), 0).to_numpy())
                    key = rows.field(0).to_numpy().view(U64) ^ mix(whose, 5)
                    order = np.argsort(key)
                    key = key[order]
                    mine = h[~near] ^ mix(owner[~near], 5)
                    k = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                    hit = key[k] == mine
                    here = np.flatnonzero(~near)[hit]
                    k = order[k[hit]]
                    n[here] = rows.field(1).to_numpy()[k]
                    emit[here] = np.stack([rows.field(2 + i).to_numpy()[k] for i in range(states)], axis=1)
                full = np.tile(end, (begin[-1], 1))
                full[place] = emit
                seen = np.full(begin[-1], texts, dtype=np.int64)
                seen[place] = n
                log = log_likelihood(*scaled(full), begin, hidden) / math.log(10)
                base = np.add.reduceat(np.log10(base_probability(seen, total, kinds)), begin[:-1])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in schema.names[:len(keep)]), pa.array(np.diff(begin)),
                     pa.array(np.add.reduceat((seen > 0).astype(np.int64), begin[:-1])),
                     pa.array(np.full(part.num_rows, total, dtype=np.int64)), pa.array(base), pa.array(log)], schema.names)

    done = frame.join(found, "key", "left").mapInArrow(run, schema)
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *new)
