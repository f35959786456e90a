"""Quality classifier by co-training of two views.

View one sees the text's content (character classes, repetition, hashed
words); view two sees the page's metadata (source, language, size, layout of
its lines).  Each view is a logistic regression.  In every round a view's
confident predictions for unlabelled documents become pseudo-labels for the
other view; both are fitted again, and their scores are calibrated on labelled
documents that no fit has seen.  The final score combines the calibrated
views as independent evidence and is computed for every document.

Fits are Newton steps: every task sums its gradient and curvature over its
rows, Spark adds them up, and only those sums (their size depends on the
number of features) reach the driver.  All labelled and all confidently
pseudo-labelled documents take part.

Rows: a null text is empty; null source, language or size are values of their
own; labels that are null are left out and several labels of a document are
averaged (a tie counts as good); without labels of both kinds every score is
the share of good ones, or 1 without any label, so nothing is rejected for
lack of knowledge; repeated rows are scored alike; an empty table gives an
empty result; other columns pass through, columns named like an output are
replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, drop_saved, mix, saved, slices, span_hashes, utf8, word_spans

WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 64, 32, 16
ROUNDS, FIRST_STEPS, STEPS = 3, 6, 2
#: Calibrated probability from which a view's prediction becomes a pseudo-label,
#: unless the taught view gives that label less than ``DISSENT`` (a view cannot
#: teach what it cannot see); the weight of such a label, and the ridge penalty.
CONFIDENT, DISSENT, PSEUDO_WEIGHT, RIDGE = 0.99, 0.3, 0.5, 1.0
#: One labelled document in so many calibrates and is not fitted.
HOLD = 5
BINS, REACH = 200, 20.0
THRESHOLD = 0.5
STEP = 3 << 20


def _classes() -> np.ndarray:
    """Class of each byte: 0 other letters, 1 upper case, 2 digit, 3 blank,
    4 sentence mark, 5 other ASCII sign, 6 beyond ASCII."""
    c = np.zeros(256, dtype=np.uint8)
    for b in range(128):
        ch = chr(b)
        c[b] = (1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch.isspace() or b < 32
                else 4 if ch in ".,;:?'\"()-" else 0 if ch.isalpha() else 5)
    c[128:] = 6
    return c


_CLASS = _classes()
N_TEXT = 7 + 9 + WORD_BUCKETS
N_META = 9 + SOURCE_BUCKETS + LANG_BUCKETS
N_ALL = N_TEXT + N_META


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int32 if values.dtype == bool else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _distinct(h: np.ndarray, who: np.ndarray, rows: int) -> np.ndarray:
    """Distinct words of each text."""
    key = h ^ mix(who.astype(U64), 9)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount(who[order[new]], minlength=rows)


def _hot(values: list, buckets: int) -> np.ndarray:
    at = [0 if v is None else 1 + zlib.crc32(str(v).encode()) % (buckets - 1) for v in values]
    out = np.zeros((len(values), buckets))
    out[np.arange(len(at)), at] = 1
    return out


def features(text: pa.Array, source: list, lang: list, n_chars: list) -> np.ndarray:
    """float32 [rows, N_ALL]: content features, then metadata features."""
    buf, off = utf8(text)
    rows = len(off) - 1
    size = np.maximum(np.diff(off), 1)
    kind = _CLASS[buf]
    share = np.column_stack([_sums(kind == i, off) for i in range(7)]) / size[:, None]
    starts, ends, first = word_spans(buf, off)
    n = np.diff(first)
    words = np.maximum(n, 1)
    h = span_hashes(buf, starts, ends)
    who = np.repeat(np.arange(rows), n)
    upper = np.concatenate([[0], np.cumsum(kind == 1, dtype=np.int32)])
    sign = np.concatenate([[0], np.cumsum(kind == 5, dtype=np.int32)])
    width = ends - starts
    caps = (upper[ends] - upper[starts]) * 2 >= width
    signs = sign[ends] - sign[starts]
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (who[1:] == who[:-1])
    kinds = _distinct(h, who, rows)
    content = np.column_stack([
        share,
        _sums(width, first) / words / 10, _sums(caps, first) / words, _sums(signs > 0, first) / words,
        _sums(signs == width, first) / words, _sums(same, first) / words, kinds / words,
        np.log1p(n) / 8, kinds / np.sqrt(words) / 10, n == 0,
        np.sqrt(np.bincount(who * WORD_BUCKETS + (h & U64(WORD_BUCKETS - 1)).astype(np.int64),
                            minlength=rows * WORD_BUCKETS).reshape(rows, WORD_BUCKETS) / words[:, None])])
    nl = np.flatnonzero(buf == 10)
    lines = np.diff(np.searchsorted(nl, off)) + 1
    line_of = np.searchsorted(nl, starts) + who  # a line of its own for each text and line break
    per_line = np.bincount(line_of, minlength=int(len(nl) + rows)) if len(starts) else np.zeros(len(nl) + rows)
    line_owner = np.repeat(np.arange(rows), lines)
    line_first = np.searchsorted(line_owner, np.arange(rows + 1))
    longest = np.maximum.reduceat(per_line, line_first[:-1]) if rows else np.zeros(0)
    chars = np.array([np.nan if c is None else c for c in n_chars], dtype=np.float64)
    layout = np.column_stack([
        np.log1p(lines) / 5, np.log1p(n / lines) / 5, np.log1p(longest) / 7,
        _sums(per_line < 5, line_first) / lines, _sums(per_line == 0, line_first) / lines,
        np.sqrt(np.maximum(_sums(per_line.astype(np.float64)**2, line_first) / lines - (n / lines)**2, 0)) / 100,
        np.isnan(chars), np.log1p(np.maximum(np.nan_to_num(chars), 0)) / 10,
        np.minimum(np.log1p(size) / 10, 2)])
    return np.hstack([content, layout, _hot(source, SOURCE_BUCKETS), _hot(lang, LANG_BUCKETS)]).astype(np.float32)


@dataclass
class View:
    weight: np.ndarray                      # [features + 1], the last is the intercept
    slope: float = 1.0                      # calibration: logit = slope * raw + shift
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight[:-1] + self.weight[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -REACH, REACH)


@dataclass
class Model:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_ALL))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_ALL))
    views: list[View] = field(default_factory=list)
    prior: float = 1.0

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return [z[:, :N_TEXT], z[:, N_TEXT:]]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), N_ALL).astype(np.float64)


def _total(table: DataFrame, kernel, size: int) -> np.ndarray:
    """Sum of ``kernel(x, label, fold)`` (vectors of ``size``) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += kernel(_matrix(b.column("x")), b.column("label").to_numpy(zero_copy_only=False),
                                b.column("fold").to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "v"])

    out = np.zeros(size)
    rows = table.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out[rows["at"].to_numpy()] = rows["v"].to_numpy()
    return out


def _targets(model: Model, parts: list[np.ndarray], label, fold, exchange: bool):
    """For each view: its target (0 to 1) and weight of every row."""
    known = ~np.isnan(label)
    out = []
    for i in range(2):
        y, w = np.where(known, label, 0.0), (known & (fold != 0)).astype(np.float64)
        if exchange:
            told, own = (sigmoid(model.views[j].logit(parts[j])) for j in (1 - i, i))
            sure = ~known & (((told >= CONFIDENT) & (own > DISSENT)) | ((told <= 1 - CONFIDENT) & (own < 1 - DISSENT)))
            y, w = np.where(sure, told > 0.5, y), np.where(sure, PSEUDO_WEIGHT, w)
        out.append((y, w))
    return out


def _newton(table: DataFrame, model: Model, teacher: Model, exchange: bool) -> None:
    sizes = [N_TEXT + 1, N_META + 1]

    def kernel(x, label, fold):
        parts = model.split(x)
        sums = []
        for (y, w), z, view in zip(_targets(teacher, parts, label, fold, exchange), parts, model.views):
            use = w > 0
            z1 = np.column_stack([z[use], np.ones(int(use.sum()))])
            p = sigmoid(z1 @ view.weight)
            sums += [z1.T @ (w[use] * (y[use] - p)), ((z1 * (w[use] * p * (1 - p))[:, None]).T @ z1).ravel()]
        return np.concatenate(sums)

    total = _total(table, kernel, sum(s + s * s for s in sizes))
    at = 0
    for view, s in zip(model.views, sizes):
        grad, curve = total[at:at + s], total[at + s:at + s + s * s].reshape(s, s)
        at += s + s * s
        ridge = np.full(s, RIDGE)
        ridge[-1] = 1e-6
        step = np.linalg.solve(curve + np.diag(ridge + 1e-9), grad - ridge * view.weight)
        view.weight = view.weight + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))


def _calibrate(table: DataFrame, model: Model) -> None:
    """Platt scaling of each view on the held-out labelled rows, from a
    histogram of its raw scores by label."""

    def kernel(x, label, fold):
        use = ~np.isnan(label) & (fold == 0)
        sums = []
        for z, view in zip(model.split(x[use]), model.views):
            b = np.clip((view.raw(z) + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(np.int64)
            y = label[use]
            sums += [np.bincount(b, weights=y, minlength=BINS), np.bincount(b, weights=1 - y, minlength=BINS)]
        return np.concatenate(sums)

    total = _total(table, kernel, 4 * BINS).reshape(2, 2, BINS)
    mid = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    for view, (good, bad) in zip(model.views, total):
        if good.sum() < 5 or bad.sum() < 5:
            view.slope, view.shift = 1.0, 0.0
            continue
        n = good + bad
        # Platt's targets keep separable data finite
        hi, lo = (good.sum() + 1) / (good.sum() + 2), 1 / (bad.sum() + 2)
        y = (good * hi + bad * lo) / np.maximum(n, 1)
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = sigmoid(w[0] * mid + w[1])
            d = n * p * (1 - p)
            g = np.array([(n * (y - p) * mid).sum() - 1e-3 * (w[0] - 1), (n * (y - p)).sum()])
            c = np.array([[(d * mid * mid).sum() + 1e-3, (d * mid).sum()], [(d * mid).sum(), d.sum() + 1e-6]])
            w = w + np.clip(np.linalg.solve(c, g), -2, 2)
        view.slope, view.shift = float(max(w[0], 0.0)), float(w[1])


def _feature_pass(docs: DataFrame, text: str, source: str, lang: str, n_chars: str):
    """Columns as features() takes them; missing ones count as null."""
    have = set(docs.columns)
    return {"text": F.coalesce(F.col(text), F.lit("")),
            "source": F.col(source).cast("string") if source in have else F.lit(None).cast("string"),
            "lang": F.col(lang).cast("string") if lang in have else F.lit(None).cast("string"),
            "n_chars": F.col(n_chars).cast("double") if n_chars in have else F.lit(None).cast("double")}


def _of(part: pa.RecordBatch) -> np.ndarray:
    return features(part.column("__text"), *(part.column(f"__{c}").to_pylist() for c in ("source", "lang", "n_chars")))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> Model:
    """Co-train on all documents; ``labels`` (key, label 0 or 1) covers some."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        (F.avg(label) >= 0.5).cast("double").alias("label"))
    cols = _feature_pass(docs, text, source, lang, n_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "__text", STEP):
                x = _of(part)
                off = pa.array(np.arange(0, x.size + 1, N_ALL, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(off, pa.array(x.ravel()))],
                                                 ["id", "x"])

    frame = docs.select(F.col(key).alias("id"), *(c.alias(f"__{n}") for n, c in cols.items()))
    schema = frame.select("id", F.lit(None).cast("array<float>").alias("x")).schema
    fold = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(HOLD)).cast("int").alias("fold")
    table = saved(frame.mapInArrow(run, schema).join(known, "id", "left").select("x", F.coalesce(
        "label", F.lit(float("nan"))).alias("label"), fold), "quality-features")
    tally = {r["label"]: r["n"] for r in table.where(~F.isnan("label")).groupBy("label").agg(
        F.count("*").alias("n")).collect()}
    good, bad = tally.get(1.0, 0), tally.get(0.0, 0)
    model = Model(prior=good / (good + bad) if good + bad else 1.0)
    if not good or not bad:
        drop_saved(table)
        return model

    def moments(x, _label, _fold):
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    total = _total(table, moments, 1 + 2 * N_ALL)
    n, s, q = total[0], total[1:N_ALL + 1], total[N_ALL + 1:]
    model.mean = s / n
    model.scale = np.sqrt(np.maximum(q / n - model.mean**2, 1e-6))
    model.views = [View(np.zeros(N_TEXT + 1)), View(np.zeros(N_META + 1))]
    for r in range(ROUNDS + 1):
        teacher = Model(model.mean, model.scale, [View(v.weight.copy(), v.slope, v.shift) for v in model.views])
        for _ in range(STEPS if r else FIRST_STEPS):
            _newton(table, model, teacher, exchange=r > 0)
        _calibrate(table, model)
    drop_saved(table)
    return model


def classify(docs: DataFrame, model: Model, text: str = "text", source: str = "source", lang: str = "lang",
             n_chars: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """Add text_score, meta_score, score (0 to 1) and keep to every document."""
    new = ["text_score", "meta_score", "score", "keep"]
    rest = [c for c in docs.columns if c not in new]
    frame = docs.select(*rest, *(c.alias(f"__{n}") for n, c in _feature_pass(docs, text, source, lang, n_chars).items()))
    schema = docs.select(*rest, *(F.lit(0.0).alias(c) for c in new[:3]), F.lit(True).alias("keep")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "__text", STEP):
                rows = part.num_rows
                if model.views:
                    logit = [v.logit(z) for v, z in zip(model.views, model.split(_of(part).astype(np.float64)))]
                    base = np.log(model.prior / (1 - model.prior))
                    scores = [sigmoid(logit[0]), sigmoid(logit[1]), sigmoid(logit[0] + logit[1] - base)]
                else:
                    scores = [np.full(rows, model.prior)] * 3
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), *(pa.array(s) for s in scores), pa.array(scores[2] >= threshold)],
                    [*rest, *new])

    return frame.mapInArrow(run, schema)
