"""A quality score by pairwise ranking: Bradley-Terry with features of whole texts."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import saved, slices, string_buffers, table, texts

#: Labelled rows of a task in a pass of the training, about; Newton steps at most; and the loss that a last one could still save.
ROWS, STEPS, RIDGE, ENOUGH = 20_000, 25, 1e-3, 1e-7
#: Widths of the bins in which a row's opponents are summed by score: for slopes, for what the Hessian's mixed part needs, and for the cut.
FINE, COARSE, CUT = 1 / 32, 1 / 4, 1 / 1024
THRESHOLD = 0.3

#: Byte classes whose shares of a text are features.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" ", "line": b"\n\r", "end": b".", "comma": b",;:", "bang": b"!?", "pipe": b"|", "sign": b"#$%&*@^~=+<>\\_", "quote": b"\"'()[]{}-/", "control": bytes(range(9)) + bytes(range(14, 32)) + b"\t\x0b\x0c\x7f", "high": bytes(range(128, 256))}
NAMES = [*CLASSES, "log_bytes", "log_words", "word_length", "word_length_spread", "same_next", "same_next_but_one", "distinct", "top_word", "same_pair", "no_vowel", "case_turns", "sign_words", "upper_words", "bang_words", "pipe_words"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text in the buffer. Shares are of bytes or words; a text without any has zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    column = {name: i for i, name in enumerate(NAMES)}
    lut = np.full(256, column["control"], np.uint8)
    for name, members in CLASSES.items():
        lut[list(members)] = column[name]
    h, start, at = W.words(data, offsets)
    lengths = np.diff(offsets)
    kinds = lut[data]
    vowel = np.zeros(256, np.uint8)
    vowel[list(b"aeiouyAEIOUY")] = 1
    vowel[128:] = 1  # a letter beyond ASCII counts as one
    upper, lower = kinds == column["upper"], kinds == column["lower"]
    turns = np.diff(np.searchsorted(np.flatnonzero(lower[:-1] & upper[1:]) + 1, offsets))
    # up to the next word there is white space alone, which is in none of these classes
    in_word = {name: np.add.reduceat(x, start, dtype=np.int64) if len(start) else start for name, x in (("vowel", vowel[data]), ("sign", kinds == column["sign"]), ("upper", upper), ("lower", lower), ("bang", kinds == column["bang"]), ("pipe", kinds == column["pipe"]), ("solid", ~W._SPACE[data]))}
    for i in range(n):
        a, b, size = offsets[i], offsets[i + 1], lengths[i]
        row = out[i]
        if size:
            row[: len(CLASSES)] = np.bincount(kinds[a:b], minlength=len(CLASSES))[: len(CLASSES)] / size
            row[column["case_turns"]] = turns[i] / size
        row[column["log_bytes"]] = np.log1p(size)
        w = h[at[i] : at[i + 1]]
        m = len(w)
        row[column["log_words"]] = np.log1p(m)
        if m:
            of = slice(at[i], at[i + 1])
            solid = in_word["solid"][of]
            _, counts = np.unique(w, return_counts=True)
            row[column["word_length"]], row[column["word_length_spread"]] = np.log1p(solid.mean()), np.log1p(solid.std())
            row[column["distinct"]], row[column["top_word"]] = len(counts) / m, counts.max() / m
            row[column["no_vowel"]] = (in_word["vowel"][of] == 0).mean()
            row[column["sign_words"]], row[column["bang_words"]], row[column["pipe_words"]] = ((in_word[name][of] > 0).mean() for name in ("sign", "bang", "pipe"))
            row[column["upper_words"]] = ((in_word["upper"][of] > 1) & (in_word["lower"][of] == 0)).mean()
            row[column["same_next"]] = (w[1:] == w[:-1]).sum() / m
            row[column["same_next_but_one"]] = (w[2:] == w[:-2]).sum() / m
            pairs = w[1:] * W._BASE + w[:-1]
            row[column["same_pair"]] = 1 - len(np.unique(pairs)) / max(1, m - 1) if m > 1 else 0
    shares = [i for name, i in column.items() if not name.startswith(("log", "word"))]
    out[:, shares] = np.sqrt(np.maximum(out[:, shares], 0))
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """The features and their squares."""
    return np.concatenate([x, x * x], 1)


@dataclass(frozen=True)
class Model:
    """score = sigmoid(scale (w . z - cut) + logit(threshold)), z being the standardised features: threshold or more exactly where w . z is cut or more."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float
    threshold: float = THRESHOLD

    def worth(self, x: np.ndarray) -> np.ndarray:
        return ((expand(x) - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.log(self.threshold / (1 - self.threshold)) + self.scale * (self.worth(x) - self.cut)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tally(s: np.ndarray, width: float, *of: np.ndarray):
    """(bins, counts, sums, least, greatest score) of the scores in bins of a width, and the sums of other arrays' rows."""
    order = np.argsort(s, kind="stable")
    s = s[order]
    bins = np.floor(s / width).astype(np.int64)
    at = np.flatnonzero(np.diff(bins, prepend=bins[:1] - 1))
    if not len(s):
        return bins, bins, s, s, s, *(x[:0] for x in of)
    return bins[at], np.diff(np.append(at, len(s))), np.add.reduceat(s, at), np.minimum.reduceat(s, at), np.maximum.reduceat(s, at), *(np.add.reduceat(x[order], at) for x in of)


def merged(tallies: list):
    """tally() of all rows from those of parts."""
    parts = list(zip(*tallies, strict=True))
    bins, at = np.unique(np.concatenate(parts[0]), return_inverse=True)
    out = [bins]
    for k, x in enumerate(map(np.concatenate, parts[1:])):
        total = np.full((len(bins), *x.shape[1:]), {2: np.inf, 3: -np.inf}.get(k, 0), x.dtype)
        {2: np.minimum, 3: np.maximum}.get(k, np.add).at(total, at, x)
        out.append(total)
    return out


def learn(each: Callable[[Callable], list], threshold: float = THRESHOLD) -> Model:
    """Bradley-Terry: P(a good text beats a bad one) = sigmoid(w . (z_good - z_bad)), by Newton steps on the mean logistic loss of every pair of a good and a bad row.

    ``each(f)`` gives f(x, y) of every part of the labelled rows, features and labels, in an order that stays. A row meets all rows of the other
    label by their scores: these are summed in bins of width FINE and stand at their bin's mean, which changes a
    slope by about 1e-5 of itself; sums over rows are whole. So a step takes two passes, and sums alone come to the driver.

    The cut is a quantile of the scores: the one below which the share of bad rows lies that the labels have, taken
    within the gap between the classes where there is one; mistakes are counted over all rows, at the edges of bins of width CUT. With a single label, or none, all scores
    are 1 for label 1 and 0.5 without rows.
    """
    width = 2 * len(NAMES)

    def moments(x, y):
        e = expand(x)
        return len(y), int((y == 1).sum()), e.mean(0), ((e - e.mean(0)) ** 2).sum(0)

    n, n_good, mean, square = 0, 0, np.zeros(width), np.zeros(width)
    for m, good, middle, around in each(moments):
        square = square + around + (middle - mean) ** 2 * n * m / (n + m)
        mean = mean + (middle - mean) * m / (n + m)
        n, n_good = n + m, n_good + good
    n_bad = n - n_good
    spread = np.sqrt(square / n) if n else np.ones(width)
    spread = np.where(spread < 1e-9, 1, spread)
    w = np.zeros(width)
    if not n_good or not n_bad:
        return Model(mean, spread, w, -1.0 if n_good else 1.0 if n_bad else 0.0, 50.0 if n else 0.0, threshold)
    pairs = float(n_good) * n_bad

    def tallied(w):
        def run(x, y):
            z = (expand(x) - mean) / spread
            s = z @ w
            return [(tally(s[y == v], FINE), tally(s[y == v], COARSE, z[y == v])) for v in (1, 0)]

        got = each(run)
        return [[merged([part[v][k] for part in got]) for k in (0, 1)] for v in (0, 1)]

    def nodes(t):
        return t[2] / t[1], t[1].astype(float)

    def loss(w, good, bad):
        (g, n), (b, m) = nodes(good[0]), nodes(bad[0])
        return sum(k * (np.logaddexp(0, b - at) @ m) for at, k in zip(g, n, strict=True)) / pairs + RIDGE / 2 * w @ w

    def slopes(w, good, bad):
        others = nodes(bad[0]), nodes(good[0])

        def run(x, y):
            z = (expand(x) - mean) / spread
            gradient, hessian = np.zeros(width), np.zeros((width, width))
            for v, sign, (at, count) in ((1, -1, others[0]), (0, 1, others[1])):
                rows = z[y == v]
                for low in range(0, len(rows), 1024):
                    part = rows[low : low + 1024]
                    p = sigmoid(sign * ((part @ w)[:, None] - at))  # that the pair's bad row wins
                    gradient += sign * part.T @ (p @ count)
                    hessian += (part * ((p * (1 - p)) @ count)[:, None]).T @ part
            return gradient, hessian

        got = each(run)
        (g, *_, of_good), (b, *_, of_bad) = good[1], bad[1]
        p = sigmoid((b - g[:, None]) * COARSE)
        mixed = of_good.T @ (p * (1 - p)) @ of_bad
        hessian = (sum(h for _, h in got) - mixed - mixed.T) / pairs + RIDGE * np.eye(width)
        return sum(g for g, _ in got) / pairs + RIDGE * w, hessian

    seen = tallied(w)
    now = loss(w, *seen)
    for _ in range(STEPS):
        gradient, hessian = slopes(w, *seen)
        values, vectors = np.linalg.eigh(hessian)
        step = vectors @ ((vectors.T @ gradient) / np.maximum(values, RIDGE / 2))
        if gradient @ step / 2 < ENOUGH:
            break
        for _ in range(STEPS):
            there = tallied(w - step)
            then = loss(w - step, *there)
            if then < now:
                break
            step = step / 2
        else:
            break
        w, seen, now = w - step, there, then

    def worths(x, y):
        s = ((expand(x) - mean) / spread) @ w
        return tally(s, CUT, np.stack([y == 1, y == 0], 1).astype(np.int64))

    bins, count, total, least, greatest, labels = merged(each(worths))
    below = np.cumsum(count)[:-1]
    wrong = np.cumsum(labels[:, 0])[:-1] + (n_bad - np.cumsum(labels[:, 1])[:-1])  # mistakes if all up to a bin are called bad
    share = n_bad / n
    near = np.flatnonzero((below >= max(1, int(n * share * 0.5))) & (below < min(n - 1, int(n * share * 1.5) + 2)))
    if len(near):
        k = near[np.argmin(wrong[near])]
    else:
        k = np.argmin(np.abs(below - n_bad)) if len(below) else None
    cut = least[0] if k is None else (greatest[k] + least[k + 1]) / 2
    middles = [(total / count)[np.searchsorted(np.cumsum(labels[:, v]), labels[:, v].sum() / 2)] for v in (0, 1)]
    return Model(mean, spread, w, float(cut), float(8 / max(middles[0] - middles[1], 1e-9)), threshold)


def fit(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> Model:
    """learn() from rows in memory."""
    return learn(lambda f: [f(x, y)] if len(x) else [], threshold)


def crc(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def held_out(key: Column) -> Column:
    return crc(key) % 5 == 0


def _feature_rows(df: DataFrame, extra: list[str]) -> DataFrame:
    """(*extra, x): df's column __text as features."""
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1):
                x = features(*string_buffers(batch.column(batch.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(list(x), pa.list_(pa.float64()))], [*extra, "x"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in extra)
    return df.select(*extra, "__text").mapInArrow(run, f"{kinds}, x array<double>")


def passes(rows: DataFrame) -> Callable[[Callable], list]:
    """each(f) for learn(): f(x, y) of every partition of rows(y, x), in the partitions' order."""
    import pyarrow as pa

    def each(f):
        def run(batches):
            from pyspark import TaskContext

            got = [(b.column(0).to_numpy(), b.column(1).flatten().to_numpy()) for b in batches if b.num_rows]
            if got:
                y, x = map(np.concatenate, zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(f(x.reshape(len(y), -1), y))], pa.binary())], ["part", "sums"])

        got = rows.mapInArrow(run, "part int, sums binary").collect()
        return [pickle.loads(r["sums"]) for r in sorted(got, key=lambda r: r["part"])]

    return each


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, threshold: float = THRESHOLD) -> Model:
    """The model from all labelled rows that aren't held out.

    Rows without a label or key don't count; a key's labels all count, those that are equal once. Of rows that repeat a key the one with the least
    features counts. Features are made before labels are joined to them, so no text is moved; they are written once and read by each pass.
    """
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__y")).where("__key is not null and __y in (0, 1)")
    known = known.where(~held_out(F.col("__key"))).distinct()
    parts = max(1, -(-known.count() // ROWS))
    rows = _feature_rows(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__key").isNotNull() & ~held_out(F.col("__key"))), ["__key"])
    rows = rows.join(known, "__key").groupBy("__key", "__y").agg(F.min("x").alias("x"))
    rows = saved(rows.repartition(parts, "__key").sortWithinPartitions("__key", "__y").select("__y", "x"))
    return learn(passes(rows), threshold)


def score(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """docs with ``score`` (double, 0 to 1), from whole texts alone. Null texts count as empty; a column named score is replaced; order and repeats don't matter."""
    import pyarrow as pa

    kept = [c for c in docs.columns if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(asdict(model))  # arrays and numbers alone, as broadcasts name classes and don't carry them

    def run(batches):
        held = Model(**sent.value)
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1):
                s = held.score(features(*string_buffers(batch.column(batch.num_columns - 1))))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(s)], [*kept, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, score double")


def query(spark, sf_dir):
    """op3: every document's score by the model of labels.quality: doc_id, held_out, score, predicted."""
    docs = texts(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    scored = score(docs.select("doc_id", "text"), model, "text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs, sf_dir, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score is threshold or more; the model is learned from the table of documents and its labels."""
    model = train(texts(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    return score(docs, model, "text").where(F.col("score") >= threshold).select(*docs.columns)
