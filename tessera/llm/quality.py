"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k | x) = sigmoid(threshold_k - w.x): one weight vector ``w`` over
hashed features is shared by all grades, thresholds are ordered.  A text's
features are

* each distinct word (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, lower-cased) and
  each distinct beginning of 4 and of 5 bytes of a longer word: 1,
* each token shape: its share of the blank-separated tokens.  A shape is made
  of the token's non-alphanumeric bytes, whether it has capitals only, and
  digits,
* the shares of repeated words, of tokens with three or more other signs and
  of tokens in capitals.

Training reads about ``train_rows`` rated rows, drawn by a hash of the id and
limited to that number; their features are made on the executors and only
these come to the driver, where the fit runs (features in fewer than
``least_rows`` training rows have no weight).  The number of training rows is a
parameter and does not follow the input.  Scoring reads every text where it is
scanned.

Selection: tail probability P(grade >= ``at_least``) of ``tail`` or more.
Grades are 0 to ``n_grades`` - 1.  Ratings of one id are joined to their lowest
grade; null ids, texts or grades, and grades outside that range, do not train.  A null or wordless text has no features: its grades follow the
thresholds alone, and it is not selected.  Rows are treated one by one; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, SPACED, constants, mix, slices, utf8, words
from .tables import ready

TRAIN_ROWS, LEAST_ROWS, DIM = 6000, 4, 1 << 20
STEPS, RATE, RIDGE = 200, 0.1, 1e-4
TAIL = 0.5

_PUNCT = constants(256, 61)
for _a, _z in ((48, 57), (65, 90), (97, 122), (128, 255), (32, 32), (9, 13)):
    _PUNCT[_a:_z + 1] = 0


def features(data: np.ndarray, off: np.ndarray):
    """Yield (feature ids, values) of each row."""
    h, woff, ws, we = words(data, off, ALNUM, spans=True)
    starts = []
    for n in (4, 5):
        long_ = np.flatnonzero(we - ws > n)
        part = np.full(len(long_), n, np.uint64)
        for i in range(n):
            part = mix(part) + ALNUM[data[ws[long_] + i]]
        starts.append((mix(part), np.searchsorted(long_, woff)))
    _, toff, ts, te = words(data, off, SPACED, spans=True)

    def per_token(flag, kind):
        c = np.zeros(len(data) + 1, kind)
        np.cumsum(flag, out=c[1:], dtype=kind)
        return c[te] - c[ts]

    punct = per_token(_PUNCT[data], np.uint64)
    upper = per_token((data >= 65) & (data <= 90), np.int32)
    lower = per_token((data >= 97) & (data <= 122), np.int32)
    digit = per_token((data >= 48) & (data <= 57), np.int32)
    signs = per_token(_PUNCT[data] != 0, np.int32) > 2
    caps = (upper > 1) & (lower == 0)
    shape = mix(punct + (caps.astype(np.uint64) << np.uint64(1)) + (digit > 0).astype(np.uint64)
                + np.uint64(0x51AFE))
    for r, (a, z, ta, tz) in enumerate(zip(woff[:-1].tolist(), woff[1:].tolist(), toff[:-1].tolist(), toff[1:].tolist())):
        if ta == tz:
            yield np.zeros(0, np.int32), np.zeros(0, np.float32)
            continue
        own = np.unique(h[a:z])
        forms, n = np.unique(shape[ta:tz], return_counts=True)
        begin = [np.unique(b[o[r]:o[r + 1]]) for b, o in starts]
        ids = np.concatenate([own, *begin, forms, np.arange(1, 4, dtype=np.uint64)]) % np.uint64(DIM)
        shares = [*(n / (tz - ta)), 1 - len(own) / max(z - a, 1), signs[ta:tz].mean(), caps[ta:tz].mean()]
        yield (ids.astype(np.int32),
               np.concatenate([np.ones(len(ids) - len(shares)), 5.0 * np.array(shares)]).astype(np.float32))


class Ordinal:
    """Cumulative-link model over hashed features."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int,
            least_rows: int = LEAST_ROWS) -> "Ordinal":
        ids = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int32)
        seen = np.bincount(ids, minlength=DIM)
        used = np.flatnonzero(seen >= least_rows)
        keep = seen[ids] >= least_rows
        col = np.searchsorted(used, ids[keep]).astype(np.int32)
        vals = np.concatenate([r[1] for r in rows])[keep] if rows else np.zeros(0, np.float32)
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])[keep]
        del ids, keep
        share = np.cumsum(np.bincount(grades, minlength=n_grades) + 1.0)[:-1] / (len(grades) + n_grades)
        start = np.log(share / (1 - share))
        first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
        p = np.concatenate([np.zeros(len(used)), [first], gaps])
        m, v = np.zeros_like(p), np.zeros_like(p)
        k = len(used)
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        for t in range(1, STEPS + 1):
            theta = np.concatenate([[-np.inf], p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1:]))]), [np.inf]])
            s = np.bincount(row, weights=p[:k][col] * vals, minlength=len(rows))
            hi, lo = theta[grades + 1], theta[grades]
            fh, fl = np.where(np.isinf(hi), 1.0, sig(hi - s)), np.where(np.isinf(lo), 0.0, sig(lo - s))
            pr = np.maximum(fh - fl, 1e-12)
            dh, dl = fh * (1 - fh) / pr, fl * (1 - fl) / pr
            ds = (dh - dl) / max(len(rows), 1)             # of the mean negative log-likelihood
            dt = np.zeros(n_grades + 1)
            np.add.at(dt, grades + 1, -dh)
            np.add.at(dt, grades, dl)
            dt = dt[1:-1] / max(len(rows), 1)
            tail = np.cumsum(dt[::-1])[::-1]
            g = np.concatenate([np.bincount(col, weights=ds[row] * vals, minlength=k) + RIDGE * p[:k],
                                [tail[0]], tail[1:] * np.exp(p[k + 1:])])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights = np.zeros(DIM, np.float32)
        weights[used] = p[:k]
        return cls(weights, p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1:]))]))

    def grade_probabilities(self, rows) -> np.ndarray:
        s = np.array([float(self.weights[i] @ v) if len(i) else 0.0 for i, v in rows])
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - s[:, None], -30, 30)))
        below = np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], axis=1)
        return np.diff(below, axis=1)


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
          rating_id: str = "doc_id", grade_col: str = "grade", train_rows: int = TRAIN_ROWS) -> Ordinal:
    """Fit on at most ``train_rows`` rated texts."""
    ready(docs.sparkSession)
    rated = (ratings.select(F.col(rating_id).alias("id"), F.col(grade_col).cast("int").alias("grade"))
             .where(F.col("id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("id").agg(F.min("grade").alias("grade")))
    total = rated.count()
    cut = F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 20)) < int(min(1.0, train_rows / max(total, 1)) * (1 << 20)) + 1
    sample = rated.where(cut).limit(train_rows)            # its size is bounded by the limit
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    held = texts.join(F.broadcast(sample), "id").select("id", "grade", "text")
    id_type = held.schema["id"].dataType.simpleString()

    def make(batches):
        for b in slices(batches, 2):
            rows = list(features(*utf8(b.column(2))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r[0].tobytes() for r in rows], pa.binary()),
                 pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["id", "grade", "ids", "vals"])

    got = sorted(held.mapInArrow(make, f"id {id_type}, grade int, ids binary, vals binary").collect(), key=lambda r: r["id"])
    return Ordinal.fit([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["vals"], np.float32)) for r in got],
                       np.array([r["grade"] for r in got], np.int64), n_grades)


def score(docs: DataFrame, model: Ordinal, at_least: int, tail: float = TAIL, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability, selected."""
    ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def rate(batches):
        for b in slices(batches, 1):
            rows = list(features(*utf8(b.column(1))))
            p = held.value.grade_probabilities(rows)
            expected, top = p @ np.arange(p.shape[1]), p[:, at_least:].sum(axis=1)
            chosen = (top >= tail) & np.array([len(r[0]) > 0 for r in rows], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(expected, pa.float64()), pa.array(top, pa.float64()),
                                              pa.array(chosen, pa.bool_())],
                                             names=["doc_id", "expected_grade", "tail_probability", "selected"])

    return slim.mapInArrow(rate, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, expected_grade double, "
                                 "tail_probability double, selected boolean")
