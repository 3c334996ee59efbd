"""Document quality by co-training two views.

The text view sees what a text says and how (repetition, symbols, case,
word shapes); the metadata view sees what is known about the page (language,
source, length, line layout). Each view has its own logistic classifier,
fitted on labelled documents; over some rounds each labels all the unlabelled
documents that it is sure of, and the other learns from them: one pass
sums the gradient of their loss and a bound of its Hessian on Spark, for each label, and they
enter the fit with ``SHARE`` of the weight of the labelled rows of that label,
however many they are. Both are then calibrated on labelled rows they were not fitted on and
combined, and all documents are scored.

Fitting reads at most ``SAMPLE`` labelled documents outside the held-out
fold and all unlabelled ones; rows of equal features (copies) count once
there. Scoring covers every document.

Defined results: null, empty and blank texts, null lang, source or n_chars
have their own feature values and get a score; very long texts are read
whole; documents at just ``SURE`` count as sure, and equal ones alike; repeated rows get the same
score; without labels of both kinds every document scores the share of
label 1 (1.0 if there are none); an empty table gives an empty table;
columns other than the named ones are passed over or through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import arrow_batches, map_arrow, materialize, table
from faresight.llm.fitting import held_out, labelled_sample, logistic, sigmoid
from faresight.llm.words import SPACED, Words, utf8

SAMPLE = 20_000
ROUNDS = 4
SURE = 0.97               # a view's label counts from this probability on
SHARE = 0.5               # weight of all pseudo-labelled rows, of that of the labelled ones
STEP, UNIT = 32, 1024     # features and weights as whole numbers, so that sums are exact
THRESHOLD = 0.5
LANG_SLOTS, SOURCE_SLOTS = 8, 16
N_TEXT, N_META = 11, 6 + LANG_SLOTS + SOURCE_SLOTS

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:'?-()\""]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = ~(_LETTER | _DIGIT | _POINT | _SPACE)


def _per_text(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=c[1:])
    return (c[offs[1:]] - c[offs[:-1]]).astype(float)


def text_view(texts: pa.Array) -> np.ndarray:
    """Shares of a text's bytes and words, as log(1 + 100 x)."""
    raw, offs = utf8(texts)
    w = Words(texts, SPACED)
    h, n = w.hashes(), w.counts()
    words, size = np.maximum(n, 1.0), np.maximum(np.diff(offs), 1.0)
    text = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[1:] != text[:-1])
    last = raw[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    firstb = raw[w.start] if len(h) else np.zeros(0, np.uint8)
    bounds = w.first
    letters = np.maximum(_per_text(_LETTER[raw], offs), 1.0)
    shares = [
        _per_text(again, bounds) / words,
        1 - _per_text(new, bounds) / words,
        _per_text(_SYMBOL[last], bounds) / words,
        _per_text(_SYMBOL[last] & (w.end - w.start == 1), bounds) / words,
        _per_text(_SYMBOL[raw], offs) / size,
        _per_text(_UPPER[raw], offs) / letters,
        _per_text(_UPPER[firstb], bounds) / words,
        _per_text(_DIGIT[raw], offs) / size,
        _per_text(_POINT[raw], offs) / size,
        _per_text(_POINT[last], bounds) / words,
    ]
    return np.column_stack([*(np.log1p(100 * s) for s in shares), np.log1p(n)])


def metadata_view(lang: pa.Array, source: pa.Array, n_chars: pa.Array, texts: pa.Array) -> np.ndarray:
    """Language and source as hashed indicators, length and line layout."""
    raw, offs = utf8(texts)
    rows = len(texts)
    out = np.zeros((rows, N_META))
    chars = np.array([-1.0 if c is None else float(c) for c in n_chars.to_pylist()])
    lines = _per_text(raw == 10, offs) + 1
    blank = np.zeros(len(raw), bool)
    blank[1:] = (raw[1:] == 10) & (raw[:-1] == 10)
    out[:, 0] = np.log1p(np.maximum(chars, 0))
    out[:, 1] = chars < 0
    out[:, 2] = np.log1p(lines)
    out[:, 3] = np.log1p(np.diff(offs) / lines)
    out[:, 4] = np.log1p(100 * _per_text(blank, offs) / lines)
    out[:, 5] = np.diff(offs) == 0
    for column, at, slots in ((lang, 6, LANG_SLOTS), (source, 6 + LANG_SLOTS, SOURCE_SLOTS)):
        for i, v in enumerate(column.to_pylist()):
            if v is not None:
                out[i, at + zlib.crc32(str(v).encode()) % slots] = 1
    return out


class View:
    """A logistic classifier on features standardised by labelled rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        self.x, self.y = self.scaled(x), y
        self.b = logistic(self.x, y)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -10, 10)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.b[:-1] + self.b[-1]

    def learn(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Fit again with pseudo-labelled rows: of each label their number,
        gradient and bound of the Hessian."""
        g, h = np.zeros(len(self.b)), np.zeros((len(self.b), len(self.b)))
        for label, (n, own_g, own_h) in sums.items():
            if n:
                weight = SHARE * (self.y == label).sum() / n
                g, h = g + weight * own_g, h + weight * own_h
        self.b = logistic(self.x, self.y, more=(self.b, g, h))

    def sums(self, x: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the loss of rows with this label and the bound of its
        Hessian (weight 1/4 a row, so that a step never overshoots where rows are
        sure), in whole numbers of 1 / (STEP * UNIT) and 1 / (STEP * STEP * 4)."""
        z = self.scaled(x)
        p = sigmoid(z @ self.b[:-1] + self.b[-1])
        a = np.rint(np.column_stack([z, np.ones(len(z))]) * STEP)
        return a.T @ np.rint((p - label) * UNIT), a.T @ a


class CoTrained:
    """Two views, calibrated and combined."""

    def __init__(self, x: list[np.ndarray], y: np.ndarray, part: np.ndarray,
                 passes: Callable[[CoTrained], list[dict]] | None = None, rounds: int = ROUNDS):
        """x: both views of labelled rows; part: False for those kept for
        calibration; passes: a pass over all unlabelled rows, that gives what
        ``View.learn`` takes for each view."""
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 1.0
            return
        if len(np.unique(y[part])) < 2 or len(np.unique(y[~part])) < 2:
            part = np.ones(len(y), bool)
            rest = part
        else:
            rest = ~part
        self.views = [View(x[v][part], y[part]) for v in (0, 1)]

        def calibrate() -> list[np.ndarray]:
            return [self._platt(view.logit(x[v][rest]), y[rest]) for v, view in enumerate(self.views)]

        self.cal = calibrate()
        for _ in range(rounds if passes else 0):
            for view, sums in zip(self.views, passes(self)):
                view.learn(sums)
            self.cal = calibrate()
        z = np.column_stack([c[0] * view.logit(x[v][rest]) + c[1]
                             for v, (view, c) in enumerate(zip(self.views, self.cal))])
        self.both = logistic(z, y[rest], np.array([0.7, 0.3, 0.0]))
        for view in self.views:
            del view.x, view.y                     # not part of the model

    def sure(self, v: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that view v is sure of as label 0 and as label 1."""
        p = sigmoid(self.cal[v][0] * self.views[v].logit(x) + self.cal[v][1])
        return 1 - p >= SURE, p >= SURE

    @staticmethod
    def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
        return logistic(z[:, None], y, np.array([1.0, 0.0]))

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(text), self.constant)
        z = np.column_stack([c[0] * view.logit(x) + c[1]
                             for view, c, x in zip(self.views, self.cal, (text, meta))])
        return sigmoid(z @ self.both[:-1] + self.both[-1])


def _views(b: pa.RecordBatch, names: tuple[str, str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    at = b.schema.names
    text, lang, source, chars = (b.column(at.index(n)) for n in names)
    return text_view(text), metadata_view(lang, source, chars, text)


NAMES = ("text", "lang", "source", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality",
        names: tuple[str, str, str, str] = NAMES, sample: int = SAMPLE) -> CoTrained:
    """names: the columns of text, lang, source and length."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *(F.col(n).alias(k) for n, k in zip(names, NAMES)))
    ids = materialize(labelled_sample(labels, label, sample), "quality_ids")

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        x = np.column_stack(_views(b, NAMES))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.names.index("label")),
                                           pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = map_arrow(rows.join(F.broadcast(ids), "doc_id"), features,       # at most ``sample`` ids
                    "doc_id long, label int, x array<double>").toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    x = np.array(got["x"].tolist()).reshape(len(got), N_TEXT + N_META)
    y = got["label"].to_numpy(float)
    part = np.array([zlib.crc32(b"c%d" % i) % 3 > 0 for i in got["doc_id"]], bool)
    both = len(np.unique(y)) == 2
    return CoTrained([x[:, :N_TEXT], x[:, N_TEXT:]], y, part, _passes(unlabelled(rows, labels)) if both else None)


def unlabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(x): the distinct features of all documents with an id that has no
    label, as bytes: all but the indicators as floats, then the places of these."""

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        text, meta = _views(b, NAMES)
        plain = np.column_stack([text, meta[:, :6]]).astype("<f4")
        places = [np.where(part.any(1), part.argmax(1) + 1, 0) for part in (meta[:, 6:6 + LANG_SLOTS], meta[:, 6 + LANG_SLOTS:])]
        packed = np.column_stack([plain.view(np.uint8), *places]).astype(np.uint8)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], ["doc_id", "x"])

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"))
    return materialize(map_arrow(rows.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")), features,
                                 "doc_id long, x binary").join(known, "doc_id", "left_anti").select("x").distinct(),
                       "quality_unlabelled")


def unpack(x: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of packed features."""
    raw = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
    plain = np.ascontiguousarray(raw[:, :-2]).view("<f4").astype(float)
    out = np.zeros((len(x), N_TEXT + N_META))
    out[:, :N_TEXT + 6] = plain
    for place, at in ((raw[:, -2], N_TEXT + 6), (raw[:, -1], N_TEXT + 6 + LANG_SLOTS)):
        some = np.flatnonzero(place)
        out[some, at + place[some].astype(int) - 1] = 1
    return out[:, :N_TEXT], out[:, N_TEXT:]


def _passes(pool: DataFrame) -> Callable[[CoTrained], list[dict]]:
    """Of each view and label, the number, gradient and Hessian of the rows
    that the other view is sure of: whole numbers, summed in any order."""

    def run(model: CoTrained) -> list[dict]:
        held = pool.sparkSession.sparkContext.broadcast(model)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held.value
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                xs = unpack(b.column(0).to_pylist())
                for v in (0, 1):
                    for label, rows in enumerate(model.sure(1 - v, xs[1 - v])):
                        g, h = model.views[v].sums(xs[v][rows], label)
                        own = np.concatenate([[rows.sum()], g, h.ravel()]).astype(np.int64)
                        total[v, label] = total.get((v, label), 0) + own
            for (v, label), own in total.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own), v, np.int32)), pa.array(np.full(len(own), label, np.int32)),
                    pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], ["view", "label", "at", "n"])

        arrow_batches(pool.sparkSession)
        got = (pool.mapInArrow(add, "view int, label int, at int, n long")
               .groupBy("view", "label", "at").agg(F.sum("n").alias("n")).toPandas())   # some 2,300 rows
        out: list[dict] = [{}, {}]
        for (v, label), part in got.groupby(["view", "label"]):
            own, k = part.sort_values("at")["n"].to_numpy(float), len(model.views[v].b)
            out[v][int(label)] = int(own[0]), own[1:1 + k] / (STEP * UNIT), own[1 + k:].reshape(k, k) / (STEP * STEP * 4)
        return out

    return run


def score(docs: DataFrame, model: CoTrained, doc_id: str = "doc_id",
          names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """(doc_id, score): the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(*_views(b, NAMES)))],
                                          ["doc_id", "score"])

    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), *(F.col(n).alias(k) for n, k in zip(names, NAMES))),
                     run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def drop_poor(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
              names: tuple[str, str, str, str] = NAMES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, names=names))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(held.value.score(*_views(b, names)) >= threshold))

    return map_arrow(docs, run, docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
