"""Toxicity by a weighted finite-state pattern grammar.

Weighted transducers read a clause word by word, together: insult (a lexicon
of words and word beginnings whose weights are learnt), will (a will-like word
before a harm), English will (for harms that are other words in German),
subject (who is to die), object (a person whom the harm meets), target (a
person addressed or named), negation and reported speech. A path reads one
word of the clause as its mark, an insult or a harm, and multiplies the
weights of its arcs; a transducer without an arc for it ends the path, so a
harm without a will word and a person is none. A clause's score in one of
five ways (plain, targeted, negated, reported, threat) is its best path of that
way, and a document's that of its best clause. A logistic model fitted
on labelled documents turns these and the number of matched clauses into a
score; a way that the labels say nothing about keeps its prior. Threats, of
which labels need not tell, are further evidence of their own (noisy-or),
whatever the length of the text.

Only clauses in which the insult or threat lexicon matches are run through
the grammar; the match itself is a sorted look-up of word fingerprints over
a whole batch of texts.

Labels are read from at most ``SAMPLE`` documents outside the held-out
fold. Lang, source and id are never inputs.

Defined results: null, empty and blank texts have no clauses and get the
model's score of an empty document; very long texts are read whole, clause
by clause; of equal paths and clauses either counts; repeated rows get the same score;
without labels of both kinds the prior weights are used; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faresight.llm.common import map_arrow, materialize, table
from faresight.llm.fitting import held_out, labelled_sample, logistic, sigmoid
from faresight.llm.words import ALNUM, Words, mix, sequence_hashes, utf8

#: Labelled documents learnt from, at most.
SAMPLE = 20_000
#: A lexicon entry occurs in so many different toxic texts, at this log odds.
SUPPORT, LOG_ODDS = 8, 2.5
PREFIXES = tuple(range(4, 11))          # bytes of word beginnings
WAYS = ("plain", "targeted", "negated", "reported", "threat")

# Closed word classes of the grammar, by symbol.
CLASSES = {
    "T": "u her tu te toi vous du dich dir ihr sie usted ustedes tus",
    "U": "you",
    "Y": "yourself yourselves",
    "P": "he she they",
    "O": "him them everyone people",
    "G": "your yours his their",
    "N": "not never no isnt arent wasnt dont doesnt nobody none neither nor without ne pas jamais nicht nie kein keine "
         "nunca jamas sin",
    "R": "said says say saying called calls calling quoted quote quotes wrote writes claimed claims alleged allegedly "
         "reported reports dit disait sagte sagt gesagt dijo dice",
    "W": "vais va werde wirst voy",
    "V": "gonna ill going shall",
    "E": "must should deserve deserves",
    "L": "will",
    "F": "all of every one each both",
    "K": "kill",
    "H": "hurt beat destroy shoot burn punch strangle",
    "M": "tuer toten töten matar",
    "S": "stab",
    "D": "die killed",
}
HARMS = "KHMSD"
#: A word read as the clause's mark: an insult, a harm, or an order to oneself.
READINGS = {"I": ("I", "I!"), "K": ("K", "K!", "K?"), **{x: (x, x + "!") for x in "HMSD"}}
MARKS = ("I!", "K!", "K?", "H!", "M!", "S!", "D!")
TARGETS, OBJECTS, ENGLISH, WILLS = "TUYPOG", "TUYO", "UYPOG", "WVEL"
#: Weights of arcs: a harm; a mark beside a target; negated or reported.
HARM, AT_TARGET, NEGATED, REPORTED = 2.0, 1.5, 0.3, 0.3
#: Words from a will word to the harm and from a negation to the mark, at most.
WITHIN, NEGATION_WITHIN = 5, 3
#: Clause ends.
ENDS = b".!?;\n\r"


def _features(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of each whole word and word beginning."""
    out, at = [h], [np.arange(len(h))]
    size = w.end - w.start
    for k in PREFIXES:
        i = np.flatnonzero(size > k)
        f = np.zeros(len(i), np.uint64)
        for j in range(k):
            f = f * np.uint64(0x100000001B3) + w.low[w.start[i] + j].astype(np.uint64)
        out.append(mix(f + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))))
        at.append(i)
    return np.concatenate(out), np.concatenate(at)


def _by_text(w: Words, f: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature)."""
    text = np.searchsorted(w.first, at, "right") - 1
    order = np.lexsort((f, text))
    f, text = f[order], text[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (text[1:] != text[:-1])
    return f[new], text[new]


def distinct_texts(rows: DataFrame) -> DataFrame:
    """Of labelled texts, one of each label and group of copies, so that words of a
    copied text don't look common: texts that share their least or greatest
    shingle fingerprint count as copies."""

    def keys(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(b.column(1), ALNUM)
        h, low, high = w.hashes(), [], []
        for i in range(b.num_rows):
            own = h[w.first[i]:w.first[i + 1]]
            s = sequence_hashes(own, min(5, len(own))).view(np.int64) if len(own) else np.zeros(1, np.int64)
            low.append(int(s.min()))
            high.append(int(s.max()))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(low, pa.int64()),
                                           pa.array(high, pa.int64())], ["doc_id", "label", "low", "high"])

    k = map_arrow(rows.select("doc_id", "text", "label"), keys, "doc_id long, label int, low long, high long")
    one = k.groupBy("label", "low").agg(F.min(F.struct("doc_id", "high")).alias("r")).select("label", "r.*")
    ids = one.groupBy("label", "high").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return rows.join(F.broadcast(ids), "doc_id", "left_semi")      # at most SAMPLE ids


def learn_lexicon(rows: DataFrame) -> dict[int, float]:
    """Insult features (fingerprints) and their log odds, from (doc_id, text,
    label). Candidates are counted over toxic texts first; only they are
    counted over the others."""
    spark = rows.sparkSession
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return {}

    def count(held=None):
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            w = Words(b.column(0), ALNUM)
            f, at = _features(w, w.hashes())
            if held is not None:
                known = held.value
                i = np.minimum(np.searchsorted(known, f), len(known) - 1)
                f, at = f[known[i] == f], at[known[i] == f]
            f, n = np.unique(_by_text(w, f, at)[0], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n.astype(np.int64))], ["f", "n"])
        return run

    def counted(label: int, held=None) -> DataFrame:
        return (map_arrow(rows.where(F.col("label") == label).select("text"), count(held), "f long, n long")
                .groupBy("f").agg(F.sum("n").alias("n")))

    pos = materialize(counted(1).where(F.col("n") >= SUPPORT), "toxic_words").toPandas()
    if not len(pos):
        return {}
    held = spark.sparkContext.broadcast(np.sort(pos["f"].to_numpy().view(np.uint64)))
    neg = counted(0, held).toPandas().set_index("f")["n"]
    out = {}
    for f, n in zip(pos["f"], pos["n"]):
        odds = math.log((n + 0.5) / (totals[1] + 1)) - math.log((neg.get(f, 0) + 0.5) / (totals[0] + 1))
        if odds >= LOG_ODDS:
            out[int(f)] = odds
    return out


class Transducer:
    """Arcs (state, symbol) -> (state, weight); symbols without one of their
    own lead to ``default(state)`` at weight 1. No path has an arc to ``None``, and none
    a second mark after ``done`` states."""

    def __init__(self, arcs: dict, default=lambda s: s, done: tuple = ("done",)):
        self.arcs, self.default, self.done = arcs, default, done

    def step(self, state, symbol: str):
        """(state, weight), or None where the path ends."""
        if state in self.done:
            return None if symbol in MARKS else self.arcs.get((state, symbol), (state, 1.0))
        arc = self.arcs.get((state, symbol))
        if arc is None:
            return self.default(state), 1.0
        return arc if arc[0] is not None else None


def _marks(arcs: dict, states, to) -> dict:
    """The same arc for every mark that has none, from each of the states."""
    for s in states:
        for x in MARKS:
            arcs.setdefault((s, x), to)
    return arcs


def _after(symbols: str, words: int, needs: tuple[str, ...]) -> Transducer:
    """The state counts down the words after one of the symbols; the marks of
    ``needs`` have an arc only while it lasts."""
    arcs = {(s, x): (words + 1, 1.0) for s in range(words + 2) for x in symbols}
    arcs |= {(0, x): (None, 0.0) for x in needs}
    arcs |= {(1, x): (None, 0.0) for x in needs}
    return Transducer(_marks(arcs, range(words + 2), ("done", 1.0)), lambda s: max(0, s - 1))


def _english(words: int) -> Transducer:
    """As ``_after`` for the harms that are German words too: an English will
    word, or "will" after an English pronoun (from ``words + 2`` on, one has come)."""
    top = words + 2
    arcs = {(s, x): (s // top * top + words + 1, 1.0) for s in range(2 * top) for x in "VE"}
    arcs |= {(s, "L"): (top + words + 1, 1.0) for s in range(top, 2 * top)}
    arcs |= {(s, x): (top + max(0, s % top - 1), 1.0) for s in range(2 * top) for x in ENGLISH}
    arcs |= {(s, x): (None, 0.0) for s in range(2 * top) if s % top < 2 for x in ("S!", "D!")}
    return Transducer(_marks(arcs, range(2 * top), ("done", 1.0)), lambda s: s // top * top + max(0, s % top - 1))


def _subject() -> Transducer:
    """Who is to die: "you", or a person who must or should. States: the
    person (0 none, 1 named, 2 addressed) and from 3 on a must."""
    arcs = {(s, x): (s // 3 * 3 + max(s % 3, 1), 1.0) for s in range(6) for x in "PO"}
    arcs |= {(s, "U"): (s // 3 * 3 + 2, 1.0) for s in range(6)}
    arcs |= {(s, "E"): (3 + s % 3, 1.0) for s in range(3)}
    arcs |= {(s, "D!"): (None, 0.0) for s in (0, 1, 3)}
    return Transducer(_marks(arcs, range(6), ("done", 1.0)))


def _object() -> Transducer:
    """The mark's own weight and its person: next after an English harm (but
    for filling words), on either side of others. It accepts in "insult" and "threat"."""
    arcs = {("none", x): ("before", 1.0) for x in "TU"}
    for s in ("none", "before"):
        arcs |= {(s, "I!"): ("insult", 1.0), (s, "D!"): ("threat", HARM), (s, "K?"): ("oneself", HARM)}
        arcs |= {(s, x): ("waits", HARM) for x in ("K!", "H!", "S!")}
    arcs |= {("none", "M!"): ("waits", HARM), ("before", "M!"): ("threat", HARM), ("waits", "F"): ("waits", 1.0),
             ("oneself", "Y"): ("threat", 1.0)}
    arcs |= {("waits", x): ("threat", 1.0) for x in OBJECTS}
    return Transducer(arcs, lambda s: "fails" if s in ("waits", "oneself") else s, ("insult", "threat", "fails"))


def _near() -> Transducer:
    """A target anywhere in the clause, once."""
    return Transducer({(0, x): (1, AT_TARGET) for x in TARGETS}, done=())


def _struck(by: Transducer, weight: float, states) -> Transducer:
    """A mark while the state is positive leads to "struck" at ``weight``."""
    arcs = dict(by.arcs)
    arcs |= {(s, x): ("struck", weight) if s else ("done", 1.0) for s in states for x in MARKS}
    return Transducer(arcs, by.default, ("done", "struck"))


def _negation() -> Transducer:
    n = NEGATION_WITHIN
    return _struck(Transducer({(s, "N"): (n, 1.0) for s in range(n + 1)}, lambda s: max(0, s - 1)), NEGATED, range(n + 1))


def _report() -> Transducer:
    return _struck(Transducer({(0, "R"): (1, 1.0)}), REPORTED, (0, 1))


class Grammar:
    """The composition of all transducers over a clause's symbols; states of
    it are built as clauses reach them."""

    def __init__(self) -> None:
        self.parts = (_object(), _negation(), _report(), _near(), _after(WILLS, WITHIN, ("K!", "H!", "M!")),
                      _english(WITHIN), _subject())
        self.start = ("none", 0, 0, 0, 0, 0, 0)
        self.words: dict[bytes, str] = {}
        for symbol, words in CLASSES.items():
            for x in words.split():
                self.words.setdefault(x.encode(), symbol)
        self.arcs: dict = {}

    def step(self, state: tuple, symbol: str):
        """(state, product of the weights), or None where a part has no arc."""
        key = state, symbol
        if key not in self.arcs:
            got = [p.step(s, symbol) for p, s in zip(self.parts, state)]
            self.arcs[key] = None if any(x is None or x[0] == "fails" for x in got) else (
                tuple(x[0] for x in got), math.prod(x[1] for x in got))
        return self.arcs[key]

    @staticmethod
    def way(state: tuple) -> int | None:
        """The way of a path that ends in this state; None if it has no mark."""
        kind, negated, reported, near = state[:4]
        if kind not in ("insult", "threat"):
            return None
        return 2 if negated == "struck" else 3 if reported == "struck" else 4 if kind == "threat" else 1 if near else 0

    def run(self, symbols: list[tuple[str, float]]) -> list[tuple[int, float]]:
        """(way, weight) of the best path of each way. Symbols come with the
        weight of an insult read as the mark."""
        paths = {self.start: 1.0}
        for symbol, weight in symbols:
            after: dict[tuple, float] = {}
            for reading in READINGS.get(symbol, (symbol,)):
                own = weight if reading == "I!" else 1.0
                for state, total in paths.items():
                    arc = self.step(state, reading)
                    if arc is not None:
                        after[arc[0]] = max(after.get(arc[0], 0.0), total * arc[1] * own)
            paths = after
        best: dict[int, float] = {}
        for state, total in paths.items():
            way = self.way(state)
            if way is not None:
                best[way] = max(best.get(way, 0.0), total)
        return sorted(best.items())


class Scorer:
    """Features of a batch of texts under a lexicon."""

    def __init__(self, lexicon: dict[int, float]):
        self.keys = np.array(sorted(lexicon), np.int64).view(np.uint64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.weights = np.array([lexicon[int(k)] for k in self.keys.view(np.int64)])
        self.grammar = Grammar()
        harm = Words(pa.array([" ".join(CLASSES[x] for x in HARMS)]), ALNUM).hashes()
        self.harm = np.sort(harm)

    def clauses(self, w: Words, raw: np.ndarray) -> np.ndarray:
        """Number of the clause that each word is in, across the batch."""
        ends = np.isin(raw, np.frombuffer(ENDS, np.uint8))
        after = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(ends, out=after[1:])
        text = np.searchsorted(w.first, np.arange(len(w)), "right")
        return after[w.start] + text               # a new text is a new clause too

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: log of the best clause's weight in each way, of the sum of
        all matched clauses' best paths, of their number, and of the words."""
        w = Words(texts, ALNUM)
        h, rows = w.hashes(), len(texts)
        out = np.zeros((rows, len(WAYS) + 3))
        out[:, -1] = np.log1p(w.counts())
        weight = np.zeros(len(w))
        if len(self.keys):
            f, at = _features(w, h)
            i = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            ok = self.keys[i] == f
            np.maximum.at(weight, at[ok], self.weights[i[ok]])
        i = np.minimum(np.searchsorted(self.harm, h), len(self.harm) - 1)
        hit = np.flatnonzero((weight > 0) | (self.harm[i] == h))
        if not len(hit):
            return out
        raw = utf8(texts)[0]
        clause = self.clauses(w, raw)
        starts = np.searchsorted(clause, clause[hit], "left")
        ends = np.searchsorted(clause, clause[hit], "right")
        done = -1
        for a, z in zip(starts.tolist(), ends.tolist()):
            if a == done:                          # the clause is done
                continue
            done = a
            t = int(np.searchsorted(w.first, a, "right")) - 1
            symbols = [("I", float(weight[k])) if weight[k] > 0 else (self.grammar.words.get(w.word(k), ""), 0.0)
                       for k in range(a, z)]
            paths = self.grammar.run(symbols)
            for way, x in paths:
                out[t, way] = max(out[t, way], x)
            if paths:
                out[t, len(WAYS)] += max(x for _, x in paths)
                out[t, len(WAYS) + 1] += 1
        out[:, :len(WAYS) + 2] = np.log1p(out[:, :len(WAYS) + 2])
        return out


#: Of the features, then the constant. Negated and reported paths weigh less by their arcs.
PRIOR = np.array([1.0, 1.2, 1.0, 1.0, 1.5, 0.5, 0.3, 0.0, -2.5])
#: Of the threat feature and a constant, where there is a threat.
THREAT = 2.0, -2.0


def probability(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """The model's score and the evidence of a threat, by noisy-or."""
    threat = x[:, WAYS.index("threat")]
    own = np.where(threat > 0, sigmoid(THREAT[0] * threat + THREAT[1]), 0.0)
    return 1 - (1 - sigmoid(x @ coef[:-1] + coef[-1])) * (1 - own)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray]:
    """(lexicon, coefficients) from at most ``sample`` labelled documents."""
    ids = labelled_sample(labels, label, sample)
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
                       .join(F.broadcast(materialize(ids, "toxic_ids")), "doc_id"), "toxic_sample")
    rows = materialize(distinct_texts(rows), "toxic_texts")
    lexicon = learn_lexicon(rows)

    def features(b: pa.RecordBatch) -> pa.RecordBatch:
        x = Scorer(lexicon).features(b.column(0))
        return pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = map_arrow(rows.select("text", "label"), features, "x array<double>, y int").toPandas()
    if not lexicon or not len(got):
        return lexicon, PRIOR
    x = np.array(got["x"].tolist())
    order = np.lexsort(x.T)                        # the same sums in any order of rows
    return lexicon, logistic(x[order], got["y"].to_numpy(float)[order], PRIOR)


def score(docs: DataFrame, model: tuple[dict[int, float], np.ndarray], doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    scorer: list[Scorer] = []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, coef = held.value
        if not scorer:
            scorer.append(Scorer(lexicon))
        p = probability(scorer[0].features(b.column(1)), coef)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run,
                     f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text))
    at, scorer = docs.columns.index(text), []

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lexicon, coef = held.value
        if not scorer:
            scorer.append(Scorer(lexicon))
        return b.filter(pa.array(probability(scorer[0].features(b.column(at)), coef) < 0.5))

    return map_arrow(docs, run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
