"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, other. Five transducers over these symbols are composed:
reported speech marks what follows it, negation marks the next few words, target marks the next few words, insult weighs marked
and unmarked insults, and threat weighs threats at a target. Since a target may also follow the insult, the target transducer
runs over the reversed clause first; so a clause takes two passes, whatever it holds. Only clauses with an insult or a threat
are run through the machine; a text's score is a logistic curve over its summed clause weights.

The insult lexicon is learned: a unit (a word, or its first 4 to 8 bytes) counts if it marks labelled toxic
rows, with a weight by its log odds. Candidates are units in at least a fixed share of the toxic rows, so their number is bounded by the mean
number of units in a row over that share, whatever the corpus; their counts in all other labelled rows are summed
in a second pass over labelled rows only. Units are 64-bit hashes, looked up through a bitmap, so scoring is a map
over texts without a shuffle.

Defined cases: null and empty texts score as a text without any clause. Without labelled rows of both kinds the fixed
words alone decide. Labels repeated for a doc_id count as their mean, rounded up from one half. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.llm.language_id import held_out
from strandloom.session import materialise, ship

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# The closed word classes of the grammar, and insults known before any label is seen.
WORDS = {
    TARGET: "you your yours youre u ya he him his she her they them their this that these those du dich dir dein deine ihr euch sie tu te toi ton ta vous votre usted ustedes tus",
    NEGATION: "not no never isnt arent wasnt dont doesnt didnt wont cant neither nor without nicht kein keine nie niemals pas jamais aucun sans nunca jamas ningun sin",
    REPORT: "said says say saying wrote writes quoted quotes quote called calls claimed claims told tells reported reportedly according alleged sagte schrieb laut dit disait selon dijo escribio dice",
    THREAT: "kill hurt destroy murder shoot stab beat punch burn strangle rape bomb attack toten umbringen tuer frapper matar golpear",
    INSULT: "idiot idiots moron morons scum loser losers stupid pathetic worthless disgusting trash imbecile bastard",
}
#: Words that negation reaches forward, and that a target reaches either way.
REACH = 3
NEAR = 4
#: Weight of an insult, of a threat at a target, and the factors of the marks.
BASE = {"insult": 1.0, "threat": 1.2, "targeted": 1.5, "negated": 0.5, "reported": 0.6}


@dataclass
class Transducer:
    """state, symbol -> (state, output, weight); a missing arc copies the symbol and goes to `rest(state)`."""

    start: int
    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)
    states: int = 1

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def then(self, other: Transducer, alphabet: int) -> Transducer:
        """This one's output read by the other, as one machine; weights add up."""
        out = Transducer(0, {}, self.states * other.states)
        for a in range(self.states):
            for b in range(other.states):
                for x in range(alphabet):
                    a2, y, w = self.step(a, x)
                    b2, z, v = other.step(b, y)
                    out.arcs[a * other.states + b, x] = (a2 * other.states + b2, z, w + v)
        out.start = self.start * other.states + other.start
        return out


# A symbol is its class (0..5) plus 8 for reported, 16 for negated, 32 for targeted.
ALPHABET = 64


def reported() -> Transducer:
    """Marks all that follows reported speech."""
    t = Transducer(0, {}, 2)
    for x in range(ALPHABET):
        t.arcs[0, x] = (int(x & 7 == REPORT), x, 0.0)
        t.arcs[1, x] = (1, x | 8, 0.0)
    return t


def nearby(of: int, reach: int, mark: int) -> Transducer:
    """Marks the `reach` symbols after one of class `of`."""
    t = Transducer(0, {}, reach + 1)
    for s in range(reach + 1):
        for x in range(ALPHABET):
            y = x | mark if s else x
            t.arcs[s, x] = (reach if x & 7 == of else max(0, s - 1), y, 0.0)
    return t


def weighed(kind: int, plain: float, targeted: float) -> Transducer:
    """Weighs the symbols of one class by their marks."""
    t = Transducer(0, {}, 1)
    for x in range(ALPHABET):
        w = (targeted if x & 32 else plain) * (BASE["negated"] if x & 16 else 1) * (BASE["reported"] if x & 8 else 1)
        t.arcs[0, x] = (0, x, w if x & 7 == kind else 0.0)
    return t


@dataclass
class Grammar:
    """A transducer for the reversed clause, and the composed machine that reads its output from the left."""

    back: Transducer
    machine: Transducer


def grammar() -> Grammar:
    target = nearby(TARGET, NEAR, 32)
    insult = weighed(INSULT, BASE["insult"], BASE["insult"] * BASE["targeted"])
    threat = weighed(THREAT, 0.0, BASE["threat"])
    machine = reported()
    for t in (nearby(NEGATION, REACH, 16), target, insult, threat):
        machine = machine.then(t, ALPHABET)
    return Grammar(target, machine)


def clause_weight(g: Grammar, symbols: list[int], weights: list[float]) -> float:
    """Weight of one clause, in units of a plain insult; weights: of each word."""
    back, state = [], g.back.start
    for x in reversed(symbols):
        state, y, _ = g.back.step(state, x)
        back.append(y)
    state, total = g.machine.start, 0.0
    for x, own in zip(reversed(back), weights, strict=True):
        state, _, w = g.machine.step(state, x)
        total += w * own
    return total


def hashes_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return next(W.word_blocks(data, np.array([0, len(data)]), W.ALNUM))[5]


def _units(data, rows, s, e, h) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of words and of their heads of 4 to 8 bytes; heads have hashes of their own kind."""
    out = [(np.arange(len(h)), h)]
    for n in range(4, 9):
        at = np.flatnonzero(e - s > n)
        x = np.zeros(len(at), np.uint64)
        for j in range(n):
            x = (x << np.uint64(8)) | W.ALNUM.fold[data[s[at] + j]].astype(np.uint64)
        out.append((at, W.mix(W.mix(x) + np.uint64(n))))
    return out


def _row_units(data, off):
    """(row, unit hash), once for each row, in blocks of whole rows."""
    for row, last, rows, s, e, h in W.word_blocks(data, off, W.ALNUM):
        u = _units(data, rows, s, e, h)
        of, x = np.concatenate([rows[i] for i, _ in u]), np.concatenate([y for _, y in u])
        order = np.lexsort((x, of))
        of, x = of[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = (of[1:] != of[:-1]) | (x[1:] != x[:-1])
        yield of[new], x[new]


def _support(batches):
    for b in batches:
        got = [x for _, x in _row_units(*W.raw(b.column("text")))]
        u, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n, pa.int64())], names=["unit", "n"])


class Lookup:
    """Sorted hashes behind a bitmap."""

    def __init__(self, hashes: np.ndarray):
        self.known = np.unique(hashes.astype(np.uint64))
        self.bits = np.zeros(1 << 18, bool)
        self.bits[self.known >> np.uint64(46)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x that are known, and where in the sorted hashes they are."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.bits[x >> np.uint64(46)])
        at = np.minimum(np.searchsorted(self.known, x[maybe]), len(self.known) - 1)
        ok = self.known[at] == x[maybe]
        return maybe[ok], at[ok]


def _contrast(units):
    def run(batches):
        look = Lookup(units.value)
        n = np.zeros((2, len(look.known)), np.int64)
        for b in batches:
            data, off = W.raw(b.column("text"))
            y = np.array(b.column("y").to_pylist(), np.int64)
            for of, x in _row_units(data, off):
                i, at = look.find(x)
                np.add.at(n, (y[of[i]], at), 1)
        yield pa.RecordBatch.from_arrays([pa.array(look.known.view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["unit", "clean", "toxic"])

    return run


@dataclass
class Model:
    insults: np.ndarray  # unit hashes, sorted
    weights: np.ndarray  # of each
    slope: float
    shift: float

    def score(self, weight: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(weight) + self.shift, -30, 30)))


def _weights(model):
    """Per row the summed weights of its clauses, how many have weight, and the heaviest one."""
    learned = Lookup(model.insults)
    fixed = {kind: hashes_of(text) for kind, text in WORDS.items()}
    look = Lookup(np.concatenate(list(fixed.values())))
    kinds = np.zeros(len(look.known), np.int64)
    for kind, x in fixed.items():
        kinds[np.searchsorted(look.known, x)] = kind
    machine = grammar()
    ends = np.zeros(256, bool)
    ends[[ord(c) for c in ".!?;\n"]] = True

    def run(data, off):
        n = len(off) - 1
        total, clauses, top = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
        for row, last, rows, s, e, h in W.word_blocks(data, off, W.ALNUM):
            symbol = np.zeros(len(h), np.int64)
            i, at = look.find(h)
            symbol[i] = kinds[at]
            weight = np.ones(len(h))
            weight[symbol == INSULT] = 0.0
            for words, x in _units(data, rows, s, e, h):
                i, at = learned.find(x)
                fresh = words[i[symbol[words[i]] != INSULT]]
                symbol[fresh], weight[fresh] = INSULT, 0.0
                np.maximum.at(weight, words[i], model.weights[at])
            hot = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
            if not len(hot):
                continue
            lo, hi = int(off[row]), int(off[last])
            stops = np.union1d(np.flatnonzero(ends[data[lo:hi]]) + lo, off[row:last])  # a row's start also starts a clause
            clause = np.searchsorted(stops, s, "right")
            for c in np.unique(clause[hot]):
                a, b = np.searchsorted(clause, [c, c + 1])
                w = clause_weight(machine, symbol[a:b].tolist(), weight[a:b].tolist())
                if w > 0:
                    r = rows[a]
                    total[r] += w
                    clauses[r] += 1
                    top[r] = max(top[r], w)
        return total, clauses, top

    return run


def _scored(model):
    def run(batches):
        of = _weights(model.value)
        for b in batches:
            total, clauses, top = of(*W.raw(b.column("text")))
            p = model.value.score(total)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(total), pa.array(clauses), pa.array(top)], names=["id", "score", "predicted", "weight", "clauses", "heaviest"]
            )

    return run


#: Labels of up to so many rows are broadcast.
BROADCAST_LABELS = 2_000_000


def label_rows(docs: DataFrame, labels: DataFrame, name: str, id_col: str = "doc_id", small: int = BROADCAST_LABELS) -> DataFrame:
    """docs with a label y of 0 or 1. Labels are broadcast where they are few enough, else both sides are shuffled."""
    y = labels.where(F.col(name).isNotNull()).groupBy(id_col).agg((F.avg(name) >= 0.5).cast("int").alias("y"))
    return docs.join(F.broadcast(y) if labels.count() <= small else y, id_col)


def fit(labelled: DataFrame, text_col: str = "text", share: float = 0.004, least: int = 4, lift: float = 2.5, sample: int = 20_000, key: str = "doc_id") -> Model:
    """labelled: rows with text and y. Four fifths of them give the lexicon; the curve is fitted on at most about `sample` of the others."""
    spark = labelled.sparkSession
    ship(spark)
    fifth = (1 << 20) // 5
    rows = labelled.select(F.col(text_col).alias("text"), "y", F.pmod(F.xxhash64(key), F.lit(1 << 20)).alias("draw"))
    size = dict(rows.groupBy("y").count().collect())
    known = np.unique(hashes_of(WORDS[INSULT]))
    if not size.get(0) or not size.get(1):
        return Model(known, np.ones(len(known)), 8.0, -4.0)
    n0, n1 = size[0] * 0.8, size[1] * 0.8
    floor = max(least, int(share * n1))
    learn = rows.where(F.col("draw") >= fifth)
    units = learn.where("y = 1").select("text").mapInArrow(_support, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).select("unit")
    units = np.array([r[0] for r in units.collect()], np.int64).view(np.uint64)
    counts = learn.select("text", "y").mapInArrow(_contrast(spark.sparkContext.broadcast(units)), "unit long, clean long, toxic long")
    counts = counts.groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    odds = np.log((counts.toxic + 0.5) / (n1 + 1)) - np.log((counts.clean + 0.5) / (n0 + 1))
    counts = counts.assign(odds=odds)[(odds > lift) & (counts.toxic >= floor)]
    found = {int(np.int64(u).astype(np.uint64)): float(min(w / 5, 1.5)) for u, w in zip(counts.unit, counts.odds, strict=True)}
    for u in known.tolist():
        found[u] = max(found.get(u, 0.0), 1.0)
    insults = np.array(sorted(found), np.uint64)
    model = Model(insults, np.array([found[u] for u in insults.tolist()]), 8.0, -4.0)
    draw = int(fifth * min(1.0, sample / (0.2 * (size[0] + size[1])))) + 1
    held = spark.sparkContext.broadcast(model)
    got = rows.where(F.col("draw") < min(draw, fifth)).select(F.col("y").alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_scored(held), "id int, score double, predicted int, weight double, clauses long, heaviest double")
    got = got.groupBy(F.col("id").alias("y"), F.round("weight", 2).alias("weight")).count().toPandas()
    if len(got) and got.y.nunique() == 2:
        model.slope, model.shift = _curve(np.log1p(got.weight.to_numpy()), got.y.to_numpy(), got["count"].to_numpy(float))
    return model


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Ridge logistic curve of label on x, weighted by counts; the slope isn't negative."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.array([8.0, -4.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (n * (p - y)) + 0.05 * (w - np.array([8.0, -4.0]))
        h = (a * (n * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(0.0, w[0]), w[1]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, predicted, weight (of all clauses), clauses (that have weight), heaviest."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_scored(spark.sparkContext.broadcast(model)), f"id {kind}, score double, predicted int, weight double, clauses long, heaviest double")
    return out.withColumnRenamed("id", id_col)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns per document; rows whose crc32(doc_id) mod 5 is 0 aren't learned from."""
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    labelled = materialise(label_rows(rows.where("not held_out"), labels.select("doc_id", "toxic"), "toxic").select("doc_id", "text", "y"), "labelled")
    model = fit(labelled)
    got = score(rows.select(F.struct("doc_id", "held_out").alias("row"), "text"), model, "row")
    return got.select("row.doc_id", "row.held_out", "score", "predicted", "weight", "clauses")
