"""Language identification by error-correcting output codes over byte trigrams.

Each language gets a codeword of +1/-1 bits. A bit's binary classifier is the log ratio of smoothed trigram
frequencies between the languages on its two sides, averaged over a text; a logistic curve fitted on a bounded
sample of labelled rows turns it into a margin. Decoding sums the logistic losses of the margins against each
codeword, weighted by how well each bit did on that sample, and takes the nearest codeword. A text whose two
nearest codewords are close is flagged.

Trigram counts cover every labelled training row: one array per language and task, summed by a shuffle. A bit's two sides are summed
in Spark too, so the driver gets one row a trigram, at most 2**18 with two numbers a bit, and the number of bits grows with the
logarithm of the number of languages only. Scoring maps over texts with the broadcast weights (bits x 1 MB) and shuffles nothing.

Defined cases: null texts and texts without a letter are `und` with score 0; a text with letters but no known
trigram gets the language that an average margin of 0 decodes to, flagged. Without training rows everything is `und`.
Rows with a null language don't train; a null id counts as held out. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.llm.worker import release, tidy
from strandloom.session import materialise, ship

DIMS = 1 << 18


def _classes() -> np.ndarray:
    """Bytes as 64 classes: letters without case, non-ASCII bytes (Latin-1 capitals as small letters), all else 0."""
    c = np.zeros(256, np.int32)
    c[97:123] = c[65:91] = np.arange(1, 27)
    c[128:] = 27 + (np.arange(128, 256) | 0x20) % 37
    return c


CLASSES = _classes()


def trigrams(data: np.ndarray, off: np.ndarray):
    """(first row, row after the last, row of each trigram, trigram), in blocks; a long text comes in several."""
    n, row = len(off) - 1, 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + W.BLOCK, "right")) - 1)
        for lo in range(int(off[row]), max(int(off[last]), int(off[row]) + 1), W.BLOCK) if last == row + 1 else [int(off[row])]:
            hi = min(int(off[last]), lo + W.BLOCK + 2) if last == row + 1 else int(off[last])
            c = CLASSES[data[lo:hi]]
            if len(c) < 3:
                continue
            t = (c[:-2] << 12) | (c[1:-1] << 6) | c[2:]
            of = np.searchsorted(off, np.arange(lo, hi - 2), "right") - 1 if last > row + 1 else np.full(len(t), row)
            ok = (c[1:-1] > 0) & (np.arange(lo + 3, hi + 1) <= off[of + 1])
            yield row, last, of[ok], t[ok]
        row = last


def _count(batches):
    held: dict[str, np.ndarray] = {}

    def flush():
        for lang, x in held.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], names=["lang", "gram", "n"])
        held.clear()

    for b in batches:
        data, off = W.raw(b.column("text"))
        langs = np.array(b.column("lang").to_pylist(), dtype=object)
        for _, _, of, t in trigrams(data, off):
            own = langs[of]
            for lang in set(own):
                held[lang] = held.get(lang, 0) + np.bincount(t[own == lang] if len(set(own)) > 1 else t, minlength=DIMS)
        if len(held) > 64:
            yield from flush()
    yield from flush()


def codewords(k: int) -> np.ndarray:
    """k codewords: exhaustive for few languages, else the best of some random codes by least distance."""
    if k <= 1:
        return np.ones((k, 0), np.int8)
    if k <= 5:
        bits = [[1 if (b >> i) & 1 else -1 for b in range(1, 2 ** (k - 1))] for i in range(k - 1)]
        return np.array([[-1] * (2 ** (k - 1) - 1), *bits], np.int8)
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.int8), (k, int(np.ceil(10 * np.log2(k)))))
        m = m[:, np.abs(m.sum(0)) < k]
        d = (m.shape[1] - m.astype(int) @ m.T.astype(int)) // 2
        least = int(d[~np.eye(k, dtype=bool)].min())
        if least > far:
            best, far = m, least
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x DIMS
    slope: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def averages(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """rows x bits: the mean weight of a row's trigrams."""
        n = len(off) - 1
        total, count = np.zeros((n, len(self.weights))), np.zeros(n)
        for row, last, of, t in trigrams(data, off):
            if not len(t):
                continue
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            at = of[starts]
            count[at] += np.diff(np.append(starts, len(of)))
            for b, w in enumerate(self.weights):
                total[at, b] += np.add.reduceat(w[t], starts)
        return total / np.maximum(count, 1)[:, None]

    def decode(self, averages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, its probability, the second's) per row."""
        margin = averages * self.slope + self.shift
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(1) for c in self.code.astype(float)], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        return p.argmax(1), order[:, -1], order[:, -2] if p.shape[1] > 1 else np.zeros(len(p))


def _averages(model):
    def run(batches):
        for b in batches:
            x = model.value.averages(*W.raw(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(list(x), pa.list_(pa.float64()))], names=["lang", "x"])

    return run


def fit(train: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang", smooth: float = 0.5, calibration_rows: int = 4000) -> Model:
    """Learn from all rows of train; key picks the sample of about calibration_rows rows that the margins are scaled on."""
    spark = train.sparkSession
    ship(spark)
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).alias("draw"))
    counts = rows.select("text", "lang").mapInArrow(tidy(_count), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "trigrams")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    total = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(sizes)
    code = codewords(len(langs))
    weights = _weights(counts, langs, total, code, smooth)
    ones = np.ones(code.shape[1])
    model = Model(langs, code, weights, ones * 4, ones * 0, ones)
    if code.shape[1]:
        share = int((1 << 20) * min(1.0, calibration_rows / max(1, sum(sizes.values())))) + 1
        held = spark.sparkContext.broadcast(model)
        got = rows.where(F.col("draw") < share).select("text", "lang").mapInArrow(tidy(_averages(held)), "lang string, x array<double>").limit(2 * calibration_rows).collect()
        x, y = np.array([r.x for r in got]), np.array([langs.index(r.lang) for r in got])
        for b in range(code.shape[1]):
            model.slope[b], model.shift[b], model.trust[b] = _platt(x[:, b], code[y, b])
    return model


def _weights(counts: DataFrame, langs: list[str], total: dict[str, int], code: np.ndarray, smooth: float) -> np.ndarray:
    """bits x DIMS: the log ratio of the mean smoothed shares of a trigram on a bit's two sides; 0 for trigrams that no text has."""
    n_bits = code.shape[1]
    weights = np.zeros((n_bits, DIMS), np.float32)
    known = counts.select("gram").distinct().count()
    if not n_bits or not known:
        return weights
    scale = [1 / (total.get(x, 0) + smooth * known) for x in langs]
    shares = [pa.array([[float(s) * (c * side > 0) for c in row] for s, row in zip(scale, code.tolist(), strict=True)], pa.list_(pa.float64())) for side in (1, -1)]
    sides = counts.sparkSession.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "plus": shares[0], "minus": shares[1]}))  # a list of rows would start Python workers of its own
    summed = counts.join(F.broadcast(sides), "lang").groupBy("gram").agg(*[F.sum(F.col("n") * F.col(c)[b]).alias(f"{c}{b}") for c in ("plus", "minus") for b in range(n_bits)])
    table = summed.toPandas()
    at = table.gram.to_numpy()
    scale = np.array(scale)
    for b in range(n_bits):
        on = code[:, b] > 0
        share = [(table[f"{c}{b}"].to_numpy() + smooth * scale[side].sum()) / side.sum() for c, side in (("plus", on), ("minus", ~on))]
        weights[b, at] = np.log(share[0]) - np.log(share[1])
    return weights


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope and shift of a ridge logistic curve for y in -1, +1, and 1 / (1 + its mean loss)."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - (y > 0)) + 0.5 * np.array([w[0] - 4, w[1]])
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[0], w[1], 1 / (1 + np.logaddexp(0, -(a @ w) * y).mean())


def _tell(m: Model, text: pa.Array, letter: pa.Array, close: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, its score, whether the two nearest codewords are close) per text."""
    n, letter = len(text), np.array(letter.to_pylist(), bool)
    if not m.langs:
        return np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n, bool)
    best, p, second = m.decode(m.averages(*W.raw(text)))
    lang = np.where(letter, np.array(m.langs, dtype=object)[best], "und")
    return lang, np.clip(np.where(letter, p, 0.0), 0, 1), (p - second < close) & letter


def _predict(model, close: float):
    def run(batches):
        for b in batches:
            lang, score, ambiguous = _tell(model.value, b.column("text"), b.column("letter"), close)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous)], names=["id", "lang_pred", "score", "ambiguous"])

    return run


def _identified(model, close: float, least: float):
    def run(text: pa.Array, letter: pa.Array) -> pa.Array:
        lang, score, ambiguous = _tell(model.value, text, letter, close)
        release()  # here, since this function has no end to do it at
        return pa.array((lang != "und") & ~(ambiguous & (score < least)), pa.bool_())

    return F.arrow_udf(run, "boolean")


def _text(text_col: str) -> tuple[Column, Column]:
    """The text, empty if null, and whether it has a letter."""
    return F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", close: float = 0.2) -> DataFrame:
    """Per row: id, lang_pred, score, ambiguous (the two nearest codewords' probabilities differ by less than close)."""
    spark = docs.sparkSession
    ship(spark)
    text, letter = _text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), letter.alias("letter"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(tidy(_predict(spark.sparkContext.broadcast(model), close)), f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)


def held_out(doc_id: Column, folds: int, at: int) -> Column:
    """crc32(doc_id as text) mod folds is at; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == at, F.lit(True))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns per document, learned from the documents that aren't held out."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    model = fit(rows.where("not held_out"), F.col("doc_id"))
    got = predict(rows.select(F.struct("doc_id", "held_out").alias("row"), "text"), model, "row")
    return got.select("row.doc_id", "row.held_out", "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, least: float = 0.5, close: float = 0.2) -> DataFrame:
    """docs whose language is told, all columns kept: `und` and flagged texts whose nearest codeword has under `least` go.

    Only the text goes to Python and only a flag comes back; the row stays in Spark.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    model = fit(rows.where("not held_out"), F.col("doc_id"))
    return docs.where(_identified(docs.sparkSession.sparkContext.broadcast(model), close, least)(*_text("text")))
