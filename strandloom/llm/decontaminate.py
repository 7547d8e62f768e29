"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over the corpus.

Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. A window is 10 consecutive words
of an item, or all words of a shorter item. A hit by hash is verified word for word.

A broadcast holds at most about `per_pass` windows. A larger benchmark is dealt into blocks of that size by hash, and the corpus goes
through one scan after another, each with its own block. The rows are written between two scans, so a task holds one block at a
time. There is no shuffle either way and nothing is dropped.

Defined cases: null and empty texts have no words and no hits. A null item text has no windows; an item
whose id is null marks words but isn't listed. Equal items are all listed. Repeated rows give repeated results.
Output columns are the id column and the new ones, so clashing names in the input don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.llm.worker import tidy
from strandloom.session import materialise, ship

SPAN = "array<struct<first:int,last:int,start:int,end:int>>"


def _item_windows(size: int):
    def run(batches):
        for b in batches:
            data, off = W.raw(b.column(1))
            ids, seen = b.column(0).to_pylist(), []
            for row, last, rows, s, e, h in W.word_blocks(data, off, W.ALNUM):
                counts = np.bincount(rows - row, minlength=last - row)
                for n in np.unique(counts[counts > 0]):
                    of = np.isin(rows, row + np.flatnonzero(counts == n))
                    first, hashes = W.windows(rows[of], h[of], min(int(n), size))
                    own_s, own_e, own = s[of], e[of], rows[of]
                    for f, x in zip(first, hashes, strict=True):
                        to = f + min(int(n), size)
                        text = b" ".join(W.ALNUM.fold[data[i:j]].tobytes() for i, j in zip(own_s[f:to], own_e[f:to], strict=True))
                        seen.append((int(x.astype(np.int64)), min(int(n), size), text, ids[own[f]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in seen], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.string()))], names=["hash", "n", "words", "item"]
            )

    return run


def item_windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (hash, n, words, item) of all windows."""
    ship(items.sparkSession)
    cols = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(_item_windows(size), "hash long, n int, words binary, item string")


class _Known:
    """A block of windows, looked up by hash and verified word for word."""

    def __init__(self, block: list):
        self.held: dict[int, dict[bytes, list[str]]] = defaultdict(dict)
        sizes: dict[int, list[int]] = defaultdict(list)
        for h, n, text, found in block:
            self.held[h][bytes(text)] = found
            sizes[n].append(h)
        self.hashes = {n: np.unique(np.array(x, np.int64)) for n, x in sizes.items()}
        self.bits = {n: np.zeros(1 << 20, bool) for n in self.hashes}
        for n, x in self.hashes.items():
            self.bits[n][x.view(np.uint64) >> np.uint64(44)] = True

    def hits(self, data, rows, s, e, h):
        """(first word, number of words, items) of each window that occurs."""
        for n, known in self.hashes.items():
            first, x = W.windows(rows, h, n)
            maybe = np.flatnonzero(self.bits[n][x >> np.uint64(44)])
            x = x[maybe].view(np.int64)
            at = np.minimum(np.searchsorted(known, x), len(known) - 1)
            hit = known[at] == x
            for f, key in zip(first[maybe[hit]], x[hit], strict=True):
                text = b" ".join(W.ALNUM.fold[data[i:j]].tobytes() for i, j in zip(s[f : f + n], e[f : f + n], strict=True))
                found = self.held[int(key)].get(text)
                if found is not None:
                    yield int(f), n, found


def _scan(block):
    def run(batches):
        known = _Known(block.value)
        for b in batches:
            data, off = W.raw(b.column("text"))
            n_words, spans, items = [], b.column("spans").to_pylist(), b.column("items").to_pylist()
            for row, last, rows, s, e, h in W.word_blocks(data, off, W.ALNUM):
                n_words.append(np.bincount(rows - row, minlength=last - row))
                for f, n, found in known.hits(data, rows, s, e, h):
                    r, base = int(rows[f]), int(np.searchsorted(rows, rows[f]))
                    spans[r].append((f - base, f - base + n, int(s[f] - off[r]), int(e[f + n - 1] - off[r])))
                    items[r] = sorted(set(items[r]) | set(found))
            for r, mine in enumerate(spans):
                if mine:
                    spans[r] = _merged(mine)
            span = pa.list_(pa.struct([(k, pa.int32()) for k in ("first", "last", "start", "end")]))
            keys = ("first", "last", "start", "end")
            out = {name: b.column(name) for name in b.schema.names}
            out["n_words"] = pa.array(np.concatenate(n_words) if n_words else [], pa.int64())
            out["spans"] = pa.array([[x if isinstance(x, dict) else dict(zip(keys, x, strict=True)) for x in r] for r in spans], span)
            out["items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _free(block):
    def flags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known(block.value)
        for text in batches:
            data, off = W.raw(text)
            free = np.ones(len(text), bool)
            for _, _, rows, s, e, h in W.word_blocks(data, off, W.ALNUM):
                for f, _, _ in known.hits(data, rows, s, e, h):
                    free[rows[f]] = False
            yield pa.array(free)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(flags)(batches)

    return F.arrow_udf(run, "boolean")


def _merged(spans: list) -> list[tuple[int, int, int, int]]:
    """Overlapping or touching word spans as one."""
    rows = sorted(tuple(x.values()) if isinstance(x, dict) else x for x in spans)
    out = [rows[0]]
    for a, b, s, e in rows[1:]:
        if a <= out[-1][1]:
            x = out[-1]
            out[-1] = (x[0], max(x[1], b), x[2], max(x[3], e))
        else:
            out.append((a, b, s, e))
    return out


def _blocks(items: DataFrame, size: int, per_pass: int):
    """Broadcasts of about per_pass windows each, at least one."""
    spark = items.sparkSession
    ship(spark)
    found = item_windows(items, size).groupBy("hash", "n", "words").agg(F.array_sort(F.collect_set("item")).alias("found"))
    found = materialise(found, "windows")
    passes = max(1, -(-found.count() // per_pass))
    for i in range(passes):
        own = found.where(F.pmod("hash", F.lit(passes)) == i) if passes > 1 else found
        yield spark.sparkContext.broadcast([tuple(r) for r in own.toLocalIterator()])


def scan(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", per_pass: int = 500_000, keep_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_hit, items (ids of items with occurring windows, sorted), spans (merged hits: words first..last, bytes start..end)."""
    df = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPAN).alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    for i, block in enumerate(_blocks(items, size, per_pass)):
        df = (materialise(df, "scanned") if i else df).mapInArrow(tidy(_scan(block)), df.schema)
    out = df.select(
        F.col("id").alias(id_col), "n_words", F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"]), F.lit(0).cast("long")).alias("n_hit"),
        "items", "spans", *(["text"] if keep_text else []),
    )
    return out


def report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The contract's columns per document."""
    s = scan(docs, items, size)
    return s.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = 10, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text", per_pass: int = 500_000) -> DataFrame:
    """docs without contaminated rows (mode 'documents'), or with the hit spans cut from their texts (mode 'spans').

    All columns of docs are kept. Where documents are dropped, only the text goes to Python and only a flag comes back. For
    spans the row travels through the scan as one struct, so its names can't clash.
    """
    if mode == "documents":
        for i, block in enumerate(_blocks(items, size, per_pass)):
            docs = (materialise(docs, "scanned") if i else docs).where(_free(block)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
        return docs
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    s = scan(row, items, size, id_col="row", text_col="text", per_pass=per_pass, keep_text=True)
    bytes_ = F.col("text").cast("binary")
    kept = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").cast("binary").alias("out")),
        lambda a, x: F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(bytes_, a["at"] + 1, x["start"] - a["at"])).alias("out")),
        lambda a: F.concat(a["out"], F.substring(bytes_, a["at"] + 1, F.octet_length("text"))).cast("string"),
    )
    new = F.when(F.size("spans") > 0, kept).otherwise(F.col(f"row.{text_col}"))
    return s.select(F.col("row").withField(text_col, new).alias("row")).select("row.*")


ORACLE = r"""WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t FROM iw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
hits AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM dwin d JOIN win ON d.n = win.n AND d.t = win.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
