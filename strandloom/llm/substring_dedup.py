"""Substring deduplication by hashing lines and sentences.

Units are lines and, within them, sentences (ended by . ! or ?), so a passage is found alone on a line or inside a longer one.
A unit is normalised to its words (A-Z as a-z, no punctuation) and digested to 128 bits in a map over texts; digests are
counted by a shuffle with partial sums, the occurrence of least (doc_id, start) stays, and every other one is repeated.
Sentences inside a repeated line aren't listed again.

Repeated units with under `least` words between them form a passage, and units of a passage of `passage` words or more are
removed spans, in code points of the original text. So a footer or a licence line that a document shares with others stays,
and a copied passage goes. A passage that starts and ends inside units shows only its whole ones: the default takes 50 words
less two units of 15. passage=0 removes every repeated unit.

Units of under `least` words are never removed. Defined cases: null and empty texts have no units; a null id ranks after all
others; rows that share an id count as one document, so their equal spans don't remove each other, but their texts hold
passages of their own. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.llm.skew import join_counted
from strandloom.session import materialise, ship

LEAST = 8
PASSAGE = 20


def _units(least: int):
    stops = np.zeros(256, bool)
    stops[[ord(c) for c in ".!?\n"]] = True
    names = ["id", "doc", "h1", "h2", "line", "start", "end", "words", "at", "whole"]

    def of(group: np.ndarray, h: np.ndarray, other: np.ndarray):
        """First and last word, and two hashes, of each run of equal group numbers with enough words."""
        first = np.flatnonzero(np.diff(group, prepend=-1))
        last = np.append(first[1:], len(group))
        up, down = W._power(len(h) + 1)
        out = []
        for x in (h, other):
            sums = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(x * up[: len(h)], out=sums[1:])
            out.append(W.mix((sums[last] - sums[first]) * down[first]))
        ok = last - first >= least
        return first[ok], last[ok], out[0][ok], out[1][ok]

    def run(batches):
        for b in batches:
            data, off = W.raw(b.column("text"))
            for row, last, rows, s, e, h in W.word_blocks(data, off, W.ALNUM):
                if not len(h):
                    continue
                lo, hi = int(off[row]), int(off[last])
                part = data[lo:hi]
                chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                lines, ends = (np.concatenate(([0], np.cumsum(m))) for m in (part == 10, stops[part]))
                shift = rows - row  # rows are apart even where a text ends without a line end
                line, sentence = lines[s - lo] + shift, ends[s - lo] + shift
                other = W.mix(h ^ np.uint64(0xD1B54A32D192ED03))
                f1, l1, a1, b1 = of(line, h, other)
                f2, l2, a2, b2 = of(sentence, h, other)
                new = ~np.isin(f2 * (1 << 32) + l2, f1 * (1 << 32) + l1)  # a line that is one sentence comes once
                f, to, h1, h2 = (np.concatenate((x, y[new])) for x, y in ((f1, f2), (l1, l2), (a1, a2), (b1, b2)))
                whole = np.arange(len(f)) < len(f1)
                r = rows[f]
                base = chars[off[r] - lo]
                cols = [h1.view(np.int64), h2.view(np.int64), line[f] - shift[f] - lines[off[r] - lo], chars[s[f] - lo] - base, chars[e[to - 1] - lo] - base, to - f, f - np.searchsorted(rows, r)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(r)) for c in ("id", "doc")), *[pa.array(x, pa.int64()) for x in cols], pa.array(whole)], names=names)

    return run


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Rows (id, doc: hash of the text, h1, h2, line, start, end, words, at: words before it, whole: is it a line)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_units(least), f"id {kind}, doc long, h1 long, h2 long, line long, start long, end long, words long, at long, whole boolean")


def _passages(gone: DataFrame, least: int, passage: int) -> DataFrame:
    """The rows of gone (disjoint repeated units) that lie in passages of enough words."""
    doc = Window.partitionBy("id", "doc").orderBy("start")
    apart = F.coalesce(F.col("at") - F.lag(F.col("at") + F.col("words")).over(doc) >= least, F.lit(False))
    runs = gone.withColumn("apart", apart.cast("long")).withColumn("run", F.sum("apart").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("passage", F.sum("words").over(Window.partitionBy("id", "doc", "run"))).where(F.col("passage") >= passage)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, passage: int = PASSAGE) -> DataFrame:
    """One row per removed span: id, start, end, words, unit ('line' or 'sentence'), keep_id, keep_start."""
    found = materialise(units(docs, id_col, text_col, least), "units")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "start")
    keys = ["h1", "h2"]
    counted = found.groupBy(*keys).agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    counted = materialise(counted.select(*keys, F.col("first.id").alias("keep_id"), F.col("first.start").alias("keep_start"), "n"), "repeated")
    gone = join_counted(found, counted, keys, "n", found.count()).where(~(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("start") == F.col("keep_start"))))
    gone = gone.select("id", "doc", "line", "start", "end", "words", "at", "whole", "keep_id", "keep_start").distinct()
    lines = gone.where("whole").select(F.col("id").alias("l_id"), F.col("doc").alias("l_doc"), F.col("line").alias("l_line"))
    apart = gone.where("not whole").join(lines, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("doc") == F.col("l_doc")) & (F.col("line") == F.col("l_line")), "left_anti")
    out = gone.where("whole").unionByName(apart)
    if passage > least:
        out = _passages(out, least, passage)
    return out.select(F.col("id").alias(id_col), "start", "end", "words", F.when(F.col("whole"), "line").otherwise("sentence").alias("unit"), "keep_id", "keep_start").distinct()


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, passage: int = PASSAGE) -> DataFrame:
    """docs with the removed spans cut out of their texts; all columns are kept."""
    spans = repeats(docs, id_col, text_col, least, passage).groupBy(F.col(id_col).alias("cut_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut_spans"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = row.join(spans, F.col(f"row.{id_col}").eqNullSafe(F.col("cut_id")), "left")
    text = F.col(f"row.{text_col}")
    kept = F.aggregate(
        "cut_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(F.greatest(x["end"], a["at"]).alias("at"), F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.greatest(x["start"] - a["at"], F.lit(0)).cast("int"))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    return joined.select(F.when(F.col("cut_id").isNull() & F.col("cut_spans").isNull(), F.col("row")).otherwise(F.col("row").withField(text_col, kept)).alias("row")).select("row.*")


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS ln, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
lp AS (SELECT *, sum(length(ln) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(ln) - 1 AS l_at FROM l),
sp AS (SELECT doc_id, line, l_at, unnest(string_split_regex(ln, '[.!?]')) AS se, generate_subscripts(string_split_regex(ln, '[.!?]'), 1) AS i FROM lp),
sq AS (SELECT *, l_at + sum(length(se) + 1) OVER (PARTITION BY doc_id, line ORDER BY i) - length(se) - 1 AS s_at FROM sp),
u AS (SELECT doc_id, line, l_at AS base, ln AS t, true AS whole FROM lp UNION ALL SELECT doc_id, line, s_at, se, false FROM sq),
w AS (SELECT doc_id, line, whole, regexp_extract_all({_FOLD.format("t")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws,
  base + length(t) - length(regexp_replace(t, '^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '')) AS start, base + length(regexp_replace(t, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$', '')) AS "end" FROM u),
k AS (SELECT doc_id, line, bool_or(whole) AS whole, start::BIGINT AS start, "end"::BIGINT AS "end", len(ws)::BIGINT AS words, array_to_string(ws, ' ') AS key FROM w WHERE len(ws) >= {LEAST} GROUP BY doc_id, line, start, "end", ws),
f AS (SELECT key, count(*) AS n, arg_min(doc_id, (doc_id, start)) AS keep_id, min((doc_id, start)) AS first FROM k GROUP BY key),
g AS (SELECT k.*, keep_id, struct_extract_at(first, 2) AS keep_start FROM k JOIN f USING (key) WHERE n > 1 AND NOT (doc_id = keep_id AND start = struct_extract_at(first, 2))),
r AS (SELECT * FROM g WHERE whole OR NOT EXISTS (SELECT 1 FROM g AS o WHERE o.whole AND o.doc_id = g.doc_id AND o.line = g.line)),
b AS (SELECT r.*, lag("end") OVER (PARTITION BY doc_id ORDER BY start) AS before FROM r),
p AS (SELECT b.*, CASE WHEN len(regexp_extract_all(substr(text, before + 1, start - before), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) >= {LEAST} THEN 1 ELSE 0 END AS apart FROM b JOIN documents USING (doc_id)),
q AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM p),
t AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS passage FROM q)
SELECT doc_id, start, "end", words, CASE WHEN whole THEN 'line' ELSE 'sentence' END AS unit, keep_id, keep_start FROM t WHERE passage >= {PASSAGE}"""
