"""Line deduplication by a deletion-neighbourhood join; DataFrame operations only.

A line is normalised (lower case, white space as single spaces) and read as words; two lines match when one word
replaced, added or removed turns one into the other, or when they are equal. Lines of under `least` words match equal lines
only, and those of under `exact` words (by default `least`) never match; the query has exact=1, so that equal lines of any length meet. Empty lines stay, whatever `exact` is.

1. Equal lines are collapsed to their earliest occurrence by 128-bit hashes (partial sums first, so a hot line is cheap).
2. One edit leaves the first or the second half of a pair untouched, so only lines that share a half with another distinct
   line go on. Nothing is lost, and few lines remain.
3. The longer line of a pair, of N words, is cut into about sqrt(N) parts, the other one likewise but for a word less in one part. The
   edit lies in one part and leaves what is before and after it untouched, so lines meet by their hash without a part.
4. Where they do, a line emits its variants with one word of that part left out, as hashes: with the place if there is another
   line of N words (equal variants differ by a replaced word), closed up if there is one of N - 1 (equal to a line that lacks
   the word). Hashes are sums over placed words, so a variant costs a subtraction. So a line of n words has some 2 sqrt(n) hashes
   without a part and sqrt(n) variants, not 2n. Equal variants meet in an aggregation that keeps the earliest line, never pairs within a group.
5. The earliest match is verified word by word, and every later line goes. A chain of matches collapses to its earliest line.

Hot keys (a half, a variant or an earliest line that very many lines share) meet their one row by a broadcast of those rows, so no task
holds them all. Beyond `broadcast` rows, a bitmap of the keys that are sought thins halves, texts and lines before they are shuffled.

Defined cases: null and empty texts stay as they are; a null id ranks last; rows that share an id count as one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.skew import join_counted, thin
from strandloom.session import materialise, settle

LEAST = 8
#: Tables of lines and of met variants with up to this many rows are broadcast; larger ones are shuffled, their hot keys apart.
BROADCAST_LINES = 1_000_000
#: Lines are cut into so many parts at most: each costs a hash of the line.
PARTS = 16


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """Rows (id, line_no, norm, n) of the lines with enough words, none of them empty."""
    # White space other than single spaces is rare: texts without any are told by plain searches, the others meet a pattern. A line's words are counted where it is split off.
    raw, odd = F.col(text_col), F.lit(False)
    for x in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(raw, F.lit(x))
    text = F.lower(F.when(odd, F.regexp_replace(raw, r"\x20?[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20{2,}", " ")).otherwise(raw))
    counted = lambda x: F.struct(x.alias("norm"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.transform(F.split(text, "\n"), lambda x: counted(F.trim(x)))).alias("line_no", "line"))
    rows = rows.select("id", "line_no", "line.norm", "line.n").where(F.col("n") >= least)
    return rows if least > 1 else rows.where("norm <> ''")


def _hashed(lines: DataFrame, least: int, short: bool) -> DataFrame:
    """(id, line_no, h1, h2, n, halves): hashes of the line and of its first and last m words, m a half for either length a match may have; where there are short lines, those of under `least` words have no halves."""
    half = lambda m: F.array(F.xxhash64(F.expr(f"substring_index(norm, ' ', {m})"), F.lit("first"), F.expr(m)), F.xxhash64(F.expr(f"substring_index(norm, ' ', -{m})"), F.lit("last"), F.expr(m)))
    halves = F.when(F.col("n") % 2 == 0, half("(n div 2)")).otherwise(F.concat(half("(n div 2)"), half("(n div 2 + 1)")))
    halves = F.when(F.col("n") >= least, halves) if short else halves
    return lines.select("id", "line_no", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("2"), "norm").alias("h2"), "n", halves.alias("halves"))


RANK = ["none", "id", "line_no", "h1", "h2"]


def _parts(text: DataFrame) -> DataFrame:
    """(h1, h2, longer, start, size, key): the parts of each line, as the longer line of a pair and as the other one, with the hash of the line without the part. Of two words at least in the longer line, so no part is empty."""
    at = lambda p, total, count: F.floor(p * total / count).cast("int")

    def cut(longer: int) -> F.Column:
        total = F.col("n") + (1 - longer)  # words of the longer line
        count = F.least(F.floor(F.sqrt(total)).cast("int"), F.lit(PARTS))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.struct(F.lit(longer).alias("longer"), total.alias("total"), p.alias("p"), at(p, total, count).alias("start"), (total - at(p + 1, total, count)).alias("after")))

    x = text.select("h1", "h2", "n", "norm", F.explode(F.concat(cut(1), cut(0))).alias("x")).select("h1", "h2", "n", "norm", "x.*")
    key = F.expr("xxhash64(total, p, substring_index(norm, ' ', start), substring_index(norm, ' ', -after))")
    return x.select("h1", "h2", "longer", "start", (F.col("n") - F.col("start") - F.col("after")).alias("size"), key.alias("key"))


def _near(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: int, broadcast: int) -> DataFrame:
    """(h1, h2, keep_id, keep_line): distinct lines with an earlier line at one edit, and the earliest such line."""
    keys = distinct.select("h1", "h2", "id", "line_no", F.explode("halves").alias("key"))
    shared = materialise(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared-halves")
    n_shared = shared.count()
    met = keys.join(F.broadcast(shared.select("key")), "key", "left_semi") if n_shared <= broadcast else join_counted(thin(keys, F.col("key"), shared, F.col("key"), n_shared), shared, ["key"], "c", keys.count())
    few = materialise(met.select("h1", "h2", "id", "line_no").distinct(), "lines")
    at = few.select("h1", "h2", F.col("id").alias("f_id"), F.col("line_no").alias("f_line"))
    in_docs, n_few = at.select("f_id").distinct(), few.count()
    those = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if n_few <= broadcast:
        at = F.broadcast(at)
        text = _lines(those.join(F.broadcast(in_docs), F.col("id").eqNullSafe(F.col("f_id")), "left_semi"), "id", "text", least).withColumn("t1", F.xxhash64("norm"))
    else:  # neither texts nor most of their lines are shuffled
        text = _lines(thin(those, F.col("id"), in_docs, F.col("f_id"), n_few), "id", "text", least).withColumn("t1", F.xxhash64("norm"))
        text = thin(text, F.col("t1"), at, F.col("h1"), n_few)
    text = text.join(at, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("line_no") == F.col("f_line")) & (F.col("t1") == F.col("h1")))
    text = materialise(text.select("h1", "h2", "id", "line_no", "n", "norm").dropDuplicates(["h1", "h2"]), "norms")

    parts = _parts(text)
    shared = parts.groupBy("key").agg(F.sum("longer").alias("longs"), F.count("*").alias("c")).where("longs > 1 or longs > 0 and c > longs")
    shared = materialise(shared, "shared-parts")
    met = parts.join(F.broadcast(shared), "key") if shared.count() <= broadcast else join_counted(parts, shared, ["key"], "c", shared.agg(F.sum("c")).first()[0] or 0)
    # Lines meet their parts before they are cut into words, so the words aren't shuffled.
    inside = F.expr("substring_index(substring_index(norm, ' ', start + size), ' ', -size)")
    w = met.join(text.select("h1", "h2", F.col("id").isNull().alias("none"), "id", "line_no", "norm"), ["h1", "h2"])
    w = w.select("key", "h1", "h2", "none", "id", "line_no", "longer", "longs", "c", F.posexplode(F.split(inside, " ")).alias("i", "word"))
    placed = lambda seed, i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "word", i), 24)  # noqa: E731  40 bits: sums can't overflow
    w = w.select("*", *[placed(s, F.col("i") - d).alias(f"g{s}{d}") for s in (1, 2) for d in (0, 1)])
    line = Window.partitionBy("h1", "h2", "key")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    w = w.select("*", *[F.sum(f"g{s}{d}").over(o).alias(f"{name}{s}{d}") for s in (1, 2) for d in (0, 1) for name, o in (("all", line), ("to", upto))])
    rank = F.struct(*RANK)
    left_out = F.struct(F.lit("place").alias("kind"), "i", *[(F.col(f"all{s}0") - F.col(f"g{s}0")).alias(f"v{s}") for s in (1, 2)])
    closed = F.struct(F.lit("closed").alias("kind"), F.lit(-1).alias("i"), *[(F.col(f"to{s}0") - F.col(f"g{s}0") + F.col(f"all{s}1") - F.col(f"to{s}1")).alias(f"v{s}") for s in (1, 2)])
    whole = F.struct(F.lit("whole").alias("kind"), F.lit(-1).alias("i"), *[F.col(f"all{s}0").alias(f"v{s}") for s in (1, 2)])
    longer, others, shorter = F.col("longer") == 1, F.col("longs") > 1, F.col("c") > F.col("longs")
    of_word = F.when(longer & others & shorter, F.array(left_out, closed)).when(longer & others, F.array(left_out)).when(longer, F.array(closed)).when(F.col("i") == 0, F.array(whole))
    variants = materialise(w.select("key", rank.alias("own"), F.explode(of_word).alias("x")).select("key", "own", "x.*"), "variants")
    keys = ["key", "i", "v1", "v2"]
    kinds = {k: F.min(F.when(F.col("kind") == k, F.col("own"))).alias(k) for k in ("place", "closed", "whole")}
    found = variants.groupBy(*keys).agg(*kinds.values(), F.count("*").alias("c")).where("place is not null and c > 1 or closed is not null and whole is not null")
    met = materialise(found, "met")
    with_met = variants.join(F.broadcast(met.drop("c")), keys) if met.count() <= broadcast else join_counted(variants, met, keys, "c", variants.count())
    # A closed-up variant matches a whole line, and the other way round; two closed-up variants may be two edits apart.
    earliest = with_met.select("own", F.when(F.col("kind") == "place", F.col("place")).when(F.col("kind") == "closed", F.col("whole")).otherwise(F.col("closed")).alias("best"))
    earliest = earliest.where("best < own").groupBy("own").agg(F.min("best").alias("best"))

    a, b = F.split("a_norm", " "), F.split("b_norm", " ")
    pairs = earliest.select(F.col("own.h1").alias("h1"), F.col("own.h2").alias("h2"), F.col("best.id").alias("keep_id"), F.col("best.line_no").alias("keep_line"), F.col("best.h1").alias("b1"), F.col("best.h2").alias("b2"))
    pairs = materialise(pairs, "earliest")
    first = pairs.groupBy("b1", "b2").agg(F.count("*").alias("c"))  # the earliest line of a template may be that of very many
    first = materialise(text.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("norm").alias("b_norm")).join(first, ["b1", "b2"]), "first-lines")
    pairs = join_counted(pairs, first, ["b1", "b2"], "c", pairs.count()).join(text.select("h1", "h2", F.col("norm").alias("a_norm")), ["h1", "h2"])
    pairs = pairs.select("h1", "h2", "keep_id", "keep_line", F.when(F.size(a) >= F.size(b), a).otherwise(b).alias("long"), F.when(F.size(a) >= F.size(b), b).otherwise(a).alias("short"))
    same = F.coalesce(F.array_position(F.zip_with("long", "short", lambda x, y: x.eqNullSafe(y)), F.lit(False)), F.lit(0)).cast("int")  # first place they differ, from 1
    pairs = pairs.withColumn("p", same).where("p > 0")
    rest = lambda c, start: F.slice(c, start, F.greatest(F.size(c) - start + 1, F.lit(0)))
    p = F.col("p")
    one = F.when(F.size("long") == F.size("short"), rest(F.col("long"), p + 1) == rest(F.col("short"), p + 1)).otherwise(rest(F.col("long"), p + 1) == rest(F.col("short"), p))
    return pairs.where(one).select("h1", "h2", "keep_id", "keep_line")


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exact: int | None = None, broadcast: int = BROADCAST_LINES) -> DataFrame:
    """One row per removed line: id, line_no (from 0), keep_id, keep_line, exact (is it equal to a kept-or-earlier line)."""
    floor = least if exact is None else min(exact, least)
    found = materialise(_hashed(_lines(docs, id_col, text_col, floor), least, floor < least), "line-hashes")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "line_no")
    distinct = found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("c"), F.max("halves").alias("halves"))
    distinct = materialise(distinct.select("h1", "h2", F.col("first.id").alias("id"), F.col("first.line_no").alias("line_no"), "c", "halves"), "distinct-lines")
    near = settle(docs.sparkSession, lambda: _near(distinct, docs, id_col, text_col, least, broadcast), "near-lines")
    table = distinct.select("h1", "h2", "id", "line_no", "c").join(near, ["h1", "h2"], "left").where("c > 1 or keep_line is not null")
    equal = F.col("keep_line").isNull()
    table = table.select("h1", "h2", "c", F.when(equal, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("keep_line", "line_no").alias("keep_line"), equal.alias("exact"))
    table = materialise(table, "gone")
    gone = join_counted(found.select("id", "line_no", "h1", "h2"), table, ["h1", "h2"], "c", found.count())
    gone = gone.where(~(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("line_no") == F.col("keep_line"))))
    return gone.select("id", "line_no", "keep_id", "keep_line", "exact").distinct().withColumnRenamed("id", id_col)


def _marked(docs: DataFrame, id_col: str, text_col: str, least: int, exact: int | None = None, broadcast: int = BROADCAST_LINES) -> DataFrame:
    """(row, gone): every row of docs and the numbers of its removed lines in order, null where there are none."""
    lines = lambda: dropped(docs, id_col, text_col, least, exact, broadcast).groupBy(F.col(id_col).alias("gone_id")).agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    gone = settle(docs.sparkSession, lines, "gone-by-document")  # the tables of lines are gone before texts may be shuffled
    few = (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= broadcast
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Few numbers go to the texts; more are hashed and the texts go by them, instead of a sort of texts.
    return row.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), F.col(f"row.{id_col}").eqNullSafe(F.col("gone_id")), "left").select("row", "gone")


def _kept(text):
    """The lines between those that go, in slices, so that a text costs its number of lines. What is in an array of one is evaluated once."""
    lines, ends = F.array(F.split(text, "\n")), lambda x: F.array(F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(x))))
    part = lambda x, e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.slice(x, F.get(e, i - 1) + 2, F.get(e, i) - F.get(e, i - 1) - 1))
    return F.get(F.transform(lines, lambda x: F.get(F.transform(ends(x), lambda e: F.array_join(F.flatten(part(x, e)), "\n")), F.lit(0))), F.lit(0))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exact: int | None = None, broadcast: int = BROADCAST_LINES) -> DataFrame:
    """docs without the removed lines, all columns kept."""
    m = _marked(docs, id_col, text_col, least, exact, broadcast)
    text = F.when(F.col("gone").isNull(), F.col(f"row.{text_col}")).otherwise(_kept(F.col(f"row.{text_col}")))
    return m.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")


def report(docs: DataFrame, least: int = LEAST, exact: int = 1) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, text without the removed lines."""
    m = _marked(docs.select("doc_id", "text"), "doc_id", "text", least, exact)
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(_kept(F.col("row.text")))
    lines = F.coalesce(F.octet_length("row.text") - F.octet_length(F.replace("row.text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    return m.select("row.doc_id", lines.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"))


ORACLE = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
o AS (SELECT doc_id, line_no, lower(trim(regexp_replace(ln, '\\s+', ' ', 'g'))) AS norm FROM l),
w AS (SELECT *, string_split(norm, ' ') AS ws FROM o WHERE norm <> ''),
a AS (SELECT norm, any_value(ws) AS ws, min((doc_id, line_no)) AS first, count(*) AS c FROM w GROUP BY norm), d AS (FROM a WHERE len(ws) >= {LEAST}),
v AS (SELECT norm, first, i, array_to_string(ws[:i - 1], ' ') || ' | ' || array_to_string(ws[i + 1:], ' ') AS place, trim(array_to_string(ws[:i - 1], ' ') || ' ' || array_to_string(ws[i + 1:], ' ')) AS closed FROM d, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
pairs AS (SELECT a.norm, b.first AS best FROM v AS a JOIN v AS b ON a.place = b.place AND a.i = b.i AND b.first < a.first
  UNION ALL SELECT a.norm, d.first FROM v AS a JOIN d ON a.closed = d.norm WHERE d.first < a.first
  UNION ALL SELECT d.norm, b.first FROM d JOIN v AS b ON b.closed = d.norm WHERE b.first < d.first),
near AS (SELECT norm, min(best) AS best FROM pairs GROUP BY norm),
gone AS (SELECT DISTINCT doc_id, line_no FROM w JOIN a USING (norm) LEFT JOIN near USING (norm) WHERE (doc_id, line_no) <> coalesce(best, a.first))
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(gs), 0)::BIGINT AS n_dropped,
  CASE WHEN gs IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gs, i - 1)), chr(10)) END AS text
FROM documents LEFT JOIN (SELECT doc_id, list(line_no) AS gs FROM gone GROUP BY doc_id) USING (doc_id)"""
