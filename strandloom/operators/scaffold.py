"""Sequences with gaps: contigs between runs of N, and the gaps around them.

A sequence is dealt in chunks, so neither the Ns nor the contigs of a chromosome are one task's; stretches that cross edges of chunks are
put together by where they start. Only the chunks of a sequence, one row each, are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialise

#: Bases of a chunk.
CHUNK = 1 << 20


def _keyed(seqs: DataFrame) -> DataFrame:
    """(id, seq) with an id that is never null, so that joins by it need no second shuffle."""
    return seqs.select(F.coalesce(F.concat(F.lit("="), "seq_id"), F.lit("")).alias("id"), "seq")


def _named(df: DataFrame) -> DataFrame:
    name = F.when(F.col("id") != "", F.substring("id", F.lit(2), F.length("id"))).alias("seq_id")
    return df.select(name, *[c for c in df.columns if c != "id"])


def _runs(seqs: DataFrame, chunk: int) -> DataFrame:
    """(id, block, start, piece, goes_on, open): stretches without N of each chunk; do they go on from the chunk before, are they open to the next?"""
    raw = F.col("seq").cast("binary")
    base = lambda at: ~F.coalesce(F.substring(raw, at, F.lit(1)).cast("string"), F.lit("")).isin("", "N")

    def part(b):
        at = b * chunk
        return F.struct(b.alias("block"), ((b > 0) & base(at)).alias("goes_on"), base(at + chunk + 1).alias("open"), F.substring(raw, at + 1, F.lit(chunk)).cast("string").alias("part"))

    blocks = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / chunk).cast("int"))
    cut = seqs.where(F.length("seq") > 0).select("id", F.explode(F.transform(blocks, part)).alias("c")).select("id", "c.*")
    runs = cut.select("id", "block", "goes_on", "open", F.length("part").alias("size"), F.posexplode(F.regexp_extract_all("part", F.lit("(N+|[^N]+)"), F.lit(1))).alias("i", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy("id", "block").orderBy("i")) - F.length("piece")
    runs = runs.withColumn("before", before).where(~F.startswith("piece", F.lit("N")))
    goes_on, open_ = F.col("goes_on") & (F.col("before") == 0), F.col("open") & (F.col("before") + F.length("piece") == F.col("size"))
    return runs.select("id", "block", (F.col("block") * F.lit(chunk).cast("long") + F.col("before")).alias("start"), "piece", goes_on.alias("goes_on"), open_.alias("open"))


def _stretches(seqs: DataFrame, chunk: int) -> DataFrame:
    """(id, block, start, piece): stretches without N, each with the block it starts in and its start in the sequence."""
    whole = ["id", "block", "start", "piece"]
    longer = F.length("seq") > chunk
    if seqs.where(longer).isEmpty():
        return _runs(seqs, chunk).select(whole)
    # The parts of cut stretches, at most two a chunk, belong to the last start at or before them.
    runs = materialise(_runs(seqs.where(longer), chunk), "stretches")
    parts = runs.where("goes_on or open")
    head = F.last(F.when(~F.col("goes_on"), F.struct("start", "block")), True).over(Window.partitionBy("id").orderBy("start"))
    heads = parts.select("id", "start", "block", "goes_on").select("id", "start", head.alias("head"))
    joined = parts.select("id", "start", "piece").join(heads, ["id", "start"]).groupBy("id", "head").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("parts"))
    joined = joined.select("id", "head.block", "head.start", F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("piece"))
    inside = runs.where("not goes_on and not open").select(whole)
    return _runs(seqs.where(~longer), chunk).select(whole).unionByName(inside).unionByName(joined)


def _numbered(stretches: DataFrame, k: int) -> DataFrame:
    """stretches with `idx`, the number of those of at least k bases before it in the sequence: counted in its block, and by blocks before that."""
    long = (F.length("piece") >= k).cast("int")
    per = stretches.groupBy("id", "block").agg(F.sum(long).alias("n"))
    per = per.select("id", "block", (F.sum("n").over(Window.partitionBy("id").orderBy("block")) - F.col("n")).alias("earlier"))
    local = stretches.withColumn("here", F.sum(long).over(Window.partitionBy("id", "block").orderBy("start")) - long)
    return local.join(per, ["id", "block"]).select("id", "start", "piece", (F.col("here") + F.col("earlier")).cast("int").alias("idx"))


def contigs(seqs: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, contig_idx, start, seq): stretches without N of at least k bases. Ids are distinct; one may be null, and a null sequence has none."""
    found = _numbered(_stretches(_keyed(seqs), chunk).where(F.length("piece") >= k), k)
    return _named(found).select("seq_id", F.col("idx").alias("contig_idx"), "start", F.col("piece").alias("seq"))


def gaps_exact(seqs: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(seq_id, gap_idx, gap_len): what lies before, between and after the contigs; one row more than contigs."""
    seqs = _keyed(seqs)
    found = _numbered(_stretches(seqs, chunk).where(F.length("piece") >= k), k)
    ends = materialise(found.select("id", F.col("idx").alias("gap_idx"), "start", (F.col("start") + F.length("piece")).alias("end")), "contig-ends")
    return _named(_between(seqs, ends))


def _between(seqs: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, gap_idx, gap_len) of contigs (id, gap_idx, start, end): a gap begins where the contig before it ends, and ends where its own starts, or with the sequence."""
    begins = seqs.select("id", F.lit(0).alias("gap_idx"), F.lit(0).cast("long").alias("at"), F.coalesce(F.length("seq"), F.lit(0)).cast("long").alias("total"))
    later = ends.select("id", (F.col("gap_idx") + 1).alias("gap_idx"), F.col("end").alias("at"))
    both = begins.unionByName(later, allowMissingColumns=True).join(ends.select("id", "gap_idx", "start"), ["id", "gap_idx"], "left")
    closed = both.where("start is not null").select("id", "gap_idx", (F.col("start") - F.col("at")).alias("gap_len"))
    last = both.where("start is null").select("id", "gap_idx", "at").join(begins.select("id", "total"), "id")
    return closed.unionByName(last.select("id", "gap_idx", (F.col("total") - F.col("at")).alias("gap_len")))


def gaps_compat(seqs: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """Gaps as split on N counts them: the pieces between Ns in order, each empty one a unit longer, a short contig like its own length of gap.

    A leading run of g keeps its length, every inner one loses one, a record without bases gains one. An inner run is one before a
    stretch that isn't the sequence's first, so these are counted by gap.
    """
    seqs = _keyed(seqs)
    found = _numbered(_stretches(seqs, chunk), k).select("id", F.col("idx").alias("gap_idx"), "start", F.length("piece").alias("n"))
    found = materialise(found, "stretches")
    ends = found.where(F.col("n") >= k).select("id", "gap_idx", "start", (F.col("start") + F.col("n")).alias("end"))
    inner = found.groupBy("id", "gap_idx").agg(F.count("*").alias("stretches"))
    lost = F.coalesce("stretches", F.lit(0)) - F.when(F.col("gap_idx") == 0, 1).otherwise(0)
    return _named(_between(seqs, ends).join(inner, ["id", "gap_idx"], "left").select("id", "gap_idx", (F.col("gap_len") - lost).alias("gap_len")))


def assemble(pieces: DataFrame, gaps: DataFrame) -> DataFrame:
    """(seq_id, seq): gap, contig, gap, ..., from (seq_id, contig_idx, seq) and (seq_id, gap_idx, gap_len)."""
    a = gaps.select("seq_id", (F.col("gap_idx") * 2).alias("at"), F.expr("repeat('N', cast(gap_len as int))").alias("s"))
    b = pieces.select("seq_id", (F.col("contig_idx") * 2 + 1).alias("at"), F.col("seq").alias("s"))
    both = a.unionByName(b).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("x"))
    return both.select("seq_id", F.array_join(F.transform("x", lambda x: x["s"]), "").alias("seq"))
