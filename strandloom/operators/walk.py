"""Sequences as walks of oriented nodes, by joins of their k-mers with the nodes' ends.

Only k-mers, positions and node numbers are shuffled; node strings are compared in pieces, and only those of nodes longer than k.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.graph import Graph, positional_kmers
from strandloom.operators.ids import row_numbers
from strandloom.session import materialise, ship

KEY = ["seq_id", "contig_idx"]
#: Ends of graphs up to this many nodes are broadcast (up to four rows a node); those of larger ones meet the k-mers in a shuffle.
BROADCAST_NODES = 250_000
PIECE = 1024


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Hits on the chain from the first one; for contigs in which a palindromic end gives a hit off the chain."""
    at, keep = pdf.pos.min(), []
    by = {p: i for p, i in zip(pdf.pos, pdf.index, strict=True)}
    while at in by:
        keep.append(by[at])
        at = pdf.next.at[by[at]]
    return pdf.loc[keep]


def hits(contigs: DataFrame, graph: Graph, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(seq_id, contig_idx, pos, nid, len, next): nodes that start at pos, which is negative for a first node that starts before the contig."""
    k = graph.k
    ends = graph.sized_ends()
    if graph.unitigs.count() <= broadcast_nodes:
        ends = F.broadcast(ends)
    met = positional_kmers(contigs.select(*KEY, "seq"), k).join(ends, "kmer").select(*KEY, "side", "pos", "nid", "len")
    met = materialise(met, "ends-met")
    right = F.min(F.when(F.col("side") == "R", F.struct("pos", "nid", "len")))
    per = met.groupBy(*KEY).agg(F.max((F.col("side") == "L") & (F.col("pos") == 0)).alias("at_start"), right.alias("x"))
    per = per.select(*KEY, "at_start", F.col("x.pos").alias("r"), F.col("x.nid").alias("r_nid"), F.col("x.len").alias("r_len")).where("at_start or r is not null")
    left = met.where("side = 'L'").join(per.select(*KEY, "at_start", "r"), KEY).where("at_start or pos > r")
    left = left.select(*KEY, "pos", "nid", "len", (F.col("pos") + F.col("len") - k + 1).alias("next"))
    first = per.where("not at_start").select(*KEY, (F.col("r") + k - F.col("r_len")).alias("pos"), F.col("r_nid").alias("nid"), F.col("r_len").alias("len"), (F.col("r") + 1).alias("next"))
    found = materialise(left.unionByName(first), "hits")
    # A contig is one chain if all its hits but one are followed by another hit, each by its own.
    followed = found.join(found.select(*KEY, F.col("pos").alias("next")), [*KEY, "next"], "left_semi").groupBy(*KEY, "next").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count("*").alias("f"))
    whole = found.groupBy(*KEY).agg(F.count("*").alias("n")).join(followed, KEY, "left")
    odd = materialise(whole.where(F.coalesce("f", F.lit(0)) != F.col("n") - 1).select(*KEY), "unchained")
    if odd.isEmpty():
        return found
    ship(contigs.sparkSession)
    chained = found.join(odd, KEY, "left_semi").groupBy(*KEY).applyInPandas(_chain, found.schema)
    return materialise(found.join(odd, KEY, "left_anti").unionByName(chained), "chains")


def _unequal(contigs: DataFrame, graph: Graph, found: DataFrame) -> DataFrame:
    """Contigs in which a node that is longer than k differs from what it covers. Both are compared in pieces, so no row holds a whole contig beside a hit."""
    covered = found.where(F.col("len") > graph.k).join(contigs.select(*KEY, F.length("seq").alias("total")), KEY)
    start = F.greatest("pos", F.lit(0))
    rows = covered.select(*KEY, "pos", "nid", start.alias("from"), F.least(F.col("pos") + F.col("len"), F.col("total")).alias("to")).where(F.col("from") < F.col("to"))
    rows = rows.select(*KEY, "nid", "pos", "to", F.explode(F.expr(f"sequence(from, to - 1, {PIECE})")).alias("at")).withColumn("n", F.least(F.lit(PIECE), F.col("to") - F.col("at")))
    block = (F.col("at") / PIECE).cast("int")
    text = contigs.select(*KEY, F.col("seq").cast("binary").alias("b"), F.explode(F.sequence(F.lit(0), F.length("seq"), F.lit(PIECE))).alias("base"))
    text = text.select(*KEY, (F.col("base") / PIECE).cast("int").alias("block"), F.substring("b", F.col("base") + 1, F.lit(2 * PIECE)).alias("part"))
    own = F.substring("part", F.col("at") - F.col("block") * PIECE + 1, F.col("n"))
    rows = rows.withColumn("block", block).join(text, [*KEY, "block"]).select(*KEY, "nid", (F.col("at") - F.col("pos")).alias("off"), "n", own.alias("own"))
    nodes = graph.oriented().where(F.length("seq") > graph.k).select("nid", F.col("seq").cast("binary").alias("node"))
    return rows.join(nodes, "nid").where(F.substring("node", F.col("off") + 1, F.col("n")) != F.col("own")).select(*KEY).distinct()


def _status(contigs: DataFrame, graph: Graph, found: DataFrame) -> DataFrame:
    k = graph.k
    per = found.groupBy(*KEY).agg(F.max(F.struct("pos", "next", "len")).alias("last"), F.min("pos").alias("first"), F.count("*").alias("n_nodes"))
    wrong = _unequal(contigs, graph, found).withColumn("unequal", F.lit(True))
    out = contigs.select(*KEY, F.length("seq").alias("total")).join(per, KEY, "left").join(wrong, KEY, "left")
    status = (
        F.when(F.col("total") < k, "TOO_SHORT").when(F.col("n_nodes").isNull(), "INSIDE_NODE").when(F.col("unequal"), "UNITIG_NOT_MATCHING")
        .when(F.col("last.next") + k <= F.col("total"), "KMER_NOT_FOUND").otherwise("OK")
    )
    ok = status == "OK"
    return out.select(
        *KEY, status.alias("status"), F.when(ok, F.greatest(-F.col("first"), F.lit(0))).cast("int").alias("start_offset"),
        F.when(ok, F.col("last.pos") + F.col("last.len") - F.col("total")).cast("int").alias("end_offset"), F.when(ok, F.col("n_nodes")).alias("n_nodes"),
    )


def _within(contigs: DataFrame, graph: Graph) -> DataFrame:
    """(seq_id, contig_idx, nid, start_offset, end_offset) of contigs that lie in one node, wherever in it."""
    first = contigs.select(*KEY, "seq", F.left("seq", F.lit(graph.k)).alias("kmer"))
    at = graph.search_anywhere(first, "inner").join(graph.oriented().withColumnRenamed("seq", "node"), "nid")
    n = F.length("seq")
    at = at.where(F.substring(F.col("node").cast("binary"), F.col("offset") + 1, n) == F.col("seq").cast("binary"))
    x = F.min(F.struct("nid", F.col("offset").alias("start_offset"), (F.length("node") - F.col("offset") - n).alias("end_offset")))
    return at.groupBy(*KEY).agg(x.alias("x")).select(*KEY, "x.*")


def embed(contigs: DataFrame, graph: Graph, inside: bool = True, broadcast_nodes: int = BROADCAST_NODES) -> tuple[DataFrame, DataFrame]:
    """(walks, trims) of contigs (seq_id, contig_idx, seq).

    walks: seq_id, contig_idx, step, pos, nid. trims: seq_id, contig_idx, status, start_offset, end_offset, n_nodes; the last three are
    null unless status is OK. With `inside`, a contig that lies strictly in one node is a walk of that node; else it keeps the status INSIDE_NODE.
    """
    found = hits(contigs, graph, broadcast_nodes)
    trims = materialise(_status(contigs, graph, found), "trims")
    rows = found.join(trims.where("status = 'OK'").select(*KEY), KEY, "left_semi").select(*KEY, F.greatest("pos", F.lit(0)).alias("pos"), "nid")
    walks = row_numbers(rows, KEY, "pos", "step").select(*KEY, "step", "pos", "nid")
    lost = trims.where("status = 'INSIDE_NODE'").select(*KEY)
    if not inside or lost.isEmpty():
        return walks, trims
    more = materialise(_within(contigs.join(lost, KEY, "left_semi"), graph), "within")
    walks = walks.unionByName(more.select(*KEY, F.lit(0).alias("step"), F.lit(0).alias("pos"), "nid"))
    both = trims.join(more.select(*KEY, F.col("start_offset").alias("a"), F.col("end_offset").alias("b")), KEY, "left")
    trims = both.select(
        *KEY, F.when(F.col("a").isNotNull(), "OK").otherwise(F.col("status")).alias("status"), F.coalesce("a", "start_offset").alias("start_offset"),
        F.coalesce("b", "end_offset").alias("end_offset"), F.when(F.col("a").isNotNull(), F.lit(1).cast("long")).otherwise(F.col("n_nodes")).alias("n_nodes"),
    )
    return walks, trims


def walk(contigs: DataFrame, graph: Graph) -> DataFrame:
    """(seq_id, contig_idx, step, pos, nid) for the contigs whose status is OK."""
    return embed(contigs, graph, False)[0]


def offsets(contigs: DataFrame, graph: Graph) -> DataFrame:
    """(seq_id, contig_idx, status, start_offset, end_offset, n_nodes); the last three are null unless status is OK."""
    return embed(contigs, graph, False)[1]


def spell(walks: DataFrame, graph: Graph) -> DataFrame:
    """(seq_id, contig_idx, spelled): whole nodes, overlapping by k - 1."""
    rows = walks.join(graph.oriented(), "nid")
    piece = F.when(F.col("step") == 0, F.col("seq")).otherwise(F.substring("seq", F.lit(graph.k), F.length("seq")))
    return rows.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", piece.alias("p")))), lambda x: x["p"]), "").alias("spelled"))


def extract(walks: DataFrame, trims: DataFrame, graph: Graph) -> DataFrame:
    """(seq_id, contig_idx, seq): the contigs as they were."""
    s = spell(walks, graph).join(trims.where("status = 'OK'"), KEY)
    return s.select(*KEY, F.expr("substring(spelled, start_offset + 1, length(spelled) - start_offset - end_offset)").alias("seq"))
