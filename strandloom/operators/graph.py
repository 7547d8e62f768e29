"""Graphs of k-mer overlaps as DataFrames: nodes, oriented nodes, end k-mers and edges.

An oriented node is nid = 2 * id + is_rc; its reverse is nid ^ 1. A graph is stranded (one orientation a node) or canonical.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import minimizers
from strandloom.operators.ids import ordered_ids
from strandloom.session import materialise


CHUNK = 1 << 14
#: Stretches whose chains aren't known yet are chained on the driver once they are so few (40 bytes each).
FEW = 1 << 19


def positional_kmers(seqs: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(…, pos, kmer) of every ASCII sequence, pos from 0; with `canonical` also canon, the smaller of the k-mer and its reverse complement.

    Sequences are cut into chunks that overlap by k - 1 bases, so a chromosome in one row needs no array of its k-mers, and
    each chunk's reverse complement is taken once: the k-mers are slices of bytes.
    """
    keep = [c for c in seqs.columns if c != "seq"]
    cut = seqs.where(F.length("seq") >= k).select(*keep, F.col("seq").cast("binary").alias("__seq"), F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(CHUNK))).alias("__at"))
    part = F.substring("__seq", F.col("__at") + 1, F.lit(CHUNK + k - 1))
    cut = cut.select(*keep, "__at", part.alias("__part"), *([S.revcomp(part.cast("string")).cast("binary").alias("__back")] if canonical else []))
    size = F.octet_length("__part")
    rows = cut.select("*", size.alias("__n"), F.explode(F.sequence(F.lit(0), size - k)).alias("__i"))
    kmer = F.substring("__part", F.col("__i") + 1, F.lit(k)).cast("string")
    back = [F.least(kmer, F.substring("__back", F.col("__n") - k - F.col("__i") + 1, F.lit(k)).cast("string")).alias("canon")] if canonical else []
    return rows.select(*keep, (F.col("__at") + F.col("__i")).alias("pos"), kmer.alias("kmer"), *back)


def _chained(at: DataFrame) -> DataFrame:
    """The rows of `at` (start, to, head, steps, least) that point to another, chained to the end as in Graph._chains: those in rings still point somewhere."""
    todo = at.where("to is not null")
    ends = at.where("to is null").join(todo.select(F.col("to").alias("start")).distinct(), "start", "left_semi").select(*at.columns)
    rows = todo.unionByName(ends).toArrow()
    start, head, steps, least = (rows.column(c).to_numpy().copy() for c in ("start", "head", "steps", "least"))
    to = rows.column("to").fill_null(-1).to_numpy()
    order = np.argsort(start)
    to = np.where(to < 0, -1, order[np.minimum(np.searchsorted(start, to, sorter=order), len(order) - 1)])
    ours = to >= 0
    for _ in range(len(start).bit_length() + 1):
        on = np.flatnonzero(to >= 0)
        if not len(on):
            break
        b = to[on]
        to[on], head[on], steps[on], least[on] = to[b], head[b], steps[on] + steps[b], np.minimum(least[on], least[b])
    own = np.flatnonzero(ours)
    found = {"start": start[own], "to": pa.array(np.where(to[own] < 0, -1, start[np.maximum(to[own], 0)]), mask=to[own] < 0), "head": head[own], "steps": steps[own], "least": least[own]}
    return at.sparkSession.createDataFrame(pa.table(found), at.schema)


@dataclass
class Graph:
    """unitigs(id, seq) with its k and strandedness; the other tables are derived from it."""

    unitigs: DataFrame
    k: int
    stranded: bool
    _edges: DataFrame | None = field(default=None, repr=False)

    @staticmethod
    def from_unitigs(seqs: DataFrame, order: list[str], k: int, stranded: bool) -> Graph:
        """One node a row, ids by `order`."""
        return Graph(ordered_ids(seqs, order).select("id", "seq"), k, stranded)

    @staticmethod
    def from_sequences(seqs: DataFrame, order: list[str], k: int, stranded: bool, multiplicity: int = 1) -> Graph:
        """One node a distinct k-mer (of at least `multiplicity` occurrences) in the orientation seen first, ids by first occurrence. Not compacted.

        K-mers of up to 63 bases are counted by minimizers as pairs of longs; longer ones as strings.
        """
        if k <= minimizers.WIDEST:
            nodes = materialise(minimizers.nodes(seqs, order, k, not stranded, multiplicity), "nodes")  # placing them by range reads them twice
            return Graph.from_unitigs(nodes, ["first"], k, stranded)
        kmers = positional_kmers(seqs, k, not stranded).where(~F.contains("kmer", F.lit("N")))
        first = F.min(F.struct(*order, "pos", "kmer"))
        nodes = kmers.groupBy(F.col("kmer" if stranded else "canon").alias("key")).agg(first.alias("first"), F.count("*").alias("n")).where(F.col("n") >= multiplicity).select("first.*")
        nodes = materialise(nodes, "nodes")  # placing them by range reads them twice
        return Graph.from_unitigs(nodes.withColumnRenamed("kmer", "seq"), [*order, "pos"], k, stranded)

    def materialised(self) -> Graph:
        return Graph(materialise(self.unitigs, "unitigs"), self.k, self.stranded)

    def oriented(self) -> DataFrame:
        """(nid, seq)."""
        forward = self.unitigs.select((F.col("id") * 2).alias("nid"), "seq")
        if self.stranded:
            return forward
        return forward.unionByName(self.unitigs.select((F.col("id") * 2 + 1).alias("nid"), S.revcomp(F.col("seq")).alias("seq")))

    def sized_ends(self) -> DataFrame:
        """(side, kmer, nid, len): the first and last k-mer of every oriented node and its length; where several have one, a forward node is named."""
        o = self.oriented().select("nid", F.length("seq").alias("len"), F.left("seq", F.lit(self.k)).alias("l"), F.right("seq", F.lit(self.k)).alias("r"))
        both = o.select("nid", "len", F.explode(F.array(F.struct(F.lit("L").alias("side"), F.col("l").alias("kmer")), F.struct(F.lit("R").alias("side"), F.col("r").alias("kmer")))).alias("e")).select("nid", "len", "e.*")
        return both.groupBy("side", "kmer").agg(F.min(F.struct((F.col("nid") % 2).alias("rc"), "nid", "len")).alias("x")).select("side", "kmer", "x.nid", "x.len")

    def ends(self) -> DataFrame:
        """(side, kmer, nid)."""
        return self.sized_ends().drop("len")

    def duplicate_ends(self) -> DataFrame:
        """(side, kmer, n) of end k-mers that two nodes share, which a de Bruijn graph must not have."""
        u = self.unitigs
        both = u.select(F.lit("L").alias("side"), F.left("seq", F.lit(self.k)).alias("kmer")).unionByName(u.select(F.lit("R").alias("side"), F.right("seq", F.lit(self.k)).alias("kmer")))
        return both.groupBy("side", "kmer").agg(F.count("*").alias("n")).where("n > 1")

    def checked(self) -> Graph:
        """This graph; raises if end k-mers aren't unique or a node is shorter than k."""
        if not self.duplicate_ends().isEmpty() or not self.unitigs.where(F.length("seq") < self.k).isEmpty():
            raise ValueError("end k-mers aren't unique, or a node is shorter than k")
        return self

    def edge_table(self) -> DataFrame:
        """edges(), written once."""
        if self._edges is None:
            self._edges = materialise(self.edges(), "edges")
        return self._edges

    def edges(self) -> DataFrame:
        """(src, dst, base): base is the 2-bit code of the nucleotide that the step adds."""
        step = self.oriented().select(F.col("nid").alias("src"), F.right("seq", F.lit(self.k)).alias("last"))
        step = step.select("src", "last", F.explode(F.array(*[F.lit(b) for b in S.BASES])).alias("b"))
        step = step.select("src", S.base_code(F.col("b")).alias("base"), S.extend_right(F.col("last"), F.col("b")).alias("kmer"))
        return step.join(self.ends().where("side = 'L'").select("kmer", F.col("nid").alias("dst")), "kmer").select("src", "dst", "base")

    def neighbours(self, side: str) -> DataFrame:
        """(nid, neighbours): in A, C, T, G order of the base at that side, comma-joined; empty where there are none."""
        if side == "R":
            found = self.edges().select(F.col("src").alias("nid"), "base", F.col("dst").alias("to"))
        else:
            o = self.oriented().select("nid", F.left("seq", F.lit(self.k)).alias("first"), F.explode(F.array(*[F.lit(b) for b in S.BASES])).alias("b"))
            o = o.select("nid", S.base_code(F.col("b")).alias("base"), S.extend_left(F.col("first"), F.col("b")).alias("kmer"))
            found = o.join(self.ends().where("side = 'R'").select("kmer", F.col("nid").alias("to")), "kmer").select("nid", "base", "to")
        listed = found.groupBy("nid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "to"))), lambda x: x["to"].cast("string")), ",").alias("neighbours"))
        return self.oriented().select("nid").join(listed, "nid", "left").select("nid", F.coalesce("neighbours", F.lit("")).alias("neighbours"))

    def search(self, kmers: DataFrame, side: str) -> DataFrame:
        """kmers with nid of the node that has the k-mer at that end, null where none has."""
        return kmers.join(self.ends().where(F.col("side") == side).select("kmer", "nid"), "kmer", "left")

    def search_anywhere(self, kmers: DataFrame, how: str = "left") -> DataFrame:
        """kmers with (nid, offset) wherever in an oriented node the k-mer lies."""
        index = positional_kmers(self.oriented(), self.k).select("kmer", "nid", F.col("pos").alias("offset"))
        return kmers.join(index, "kmer", how)

    def stats(self) -> DataFrame:
        """One row: k, stranded, nodes, edges, avg_length. A canonical graph's edges count once for both directions."""
        n = self.unitigs.agg(F.count("*").alias("nodes"), F.avg(F.length("seq")).alias("avg_length"))
        e = self.edges().agg((F.count("*") / (1 if self.stranded else 2)).alias("edges"))
        return n.crossJoin(e).select(F.lit(self.k).alias("k"), F.lit(self.stranded).alias("stranded"), "nodes", "edges", "avg_length")

    def printed(self) -> DataFrame:
        return self.unitigs.orderBy("id").select(F.format_string("Node %d: %s", "id", "seq").alias("line"))

    def save(self, path: str) -> None:
        self.unitigs.write.parquet(f"{path}/unitigs")
        meta = self.unitigs.agg(F.bit_xor(F.xxhash64("id", "seq")).alias("fingerprint")).select(F.lit(self.k).alias("k"), F.lit(self.stranded).alias("stranded"), F.coalesce("fingerprint", F.lit(0)).alias("fingerprint"))
        meta.coalesce(1).write.parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        meta = spark.read.parquet(f"{path}/meta").first()
        return Graph(spark.read.parquet(f"{path}/unitigs"), meta.k, meta.stranded)

    def fingerprint(self) -> int:
        return self.unitigs.agg(F.bit_xor(F.xxhash64("id", "seq"))).first()[0] or 0

    def compacted(self) -> Graph:
        """Unitigs: chains of nodes whose joints have no other edge; ids by the least node of each. In a canonical graph, a k-mer that is its own reverse complement joins nothing.

        Joints are contracted where they lie, by minimizers; what is left are far fewer stretches, which pointer doubling chains.
        """
        if 2 <= self.k <= minimizers.WIDEST + 1:
            joints = minimizers.joints(self.oriented(), self.k, not self.stranded)
        else:
            joints = self._joints()
        stretches = materialise(minimizers.contracted(joints), "stretches")
        chains, cut = self._chains(stretches)
        if cut is not None:
            # Cycles are cut before their least node, and its reverse after it.
            joints = stretches.select(F.when(F.col("off") == 1, F.col("start")).otherwise(F.lag("nid").over(Window.partitionBy("start").orderBy("off"))).alias("src"), F.col("nid").alias("dst"))
            cut_dst, cut_src = cut.where("nid % 2 = 0").select(F.col("nid").alias("dst")), cut.where("nid % 2 = 1").select(F.col("nid").alias("src"))
            stretches = materialise(minimizers.contracted(joints.join(cut_dst, "dst", "left_anti").join(cut_src, "src", "left_anti").select("src", "dst")), "stretches")
            chains, cut = self._chains(stretches)
        return self._spelled(stretches, chains)

    def _joints(self) -> DataFrame:
        """minimizers.joints for k-mers of any length, as strings."""
        j = F.lit(self.k - 1)
        ends = self.oriented().select("nid", F.explode(F.array(F.struct(F.left("seq", j).alias("j"), F.lit(False).alias("out")), F.struct(F.right("seq", j).alias("j"), F.lit(True).alias("out")))).alias("e")).select("nid", "e.*")
        src, dst = F.when(F.col("out"), F.col("nid")), F.when(~F.col("out"), F.col("nid"))
        met = ends.groupBy("j").agg(F.max(src).alias("src"), F.max(dst).alias("dst"), F.count(src).alias("o"), F.count(dst).alias("i")).where("o = 1 and i = 1 and src <> dst").select("src", "dst")
        return met if self.stranded else met.where(F.col("dst") != F.col("src").bitwiseXOR(1))

    def _chains(self, stretches: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(start, head, steps) of stretches: the first node of the chain each is in and the steps from it; and (nid) of the nodes where cycles are to be cut, if there are any."""
        number = F.col("nid") if self.stranded else F.shiftright("nid", 1)
        least = stretches.groupBy("start").agg(F.min(number).alias("least"))
        ends = stretches.where("last").select("start", F.col("nid").alias("end"), F.col("off").alias("n")).join(least, "start")
        ends = materialise(ends, "stretch-ends")
        before = ends.select(F.col("end").alias("start"), F.col("start").alias("to"), F.col("n").alias("steps"))
        # to: a stretch further back, null at the head of a chain; steps: from `head` to this stretch's start.
        at = ends.select("start", "least").join(before, "start", "left")
        at = materialise(at.select("start", "to", F.coalesce("to", "start").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"), "least"), "chain")
        for _ in range(ends.count().bit_length() + 1):
            left = at.where("to is not null").count()
            if left == 0:
                break
            if left <= FEW:
                at = at.where("to is null").unionByName(_chained(at))
                break
            b = at.select(F.col("start").alias("to"), F.col("to").alias("to2"), F.col("head").alias("h2"), F.col("steps").alias("s2"), F.col("least").alias("l2"))
            on = at.where("to is not null").join(b, "to").select("start", F.col("to2").alias("to"), F.col("h2").alias("head"), (F.col("steps") + F.col("s2")).alias("steps"), F.least("least", "l2").alias("least"))
            at = materialise(at.where("to is null").unionByName(on), "chain")
        rings = at.where("to is not null").select("start", F.col("least").alias("ring"))
        if rings.isEmpty():
            return at.select("start", "head", "steps"), None
        cut = stretches.join(rings, "start").where((F.col("nid") == F.col("ring")) if self.stranded else (number == F.col("ring"))).select("nid")
        return at.select("start", "head", "steps"), materialise(cut, "cuts")

    def _spelled(self, stretches: DataFrame, chains: DataFrame) -> Graph:
        """Unitigs of nodes along their chains."""
        nodes = self.oriented()
        at = stretches.join(chains, "start").select("nid", "head", (F.col("steps") + F.col("off")).alias("steps"))
        at = nodes.select("nid").join(at, "nid", "left").select("nid", F.coalesce("head", "nid").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"))
        piece = F.when(F.col("steps") == 0, F.col("seq")).otherwise(F.substring("seq", F.lit(self.k), F.length("seq")))
        pieces = at.join(nodes, "nid").groupBy("head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("steps", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"), F.min("nid").alias("low"))
        if not self.stranded:  # of a chain and its reverse, the one with the least sequence stays
            pieces = pieces.withColumn("key", S.canonical(F.col("seq"))).groupBy("key").agg(F.min("low").alias("low"), F.first("key").alias("seq"))
        return Graph.from_unitigs(pieces.select("low", "seq"), ["low"], self.k, self.stranded)
