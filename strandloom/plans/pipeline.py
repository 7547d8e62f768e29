"""Whole jobs: build a graph, encode sequences over it, decode them, report statistics."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import cluster
from strandloom.operators import encode as enc
from strandloom.operators import parse, scaffold, walk
from strandloom.operators.graph import Graph
from strandloom.operators.ids import ordered_ids
from strandloom.session import materialise, scratch
from strandloom.sources import fasta


def build(spark: SparkSession, unitig_files: str | list[str], out: str, k: int, stranded: bool = False) -> Graph:
    """Unitigs of FASTA files as a saved graph; ids are the records' places in the files, which follow each other by path."""
    records = fasta.read_sequences(spark, unitig_files, place=True)
    numbered = ordered_ids(records, fasta.PLACE).select("id", S.normalise(F.col("seq")).alias("seq"))
    graph = Graph(materialise(numbered, "unitigs"), k, stranded).checked()
    graph.save(out)
    return Graph.load(spark, out)


def encode(seqs: DataFrame, graph: Graph, out: str, params: enc.Params = enc.Params(), block: int = parse.BLOCK) -> DataFrame:
    """Encode (seq_id, seq) into tables under out: extensions, trims (with statuses), gaps, meta. Returns the trims.

    Contigs strictly inside a node are walks of that node. Those that don't embed keep their status, and their bases count as dropped;
    nothing is dropped silently. If a walk has over `block` nodes, all are encoded in blocks of so many, which gives the same extensions;
    params.max_contig_nodes cuts walks instead.
    """
    seqs = materialise(seqs, "sequences")
    contigs = materialise(scaffold.contigs(seqs, graph.k), "contigs")
    walks, trims = walk.embed(contigs, graph)
    walks = materialise(walks, "walks")
    blocks = params.max_contig_nodes is None and not walks.where(F.col("step") >= block).isEmpty()
    (parse.greedy(walks, graph, params, block) if blocks else enc.greedy(walks, graph, params)).write.parquet(f"{out}/extensions")
    trims.join(contigs.select("seq_id", "contig_idx", F.length("seq").alias("bases")), ["seq_id", "contig_idx"]).write.parquet(f"{out}/trims")
    scaffold.gaps_exact(seqs, graph.k).write.parquet(f"{out}/gaps")
    spark = seqs.sparkSession
    spark.createDataFrame([(graph.fingerprint(), graph.k)], "fingerprint long, k int").coalesce(1).write.parquet(f"{out}/meta")
    return spark.read.parquet(f"{out}/trims")


def decode(spark: SparkSession, encoded: str, graph: Graph) -> DataFrame:
    """(seq_id, seq) of an encoding; contigs that didn't embed are stretches of N. Raises where the graph isn't the one it was made with."""
    if spark.read.parquet(f"{encoded}/meta").first().fingerprint != graph.fingerprint():
        raise ValueError("the encoding was made with another graph")
    trims, gaps = spark.read.parquet(f"{encoded}/trims"), spark.read.parquet(f"{encoded}/gaps")
    walks = enc.decode(spark.read.parquet(f"{encoded}/extensions"), graph)
    pieces = walk.extract(walks, trims, graph)
    lost = trims.where("status <> 'OK'").select("seq_id", "contig_idx", F.expr("repeat('N', bases)").alias("seq"))
    return scaffold.assemble(pieces.unionByName(lost), gaps)


def statistics(spark: SparkSession, encoded: str) -> DataFrame:
    """The table of extensions and nodes by kind. Nodes are counted from the trims, so nothing is decoded."""
    ext, trims = spark.read.parquet(f"{encoded}/extensions"), spark.read.parquet(f"{encoded}/trims")
    return enc.stats_table(ext, trims.where("status = 'OK'").agg(F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("nodes")))


def _records(spark: SparkSession, genomes: str | list[str]) -> DataFrame:
    """(genome, record, seq) of files, one file a genome."""
    found = fasta.read_sequences(spark, genomes, place=True)
    genome = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.(fa|fna|fasta|fq|fastq)(\.b?gz)?$", "")
    return materialise(found.select(genome.alias("genome"), S.sanitise_id(F.col("header")).alias("record"), S.normalise(F.col("seq")).alias("seq")), "records")


def split_by_cluster(spark: SparkSession, genomes: str | list[str], out: str, k: int, sketch_size: int | None = None) -> DataFrame:
    """Deal the records of files, one file a genome, into one folder of sequences a cluster. The genome that is first by name seeds the clusters.

    Returns (genome, record, cluster), which is written too. Records of one name in several genomes stay apart.
    """
    records = _records(spark, genomes)
    placed = _placed(records, out, k, sketch_size)
    named = records.join(placed, ["genome", "record"]).select("cluster", F.concat(F.lit(">"), "genome", F.lit("|"), "record", F.lit("\n"), "seq").alias("value"))
    named.write.partitionBy("cluster").text(f"{out}/sequences")
    return placed


def _placed(records: DataFrame, out: str, k: int, sketch_size: int | None) -> DataFrame:
    first = records.agg(F.min("genome")).first()[0]
    cluster.communities(records, first, k, sketch_size).write.parquet(f"{out}/clusters")
    return records.sparkSession.read.parquet(f"{out}/clusters")


def whole(spark: SparkSession, genomes: str | list[str], out: str, k: int, clusters: bool = True, stranded: bool = False, sketch_size: int | None = None, params: enc.Params = enc.Params()) -> list[str]:
    """From files, one a genome, to encodings: the records are dealt into clusters (or are one, named `all`), and each cluster gets a graph of its unitigs and an encoding.

    Writes clusters, sequences (seq_id, seq, by cluster), graphs/<name> and encodings/<name> under out, and returns the names, which are
    the clusters' with signs that paths can't have escaped. Ids are genome|record; a genome's records should have distinct names. There
    are as many clusters as the first genome has records: they are done one after the other, each by jobs over all executors.
    """
    records = _records(spark, genomes)
    if clusters:
        records = records.join(_placed(records, out, k, sketch_size), ["genome", "record"])
    else:
        records = records.withColumn("cluster", F.lit("all"))
    named = records.select(F.concat_ws("|", "genome", "record").alias("seq_id"), "seq", "cluster")
    named.write.partitionBy("cluster").parquet(f"{out}/sequences")
    named = spark.read.schema("seq_id string, seq string, cluster string").parquet(f"{out}/sequences")
    done = []
    for (name,) in sorted(named.select("cluster").distinct().collect()):
        seqs, folder = named.where(F.col("cluster") == name).select("seq_id", "seq"), quote(name, safe=" ")
        with scratch(spark):
            Graph.from_sequences(seqs, ["seq_id"], k, stranded).materialised().compacted().checked().save(f"{out}/graphs/{folder}")
            encode(seqs, Graph.load(spark, f"{out}/graphs/{folder}"), f"{out}/encodings/{folder}", params)
        done.append(folder)
    return done
