"""python -m strandloom.cli build | cluster | stats-g | encode | decode | stats-p | all; on a cluster through spark-submit, whose master and settings it keeps."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strandloom.operators.encode import Params
from strandloom.operators.graph import Graph
from strandloom.plans import pipeline
from strandloom.session import get_session, scratch
from strandloom.sources import fasta


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("build", help="a graph of unitigs")
    c.add_argument("-k", type=int, required=True)
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-f", "--forward-only", action="store_true", help="k-mers and their reverse complements are apart")
    c = sub.add_parser("cluster", help="records of genomes dealt into clusters around the records of the first genome")
    c.add_argument("-k", type=int, required=True)
    c.add_argument("-i", "--input", required=True, nargs="+", help="FASTA files, one a genome")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--sketch", type=int, help="estimate from so many hashes a record")
    c = sub.add_parser("stats-g", help="k, nodes, edges and lengths of a graph")
    c.add_argument("-g", "--graph", required=True)
    c = sub.add_parser("encode", help="sequences over a graph")
    for a in ("-i", "-o", "-g"):
        c.add_argument(a, {"-i": "--input", "-o": "--output", "-g": "--graph"}[a], required=True)
    c.add_argument("--min-rep", type=int, default=Params.min_rep)
    c.add_argument("--min-depth", type=int, default=Params.min_sp)
    c.add_argument("--max-depth", type=int, default=Params.max_sp)
    c.add_argument("--max-contig-nodes", type=int, help="encode longer walks in pieces")
    c = sub.add_parser("decode", help="back to FASTA")
    for a in ("-i", "-o", "-g"):
        c.add_argument(a, {"-i": "--input", "-o": "--output", "-g": "--graph"}[a], required=True)
    c = sub.add_parser("stats-p", help="extensions and nodes of an encoding")
    c.add_argument("-i", "--input", required=True)
    c = sub.add_parser("all", help="clusters of genomes, a graph and an encoding of each")
    c.add_argument("-k", type=int, required=True)
    c.add_argument("-i", "--input", required=True, nargs="+", help="files, one a genome")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-f", "--forward-only", action="store_true", help="k-mers and their reverse complements are apart")
    c.add_argument("--one-graph", action="store_true", help="no clusters")
    c.add_argument("--sketch", type=int, help="estimate clusters from so many hashes a record")
    a = p.parse_args(args)
    spark = get_session()
    with scratch(spark):
        run(spark, a)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "build":
        pipeline.build(spark, a.input, a.output, a.k, a.forward_only)
    elif a.command == "cluster":
        pipeline.split_by_cluster(spark, a.input, a.output, a.k, a.sketch).groupBy("cluster").count().show(truncate=False)
    elif a.command == "stats-g":
        Graph.load(spark, a.graph).stats().show(truncate=False)
    elif a.command == "encode":
        params = Params(a.min_depth, a.max_depth, a.min_rep, max_contig_nodes=a.max_contig_nodes)
        trims = pipeline.encode(fasta.sequences(fasta.read_sequences(spark, a.input)), Graph.load(spark, a.graph), a.output, params)
        trims.groupBy("status").count().show()
    elif a.command == "decode":
        fasta.write_fasta(pipeline.decode(spark, a.input, Graph.load(spark, a.graph)), a.output)
    elif a.command == "all":
        for name in pipeline.whole(spark, a.input, a.output, a.k, not a.one_graph, a.forward_only, a.sketch):
            print(name)
            pipeline.statistics(spark, f"{a.output}/encodings/{name}").show(truncate=False)
    else:
        pipeline.statistics(spark, a.input).show(truncate=False)


if __name__ == "__main__":
    main()
