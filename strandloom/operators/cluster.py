"""Containment of k-mer sets, best clusters, and grams of consecutive nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.graph import positional_kmers
from strandloom.session import materialise


def kmer_sets(seqs: DataFrame, name: str, k: int) -> DataFrame:
    """(name, kmer): distinct canonical k-mers of all sequences of a name."""
    rows = positional_kmers(seqs.select(name, "seq"), k, True)
    return rows.where(~F.contains("kmer", F.lit("N"))).select(name, F.col("canon").alias("kmer")).distinct()


def containment(queries: DataFrame, references: DataFrame, k: int, zeros: bool = False) -> DataFrame:
    """queries (query, seq) x references (reference, seq) -> (query, reference, common, size, score): the share of the query's k-mers that the reference has.

    Only pairs with common k-mers meet, by a join on k-mers with partial counts, and only they are listed; with `zeros` every pair of names is.
    """
    q, r = materialise(kmer_sets(queries, "query", k), "query-kmers"), kmer_sets(references, "reference", k)
    size = q.groupBy("query").agg(F.count("*").alias("size"))
    common = q.join(r, "kmer").groupBy("query", "reference").agg(F.count("*").alias("common"))
    if zeros:
        names = size.join(F.broadcast(r.select("reference").distinct()), how="cross")
        out = names.join(common, ["query", "reference"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    else:
        out = common.join(size, "query")
    return out.select("query", "reference", "common", "size", (F.col("common") / F.col("size")).alias("score"))


def best(matrix: DataFrame) -> DataFrame:
    """(query, reference, score): the reference of the best score, the first by name of equal ones."""
    top = matrix.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "reference")).alias("x"))
    return top.select("query", "x.reference", (-F.col("x.s")).alias("score"))


def sketch(seqs: DataFrame, name: str, k: int, size: int = 1000) -> DataFrame:
    """(name, hashes): the `size` least hashes of the distinct canonical k-mers, for approximate containment."""
    h = kmer_sets(seqs, name, k).select(name, F.xxhash64("kmer").alias("h"))
    w = Window.partitionBy(name).orderBy("h")
    return h.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).groupBy(name).agg(F.sort_array(F.collect_list("h")).alias("hashes"))


def sketched_containment(queries: DataFrame, references: DataFrame, k: int, size: int = 1000) -> DataFrame:
    """containment() as an estimate: (query, reference, common, size, score) over the hashes of both sketches that are below the least of their two largest ones.

    A full sketch says nothing about hashes above its largest one; one that isn't full holds all hashes of its name. Sketches of the pairs with a common hash meet.
    """
    s = lambda df, name: sketch(df, name, k, size).select(name, F.explode("hashes").alias("h"), F.when(F.size("hashes") == size, F.array_max("hashes")).alias(f"top_{name}"))
    q, r = materialise(s(queries, "query"), "query-sketches"), materialise(s(references, "reference"), "reference-sketches")
    pairs = q.join(r, "h").groupBy("query", "reference").agg(F.count("*").alias("common"), F.least(F.max("top_query"), F.max("top_reference")).alias("top"))
    sizes = pairs.join(q.select("query", "h"), "query").where("top is null or h <= top").groupBy("query", "reference").agg(F.count("*").alias("size"))
    out = pairs.join(sizes, ["query", "reference"])
    return out.select("query", "reference", "common", "size", (F.col("common") / F.col("size")).alias("score"))


def grams(walks: DataFrame, g: int, genome: str) -> DataFrame:
    """(gram, genome, cnt): runs of g consecutive nodes, counted per genome."""
    key = [genome, "seq_id", "contig_idx"] if genome != "seq_id" else ["seq_id", "contig_idx"]
    w = Window.partitionBy(*key).orderBy("step")
    cols = [F.lead("nid", i).over(w).cast("string") for i in range(g)]
    rows = walks.select(F.col(genome).alias("genome"), F.concat_ws("-", *cols).alias("gram"), F.lead("nid", g - 1).over(w).alias("last")).where("last is not null")
    return rows.groupBy("gram", "genome").agg(F.count("*").alias("cnt"))


def coverage(counts: DataFrame) -> DataFrame:
    """(gram, genomes, total)."""
    return counts.groupBy("gram").agg(F.count_if(F.col("cnt") > 0).alias("genomes"), F.sum("cnt").alias("total"))


def rarity(counts: DataFrame) -> DataFrame:
    """(genomes, grams, percent): how many grams are in so many genomes."""
    h = coverage(counts).groupBy("genomes").agg(F.count("*").alias("grams"))
    return h.select("genomes", "grams", (100 * F.col("grams") / F.sum("grams").over(Window.partitionBy(F.lit(1)))).alias("percent"))


def summary(counts: DataFrame) -> DataFrame:
    """One row: grams, unique ones, means and medians of genomes with and without grams seen once."""
    c = coverage(counts)
    return c.agg(
        F.count("*").alias("grams"), F.count_if(F.col("total") == 1).alias("uniques"), F.avg("genomes").alias("mean"), F.median("genomes").alias("median"),
        F.avg(F.when(F.col("total") > 1, F.col("genomes"))).alias("mean_repeated"), F.median(F.when(F.col("total") > 1, F.col("genomes"))).alias("median_repeated"),
    )


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(type, length, n) of (type, length): bins of one, centred on whole numbers."""
    return lengths.groupBy("type", "length").agg(F.count("*").alias("n"))


def cost_model(lengths: DataFrame) -> DataFrame:
    """(type, total_length, n, mean_length, cost, percent_length, percent_cost), with a total row. NN costs 2 a base, R 16 and SP 20 each."""
    per = lengths.groupBy("type").agg(F.sum("length").alias("total_length"), F.count("*").alias("n"))
    per = per.withColumn("cost", F.when(F.col("type") == "NN", 2 * F.col("total_length")).when(F.col("type") == "R", 16 * F.col("n")).otherwise(20 * F.col("n")))
    both = per.rollup("type").agg(*[F.sum(c).alias(c) for c in ("total_length", "n", "cost")])
    w = Window.partitionBy(F.lit(1))
    share = lambda c: F.try_divide(100 * F.col(c), F.max(F.when(F.col("type").isNull(), F.col(c))).over(w))
    return both.select(F.coalesce("type", F.lit("total")).alias("type"), "total_length", "n", F.try_divide("total_length", "n").alias("mean_length"), "cost", share("total_length").alias("percent_length"), share("cost").alias("percent_cost"))


def classify(lengths: DataFrame, least_sp: int = 8) -> DataFrame:
    """(type, length): shortest paths of under least_sp nodes count as nucleotides."""
    return lengths.select(F.when((F.col("type") == "SP") & (F.col("length") < least_sp), "NN").otherwise(F.col("type")).alias("type"), "length")


def communities(records: DataFrame, first: str, k: int, sketch_size: int | None = None) -> DataFrame:
    """(genome, record, cluster) of (genome, record, seq): each record of the first genome seeds a cluster, and every other record joins the one that holds most of its k-mers.

    Records are told apart by genome and name. One that has no k-mer in common with any seed joins the first seed by name. With
    sketch_size, containment is estimated from sketches of that many hashes.
    """
    seeds = records.where(F.col("genome") == first).select(F.col("record").alias("reference"), "seq")
    key = F.to_json(F.struct("genome", "record"))
    others = records.where(F.col("genome") != first)
    asked = others.select(key.alias("query"), "seq")
    matrix = containment(asked, seeds, k) if sketch_size is None else sketched_containment(asked, seeds, k, sketch_size)
    placed = others.select("genome", "record", key.alias("query")).distinct().join(best(matrix).select("query", "reference"), "query", "left")
    least = seeds.agg(F.min("reference")).first()[0]
    placed = placed.select("genome", "record", F.coalesce("reference", F.lit(least)).alias("cluster"))
    return seeds.select(F.lit(first).alias("genome"), F.col("reference").alias("record"), F.col("reference").alias("cluster")).distinct().unionByName(placed)
