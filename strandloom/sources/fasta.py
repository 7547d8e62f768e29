"""FASTA and FASTQ in and out, record splitting, and the text formats around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators.ids import ordered_ids
from strandloom.sources import bgzf


#: Where a record stands, in order: file, part of the file, place in that part.
PLACE = ["file", "block", "at"]


def read_fasta(spark: SparkSession, path: str | list[str], place: bool = False) -> DataFrame:
    """(header, seq) of FASTA files, compressed or not, and with `place` also PLACE. Records are split where a line starts with '>', so files are read in parallel."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")] if place else []
    rows = rows.select(*where, F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "").alias("v")).where("trim(v) <> ''")
    return rows.select(*(PLACE if place else []), F.substring_index("v", "\n", 1).alias("header"), F.when(F.contains("v", F.lit("\n")), F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\\n', 1)) + 2)"), r"\s+", "")).otherwise("").alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str], place: bool = False) -> DataFrame:
    """(header, seq, quality) of FASTQ files, and with `place` also PLACE, of four lines a record; lines are numbered by file and place, without a global sort in one task.

    A record without '@', without '+', or with as many signs of quality as it has not bases raises.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = ordered_ids(lines.where("trim(value) <> ''"), ["file", "block", "at"], "line")
    first = lines.groupBy("file").agg(F.min("line").alias("first"))
    numbered = lines.join(first, "file").withColumn("n", F.col("line") - F.col("first"))
    numbered = numbered.select("file", F.floor(F.col("n") / 4).alias("record"), (F.col("n") % 4).alias("i"), F.regexp_replace("value", "\r", "").alias("value"))
    per = numbered.groupBy("file", "record").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(c) for i, c in enumerate(("h", "seq", "plus", "quality"))])
    right = F.startswith("h", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length("quality"))
    wrong = F.raise_error(F.concat(F.lit("no FASTQ record: line "), (F.col("record") * 4 + 1).cast("string"), F.lit(" of "), F.col("file")))
    where = [F.col("file"), F.lit(0).cast("long").alias("block"), F.col("record").alias("at")] if place else []
    return per.select(*where, F.when(F.coalesce(right, F.lit(False)), F.substring("h", F.lit(2), F.length("h"))).otherwise(wrong).alias("header"), "seq", "quality")


def read_sequences(spark: SparkSession, path: str | list[str], place: bool = False) -> DataFrame:
    """(header, seq) of FASTA and FASTQ files, told apart by the first sign of each file, and with `place` also PLACE; another first sign raises, an empty file has no records.

    BGZF files are read by ranges of blocks in many tasks, other compressed files in one task each.
    """
    found: dict[str, list[str]] = {">": [], "@": [], "bgzf": []}
    for file in sorted(spark.read.text(path).inputFiles()):
        if file.endswith((".gz", ".bgz")) and bgzf.is_bgzf(file):
            found["bgzf"].append(file)
            continue
        first = spark.read.text(file).where("trim(value) <> ''").first()
        if first is None:
            continue
        sign = first.value.lstrip()[:1]
        if sign not in found:
            raise ValueError(f"neither FASTA nor FASTQ: {file}")
        found[sign].append(file)
    columns = [*(PLACE if place else []), "header", "seq"]
    out = read_fasta(spark, found[">"], place) if found[">"] else spark.createDataFrame([], ", ".join({"block": "block long", "at": "at long"}.get(c, f"{c} string") for c in columns))
    if found["@"]:
        out = out.unionByName(read_fastq(spark, found["@"], place).select(columns))
    out = out.unionByName(bgzf.read_bgzf(spark, found["bgzf"]).select(columns)) if found["bgzf"] else out
    # Local paths come with one slash or three; PLACE orders them by name alone.
    return out.withColumn("file", F.regexp_replace("file", "^file:/+", "file:///")) if place else out


def write_fasta(seqs: DataFrame, path: str, header: str = "seq_id") -> None:
    """'>id' and the sequence on one line."""
    seqs.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def split_records(records: DataFrame, path: str) -> None:
    """One folder a record name, made safe; records of one name stay together instead of replacing each other."""
    named = records.select(S.sanitise_id(F.col("header")).alias("name"), F.concat(F.lit(">"), "header", F.lit("\n"), "seq").alias("value"))
    named.write.partitionBy("name").text(path)


def sequences(records: DataFrame) -> DataFrame:
    """(seq_id, seq) ready to embed: ids are first words, sequences normalised."""
    return records.select(F.substring_index("header", " ", 1).alias("seq_id"), S.normalise(F.col("seq")).alias("seq"))


def _tsv_lines(spark: SparkSession, path: str, skip: int) -> tuple[DataFrame, DataFrame]:
    """Lines after the first `skip` of each file, and those first ones with their numbers from 1."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    w = Window.partitionBy("file").orderBy("block", "at")
    head = lines.where("block = 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= skip)
    return lines.join(head.select("file", "block", "at"), ["file", "block", "at"], "left_anti"), head


def read_tsv(spark: SparkSession, path: str, schema: str, skip: int = 4, header: bool = False) -> DataFrame:
    """Tab-separated rows after `skip` lines of each file, and with `header` one more that names the columns."""
    rows, _ = _tsv_lines(spark, path, skip + header)
    return rows.select(F.from_csv("value", F.lit(schema), {"sep": "\t"}).alias("x")).select("x.*")


def read_wide(spark: SparkSession, path: str, skip: int = 4) -> DataFrame:
    """(gram, genome, cnt) of tables with a column per genome: the line after `skip` names the columns, the first one the grams. Each file has its own header; empty cells give no rows."""
    rows, head = _tsv_lines(spark, path, skip + 1)
    names = head.where(F.col("r") == skip + 1).select("file", F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("names"))
    cells = rows.where("trim(value) <> ''").join(F.broadcast(names), "file").select("names", F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("v"))
    cells = cells.select(F.get("v", F.lit(0)).alias("gram"), F.posexplode(F.slice("v", F.lit(2), F.size("v"))).alias("i", "cnt"), "names")
    return cells.select("gram", F.get("names", F.col("i") + 1).alias("genome"), F.col("cnt").try_cast("bigint").alias("cnt")).where("cnt is not null")


def write_wide(counts: DataFrame, path: str, notes: list[str]) -> None:
    """read_wide's format in one folder: notes first, then names, then a row a gram with 0 where a genome lacks it. Every file has the notes and the names."""
    genomes = [r.genome for r in counts.select("genome").distinct().orderBy("genome").collect()]
    wide = counts.groupBy("gram").pivot("genome", genomes).agg(F.sum("cnt"))
    line = F.concat_ws("\t", "gram", *[F.coalesce(F.col(f"`{g}`"), F.lit(0)).cast("string") for g in genomes])
    text = "\n".join([*notes, "\t".join(["gram", *genomes])])
    part = F.spark_partition_id()
    rows = wide.select(part.alias("p"), F.lit(1).alias("o"), line.alias("value"))
    heads = rows.select("p").distinct().select("p", F.lit(0).alias("o"), F.lit(text).alias("value"))
    rows.unionByName(heads).repartition("p").sortWithinPartitions("p", "o").select("value", "p").write.partitionBy("p").text(path)


def parse_sizes(lines: DataFrame) -> DataFrame:
    """(n, k, filetype, filesize) of `ls -l` lines of files whose names end in <n>.k<k>.<type>, or <n>_k<k>.<type>."""
    pattern = r"(\d+)\s+\S+\s+\d+\s+\S+\s+\S*?(\d+)[._]k(\d+)\.(\w+)$"
    x = lambda i: F.regexp_extract("value", pattern, i)
    return lines.where(F.col("value").rlike(pattern)).select(x(2).cast("int").alias("n"), x(3).cast("int").alias("k"), x(4).alias("filetype"), x(1).cast("bigint").alias("filesize"))


def parse_extensions(lines: DataFrame) -> DataFrame:
    """(type, length) of log lines R:a-b and SP:n, and of nucleotides NN."""
    kind = F.regexp_extract("value", r"^(R|SP|NN)\b", 1)
    length = F.when(kind == "NN", F.lit(1)).otherwise(F.regexp_extract("value", r"^(?:R|SP):(\d+)", 1).try_cast("int"))
    return lines.select(kind.alias("type"), length.alias("length")).where("type <> '' and length is not null")


def parse_stats(lines: DataFrame) -> DataFrame:
    """(n, k, nodes, edges, avg_length) of the text that graph statistics print, one line a file: '<n>.k<k>... nodes: a edges: b average length: c', in any order and with any words between."""
    number = lambda name: F.regexp_extract("value", rf"(?i){name}[^0-9\n]*?([0-9][0-9_,]*(?:\.[0-9]+)?)", 1)
    whole = lambda x: F.regexp_replace(x, "[_,]", "").try_cast("bigint")
    name = r"(\d+)[._]k(\d+)"
    rows = lines.where(F.col("value").rlike(name) & F.col("value").rlike("(?i)nodes?"))
    return rows.select(
        F.regexp_extract("value", name, 1).cast("int").alias("n"), F.regexp_extract("value", name, 2).cast("int").alias("k"), whole(number("nodes?")).alias("nodes"),
        whole(number("edges?")).alias("edges"), F.regexp_replace(number("(?:average|avg)[ _a-z]*len[a-z]*"), "[_,]", "").try_cast("double").alias("avg_length"),
    )
