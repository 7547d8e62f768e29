"""FASTA and FASTQ in BGZF files (gzip in blocks, as bgzip writes them), read by ranges of blocks in many tasks."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.session import ship

MAGIC = b"\x1f\x8b\x08\x04"
#: No block is longer, compressed or not.
LARGEST = 1 << 16
SPLIT = 8 << 20
SCHEMA = "file string, block long, at long, header string, seq string, quality string"
BATCH_BYTES = 16 << 20


def open_file(path: str) -> tuple[pa.NativeFile, int]:
    """The file at a path or URI of a file system that pyarrow knows, and its size."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(name), fs.get_file_info(name).size


def block_size(head: bytes) -> int | None:
    """Bytes of the block that begins with head, or None where no block begins."""
    if head[:4] != MAGIC or len(head) < 18:
        return None
    extra, at = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while at + 4 <= len(extra):
        n = int.from_bytes(extra[at + 2 : at + 4], "little")
        if extra[at : at + 2] == b"BC" and n == 2:
            return int.from_bytes(extra[at + 4 : at + 6], "little") + 1
        at += 4 + n
    return None


def is_bgzf(path: str) -> bool:
    try:
        f, size = open_file(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):  # a file system of Spark's alone: the file is read as any gzip file
        return False
    with f:
        return size > 0 and block_size(f.read(LARGEST)) is not None


def inflate(block: bytes) -> bytes:
    """A block's text; zlib checks its length and checksum."""
    return zlib.decompress(block, 31)


def first_block(f: pa.NativeFile, at: int, size: int) -> int:
    """Where the first block at or after `at` begins; one that only looks like a block fails its checksum."""
    f.seek(at)
    window = f.read(2 * LARGEST)
    here = window.find(MAGIC) if at else 0
    while 0 <= here < LARGEST:
        n = block_size(window[here:])
        if n is not None and here + n <= len(window):
            try:
                inflate(window[here : here + n])
                return at + here
            except zlib.error:
                pass
        here = window.find(MAGIC, here + 1)
    if size - at <= LARGEST:
        return size
    raise ValueError(f"no BGZF block after byte {at}")


def blocks(f: pa.NativeFile, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(where it ends, text) of the blocks from `at` on. A block that is cut or changed raises."""
    while at < size:
        f.seek(at)
        head = f.read(LARGEST)
        n = block_size(head)
        if n is None or n > len(head):
            raise ValueError(f"BGZF file is cut or damaged at byte {at}")
        try:
            text = inflate(head[:n])
        except zlib.error as e:
            raise ValueError(f"BGZF file is cut or damaged at byte {at}: {e}") from e
        at += n
        yield at, text


@dataclass
class Range(InputPartition):
    """The blocks of a file that begin in [low, high)."""

    file: str
    low: int
    high: int
    sign: bytes


def _text(r: Range) -> tuple[bytearray, int]:
    """The text of a range's blocks and of what its last record needs beyond them, and the size of the former."""
    f, size = open_file(r.file)
    with f:
        text, start = bytearray(), first_block(f, r.low, size)
        if start >= r.high:
            return text, 0
        it, end = blocks(f, start, size), start
        while end < r.high:
            got = next(it, None)
            if got is None:
                break
            end, part = got
            text += part
        own, looked = len(text), len(text)
        # A record is the range's that has the newline before it. The last one ends with the next record, or for FASTQ after four lines.
        lines = 0
        for _, part in it if own else []:
            text += part
            if r.sign == b">":
                if text.find(b"\n>", max(own, looked - 1)) >= 0:
                    break
            else:
                lines += part.count(b"\n")
                if lines > 4:
                    break
            looked = len(text)
        return text, own


def fasta_records(text: bytearray, own: int, first: bool) -> Iterator[tuple[str, str, None]]:
    start = 0 if first else text.find(b"\n>") + 1
    if not first and not 0 < start <= own:
        return
    stop = text.find(b"\n>", max(own, start))
    body = bytes(text[start : stop if stop >= 0 else len(text)]).replace(b"\r", b"")
    for i, record in enumerate(body.lstrip().split(b"\n>")):
        header, _, seq = (record[1:] if i == 0 else record).partition(b"\n")
        if header.strip() or seq.strip():
            yield header.decode(), b"".join(seq.split()).decode(), None


def fastq_records(text: bytearray, own: int, first: bool, file: str) -> Iterator[tuple[str, str, str]]:
    """Records of four lines. The first record of a range is at the first line with '@' whose next but one has '+': qualities that begin with '@' have bases there."""
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1])
    line = lambda i: bytes(text[starts[i] : starts[i + 1] - 1 if i + 1 < len(starts) else len(text)]).rstrip(b"\r") if i < len(starts) else b""
    n = int(np.searchsorted(starts, own, "right"))
    if first:
        at = next((i for i in range(n) if line(i).strip()), n)
    else:
        at = next((i for i in range(1, n) if line(i)[:1] == b"@" and line(i + 2)[:1] == b"+"), n)
    while at < n:
        h, seq, plus, quality = (line(at + j) for j in range(4))
        if not (h or seq or plus or quality) and not bytes(text[starts[at] :]).strip():
            return
        if h[:1] != b"@" or plus[:1] != b"+" or len(seq) != len(quality):
            raise ValueError(f"no FASTQ record: {h[:80].decode(errors='replace')!r} of {file}")
        yield h[1:].decode(), seq.decode(), quality.decode()
        at += 4


class BgzfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.split = json.loads(options["files"]), int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        out = []
        for file in self.files:
            f, size = open_file(file)
            with f:
                sign = next((t for _, b in blocks(f, 0, size) if (t := b.lstrip()[:1])), None)
            if sign is None:
                continue
            if sign not in (b">", b"@"):
                raise ValueError(f"neither FASTA nor FASTQ: {file}")
            out += [Range(file, low, min(low + self.split, size), sign) for low in range(0, size, self.split)]
        return out or [Range("", 0, 0, b"")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        text, own = _text(partition)
        first = partition.low == 0
        records = fasta_records(text, own, first) if partition.sign == b">" else fastq_records(text, own, first, partition.file)
        held, size = [], 0
        for at, r in enumerate(records):
            held.append((partition.file, partition.low, at, *r))
            size += len(r[0]) + len(r[1])
            if size >= BATCH_BYTES:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class BgzfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandloom_bgzf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BgzfReader:
        return BgzfReader(self.options)


def read_bgzf(spark: SparkSession, files: list[str], split: int = SPLIT) -> DataFrame:
    """(file, block, at, header, seq, quality) of BGZF files of FASTA or FASTQ, one task for every `split` compressed bytes; (file, block, at) orders the records as the files do.

    A record is read by the task that has the newline before it, to its end, so records go over edges of tasks; quality is null for FASTA.
    Blocks that are cut or changed raise (a file that ends between two blocks can't be told from a whole one), and so do records that aren't FASTQ and files of another first sign. Empty files have no records.
    """
    ship(spark)
    spark.dataSource.register(BgzfSource)
    return spark.read.format("strandloom_bgzf").option("files", json.dumps(files)).option("split", split).load()
