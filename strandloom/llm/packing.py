"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Texts are tokenised in a map (once) and cut into whole sequences and a rest. Only piece lengths, checksums and ids go on,
never tokens. The histogram has at most `size` lengths, so the packing itself, which counts patterns of lengths
instead of packing pieces, is a small driver step whatever the corpus holds. Every length's pieces get gapless
ranks from a range-partitioned sort (no task holds one length), and rank intervals lead back to pattern slots.

Defined cases: null and empty texts are the end id alone. A piece never spans sequences. Repeated rows are packed as
often as they come. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import words as W
from strandloom.llm.worker import remembered, tidy
from strandloom.session import materialise, ship

SIZE = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
CACHED = 150_000  # words that a worker remembers, twice
#: Letters whose small forms are single letters too and that no normal form changes.
LATIN = [c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
# How this vocabulary splits a text, for texts of ASCII and these letters only.
SIMPLE = re.compile("[\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-/:-@\\[-`{-~]+")
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


class Remembered:
    """At most 2 * size entries: what hasn't been asked for since the last turn goes first."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Encoder:
    """Token ids as little-endian bytes.

    This vocabulary drops white space, makes small letters and splits a text into words, digits and runs of signs. Texts of ASCII and
    Latin-1 letters are split here, and each word is encoded by the vocabulary's model once and remembered; every
    other text, and one that spells a special token, goes through the whole tokenizer.
    """

    def __init__(self, path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.model = self.tokenizer.model
        self.simple = path is None  # the split above is that of the default vocabulary
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spell = str.maketrans({c: spelled.pre_tokenize_str(chr(c))[0][0] for c in LATIN})
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words = Remembered(CACHED)

    def encode(self, text: bytes) -> bytes:
        t = text.decode("utf-8", "replace")
        if not self.simple or "<|" in t or not SIMPLE.fullmatch(t):
            return b"".join([self.id_bytes[i] for i in self.tokenizer.encode(t, add_special_tokens=False).ids])
        words = SPLIT.findall(t.lower())
        get = self.words.new.get
        out = [get(w) for w in words]
        if None in out:
            out = [x or self.word(w) for x, w in zip(out, words, strict=True)]
        return b"".join(out)

    def word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            got = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(w.translate(self.spell))])
            self.words.put(w, got)
        return got


def _pieces(path: str | None, end_id: int, size: int):
    def run(batches):
        encoder, end = remembered(("packing", path), lambda: Encoder(path)), np.array([end_id], "<u4").tobytes()
        for b in batches:
            data, off = W.raw(b.column("text"))
            of, out = [], []
            for row in range(len(b)):
                ids = encoder.encode(data[off[row] : off[row + 1]].tobytes()) + end
                n = len(ids) // 4
                for at in range(0, n, size):
                    of.append(row)
                    out.append((at, min(size, n - at), zlib.crc32(ids[4 * at : 4 * (at + size)]), n))
            cols = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(of, pa.int64())), *cols], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, size: int = SIZE) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens): whole sequences first, then the rest of a text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_pieces(path, end_id, size), keep=True), f"id {kind}, {PIECE}").withColumnRenamed("id", id_col)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, their lengths). Longest lengths first, each into the open pattern with the most room."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, held in room.items() if held and s >= length), default=None)
            if space is None:
                room.setdefault(size - length, []).append((left, (length,)))
                break
            n, held = room[space].pop()
            fill = min(n, left)
            if n > fill:
                room[space].append((n - fill, held))
            room.setdefault(space - length, []).append((fill, (*held, length)))
            left -= fill
    return [x for s in sorted(room) for x in room[s]]


def slots(packed: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, sequences, first sequence, offset), ordered by length and rank."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for n, held in packed:
        offset = 0
        for length in held:
            first = rank.get(length, 0)
            out.append((length, first, n, sequence, offset))
            rank[length] = first + n
            offset += length
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _placed(plan, runs):
    def run(batches):
        p, r = plan.value, runs.value  # runs: partition, length, index of its first piece, rank of that piece
        slot_key = p[:, 0] * (1 << 48) + p[:, 1]
        run_key = r[:, 0] * (1 << 16) + r[:, 1]
        for b in batches:
            mid, length = (b.column(c).to_numpy(zero_copy_only=False) for c in ("mid", "length"))
            of = np.searchsorted(run_key, (mid >> 33) * (1 << 16) + length)
            rank = (mid & ((1 << 33) - 1)) - r[of, 2] + r[of, 3]
            at = np.searchsorted(slot_key, length * (1 << 48) + rank, "right") - 1
            cols = [b.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(p[at, 3] + rank - p[at, 1]), pa.array(p[at, 4])], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, size: int = SIZE) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. size is at most 65535."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, id_col, text_col, path, end_id, size).withColumnRenamed(id_col, "id"), "pieces")
    histogram = dict(cut.groupBy("length").count().collect())
    plan = slots(patterns(histogram, size))
    order = ["length", "id", "start"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = materialise(cut.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("mid", 33)
    runs = ranked.groupBy(part.alias("part"), "length").agg(F.min(F.col("mid").bitwiseAND((1 << 33) - 1)).alias("first"), F.count("*").alias("n")).collect()
    seen: dict[int, int] = {}
    table = []
    for r in sorted(runs, key=lambda r: (r.part, r.length)):
        table.append((r.part, r.length, r.first, seen.get(r.length, 0)))
        seen[r.length] = table[-1][3] + r.n
    share = spark.sparkContext.broadcast
    kind = cut.schema["id"].dataType.simpleString()
    out = ranked.mapInArrow(_placed(share(plan), share(np.array(table, np.int64).reshape(-1, 4))), f"id {kind}, {PIECE}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
