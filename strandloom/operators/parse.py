"""One walk over many tasks: repetitions and the greedy encoding of whole walks, equal to what a single task finds.

A walk is cut into blocks. Runs that go on over edges of blocks come from one number a block and offset. Where an encoder goes next
from a step is a function of the step, so each block tells where those who enter it leave it, and the steps that are really entered
are found by doubling these moves. Joins are by ids that are never null.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import paths
from strandloom.operators.encode import ANCHOR, EXT, KEY, MAX_RUN, Params
from strandloom.operators.encode import greedy as greedy_in_one
from strandloom.operators.graph import Graph
from strandloom.operators.groups import map_groups
from strandloom.operators.ids import row_numbers
from strandloom.operators.paths import Adjacency
from strandloom.session import materialise

#: Steps of a block.
BLOCK = 1 << 16
BLOCK_KEY = [*KEY, "block"]
# Rows of a block that aren't nodes come before them, by these places.
NEXT, SIZE, ARRIVAL, ENTRY = (-(1 << 62) + i for i in range(4))


def _keyed(walks: DataFrame) -> DataFrame:
    return walks.select(F.coalesce(F.concat(F.lit("="), "seq_id"), F.lit("")).alias("seq_id"), "contig_idx", F.col("step").cast("long").alias("step"), F.col("nid").cast("long").alias("nid"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("seq_id", F.when(F.col("seq_id") != "", F.substring("seq_id", F.lit(2), F.length("seq_id"))))


def _dealt(walks: DataFrame, block: int, before: int = 0, after: int = 0) -> DataFrame:
    """(BLOCK_KEY, place, value): each block's nodes by step, with so many of those before and after it."""
    home, at = F.floor(F.col("step") / block).cast("int"), F.col("step") % block
    blocks = F.array_compact(F.array(home, F.when(at >= block - before, home + 1), F.when((at < after) & (home > 0), home - 1)))
    return walks.select(*KEY, F.explode(blocks).alias("block"), F.col("step").alias("place"), F.col("nid").alias("value"))


def _reached(moves: DataFrame, starts: DataFrame) -> DataFrame:
    """(KEY, at): starts and all that is reached from them by moves (KEY, at, to), which go forward. As many rounds as the logarithm of the longest way."""
    found, moves = materialise(starts.select(*KEY, "at").distinct(), "reached"), materialise(moves.select(*KEY, "at", "to").distinct(), "moves")
    while not moves.isEmpty():
        further = found.join(moves, [*KEY, "at"]).select(*KEY, F.col("to").alias("at"))
        found = materialise(found.unionByName(further).distinct(), "reached")
        moves = materialise(moves.join(moves.select(*KEY, F.col("at").alias("to"), F.col("to").alias("next")), [*KEY, "to"]).select(*KEY, "at", F.col("next").alias("to")), "moves")
    return found


def _number(packed, i):
    """The i-th of packed 8-byte numbers."""
    return F.conv(F.hex(F.substring(packed, (8 * i + 1).cast("int"), F.lit(8))), 16, 10).cast("long")


def _repetitions(walks: DataFrame, params: Params, block: int) -> DataFrame:
    most = params.max_offset + 1
    block = max(block, most)
    dealt = materialise(_dealt(walks, block, before=most), "walk-blocks")

    def edge(key: tuple, c: dict[str, list]) -> list[tuple]:
        """Where the runs that come into a block stop in it, by offset."""
        start, path = key[2] * block, np.array(c["value"])
        own = start - c["place"][0]
        if key[2] == 0 or own >= len(path):
            return []
        out = []
        for o in range(most):
            differ = np.flatnonzero(path[own:] != path[own - o - 1 : len(path) - o - 1])
            out.append((*key, o, start + int(differ[0]) if len(differ) else None, start + len(path) - own))
        return out

    stops = map_groups(dealt, BLOCK_KEY, "place", edge, "seq_id string, contig_idx int, block int, o int, stop long, end long")
    w = Window.partitionBy(*KEY, "o").orderBy("block")
    stop = F.coalesce(F.first("stop", True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.max("end").over(Window.partitionBy(*KEY, "o")))
    stops = stops.select(*KEY, (F.col("block") - 1).alias("block"), (-1 - F.col("o")).cast("long").alias("place"), stop.alias("value"))

    def moves(key: tuple, c: dict[str, list]) -> list[tuple]:
        """Each step's longest run, and where those who enter at it leave the block."""
        place, value, start = np.array(c["place"]), np.array(c["value"]), key[2] * block
        path = value[place >= 0]
        first = int(place[place >= 0][0]) if len(path) else 0
        own = start - first
        if own >= len(path):
            return []
        end, n = first + len(path), len(path) - own
        onward = {int(-1 - p): int(v) for p, v in zip(place[place < 0], value[place < 0], strict=True)}
        at = np.arange(start, end)
        best_run, best_off = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for o in range(most):
            skip = max(0, o + 1 - start)  # steps of the walk's beginning that have nothing so far back
            if skip >= n:
                break
            same = path[own + skip :] == path[own + skip - o - 1 : len(path) - o - 1]
            stop = np.where(same, onward.get(o, end), at[skip:])
            run = np.minimum.accumulate(stop[::-1])[::-1] - at[skip:]
            better = run > best_run[skip:]
            best_run[skip:][better], best_off[skip:][better] = run[better], o
        run = np.where((best_run >= params.min_rep) & (at > 0), np.minimum(best_run, MAX_RUN), 0)
        leave = (at + np.maximum(run, 1)).tolist()
        for i in range(n - 1, -1, -1):
            if leave[i] < end:
                leave[i] = leave[leave[i] - start]
        leave = np.array(leave)
        return [(*key, leave.astype(">i8").tobytes(), np.unique(leave).astype(">i8").tobytes(), run.astype("<i4").tobytes(), best_off.astype("u1").tobytes())]

    ways = map_groups(dealt.unionByName(stops), BLOCK_KEY, "place", moves, "seq_id string, contig_idx int, block int, leave binary, outs binary, run binary, off binary")
    ways = materialise(ways, "ways")
    outs = F.transform(F.sequence(F.lit(0), (F.octet_length("outs") / 8 - 1).cast("int")), lambda i: _number(F.col("outs"), i))
    entered = ways.select(*KEY, F.explode(outs).alias("at")).distinct().withColumn("block", F.floor(F.col("at") / block).cast("int"))
    here = entered.join(ways.select(*BLOCK_KEY, "leave"), BLOCK_KEY).where(F.col("at") - F.col("block") * block < F.octet_length("leave") / 8)
    jumps = here.select(*KEY, "at", _number(F.col("leave"), F.col("at") - F.col("block") * F.lit(block).cast("long")).alias("to"))
    first = ways.where("block = 0").select(*KEY, F.lit(0).cast("long").alias("at"), _number(F.col("leave"), F.lit(0)).alias("to"))
    entries = _reached(jumps.unionByName(first), first).withColumn("block", F.floor(F.col("at") / block).cast("int"))

    def taken(key: tuple, c: dict[str, list]) -> list[tuple]:
        run, off, start, out = np.frombuffer(c["run"][0], "<i4"), np.frombuffer(c["off"][0], "u1"), key[2] * block, []
        i = c["at"][0] - start
        while i < len(run):
            if run[i]:
                out.append((*key[:2], start + i, int(run[i]), int(off[i])))
            i += max(int(run[i]), 1)
        return out

    real = ways.select(*BLOCK_KEY, "run", "off").join(entries, BLOCK_KEY)
    return map_groups(real, BLOCK_KEY, "at", taken, "seq_id string, contig_idx int, pos long, run int, offset int")


def repetitions(walks: DataFrame, params: Params = Params(), block: int = BLOCK) -> DataFrame:
    """encode.repetitions() with a walk in many tasks: (seq_id, contig_idx, pos, run, offset)."""
    return _named(_repetitions(_keyed(walks), params, block)).withColumn("pos", F.col("pos").cast("int"))


class _Block:
    """A block's nodes and repetitions, and the rule of the next step in it."""

    def __init__(self, key: tuple, c: dict[str, list], block: int, params: Params, graph: Adjacency):
        special = {p: v for p, v in zip(c["place"], c["value"], strict=True) if p <= ENTRY}
        self.next, self.size, self.arrival, self.entry = (special.get(p) for p in (NEXT, SIZE, ARRIVAL, ENTRY))
        reps = sorted((v, r, o) for p, v, r, o in zip(c["place"], c["value"], c["run"], c["off"], strict=True) if ENTRY < p < 0)
        self.reps, self.before = {r[0]: r for r in reps}, [r[0] - 1 for r in reps]
        self.path = [v for p, v in zip(c["place"], c["value"], strict=True) if p >= 0]
        self.start, self.first = key[2] * block, key[2] == 0
        self.end = min(self.start + block, self.size)
        self.params, self.graph = params, graph

    def limit(self, cur: int) -> int:
        """Where the next repetition begins from step cur on, or the walk's end."""
        i = bisect_right(self.before, cur - 1)
        return self.before[i] + 1 if i < len(self.before) else self.next

    def length(self, cur: int, limit: int) -> int:
        return min(self.graph.prefix(self.path, cur - self.start, self.params.max_sp), limit - 1 - cur)

    def leave(self, cur: int) -> int | None:
        """Where one who is at cur, and meets no repetition, enters the next block; None if the walk ends or a repetition begins."""
        while cur < self.end:
            limit = self.limit(cur)
            if cur == limit - 1:
                return None
            cur += self.length(cur, limit)
        return cur

    def known(self) -> int | None:
        """The last step of the block that is surely visited, whatever lies before it."""
        ends = [p - 1 + r for p, r, _ in self.reps.values()]
        if ends:
            return ends[-1] if ends[-1] < self.end else None
        return self.arrival if self.arrival is not None else 0 if self.first else None

    def moves(self) -> list[tuple[int | None, int]]:
        """(None, out) where the block's exit is known, else (in, out) of every step that may be the first one in it."""
        cur = self.known()
        if cur is not None:
            out = self.leave(cur)
            return [] if out is None else [(None, out)]
        if self.reps:
            return []
        outs: dict[int, int | None] = {}
        for c in range(self.start, min(self.start + self.params.max_sp, self.end)):
            outs[c] = self.leave(c)
        return [(c, o) for c, o in outs.items() if o is not None]

    def extensions(self) -> list[tuple]:
        """(kind, nid, base, nb, off, at, number of NN in a row, does their row go back beyond the block?)"""
        cur = 0 if self.first else self.entry if self.entry is not None else self.arrival
        if cur is None:
            return []
        node = lambda i: self.path[i - self.start]
        out, n, lead = [], 0, not self.first and self.arrival is None
        if self.first:
            out.append(("TN", node(0), None, 1, None, 0, 0, False))
        while cur < self.end:
            limit = self.limit(cur)
            if cur == limit - 1:
                if limit not in self.reps:
                    break
                _, run, off = self.reps[limit]
                out.append(("R", None, None, run, off, cur + 1, 0, False))
                cur, n, lead = cur + run, 0, False
                continue
            length = self.length(cur, limit)
            if length >= self.params.min_sp:
                out.append(("TN", node(cur + length), None, length, None, cur + 1, 0, False))
                n, lead = 0, False
            else:
                for i in range(cur, cur + length):
                    n += 1
                    out.append(("NN", node(i + 1), self.graph.base_to(node(i), node(i + 1)), 1, None, i + 1, n, lead))
            cur += length
        return out


def greedy(walks: DataFrame, graph: Graph, params: Params = Params(), block: int = BLOCK, broadcast_edges: int = paths.BROADCAST_EDGES) -> DataFrame:
    """encode.greedy() with a walk in many tasks; the same extensions, whatever the block. params.max_contig_nodes isn't needed and isn't used.

    Graphs of more than broadcast_edges edges are left to encode.greedy, whose tasks hold a walk. A block's task holds its nodes and the
    max_sp after them.
    """
    edges = graph.edge_table()
    if edges.count() > broadcast_edges:
        return greedy_in_one(walks, graph, params, broadcast_edges)
    adjacency = walks.sparkSession.sparkContext.broadcast(Adjacency.of(edges))
    walks, ahead = materialise(_keyed(walks), "walks"), params.max_sp + 1
    reps = materialise(_repetitions(walks, params, block), "repetitions")
    block = max(block, ahead)
    no = [F.lit(None).cast("int").alias("run"), F.lit(None).cast("int").alias("off")]
    home, end = F.floor((F.col("pos") - 1) / block).cast("int"), F.col("pos") - 1 + F.col("run")
    own = reps.select(*KEY, home.alias("block"), (-F.col("pos")).alias("place"), F.col("pos").alias("value"), "run", F.col("offset").alias("off"))
    arrivals = reps.where(F.floor(end / block) > home).select(*KEY, F.floor(end / block).cast("int").alias("block"), F.lit(ARRIVAL).alias("place"), end.alias("value"), *no)
    sizes = walks.groupBy(*KEY).agg((F.max("step") + 1).alias("size"))
    every = sizes.select(*KEY, "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / block).cast("int"))).alias("block"))
    least = own.groupBy(*BLOCK_KEY).agg(F.min("value").alias("least"))
    later = F.first("least", True).over(Window.partitionBy(*KEY).orderBy("block").rowsBetween(1, Window.unboundedFollowing))
    every = every.join(least, BLOCK_KEY, "left").select(*BLOCK_KEY, "size", F.coalesce(later, "size").alias("next"))
    about = every.select(*BLOCK_KEY, F.explode(F.array(F.struct(F.lit(NEXT).alias("place"), F.col("next").alias("value")), F.struct(F.lit(SIZE).alias("place"), F.col("size").alias("value")))).alias("x")).select(*BLOCK_KEY, "x.*", *no)
    rows = _dealt(walks, block, after=ahead).select("*", *no).unionByName(own).unionByName(arrivals).unionByName(about)
    rows = materialise(rows, "encoder-blocks")

    def moves(key: tuple, c: dict[str, list]) -> list[tuple]:
        return [(*key[:2], *m) for m in _Block(key, c, block, params, adjacency.value).moves()]

    ways = materialise(map_groups(rows, BLOCK_KEY, "place", moves, "seq_id string, contig_idx int, at long, to long"), "ways")
    entries = _reached(ways.where("at is not null"), ways.where("at is null").select(*KEY, F.col("to").alias("at")))
    entries = entries.select(*KEY, F.floor(F.col("at") / block).cast("int").alias("block"), F.lit(ENTRY).alias("place"), F.col("at").alias("value"), *no)

    def of(key: tuple, c: dict[str, list]) -> list[tuple]:
        return [(*key, *x[:7], int(x[7])) for x in _Block(key, c, block, params, adjacency.value).extensions()]

    schema = "seq_id string, contig_idx int, block int, kind string, nid long, base int, nb int, off int, at long, n int, lead int"
    found = materialise(map_groups(rows.unionByName(entries), BLOCK_KEY, "place", of, schema), "extensions")
    # NN in a row are counted over blocks: those at a block's beginning follow the ones that the blocks before it end with.
    last = F.max(F.when(F.col("kind") != "NN", F.col("at")))
    per = found.groupBy(*BLOCK_KEY).agg(last.alias("last"), F.max_by("n", "at").alias("tail"))
    w = Window.partitionBy(*KEY).orderBy("block")
    before = F.coalesce(F.sum("tail").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("before", before)
    carry = F.col("before") - F.coalesce(F.last(F.when(F.col("last").isNotNull(), F.col("before")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.join(per.select(*BLOCK_KEY, carry.alias("carry")), BLOCK_KEY)
    anchor = (F.col("n") + F.col("lead") * F.col("carry")) % ANCHOR == 0
    found = found.withColumn("nid", F.when((F.col("kind") != "NN") | anchor, F.col("nid")))
    ends = walks.select(*KEY, F.col("step").alias("end"), F.col("nid").alias("copied"))
    copies = found.where("kind = 'R'").withColumn("end", F.col("at") + F.col("nb") - 1).join(ends, [*KEY, "end"]).withColumn("nid", F.col("copied")).drop("end", "copied")
    out = row_numbers(found.where("kind <> 'R'").unionByName(copies).drop("block", "n", "lead", "carry"), KEY, "at", "ext_idx")
    return _named(out).select(*[F.col(c).cast(t) for c, t in (f.split() for f in EXT.split(", "))])
