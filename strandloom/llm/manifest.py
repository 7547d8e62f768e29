"""Merkle manifests of datasets: one hash tree a source, one over the sources, kept as blocks in van Emde Boas order.

A tree has 16 children a node. A tree of n node levels is laid out as its upper half (n // 2 levels), followed by the trees below it, each
laid out the same way, so a path from a leaf to the root touches few runs of neighbouring nodes whatever the size of a page or cache
line. `address` is that order as arithmetic on (level, index); no pointers are stored.

Aligned subtrees of `height` levels over their leaves (16 ** height of them) are one row each: an array of digests by address. Their
roots are the leaves of the next round of blocks, and so on until a source has one node left; the subroots are the leaves of the tree over
sources, built the same way. A proof is read downwards: a block's path upwards is its slot's siblings in the block above it, and that
block's path. No task holds more than one block of members at a time, and a block's rows are joined on (source, block), so a source with any share of
the rows is spread like all others. Texts are read once, where the leaves are hashed.

Defined cases: null values count as '-', the null source is a source of its own and the first one; null ids come first; of rows that share
source and id the one with the smaller leaf comes first, and repeated rows are leaves of their own. A lone leaf is its subroot, a lone
subroot the root. An empty table gives no rows. Columns beside the five hashed ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.skew import join_counted
from strandloom.operators.ids import ordered_ids
from strandloom.session import materialise

ARITY = 16
#: Levels of a block: 2 are 256 members, up to 273 digests.
HEIGHT = 2
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TREE = ["top", "none", "src"]


def size(levels: int, arity: int = ARITY) -> int:
    """Nodes of a full tree."""
    return (arity**levels - 1) // (arity - 1)


def address(levels: int, depth: int, index, arity: int = ARITY):
    """Place of node `index` of level `depth` (the root's is 0) in a full tree of so many levels; index may be a number or a column."""
    if levels == 1:
        return index * 0
    upper = levels // 2
    if depth < upper:
        return address(upper, depth, index, arity)
    per = arity ** (depth - upper)
    tree = F.floor(index / per) if isinstance(index, Column) else index // per
    return tree * size(levels - upper, arity) + size(upper, arity) + address(levels - upper, depth - upper, index % per, arity)


def hashed(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def leaf(values: dict[str, Column]) -> Column:
    """Hash of a row: each value's UTF-8 length, ':' and the value, '-' for a null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return hashed(F.concat(*[part(values[f]) for f in FIELDS]))


def _run(digests: Column) -> Column:
    """The parents of one level: the hash of every 16 consecutive digests."""
    n = F.ceil(F.size(digests) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: hashed(F.array_join(F.slice(digests, i * ARITY + 1, F.lit(ARITY)), "")))


def _laid_out(levels: list[Column], depth: int, span: int, index: Column) -> Column:
    """The subtree of `span` levels at (depth, index) as an array by address; levels[d] are the digests of level d, null where a last run is short."""
    if span == 1:
        return F.array(F.get(levels[depth], index))
    upper = span // 2
    fan = ARITY**upper
    below = F.flatten(F.transform(F.sequence(index * fan, index * fan + (fan - 1)), lambda j: _laid_out(levels, depth + upper, span - upper, j.cast("int"))))
    return F.concat(_laid_out(levels, depth, upper, index), below)


def _blocks(members: DataFrame, round_: int, height: int) -> DataFrame:
    """(TREE, levels, round, block, height, members, nodes, root) of (TREE, levels, pos, digest, …): levels is that of the whole tree."""
    own = [c for c in members.columns if c not in (*TREE, "levels", "pos")]
    block = F.floor(F.col("pos") / ARITY**height).cast("long")
    rows = members.groupBy(*TREE, "levels", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", *own))).alias("members"))
    here = F.greatest(F.lit(0), F.least(F.lit(height), F.col("levels") - height * round_)).cast("int")
    rows = rows.select(*TREE, "levels", F.lit(round_).alias("round"), "block", here.alias("height"), "members", F.transform("members", lambda m: m["digest"]).alias("__0"))
    for q in range(1, height + 1):
        rows = rows.withColumn(f"__{q}", F.when(F.col("height") >= q, _run(F.col(f"__{q - 1}"))))
    nodes, root = F.lit(None), F.lit(None)
    for h in range(height + 1):
        levels = [F.col(f"__{h - d}") for d in range(h + 1)]  # from the root down
        nodes = F.when(F.col("height") == h, _laid_out(levels, 0, h + 1, F.lit(0))).otherwise(nodes)
        root = F.when(F.col("height") == h, F.get(levels[0], F.lit(0))).otherwise(root)
    return rows.select(*TREE, "levels", "round", "block", "height", "members", nodes.alias("nodes"), root.alias("root"))


def _path(height: int, nodes: Column, slot: Column) -> Column:
    """Siblings to the left and right of a member's path in its block, from below, each as joined digests."""
    steps = []
    for q in range(height):
        at = F.floor(slot / ARITY**q).cast("int")
        first = (at - at % ARITY).cast("int")
        run = F.transform(F.sequence(F.lit(0), F.lit(ARITY - 1)), lambda s: F.get(nodes, address(height + 1, height - q, first + s).cast("int")))  # noqa: B023
        steps.append(F.struct(F.array_join(F.slice(run, F.lit(1), at - first), "").alias("left"), F.array_join(F.slice(run, at - first + 2, F.lit(ARITY)), "").alias("right")))
    return F.array(*steps) if steps else F.array().cast("array<struct<left:string,right:string>>")


def _paths(height: Column, most: int, nodes: Column, slot: Column) -> Column:
    out = _path(0, nodes, slot)
    for h in range(1, most + 1):
        out = F.when(height == h, _path(h, nodes, slot)).otherwise(out)
    return out


@dataclass
class Manifest:
    """rounds[top][t]: the blocks of a round, of the sources' trees (0) and of the tree over sources (1)."""

    rounds: list[list[DataFrame]]
    height: int = HEIGHT

    def table(self) -> DataFrame:
        """All blocks but for the members' own columns, with the place of each block in the tree of its tree's blocks, again in van Emde Boas order."""
        out = None
        for rows in (r for half in self.rounds for r in half):
            rows = rows.withColumn("members", F.transform("members", lambda m: m["digest"]))
            out = rows if out is None else out.unionByName(rows)
        deep = F.greatest(F.lit(1), F.ceil(F.col("levels") / self.height)).cast("int")
        place = F.lit(None).cast("long")
        for levels in range(1, 9):
            for t in range(levels):
                here = (deep == levels) & (F.col("round") == t)
                place = F.when(here, address(levels, levels - 1 - t, F.col("block"), ARITY**self.height).cast("long")).otherwise(place)
        return out.withColumn("address", place)

    def save(self, path: str) -> None:
        """Blocks in the order of tree and address, so that what a proof reads lies close together."""
        self.table().repartitionByRange(*TREE, "address").sortWithinPartitions(*TREE, "address").write.parquet(path)

    def root(self) -> str | None:
        """The hash over everything; None for an empty table."""
        last = self.rounds[1][-1].select("root").first() if self.rounds[1] else None
        return last.root if last else None

    def proofs(self) -> DataFrame:
        """(member, subroot, path) of every leaf: the row that was given, its source's subroot, and the siblings from leaf to root."""
        top = self._down(self.rounds[1], None).select("member.none", "member.src", F.col("member.digest").alias("subroot"), "path")
        return self._down(self.rounds[0], top)

    def _down(self, rounds: list[DataFrame], above: DataFrame | None) -> DataFrame:
        """(TREE, member, subroot, path): from the last round, whose blocks are their trees' tops, to the first. above: (none, src, subroot, path) of whole trees."""
        up = None
        for t in range(len(rounds) - 1, -1, -1):
            blocks = rounds[t]
            # Whole trees end in this round where no level is left above it.
            ends = F.col("levels") <= self.height * (t + 1)
            done = blocks.where(ends)
            done = done.join(above, ["none", "src"]) if above is not None else done.select("*", F.col("root").alias("subroot"), _path(0, F.col("nodes"), F.lit(0)).alias("path"))
            if up is not None:
                done = done.unionByName(blocks.where(~ends).join(up, [*TREE, "block"]))
            found = done.select(*TREE, "subroot", F.col("path").alias("__up"), "nodes", "height", F.explode("members").alias("member"))
            slot = (F.col("member.pos") % ARITY**self.height).cast("int")
            found = found.select(*TREE, "member", "subroot", F.concat(_paths(F.col("height"), self.height, F.col("nodes"), slot), "__up").alias("path"))
            if t == 0:
                return found
            up = found.select(*TREE, F.col("member.pos").alias("block"), "subroot", "path")


def _forest(members: DataFrame, height: int, name: str) -> list[DataFrame]:
    """The rounds of blocks over members (TREE, levels, pos, digest, …), each written once."""
    most = members.agg(F.max("levels")).first()[0]
    if most is None:
        return []
    rounds = [materialise(_blocks(members, 0, height), f"{name}-0")]
    while height * len(rounds) < most:
        t = len(rounds)
        roots = rounds[-1].where(F.col("levels") > height * t).select(*TREE, "levels", F.col("block").alias("pos"), F.col("root").alias("digest"))
        rounds.append(materialise(_blocks(roots, t, height), f"{name}-{t}"))
    return rounds


def _levels(n: Column) -> Column:
    """Levels above n leaves."""
    return sum(((n > ARITY**q).cast("int") for q in range(1, 15)), (n > 1).cast("int"))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(none, src, source, doc_id, digest, changed): the leaf of every row, and of the row with `tampered` as its text where that isn't null."""
    values = {f: F.col(f) for f in FIELDS}
    other = F.when(tampered.isNotNull(), leaf(values | {"text": tampered})) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select("source", "doc_id", leaf(values).alias("digest"), other.alias("changed"))
    return rows.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("src"), "doc_id", "digest", "changed")


def build(rows: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest over leaves (none, src, doc_id, digest, …)."""
    rows = materialise(rows, "leaves")
    placed = materialise(ordered_ids(rows.withColumn("named", ~F.col("none")), ["named", "src", "doc_id", "digest"]).drop("named"), "placed")
    sources = materialise(placed.groupBy("none", "src").agg(F.min("id").alias("first"), F.count("*").alias("n")), "sources")
    members = join_counted(placed, sources, ["none", "src"], "n", rows.count())
    members = members.select(F.lit(False).alias("top"), "none", "src", _levels(F.col("n")).alias("levels"), (F.col("id") - F.col("first")).alias("pos"), "doc_id", "digest", "changed")
    below = _forest(members.select(*TREE, "levels", "pos", "digest", "doc_id", "changed"), height, "blocks")
    subroots = None
    for t, blocks in enumerate(below):
        ended = blocks.where(F.col("levels") <= height * (t + 1)).select("none", "src", F.col("root").alias("digest"))
        subroots = ended if subroots is None else subroots.unionByName(ended)
    if subroots is None:
        return Manifest([[], []], height)
    top = materialise(ordered_ids(sources.join(subroots, ["none", "src"]).withColumn("named", ~F.col("none")), ["named", "src"]), "subroots")
    levels = _levels(F.lit(top.count()))
    over = top.select(F.lit(True).alias("top"), F.lit(False).alias("of_none"), F.lit("").alias("of_src"), levels.alias("levels"), F.col("id").alias("pos"), "digest", "none", "src")
    over = over.select("top", "levels", "pos", "digest", F.struct("none", "src").alias("tree"), "of_none", "of_src")
    # The tree over sources is one tree; its members name theirs.
    over = over.select("top", F.col("of_none").alias("none"), F.col("of_src").alias("src"), "levels", "pos", "digest", "tree")
    return Manifest([below, _named(_forest(over, height, "top"))], height)


def _named(rounds: list[DataFrame]) -> list[DataFrame]:
    """First round with the members' tree as fields none and src."""
    if rounds:
        first = rounds[0]
        rounds[0] = first.withColumn("members", F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), m["digest"].alias("digest"), m["tree"]["none"].alias("none"), m["tree"]["src"].alias("src"))))
    return rounds


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda acc, s: hashed(F.concat(s["left"], acc, s["right"])))


def report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Where 5 divides crc32(doc_id), the folded leaf is that of the text in lower case (A-Z only)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    manifest = build(leaves(docs, lower), height)
    root = manifest.root()
    if root is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    proof = hashed(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""))
    rows = manifest.proofs().select(
        F.col("member.doc_id").alias("doc_id"), F.col("member.digest").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"),
        folded(F.coalesce("member.changed", "member.digest"), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(levels: int = 6) -> str:
    """The same by levels: nodes of level q + 1 are the hashes of every 16 nodes of level q in trees with more than one; enough for 16 ** levels rows."""
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    whole = lambda text: "sha256(" + " || ".join(part(text if f == "text" else f) for f in FIELDS) + ")"
    ctes = [
        f"d AS (SELECT doc_id, source, {whole('text')} AS digest, {whole('translate(text, upper_, lower_)')} AS changed FROM documents, (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper_, 'abcdefghijklmnopqrstuvwxyz' AS lower_))",
        "s0 AS MATERIALIZED (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, digest, doc_id, changed FROM d)",
    ]
    up = lambda a, q: f"{a}{q + 1} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest FROM {a}{q} WHERE n > 1 GROUP BY tree, pos // 16, n)"
    ctes += [up("s", q) for q in range(levels)]
    ctes.append("sub AS (" + " UNION ALL ".join(f"SELECT tree, digest FROM s{q} WHERE n = 1" for q in range(levels + 1)) + ")")
    ctes.append("t0 AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest, tree AS source FROM sub)")
    ctes += [up("t", q) for q in range(levels)]
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT digest AS root FROM t{q} WHERE n = 1" for q in range(levels + 1)) + ")")
    ctes.append("p AS (SELECT s0.doc_id, s0.tree, s0.pos AS at, s0.digest AS leaf, s0.changed, t0.pos AS tat, t0.digest AS subroot FROM s0 JOIN t0 ON t0.source IS NOT DISTINCT FROM s0.tree)")
    joined, sides = "p", []
    for a, col in (("s", "at"), ("t", "tat")):
        for q in range(levels):
            tree = "p.tree" if a == "s" else "0"
            side = f"(SELECT {{}} FROM {a}{q} AS x WHERE x.n > 1 AND x.tree IS NOT DISTINCT FROM {tree} AND x.pos // 16 = p.{col} // {16 ** (q + 1)} AND x.pos {{}} p.{col} // {16**q})"
            sides.append([side.format("coalesce(string_agg(digest, '' ORDER BY pos), '')", op) for op in ("<", ">")] + [f"EXISTS {side.format('1', '=')}"])
    cols = ", ".join(f"{x[0]} AS l{i}, {x[1]} AS r{i}, {x[2]} AS e{i}" for i, x in enumerate(sides))
    ctes.append(f"q AS MATERIALIZED (SELECT *, {cols} FROM {joined})")
    fold = "CASE WHEN crc_ % 5 = 0 AND changed IS NOT NULL THEN changed ELSE leaf END"
    ctes.append(f"f0 AS (SELECT *, {fold} AS acc FROM (SELECT q.*, crc.crc_ FROM q LEFT JOIN crc ON crc.id = q.doc_id))")
    ctes += [f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN e{i} THEN sha256(l{i} || acc || r{i}) ELSE acc END AS acc) FROM f{i})" for i in range(len(sides))]
    proof = " || ".join(f"l{i} || r{i}" for i in range(len(sides)))
    return "WITH RECURSIVE " + CRC + ", " + ", ".join(ctes) + f" SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM f{len(sides)}, root"


# Unsigned crc32 of a decimal id, byte by byte and bit by bit (the reflected polynomial is a fixed value).
CRC = """bytes AS (SELECT DISTINCT doc_id AS id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
steps AS (SELECT id, s, 0 AS i, 4294967295::UBIGINT AS c FROM bytes UNION ALL SELECT id, s, i + 1, list_reduce(list_prepend(xor(c, ascii(s[i // 8 + 1])::UBIGINT * (i % 8 = 0)::UBIGINT), [0::UBIGINT]), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END) FROM steps WHERE i < 8 * length(s)),
crc AS (SELECT id, xor(c, 4294967295::UBIGINT) AS crc_ FROM steps WHERE i = 8 * length(s))"""
ORACLE = _oracle()
