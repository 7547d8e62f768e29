"""Repair of conversations' structure by a dynamic program over a grammar.

A conversation is a string of symbols, one a turn: the initial of its role (s, u, a, o for others, e for an empty role; in upper case where
the text is truncated), b for a blank turn and d for a repeated one. A repaired conversation's initials are `(s?(ua)+)?`. Edits: Keep costs
0, Rerole to user or assistant 1, Delete 2 (the only edit of b and d), Insert of a turn without text 5, and 5 more for a truncated turn
that stays. Of equally cheap audits (the edits' initials in order) the least by ASCII is taken; since an audit says what each turn becomes,
it fixes the repaired conversation.

1. Turns are numbered by range partitions of (conv_id, turn, role, text). Symbols of up to CHUNK turns of a conversation form a string, so a
   conversation of any length is many strings. Equal strings, in whatever conversation, are evaluated once.
2. Re-Pair: in each round the commonest pairs of neighbouring symbols that can't overlap become new symbols, up to max_rules of them. The rest
   stays as it is, so max_rules bounds the grammar and loses nothing.
3. A symbol has a min-plus matrix over the states nothing, s, u, a: the cheapest way from one to the other, with its audit as a rope. A rule's
   matrix is the product of its two symbols', computed once and bottom-up; a string's is that of its symbols. The order (cost, audit) is kept
   by products: of two equally cheap audits over the same turns neither is the beginning of the other, since it would lack an Insert that costs.
4. A conversation's strings and then its turns are streamed in order through one pass, which multiplies the strings' matrices, follows the
   audit and hashes the repaired turns as they come. It holds the audit and one batch, never a conversation's texts.

Defined cases: a null role or text is one space, and a null id is a conversation; null turns come first; turns with equal numbers are ordered
by role and text; an empty table gives no rows; other columns are ignored. Repeated turns are found by 128-bit hashes of id, role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.skew import join_counted
from strandloom.operators.ids import ordered_ids
from strandloom.session import materialise, ship

CHUNK = 1024
MAX_RULES = 512
ROUNDS = 16
PAIRS = 64
#: States of a repaired conversation so far: empty, ends in system, in user, in assistant. It may end in the first and the last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
TRUNCATED, REROLE, DELETE, INSERT = 5, 1, 2, 5
SPACES = r"\x20\x09-\x0D"
STATES = "array<struct<p:int,q:int,cost:long,audit:string>>"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, role string, text string"

Rope = "str | tuple"
Matrix = "list[list[tuple[int, Rope] | None]]"


def pieces(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if x:
                yield x
        else:
            stack += (x[1], x[0])


def _less(a: Rope, b: Rope) -> bool:
    """Is a before b by ASCII?"""
    while isinstance(a, tuple) and isinstance(b, tuple) and a[0] is b[0]:
        a, b = a[1], b[1]
    return a is not b and "".join(pieces(a)) < "".join(pieces(b))


def _better(old: tuple | None, cost: int, rope: Rope) -> tuple:
    return (cost, rope) if old is None or cost < old[0] or cost == old[0] and _less(rope, old[1]) else old


def product(a: Matrix, b: Matrix) -> Matrix:
    out = [[None] * 4 for _ in a]
    for i, row in enumerate(a):
        for m, x in enumerate(row):
            if x is not None:
                for q, y in enumerate(b[m]):
                    if y is not None:
                        out[i][q] = _better(out[i][q], x[0] + y[0], (x[1], y[1]))
    return out


def after_insert(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _inserts() -> Matrix:
    """None, one or two inserted turns; more come back to a state that was there at less cost."""
    out = [[None] * 4 for _ in range(4)]
    for p in range(4):
        q = p
        for n in range(3):
            out[p][q] = _better(out[p][q], INSERT * n, "I" * n)
            q = after_insert(q)
    return out


INSERTS = _inserts()


def kept(state: int, kind: str) -> int | None:
    """The state after a kept turn; None where it can't be kept."""
    if kind == "e":
        return state
    return {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}.get(kind, {}).get(state)


def symbol_matrix(symbol: str) -> Matrix:
    """Inserted turns and then the edit of one turn."""
    one = [[None] * 4 for _ in range(4)]
    for p in range(4):
        one[p][p] = (DELETE, "D")
        if symbol not in "bd":
            more = TRUNCATED if symbol.isupper() else 0
            one[p][after_insert(p)] = _better(one[p][after_insert(p)], REROLE + more, "R")
            q = kept(p, symbol.lower())
            if q is not None:
                one[p][q] = _better(one[p][q], more, "K")
    return product(INSERTS, one)


def matrices(rules: list[tuple[str, str, str]]) -> dict[str, Matrix]:
    """Of all symbols and rules (new symbol, its two symbols), which may use the ones before them."""
    out = {s: symbol_matrix(s) for s in "suaoeSUAOEbd"}
    for new, a, b in rules:
        out[new] = product(out[a], out[b])
    return out


def grammar(strings: DataFrame, max_rules: int = MAX_RULES) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """strings (seq, …) with `packed`, seq in the symbols of the rules."""
    rows, rules = strings.withColumn("packed", F.col("seq")), []
    for _ in range(ROUNDS):
        if len(rules) >= max_rules:
            break
        pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("packed") - 1), lambda i: F.substring("packed", i, F.lit(2)))).alias("pair")
        often = rows.where(F.length("packed") > 1).select(pair).groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
        firsts, seconds, chosen = set(), set(), []
        for r in often.orderBy(F.desc("n"), "pair").limit(PAIRS).collect():
            a, b = r.pair
            overlaps = a in seconds or b in firsts or (a == b and (a in firsts or chosen))
            if not overlaps and len(rules) < max_rules:
                new = chr(0xE000 + len(rules))
                rules.append((new, a, b))
                chosen.append((new, a + b))
                firsts.add(a)
                seconds.add(b)
        if not chosen:
            break
        packed = F.col("packed")
        for new, p in chosen:
            packed = F.replace(packed, F.lit(p), F.lit(new))
        rows = materialise(rows.withColumn("packed", packed), "packed")
    return rows, rules


def _evaluated(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows (seq, first, c, packed) -> (seq, first, c, states): the matrix of each string, of a conversation's first one only from the empty state."""
    ship(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matrices(rules)
        for b in batches:
            states = []
            for packed, first in zip(b.column("packed").to_pylist(), b.column("first").to_pylist(), strict=True):
                m = [[(0, "") if p == q else None for q in range(4)] for p in ([EMPTY] if first else range(4))]
                for s in packed:
                    m = product(m, known[s])
                states.append([{"p": p, "q": q, "cost": x[0], "audit": "".join(pieces(x[1]))} for p, row in enumerate(m) for q, x in enumerate(row) if x is not None])
            kind = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("seq"), b.column("first"), b.column("c"), pa.array(states, kind)], names=["seq", "first", "c", "states"])

    return rows.select("seq", "first", "c", "packed").mapInArrow(run, f"seq string, first boolean, c long, states {STATES}")


def _symbol() -> Column:
    text, initial = F.col("text"), F.left("role", F.lit(1))
    blank = ~text.rlike(f"[^{SPACES}]")
    kind = F.when(initial.isin("s", "u", "a"), initial).when(initial == "", "e").otherwise("o")
    return F.when(blank, "b").otherwise(F.when(text.rlike(rf"[.!?][{SPACES}]*\z"), kind).otherwise(F.upper(kind)))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, symbol, h1, h2, id): ids in the order of conversations and their turns. Symbols don't know of repeated turns yet."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    own = ["conv_id", "role", "text"]
    rows = rows.select("*", _symbol().alias("symbol"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(2), *own).alias("h2"))
    return materialise(ordered_ids(rows, ["conv_id", "turn", "role", "text"]), "turns")


def strings(placed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, block, seq, first): the symbols of a conversation's turns, in pieces of at most `chunk`."""
    keys = placed.select("id", "h1", "h2")
    again = materialise(placed.where("symbol <> 'b'").groupBy("h1", "h2").agg(F.min("id").alias("at"), F.count("*").alias("c")).where("c > 1"), "repeated")
    again = join_counted(keys, again, ["h1", "h2"], "c", keys.count()).where("id > at").select("id", F.lit("d").alias("d"))
    rows = placed.select("id", "conv_id", "symbol").join(again, "id", "left").select("id", "conv_id", F.coalesce("d", "symbol").alias("symbol"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "symbol"))), lambda x: x["symbol"]), "")
    rows = rows.groupBy("conv_id", F.floor(F.col("id") / chunk).alias("block")).agg(seq.alias("seq"))
    first = F.col("block") == F.min("block").over(Window.partitionBy("conv_id"))
    return materialise(rows.select("conv_id", "block", "seq", first.alias("first")), "strings")


class _Conversation:
    """One conversation as it streams by: its strings, then its turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.state = conv_id, [], [(0, "")] + [None] * 3
        self.audit, self.cost, self.at, self.turn_no, self.now = "", 0, 0, 0, EMPTY
        self.counts, self.illegal, self.before = {"b": 0, "d": 0, "t": 0}, 0, None
        self.low = self.high = None
        self.turns, self.sha, self.any = 0, hashlib.sha256(), False

    def string(self, seq: str, states: list[dict]) -> None:
        self.symbols.append(seq)
        new: list[tuple | None] = [None] * 4
        for x in states:
            old = self.state[x["p"]]
            if old is not None:
                new[x["q"]] = _better(new[x["q"]], old[0] + x["cost"], (old[1], x["audit"]))
        self.state = new

    def settle(self) -> None:
        """All strings are there: the cheapest way to an end."""
        last, self.symbols = product([self.state], INSERTS)[0], "".join(self.symbols)
        best = last[EMPTY]
        if last[ASSISTANT] is not None:
            best = _better(best, *last[ASSISTANT])
        self.cost, self.audit = best[0], "".join(pieces(best[1]))

    def put(self, role: bytes, text: bytes) -> tuple[bytes, bytes]:
        self.sha.update((b"\n" if self.any else b"") + role + b":" + text)
        self.any = True
        return role, text

    def insert(self) -> Iterator[tuple[bytes, bytes]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.now = after_insert(self.now)
            yield self.put(b"assistant" if self.now == ASSISTANT else b"user", b"")

    def turn(self, turn: int | None, role: bytes, text: bytes) -> Iterator[tuple[bytes, bytes]]:
        """The repaired turns up to this one."""
        symbol = self.symbols[self.turn_no]
        self.turn_no += 1
        fault = symbol if symbol in self.counts else "t" if symbol.isupper() else None
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.before is not None and self.before + role[:1] not in (b"su", b"ua", b"au"):
            self.illegal += 1
        self.before = role[:1]
        yield from self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.now = kept(self.now, symbol.lower())
            yield self.put(role, text)
        elif edit == "R":
            self.now = after_insert(self.now)
            yield self.put(b"assistant" if self.now == ASSISTANT else b"user", text)

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        c = self.counts
        return self.conv_id, gaps, c["b"], c["d"], c["t"], self.illegal, self.cost, self.audit, self.sha.hexdigest()


def _streamed(rows: DataFrame, texts: bool) -> DataFrame:
    """Marks (kind 0), strings (1) and turns (2) of each conversation in order -> REPORT, or the turns of REPAIRED."""
    ship(rows.sparkSession)
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in (REPAIRED if texts else REPORT).split(", "))])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        settled, place, out, held = False, 0, [], 0

        def say(found: Iterable[tuple[bytes, bytes]]) -> None:
            nonlocal place, held
            for role, text in found:
                if texts:
                    out.append((now.conv_id, place, role.decode(), text.decode()))
                    place, held = place + 1, held + len(text)

        def close() -> None:
            if not settled:
                now.settle()
            say(now.insert())
            if not texts:
                out.append(now.report())

        for b in batches:
            for conv_id, kind, turn, role, text, seq, states in zip(*[b.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "seq", "states")], strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        close()
                    now, settled, place = _Conversation(conv_id), False, 0
                if kind == 1:
                    now.string(seq, states)
                elif kind == 2:
                    if not settled:
                        now.settle()
                        settled = True
                    say(now.turn(turn, role, text))
                if len(out) >= 10_000 or held > 1 << 24:
                    yield batch(out)
                    out, held = [], 0
        if now is not None:
            close()
        if out:
            yield batch(out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at").mapInArrow(run, REPAIRED if texts else REPORT)


def _repaired(turns: DataFrame, marks: DataFrame, texts: bool, chunk: int, max_rules: int) -> DataFrame:
    placed = numbered(turns)
    found = strings(placed, chunk)
    distinct = materialise(found.groupBy("seq", "first").agg(F.count("*").alias("c")), "distinct-strings")
    packed, rules = grammar(distinct, max_rules)
    states = materialise(_evaluated(packed, rules), "states")
    solved = join_counted(found, states, ["seq", "first"], "c", found.count())
    null = lambda t: F.lit(None).cast(t)
    rows = placed.select("conv_id", F.lit(2).alias("kind"), F.col("id").alias("at"), "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), null("string").alias("seq"), null(STATES).alias("states"))
    heads = solved.select("conv_id", F.lit(1).alias("kind"), F.col("block").alias("at"), null("long").alias("turn"), null("binary").alias("role"), null("binary").alias("text"), "seq", "states")
    marks = marks.select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), null("long").alias("turn"), null("binary").alias("role"), null("binary").alias("text"), null("string").alias("seq"), null(STATES).alias("states"))
    return _streamed(marks.unionByName(heads).unionByName(rows), texts)


def repair(turns: DataFrame, chunk: int = CHUNK, max_rules: int = MAX_RULES) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations; one that loses all its turns has no rows."""
    return _repaired(turns, turns.select("conv_id").distinct(), True, chunk, max_rules)


def examine(turns: DataFrame, conversations: DataFrame | None = None, chunk: int = CHUNK, max_rules: int = MAX_RULES) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. conversations: all conv_ids, those without turns among them."""
    return _repaired(turns, (turns if conversations is None else conversations).select("conv_id").distinct(), False, chunk, max_rules)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by crc32('conv_id:turn') % 20: 0 drops a turn, 1 empties it, 2 takes its [.!?], 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("f"))
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("f <> 0").select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(0), (F.col("f") == 3).cast("int"))).alias("copy"))
    return rows.drop("copy")


def report(turns: DataFrame) -> DataFrame:
    """examine() over damaged turns, one row for every conv_id that was there before."""
    return examine(damaged(turns), turns)


ORACLE = r"""WITH RECURSIVE names AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
steps AS (SELECT s, 0 AS i, 4294967295::UBIGINT AS c FROM names UNION ALL SELECT s, i + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END FROM (SELECT s, i, xor(c, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END::UBIGINT) AS x FROM steps WHERE i < 8 * length(s))),
crc AS MATERIALIZED (SELECT s, xor(c, 4294967295::UBIGINT) % 20 AS f FROM steps WHERE i = 8 * length(s)),
base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, f FROM conversations JOIN crc ON s = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') WHERE f <> 0),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, 1 + (f = 3)::INT)) AS copy FROM base),
r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
g AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before FROM r),
t AS MATERIALIZED (SELECT *, blank OR again AS must, NOT blank AND NOT again AND cut AS trunc FROM g),
ins(p, q, cost, audit, rep) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'),
  (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
act(e, ini, p, q, cost) AS (VALUES ('D', NULL, 0, 0, 2), ('D', NULL, 1, 1, 2), ('D', NULL, 2, 2, 2), ('D', NULL, 3, 3, 2), ('R', NULL, 0, 2, 1), ('R', NULL, 1, 2, 1), ('R', NULL, 3, 2, 1), ('R', NULL, 2, 3, 1), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
  ('K', '', 0, 0, 0), ('K', '', 1, 1, 0), ('K', '', 2, 2, 0), ('K', '', 3, 3, 0)),
every AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS st, {'c': 0::BIGINT, 'a': '', 'rep': ''} AS b FROM every
  UNION ALL SELECT conv_id, i, st, b FROM (SELECT dp.conv_id, dp.i + 1 AS i, act.q AS st, min({'c': dp.b.c + ins.cost + act.cost + CASE WHEN trunc AND e <> 'D' THEN 5 ELSE 0 END, 'a': dp.b.a || ins.audit || e, 'rep': dp.b.rep || ins.rep || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE act.q WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || text END}) AS b
    FROM dp JOIN t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.i = dp.i + 1 JOIN ins ON ins.p = dp.st JOIN act ON act.p = ins.q AND (act.ini IS NULL OR act.ini = t.ini) AND (e = 'D' OR NOT must) GROUP BY dp.conv_id, dp.i, act.q)),
n AS (SELECT conv_id, max(i) AS n FROM dp GROUP BY conv_id),
fin AS (SELECT dp.conv_id, min({'c': b.c + ins.cost, 'a': b.a || ins.audit, 'rep': b.rep || ins.rep}) AS b FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN ins ON ins.p = dp.st WHERE ins.q IN (0, 3) GROUP BY dp.conv_id),
per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate, count_if(trunc) AS truncated, count_if(before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id)
SELECT fin.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(substr(b.rep, 2)) AS repaired_sha256 FROM fin LEFT JOIN per ON per.conv_id IS NOT DISTINCT FROM fin.conv_id"""
