"""Secret scans with multipart credential linking; DataFrame operations only.

Base patterns are certain enough alone. Weak candidates (mixed tokens with digits) are reported only where an account
identifier and an endpoint stand within `scope` code points of them, both: parts are interval-joined in cells as
wide as the scope, of which each role keeps its first and last start, so a cell full of parts costs two numbers.

Every pattern runs over whole texts, guarded by a cheaper test; a text with no hit is one narrow row. Positions come
from the gaps between matches, summed over exploded matches, so a text with very many of them needs no long array work.

Defined cases: null counts as empty and has no spans; repeated rows give repeated results; an empty table no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import materialise

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the same matches as runs of [0-9a-f] of which those under 32 are dropped
# The method's parts.
IDENT = r"""(?i:user_?name|user_?id|login|client_?id|account_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+"""
ENDPOINT = r"""(?:[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._:@/-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"""
WEAK = r"[A-Za-z0-9+/=_-]{16,}"

KINDS = ["assign", "access", "hex", "weak"]
SCOPE = 200


def _parts(text: Column, kind: str, pattern: str, guard: Column, good) -> Column:
    """Array of (kind, i, gap before the i-th match, its length, does it count); empty where guard is false."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    rows = F.transform(
        F.filter(zipped, lambda z: z["hit"].isNotNull()),
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("n"), good(z["hit"]).alias("good")),
    )
    return F.when(guard, rows).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,n:int,good:boolean>>"))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    always = lambda m: F.lit(True)
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row_id"))
    has_end = (text.contains("://") | text.rlike(r"[0-9]\.[0-9]")) & text.rlike(ENDPOINT)
    rows = rows.withColumn("linked", has_end & (text.rlike(IDENT) | text.contains("AKIA")))
    linked = F.col("linked")
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    parts = F.concat(
        _parts(text, "assign", ASSIGN, text.rlike(ASSIGN), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        _parts(text, "access", ACCESS, text.contains("AKIA"), lambda m: F.length(m) >= 16),
        _parts(text, "hex", HEX, text.rlike(HEX), always),
        _parts(text, "ident", IDENT, linked, always),
        _parts(text, "endpoint", ENDPOINT, linked, always),
        _parts(text, "weak", WEAK, linked, mixed),
    )
    return materialise(rows.select("id", "row_id", parts.alias("parts")), "parts")


def _placed(scanned: DataFrame) -> DataFrame:
    """One row per part that counts: row_id, kind, start, end."""
    x = scanned.where(F.size("parts") > 0).select("row_id", F.explode("parts").alias("p")).select("row_id", "p.*")
    w = Window.partitionBy("row_id", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("n")).over(w)
    return x.select("row_id", "kind", "good", (end - F.col("n")).alias("start"), end.alias("end")).where("good or kind = 'access'")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak candidates apart from base spans, with an identifier and an endpoint within scope."""
    in_row = Window.partitionBy("row_id").orderBy("start", "end")
    base = F.col("kind").isin("assign", "access", "hex") & F.col("good")
    covered = parts.where(base | (F.col("kind") == "weak"))
    covered = covered.withColumn("reach", F.max(F.when(base, F.col("end"))).over(in_row.rowsBetween(Window.unboundedPreceding, -1)))
    covered = covered.withColumn("ahead", F.min(F.when(base, F.col("start"))).over(in_row.rowsBetween(1, Window.unboundedFollowing)))
    weak = covered.where((F.col("kind") == "weak") & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("end"))))
    cell = F.floor(F.col("start") / scope)
    role = F.when(F.col("kind") == "endpoint", "endpoint").otherwise("ident")
    cells = parts.where(F.col("kind").isin("ident", "endpoint", "access")).groupBy("row_id", role.alias("role"), cell.alias("cell")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = weak.select("row_id", "start", "end", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).join(cells, ["row_id", "cell"])
    near = near.where(F.least(F.abs(F.col("first") - F.col("start")), F.abs(F.col("last") - F.col("start"))) <= scope)
    both = near.groupBy("row_id", "start", "end").agg(F.max((F.col("role") == "ident").cast("int")).alias("a"), F.max((F.col("role") == "endpoint").cast("int")).alias("b"))
    return both.where("a = 1 and b = 1").select("row_id", F.lit("weak").alias("kind"), "start", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, n_weak, base_sha256, spans ('kind:start:end' in code points, end exclusive)."""
    scanned = _scanned(docs, id_col, text_col)
    parts = materialise(_placed(scanned), "placed")
    base = parts.where(F.col("good") & F.col("kind").isin("assign", "access", "hex")).select("row_id", "kind", "start", "end")
    found = base.unionByName(_linked(parts, scope))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", order.alias("o"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["s"]), ",")
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    per_row = found.groupBy("row_id").agg(*[n(k) for k in KINDS], joined(F.collect_list(F.when(F.col("kind") != "weak", span))).alias("base"), joined(F.collect_list(span)).alias("spans"))
    out = scanned.select("id", "row_id").join(per_row, "row_id", "left")
    return out.select(
        F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _sql(kind: str, pattern: str, source: str, good: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, i, end_ - length(hit) AS start, end_ AS "end", {good} AS good FROM (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS end_ FROM
(SELECT doc_id, unnest(string_split_regex(t, '{pattern}')) AS gap, unnest(regexp_extract_all(t, '{pattern}')) AS hit, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS i FROM {source}) WHERE hit IS NOT NULL)"""


_ASSIGN_SQL = ASSIGN.replace("(?i:", "(?:").replace("password|passwd|secret|token|api_?key", "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
_IDENT_SQL = IDENT.replace("(?i:", "(?:").replace("user_?name|user_?id|login|client_?id|account_?id|access_?key_?id|key_?id", "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("user_?name", "user_?id", "login", "client_?id", "account_?id", "access_?key_?id", "key_?id")))
_ASSIGN_Q = _ASSIGN_SQL.replace("'", "''")
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT * FROM d WHERE regexp_matches(t, '{ENDPOINT}') AND (regexp_matches(t, '{_IDENT_SQL.replace("'", "''")}') OR contains(t, 'AKIA'))),
p AS ({_sql("assign", _ASSIGN_SQL, "d", f"length(regexp_extract(hit, '{_ASSIGN_Q}', 2)) >= 8")}
UNION ALL {_sql("access", ACCESS, "d", "length(hit) >= 16")}
UNION ALL {_sql("hex", HEX, "d", "true")}
UNION ALL {_sql("ident", _IDENT_SQL, "l", "true")}
UNION ALL {_sql("endpoint", ENDPOINT, "l", "true")}
UNION ALL {_sql("weak", WEAK, "l", "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')")}),
b AS (SELECT doc_id, kind, start, "end" FROM p WHERE good AND kind IN ('assign', 'access', 'hex')),
w AS (SELECT doc_id, kind, start, "end" FROM p WHERE good AND kind = 'weak'
  AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = p.doc_id AND b.start < p."end" AND b."end" > p.start)
  AND EXISTS (SELECT 1 FROM p AS q WHERE q.doc_id = p.doc_id AND q.kind IN ('ident', 'access') AND abs(q.start - p.start) <= {SCOPE})
  AND EXISTS (SELECT 1 FROM p AS q WHERE q.doc_id = p.doc_id AND q.kind = 'endpoint' AND abs(q.start - p.start) <= {SCOPE})),
s AS (SELECT *, list_position(['assign', 'access', 'hex', 'weak'], kind) AS o, kind || ':' || start || ':' || "end" AS s FROM (FROM b UNION ALL FROM w)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, count(*) FILTER (kind = 'weak') AS k,
  coalesce(string_agg(s, ',' ORDER BY start, o) FILTER (kind <> 'weak'), '') AS base, string_agg(s, ',' ORDER BY start, o) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, coalesce(k, 0)::BIGINT AS n_weak, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
