"""Deduplication, similarity and decontamination against brute force, with nulls, empties, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from strandloom.llm import components, decontaminate, exact_dedup, jaccard_join, line_dedup, skew, substring_dedup

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_exact(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a\tb"), (4, None), (5, ""), (5, ""), (6, "x"), (None, "x"), (7, "é"), (8, " é")]
    got = {(r.doc_id, r.kept): (r.keep_id, r.group_size) for r in exact_dedup.dedup(frame(spark, rows)).collect()}
    assert got[2, True] == (2, 3) and got[1, False] == (2, 3) and got[3, False] == (2, 3)
    assert got[4, True] == (4, 3) and got[5, False] == (4, 3) and got[6, True] == (6, 2) and got[None, False] == (6, 2) and got[8, True] == (8, 1)
    out = exact_dedup.dedup(frame(spark, [(1, "a"), (1, "a")]))
    assert sorted(r.kept for r in out.collect()) == [False, True]
    assert out.first().text_sha256 == hashlib.sha256(b"a").hexdigest()
    assert exact_dedup.dedup(frame(spark, [])).count() == 0


def test_exact_batches(spark):
    index = exact_dedup.DigestIndex(spark, f"index_{uuid.uuid4().hex}", 4)
    index.add(frame(spark, [(1, "a"), (2, "b")])).count()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.add(frame(spark, [(9, "a "), (10, "c"), (11, "c")])).collect()}
    assert got == {9: (1, 2, False), 10: (10, 2, True), 11: (10, 2, False)}
    assert index.view().count() == 3
    # a third batch sees the rows of both before it
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.add(frame(spark, [(0, "a   "), (12, "c"), (13, "d")])).collect()}
    assert got == {0: (1, 3, False), 12: (10, 3, False), 13: (13, 1, True)}
    got = {r.keep_id: r.group_size for r in index.view("best").collect()}
    assert got == {0: 3, 2: 1, 10: 3, 13: 1}
    index.drop()
    assert index.read() is None


def test_exact_batch_repeated(spark):
    """A batch that is added again, as after a failure past its append, gives the same rows and leaves the same index."""
    index = exact_dedup.DigestIndex(spark, f"index_{uuid.uuid4().hex}", 4)
    index.add(frame(spark, [(1, "a"), (2, "b")]), batch="x").count()
    rows = [(5, "b"), (6, "c"), (7, "c"), (None, "c")]
    runs = [sorted(map(str, index.add(frame(spark, rows), batch="y").collect())) for _ in range(2)]
    assert runs[0] == runs[1] and sum("kept=True" in r for r in runs[0]) == 1
    assert index.read().count() == 4 and {r.keep_id: r.group_size for r in index.view("first").collect()} == {1: 1, 2: 2, 6: 3}
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.add(frame(spark, [(1, "a"), (2, "b")]), batch="x").collect()}
    assert again == {1: (1, 1, True), 2: (2, 2, True)}
    index.drop()


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_in_batches(spark, batches):
    rng = random.Random(9)
    rows = [(i, rng.choice("abc") * rng.randrange(1, 4) + " " * rng.randrange(3)) for i in range(60)] + [(None, "a"), (7, "zz"), (7, "zz")]
    groups = {}
    for i, t in rows:
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), i is None, i or 0))
    got = exact_dedup.dedup(frame(spark, rows), batches).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    expect = {hashlib.sha256(t.encode()).hexdigest(): (min(g)[2], len(g)) for t, g in groups.items()}
    assert {r.text_sha256: (r.keep_id, r.group_size) for r in got} == expect
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def windows_brute(docs, items):
    wins = []
    for i, t in items:
        w = WORD.findall(ascii_lower(t or ""))
        n = min(10, len(w))
        wins += [(i, tuple(w[j : j + n])) for j in range(len(w) - n + 1)] if n else []
    out = {}
    for i, t in docs:
        w = WORD.findall(ascii_lower(t or ""))
        hit, found = set(), set()
        for item, win in wins:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(str(item))
        ids = ",".join(sorted(found))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["Ab", "c1", "é", "DE", "zz", "ñandú", "x"])
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 3, 12, 15])))) for i in range(12)] + [(20, "only"), (21, None), (22, "..."), (3, "solo word")]
    docs = [(0, None), (1, ""), (2, "Only. the ONLY one")]
    for i in range(3, 60):
        text = " ".join(word() for _ in range(rng.randrange(30)))
        docs.append((i, text + "; " + (rng.choice(items)[1] or "") + "!" + text if i % 3 else text))
    expect = windows_brute(docs, items)
    d, b = frame(spark, docs), frame(spark, items, "item_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in decontaminate.report(d, b).collect()} == expect
    several = decontaminate.scan(d, b, per_pass=5)
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"])) for r in several.collect()} == {i: x[:3] for i, x in expect.items()}
    clash = d.withColumn("spans", F.lit(1)).withColumn("n_hit", F.lit("x")).withColumn("row", F.lit(2))
    kept = decontaminate.clean(clash, b)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i, x in expect.items() if not x[4]}
    cut = {r.doc_id: r.text for r in decontaminate.clean(frame(spark, [(1, "é one TWO three. rest"), (2, None)]), frame(spark, [(1, "one two three")], "item_id long, text string"), mode="spans").collect()}
    assert cut == {1: "é . rest", 2: None}
    assert decontaminate.report(frame(spark, []), b).count() == 0
    assert decontaminate.report(d, frame(spark, [], "item_id long, text string")).where("contaminated").count() == 0


def jaccard_brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, rows = text(40), [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "a b c d e"), (5, "a b c d e f"), (6, " \t\n")]

    def edited(words, edits):
        w = list(words)
        for _ in range(edits):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1, 2])] = text(rng.choice([0, 1, 1]))
        return w

    groups = [(text(120), 60), (text(60), 40), (text(12), 12), (text(9), 30), (text(8), 20), (text(300), 6)]
    for base, n in groups:
        for _ in range(n):
            rows.append((len(rows), " ".join(edited(base, rng.choice([0, 0, 1, 1, 2, 3, 4])))))
    for _ in range(60):  # a common passage in texts that are otherwise apart
        rows.append((len(rows), " ".join(text(rng.randrange(5, 40)) + shared + text(rng.randrange(5, 40)))))
    base = text(100)
    for i in range(0, 40):  # a chain of texts, each near the next
        base = edited(base, 2)
        rows.append((len(rows), " ".join(base)))
    rows += [(len(rows) + i, rows[30][1].upper()) for i in range(5)]
    rng.shuffle(rows)
    rows = [(i * 3 % 10007, t) for i, (_, t) in enumerate(rows)]
    expect = jaccard_brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, rows)).collect()}
    assert got == expect
    # nothing broadcast, a heavy map in which nearly all shingles are heavy, and whole hashes counted: the same result
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, rows), broadcast=0, map_log=6, head=64).collect()}
    assert got == expect
    kept = jaccard_join.keep_first(frame(spark, rows).withColumn("n", F.lit(1)).withColumn("node", F.lit(2)))
    assert {r.doc_id for r in kept.collect()} == {i for i, x in expect.items() if x[1] == i}


def test_jaccard_edges(spark):
    assert jaccard_join.join(frame(spark, [])).count() == 0
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, [(5, "a b"), (5, "a b"), (4, "A  B"), (None, "a b"), (9, None)])).collect()), key=str)
    assert got == [(4, 1, 4), (5, 1, 4), (5, 1, 4), (9, 0, 9), (None, 1, None)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(edges)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component_id for r in components.components(frame(spark, edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog today"
    rows = [
        (1, f"{line}\nshort line\n{line.upper()}"), (2, f"short line\n{line.replace('fox', 'cat')}\nand one more line that nobody else has at all"),
        (3, line.replace("lazy ", "")), (4, line.replace("lazy dog", "lazy old dog now")), (5, None), (6, ""), (None, "x " + line), (7, f" {line}  \r\nend"),
    ]
    docs = frame(spark, rows).withColumn("gone", F.lit(9)).withColumn("lines", F.lit("l"))
    out = line_dedup.clean(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns
    assert got == {1: f"{line}\nshort line", 2: "short line\nand one more line that nobody else has at all", 3: "", 4: rows[3][1], 5: None, 6: "", None: "", 7: "end"}
    assert line_dedup.report(frame(spark, [])).count() == 0


def test_lines_short(spark):
    rows = [(1, "Short line\n\n}\na b c"), (2, "short  LINE\n\n}\na b d"), (None, "x\nshort line"), (3, " \nx\n")]
    got = {r.doc_id: r.text for r in line_dedup.clean(frame(spark, rows), exact=1).collect()}
    assert got == {1: rows[0][1], 2: "\na b d", 3: rows[3][1], None: ""}
    got = {(r.doc_id, r.line_no, r.keep_id, r.keep_line, r.exact) for r in line_dedup.dropped(frame(spark, rows), exact=2).collect()}
    assert got == {(2, 0, 1, 0, True), (None, 1, 1, 0, True)}
    assert line_dedup.dropped(frame(spark, rows)).count() == 0
    import corpus_pipeline

    docs = frame(spark, rows[:2]).withColumn("n_chars", F.length("text"))
    assert {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()} == {1: (rows[0][1], len(rows[0][1])), 2: ("\na b d", 6)}


def test_lines_brute(spark):
    rng = random.Random(8)
    base = [[rng.choice("abcdefgh") for _ in range(9)] for _ in range(6)]
    rows = []
    for i in range(30):
        lines = []
        for _ in range(3):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choice([[], ["z"], ["y"]])
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        s, t = sorted((a, b), key=len)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    occurrences = [(i, j, line.split(" ")) for i, t in rows for j, line in enumerate(t.split("\n")) if len(line.split(" ")) >= 8]
    expect = {(i, j) for n, (i, j, w) in enumerate(occurrences) if any(near(w, v) for _, _, v in occurrences[:n])}
    # a later occurrence of an equal line goes with it; an earlier match is sought from a line's first occurrence
    got = {(r.doc_id, r.line_no) for r in line_dedup.dropped(frame(spark, rows)).collect()}
    assert got == expect
    # with nothing broadcast but hot keys, and with many copies of one template
    rows += [(100 + i, f"this line of a template is for number {i} only\nthanks") for i in range(1500)] + [(5000, "word " * 300_000)]
    wide = line_dedup.dropped(frame(spark, rows), exact=1, broadcast=0)
    assert wide.where("doc_id >= 100").count() == 2 * 1499 and {(r.doc_id, r.line_no) for r in wide.where("doc_id < 100").collect()} == expect


def test_substrings(spark):
    a = "This passage of more than eight words is repeated here."
    b = "Another long sentence that stands in two of the texts!"
    rows = [(1, f"intro {a} {b}"), (2, f"Start. {a} End. short. short."), (3, f"{b.lower()}\nx"), (4, None), (5, ""), (6, "é " + a + "\n" + a), (None, a)]
    got = sorted(((r.doc_id, r.start, r.end, r.unit, r.keep_id, r.keep_start) for r in substring_dedup.repeats(frame(spark, rows), passage=0).collect()), key=str)
    n = len(a) - 1
    assert (3, 0, len(b) - 1, "line", 1, 6 + len(a) + 1) in got
    assert (6, 3 + n + 1 - 1 + 1, 3 + n + 1 + n, "line", 2, 7) in got and (None, 0, n, "line", 2, 7) in got
    assert len(got) == 3
    out = substring_dedup.clean(frame(spark, rows).withColumn("start", F.lit(1)), passage=0)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] == "!\nx" and texts[4] is None and texts[None] == "." and texts[1] == rows[0][1]
    assert substring_dedup.repeats(frame(spark, [])).count() == 0


def test_substrings_in_passages(spark):
    """A shared line stays; repeated units with few words between them go as one passage, each of two texts with one id on its own."""
    a, b = "one two three four five six seven eight nine ten.", "The second sentence of it has again a few more words than that."
    own = "Here stands a sentence that no other text has at all."
    rows = [
        (1, f"{a} {b}"), (2, f"x {own} y. {a} {b} z"), (3, a), (4, f"{a} {own.upper()} of four. {b}"), (5, f"{a} short one. {b}"),
        (6, a), (6, b), (7, f"{a} {b}"), (7, f"{a} {b}"), (None, f"{b} {a}"), (8, None), (9, ""),
    ]
    removed = lambda **p: {r.doc_id for r in substring_dedup.repeats(frame(spark, rows), **p).collect()}
    assert removed(passage=0) == {2, 3, 4, 5, 6, 7, None}
    assert removed(passage=20) == {2, 5, 7, None}
    assert removed(passage=24) == set()
    docs = frame(spark, rows)
    got = [(r.doc_id, r.text) for r in substring_dedup.clean(docs).collect()]
    assert len(got) == len(rows) and {(3, a), (4, rows[3][1]), (6, a), (6, b), (1, rows[0][1]), (8, None), (9, "")} <= set(got)
    assert dict(got)[2] == f"x {own} y. . . z"
    assert dict(got)[5].strip(" .") == "short one"


@pytest.mark.parametrize("n", [3_000_000])
def test_long_text(spark, n):
    long = "ab cd " * (n // 6)
    rows = [(1, long), (2, "x"), (3, "q" * n)]
    assert {r.doc_id: r.n_words for r in decontaminate.report(frame(spark, rows), frame(spark, [(1, "cd ab cd")], "item_id long, text string")).collect()} == {1: n // 3, 2: 1, 3: 1}
    assert {r.doc_id: r.n_shingles for r in jaccard_join.join(frame(spark, rows)).collect()} == {1: 2, 2: 1, 3: 1}


@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST_LINES, 0])
def test_lines_of_long_texts(spark, broadcast):
    """A text of very many lines costs their number; first, last and all lines of a text may go."""
    long = "\n".join(f"line {i % 40_000} of so many that it matters a lot" for i in range(80_000))
    rows = [(1, "a b\nc d"), (2, "a b\nkept\nc d"), (3, "c d\na b"), (4, "x y\na b"), (5, "a b\nz"), (6, None), (7, ""), (9, long)]
    got = {r.doc_id: r.text for r in line_dedup.clean(frame(spark, rows), least=50, exact=1, broadcast=broadcast).collect()}
    assert got.pop(9) == long[: len(long) // 2]
    assert got == {1: "a b\nc d", 2: "kept", 3: "", 4: "x y", 5: "z", 6: None, 7: ""}


@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST_LINES, 0])
def test_lines_every_place(spark, monkeypatch, broadcast):
    """One edit is found at any place of a line, two edits at none, and variants are left out near the edit only, not all over the line."""
    lines, expect, words = [], set(), 0
    for n in (8, 9, 10, 16, 17, 24, 25, 63, 64, 65, 290):
        for at in range(n) if n < 60 else (0, 1, 7, 8, n // 2, n - 8, n - 2, n - 1):
            for edit in ("replaced", "added", "removed", "two"):
                line = [f"w{n}x{at}{edit}{i // 2}" for i in range(n)]  # words stand twice, side by side
                other = {"replaced": [*line[:at], "z", *line[at + 1 :]], "added": [*line[:at], "z", *line[at:]], "removed": line[:at] + line[at + 1 :]}.get(edit) or [*line[:at], "z", *line[at + 1 : -1], "y", "y"]
                if edit != "two" and min(len(line), len(other)) >= 8:
                    expect.add(len(lines) + 1)
                lines += [line, other]
                words += len(line) + len(other)
    made, write = [], line_dedup.materialise

    def materialise(df, name):
        out = write(df, name)
        if name == "variants":
            made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialise", materialise)
    rows = [(i, " ".join(line)) for i, line in enumerate(lines)]
    got = {(r.doc_id, r.keep_id) for r in line_dedup.dropped(frame(spark, rows), broadcast=broadcast).collect()}
    assert got == {(i, i - 1) for i in expect}
    assert made[0] < words


def test_thin(spark):
    """All rows with a key of the table stay, null too, and few others; columns as before."""
    rows = spark.range(60_000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    keys = rows.where("doc_id is null or doc_id % 30 = 7").select(F.col("doc_id").alias("k"))
    out = skew.thin(rows, F.col("doc_id"), keys, F.col("k"), 2001)
    assert out.columns == rows.columns
    assert out.where("doc_id is null or doc_id % 30 = 7").count() == 2001 and out.count() < 2001 + 58_000 // 10
    assert skew.thin(rows, F.col("doc_id"), keys.limit(0), F.col("k"), 0).count() == 0


def test_lines_without_shuffled_texts(spark, monkeypatch):
    """Beyond the bound of broadcasts, texts aren't shuffled to fetch the few lines that may be near another."""
    line = "the quick brown fox jumps over the lazy dog today"
    rows = [(1, line), (2, line.replace("fox", "cat"))] + [(i, " ".join(f"{i}x{j}" for j in range(20))) for i in range(3, 1000)]
    again, lines = [], line_dedup._lines

    def seen(docs, id_col, *args):
        if id_col == "id":  # the texts that are read again
            again.append((docs.count(), docs._jdf.queryExecution().executedPlan().toString()))
        return lines(docs, id_col, *args)

    monkeypatch.setattr(line_dedup, "_lines", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [(r.doc_id, r.keep_id) for r in line_dedup.dropped(frame(spark, rows), broadcast=0).collect()] == [(2, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (n, plan), = again
    assert 2 <= n < 300 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
