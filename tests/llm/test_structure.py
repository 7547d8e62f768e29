"""Page text, hash trees and conversation repair against brute force, with nulls, empties, ties, repeated rows, long rows and clashing names."""

import hashlib
import html
import random
import re
import zlib
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from strandloom.llm import conversations, html_text, manifest

SPACES = " \t\n\x0b\x0c\r"


# --- pages


def page(own, menu=("Home", "News"), foot="All rights reserved", extra=""):
    return (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p><p>no';</script></head><body class='no-sidebar'><nav><ul>"
        + "".join(f"<li><a href='/x'>{m}</a>" for m in menu) + "</ul></nav><!-- <p>no</p> --><article><h1>" + own[0] + "</h1>" + "".join(f"<p><b>{x}<br><p>" for x in own[1:]) + f"</article>{extra}<footer>{foot}</footer></body></html>"
    )


def lcs_length(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_alignment():
    rng = random.Random(3)
    for _ in range(1500):
        a = [rng.randrange(rng.choice([2, 4, 9])) for _ in range(rng.randrange(14))]
        b = [rng.randrange(5) for _ in range(rng.randrange(14))]
        for most in (1 << 26, 4):
            common = [x for x, s in zip(a, html_text.shared(a, b, most), strict=True) if s]
            rest = iter(b)
            assert all(x in rest for x in common) and len(common) == lcs_length(a, b)
    same = html_text.shared([1] * 30_000 + [2], [2] + [1] * 30_000)
    assert same.sum() == 30_000


def test_lines():
    L = lambda x: [(t, f & ~html_text.PROSE) for t, _, f in html_text.lines(x)]
    assert L("a &amp; b<br>c&nbsp;&lt;d&gt;<p>e\n f<i>g</i>") == [("a & b c <d>", 0), ("e fg", 0)]
    assert L("<header>x</header><main><header>y</header><p>z</main>") == [("x", 1), ("y", 1), ("z", 2)]
    assert L("<article class='post comments-open'><header><h1>t</h1></header><p>z<footer>by</footer></article><p>out") == [("t", 2), ("z", 2), ("by", 1), ("out", 1)]
    assert L("<section id=comments><article class='comment'><p>c</article></section><div class='cookieNotice'>n</div><div class='with-sidebar'>k</div>") == [("c", 1), ("n", 1), ("k", 0)]
    assert L("<form><p>q</form><div role='navigation'>r</div><p title='a>b'>s<script>t") == [("q", 1), ("r", 1), ("s", 0)]
    assert L("") == [] and L("<p") == [] and L("<!-- x") == [] and L("1 < 2 &am &amp") == [("1 < 2 &am &", 0)]
    assert len(html_text.lines("<div>" * 50_000 + "x")) == 1


def test_pages(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows, expect = [], {}
    for i in range(40):  # landmarks, a paragraph that many articles have
        own = [say(4), say(40), "The &amp; end.", say(25)]
        rows.append((i, f"https://a.example/p/{i}", page(own, extra="<div class='comments'><p>first!</p></div>")))
        expect[i] = " ".join(html.unescape(x) for x in own)
    for i in range(40, 80):  # no landmarks: what pages share is found by differencing alone
        own = [say(12) for _ in range(4)]
        soup = "<div>Welcome to the shop</div><div>Menu one</div>" + "".join(f"<div>{x}</div>" for x in own) + f"<table><tr><td>Call us<td>or write {'today' if i % 20 else 'soon'}</table><div>All rights reserved by the shop and its owners since then</div>"
        rows.append((i, f"http://b.example/{i % 4}/{i}?x={i}", soup))
        expect[i] = " ".join(own)
    copy = page(["One text", say(50), say(50)])
    for i in range(80, 120):  # copies, and one with edits, keep their text
        rows.append((i, "https://c.example/copy" if i % 2 else f"https://c.example/copy/{i}", copy if i != 100 else copy.replace("One text", "Another title")))
        expect[i] = re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", copy[copy.index("<h1>") : copy.index("</article>")])).strip()
    expect[100] = expect[100].replace("One text", "Another title")
    big = [say(3)] + [say(8) for _ in range(3000)]
    rows += [(200, None, page(["N", "null url"])), (201, "https://a.example/p/3", None), (202, "u", ""), (203, "https://d.example/", page(big)), (None, "https://a.example/p/0", rows[0][2]), (0, rows[0][1], rows[0][2])]
    expect |= {200: "N null url", 201: "", 202: "", 203: " ".join(big), None: expect[0]}
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("x")).repartition(3)
    got = html_text.extract(pages).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        assert (r.text, r.n_chars) == (expect[r.page_id], len(expect[r.page_id])), r.page_id
    assert html_text.extract(pages.where("false")).count() == 0


# --- hash trees


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def climb(nodes):
    """Root, and each leaf's siblings as (left, right) from below."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i - i % 16
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
            at[leaf] = i // 16
        nodes = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def manifest_brute(rows):
    leaf = lambda r: H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], r[1])))
    low = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        sources[s].sort(key=lambda x: x[0])
        trees.append(climb([k[2] for k, _ in sources[s]]))
    root, tops = climb([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(order, trees, tops, strict=True):
        for (key, r), path in zip(sources[s], paths, strict=True):
            path = path + top
            acc = leaf((r[0], low(r[1]), *r[2:])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else key[2]
            for left, right in path:
                acc = H(left + acc + right)
            out.append((r[0], key[2], subroot, root, H("".join(a + b for a, b in path)), acc, acc == root))
    return sorted(out, key=str)


def test_addresses():
    for levels, arity in ((1, 16), (2, 16), (3, 16), (5, 3), (4, 2), (7, 2)):
        every = [manifest.address(levels, d, i, arity) for d in range(levels) for i in range(arity**d)]
        assert sorted(every) == list(range(manifest.size(levels, arity)))
    # halves: the first nodes are the upper levels, then come whole trees
    assert [manifest.address(4, d, i, 2) for d, i in ((0, 0), (1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (2, 1))] == [0, 1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest(spark, height, tmp_path):
    rng = random.Random(6)
    rows = []
    for source, n in (("b", 300), ("a", 17), ("é", 16), ("c", 1), (None, 20), ("", 2), *((f"s{i}", 1) for i in range(14))):
        rows += [(rng.randrange(10**6), rng.choice(["Ab C", "", "ÄÖ X" * rng.randrange(3), None, "q" * 50_000 if not i else "z"]), rng.choice(["en", None]), source, rng.choice([None, 5, -3])) for i in range(n)]
    rows += [rows[0], rows[0], (None, "Ab", "en", "a", 2), (None, "Ac", "en", "a", 2), (rows[1][0], "Other", None, "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumn("top", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("digest", F.lit("x")).repartition(5)
    got = sorted((tuple(r) for r in manifest.report(docs, height).collect()), key=str)
    assert got == manifest_brute(rows)
    if height == 2:
        m = manifest.build(manifest.leaves(docs))
        m.save(str(tmp_path / "m"))
        blocks = spark.read.parquet(str(tmp_path / "m"))
        assert m.root() == got[0][3] and blocks.groupBy("top", "none", "src", "address").count().where("count > 1").count() == 0
        assert blocks.where("address is null or size(nodes) > 273").count() == 0
    assert manifest.report(docs.where("false"), height).count() == 0 and manifest.build(manifest.leaves(docs.where("false"))).root() is None
    one = manifest.report(docs.where("source = 'c'"), height).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H("")


# --- conversations


def damage_brute(rows):
    out = []
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if f:
            row = (conv, turn, "user" if f == 4 else role, "" if f == 1 else text.translate({ord(c): None for c in ".!?"}) if f == 2 else text)
            out += [row] * (2 if f == 3 else 1)
    return out


def repair_brute(turns):
    """The whole row of one conversation's damaged turns, states as the initials so far."""
    turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for r in turns:
        end = r[3].rstrip(SPACES)
        faults.append("blank" if not end else "duplicate" if r[2:] in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add(r[2:])
    step = lambda state, ini: state if ini == "" else {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(ini)

    def grow(states):
        out = dict(states)
        for _ in range(3):
            for s, (cost, audit, text) in list(out.items()):
                ini, role = ("a", "assistant") if s == "u" else ("u", "user")
                new = (cost + 5, audit + "I", (*text, role + ":"))
                if ini not in out or new[:2] < out[ini][:2]:
                    out[ini] = new
        return out

    states = {"": (0, "", ())}
    for r, fault in zip(turns, faults, strict=True):
        new = {}
        for s, (cost, audit, text) in grow(states).items():
            options = [(s, cost + 2, "D", None)]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                options.append((step(s, r[2][:1]), cost + more, "K", f"{r[2]}:{r[3]}"))
                options += [(step(s, role[0]), cost + more + 1, "R", f"{role}:{r[3]}") for role in ("user", "assistant")]
            for to, c, e, line in options:
                if to is not None and (to not in new or (c, audit + e) < new[to][:2]):
                    new[to] = (c, audit + e, text if line is None else (*text, line))
        states = new
    cost, audit, text = min((v for s, v in grow(states).items() if s in ("", "a")), key=lambda v: v[:2])
    numbers = [r[1] for r in turns if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairwise(turns))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, H("\n".join(text))), text


def dialogues(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(12)):
            role = rng.choice(["system", "user", "assistant"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            role = rng.choice([None, "", "tool", "usher"]) if rng.random() < 0.1 else role
            text = rng.choice(["Yes.", "Yes.", "no", "", " \t\n", None, "Eh?\n", "so!  ", "a b c.", "ünd.", f"t{turn}.", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [rows[3]] * 3 + [(10_000, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "Go!"]) + f" {i % 50}.") for i in range(1500)]
    return rows


@pytest.mark.parametrize(("chunk", "rules"), [(1024, 512), (7, 5), (16, 0)])
def test_repair(spark, chunk, rules):
    rows = dialogues(chunk, 60)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("x")).withColumn("symbol", F.lit(1)).repartition(4)
    by_conv = {r[0]: [] for r in rows}
    for r in damage_brute(rows):
        by_conv[r[0]].append(r)
    expect = {c: repair_brute(t) for c, t in by_conv.items()}
    hurt = conversations.damaged(turns)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.examine(hurt, turns, chunk, rules).collect()}
    assert got == {c: x[0] for c, x in expect.items()}
    back = {}
    for r in conversations.repair(hurt, chunk, rules).orderBy("conv_id", "place").collect():
        back.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert back == {c: list(x[1]) for c, x in expect.items() if x[1]}


def test_repair_of_nothing(spark):
    turns = spark.createDataFrame([(1, 1, None, None), (2, 2, "user", "")], "conv_id long, turn long, role string, text string")
    assert conversations.report(turns.where("false")).count() == 0
    got = {r.conv_id: tuple(r)[1:] for r in conversations.examine(turns.where("conv_id = 2"), turns).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", H("")), 2: (0, 1, 0, 0, 0, 2, "D", H(""))}


def test_grammar():
    """A rule's matrix is that of the symbols it stands for."""
    rng = random.Random(8)
    for _ in range(50):
        symbols = rng.choices("suaoeSUAbd", k=6)
        rules = [("1", symbols[0], symbols[1]), ("2", symbols[2], symbols[3]), ("3", "1", "2")]
        m = conversations.matrices(rules)
        flat = m[symbols[0]]
        for s in symbols[1:4]:
            flat = conversations.product(flat, m[s])
        text = lambda x: [[y and (y[0], "".join(conversations.pieces(y[1]))) for y in row] for row in x]
        assert text(flat) == text(m["3"])
