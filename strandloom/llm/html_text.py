"""Main text of web pages by differencing pages of nearest URL, helped by the landmarks that pages name themselves.

1. A page becomes lines: one per block element, with white space as single spaces and character references decoded; br is white space.
   Scripts, styles, comments in the markup and the head give none. A line has a place (the path of its block elements and their classes),
   and is the furniture of a page (in nav, aside, form, ... or in an element whose class, id or role says menu, advert, comments, ...), its own text
   (in article, or main where there is no article) or neither. Where a page has own text, all the rest is furniture.
2. Within a host, pages are ordered by path, and each is paired with the nearest one before and after it that has other text. Lines of
   a pair are aligned by a longest common subsequence of their hashes; what both have is shared. A pair that shares
   half of its prose or more is a copy with edits, and says nothing about what is shared.
   Lines that the landmarks give away needn't be aligned.
3. Over all pairs of a host the share of shared lines of each place is counted. A place of which nearly all lines are shared is a template.
4. Furniture, lines in templates, and shared lines go. Own text is only believed to be a template's if its place is shared in half of its lines
   in at least EVIDENCE pairs, since short paragraphs of articles may be equal by chance.
5. The pages are parsed once more, and only those that lose lines besides furniture meet a list of them.

Pages of equal lines in a host are one unit: they are aligned once, so a group of copies costs one page. Hosts, units and partners with very
many rows are split off from the joins (`skew.join_counted`); pairs come from gapless ids of a range-partitioned order, so a host isn't a task.

Defined cases: a null html is an empty page, a null url a host of its own; pages alone on their host keep all but furniture; each of repeated
rows has its own result; unclosed elements end with the page, and what follows an unclosed script or comment is part of it; other columns are
ignored. A page's lines are held by one task; nothing else of any host is.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from strandloom.llm.skew import join_counted
from strandloom.operators.ids import ordered_ids
from strandloom.session import materialise, ship

FURNITURE, OWN, PROSE = 1, 2, 4
PROSE_WORDS = 8
#: Share of the prose of the smaller page from which on a pair is a copy.
COPY = 0.5
#: Shares of shared lines from which on a place is a template: for all lines, and for shared lines of own text.
TEMPLATE, OWN_TEMPLATE, EVIDENCE = 0.9, 0.5, 20

# Fixed values of the markup: elements that don't end a line, those without content, those whose content is no text, and those that are furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script style template noscript head iframe object svg math select textarea audio video canvas"
INLINE_HIDDEN = ("script", "style", "svg", "math")
ASIDE = frozenset("nav aside footer form button dialog menu fieldset".split())
# Words of a class, id or role that say furniture, whole or between hyphens and the like.
WORDS = frozenset(
    "ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion "
    "disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
# A word after one of these says what the element lacks or goes with.
AFTER = frozenset("has no non with without".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(HIDDEN.split())})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[/!?][^>]*>|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
HINT = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 14)
def _place(parent: int, tag: str, name: str) -> int:
    return _hash(parent, tag, name)


@lru_cache(1 << 14)
def _hinted(attributes: str) -> tuple[str, frozenset[str], bool]:
    """The class attribute without digits, the furniture words of class, id and role, and whether one of them stands alone."""
    name, found, alone = "", set(), False
    for kind, a, b, c in HINT.findall(attributes):
        value = a or b or c
        if kind.lower() == "class":
            name = re.sub(r"\d+", "", value)
        alone |= any(w.lower() in WORDS for w in value.split())
        words = [w.lower() for w in SPLIT.sub(" ", value).split()]
        found |= {w for before, w in zip(["", *words], words, strict=False) if w in WORDS and before not in AFTER}
    return name, frozenset(found), alone


def lines(page: str) -> list[tuple[str, int, int]]:
    """(text, place, flags) of a page's lines, in order."""
    found: list[tuple[str, int, bool, str]] = []
    # Open block elements: tag, place, is it furniture, whose own text it is.
    stack: list[tuple[str, int, bool, str]] = [("", 0, False, "")]
    open_tags: dict[str, int] = {}
    text: list[str] = []

    def end() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line:
                found.append((line, *stack[-1][1:]))
            text.clear()

    def close(tag: str) -> None:
        while stack[-1][0] != tag:
            open_tags[stack.pop()[0]] -= 1
        open_tags[stack.pop()[0]] -= 1

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m.group(3)
        if tag is None:
            if m.group(1) and m.group(1).lower() not in INLINE_HIDDEN:
                end()
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
        if tag in INLINE or tag == "br":
            continue
        end()
        if m.group(2):
            if open_tags.get(tag):
                close(tag)
            continue
        if tag in VOID or m.group(4).endswith("/"):
            continue
        if open_tags.get("p") and stack[-1][0] == "p":  # a block ends an open paragraph
            close("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag:
            close(tag)
        _, place, furniture, own = stack[-1]
        name, words, alone = _hinted(m.group(4)) if m.group(4) else ("", (), False)
        if tag in ("article", "main") and not furniture:
            own = "article" if tag == "article" or own == "article" else "main"
        if tag in ASIDE or tag == "header" and own != "article":
            furniture = True
        elif words and tag not in ("html", "body", "main") and (alone or tag != "article"):  # an article's class may say that it has comments
            furniture = True
        stack.append((tag, _place(place, tag, name), furniture, own))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    text.append(html.unescape(page[at:]))
    end()
    kinds = {own for _, _, furniture, own in found if not furniture}
    whose = "article" if "article" in kinds else "main" if "main" in kinds else None
    out = []
    for line, place, furniture, own in found:
        mine = whose is not None and not furniture and (own == whose or whose == "main" and own == "article")
        flags = (OWN if mine else FURNITURE if furniture or whose else 0) | (PROSE if line.count(" ") >= PROSE_WORDS - 1 else 0)
        out.append((line, place, flags))
    return out


def shared(a: list[int], b: list[int], most: int = 1 << 26) -> np.ndarray:
    """Which of a are in a longest common subsequence with b. Rows of bits over b are kept for up to `most` bits; larger tables are halved first."""
    out = np.zeros(len(a), bool)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ii, j, jj = todo.pop()
        while i < ii and j < jj and a[i] == b[j]:
            out[i] = True
            i, j = i + 1, j + 1
        while i < ii and j < jj and a[ii - 1] == b[jj - 1]:
            ii, jj = ii - 1, jj - 1
            out[ii] = True
        both = set(a[i:ii]) & set(b[j:jj])
        x = [k for k in range(i, ii) if a[k] in both]
        y = [k for k in range(j, jj) if b[k] in both]
        if not x:
            continue
        if len(x) == 1:
            out[x[0]] = True
        elif len(x) * len(y) <= most:
            out[_aligned([a[k] for k in x], [b[k] for k in y], x)] = True
        else:
            half = len(x) // 2
            first, last, other = [a[k] for k in x[:half]], [a[k] for k in x[half:]], [b[k] for k in y]
            forth = _lengths(_rows(first, other, False)[-1], len(y))
            back = _lengths(_rows(last[::-1], other[::-1], False)[-1], len(y))[::-1]
            cut = int(np.argmax(forth + back))
            mid = y[cut] if cut < len(y) else jj
            todo += [(x[0], x[half], y[0], mid), (x[half], ii, mid, jj)]
    return out


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit j of row i is 0 where the longest common subsequence of a[:i + 1] grows with b[j]."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows or [v]


def _lengths(row: int, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def _aligned(a: list[int], b: list[int], places: list[int]) -> list[int]:
    rows, i, j, out = _rows(a, b, True), len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(places[i])
                j -= 1
    return out


URL = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(.*)$", re.S)
PARSED = "k1 long, k2 long, unit binary, sig binary, host string, path string, query string, hashes binary, places binary"
#: Pages that lose lines beyond furniture: up to this number their lists are broadcast to the pages, beyond that the pages are shuffled to meet them.
BROADCAST_PAGES = 200_000


def _in_parts(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of batches, about 16 MB at a time."""
    for b in batches:
        step = max(1, int(b.num_rows * (1 << 24) / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield list(zip(*[part.column(c).to_pylist() for c in columns], strict=True))


def _keyed(pages: DataFrame) -> DataFrame:
    """(k1, k2, page_id, url, html): rows with equal keys are equal."""
    own = ["page_id", "url", "html"]
    none = [F.col(c).isNull() for c in own]
    return pages.select(F.xxhash64(*own, *none).alias("k1"), F.xxhash64(F.lit(2), *own, *none).alias("k2"), *own)


def parse(keyed: DataFrame) -> DataFrame:
    """PARSED rows: what identifies a page's lines but for furniture (unit) and their text (sig), their 64-bit hashes, and their places, 4 bytes each with the flags in the low bits."""
    ship(keyed.sparkSession)
    names, kinds = [f.split()[0] for f in PARSED.split(", ")], [pa.int64()] * 2 + [pa.binary()] * 2 + [pa.string()] * 3 + [pa.binary()] * 2

    def of(k1: int, k2: int, url: str | None, page: str | None) -> tuple:
        m = URL.match(url or "")
        host, path, query = (m.group(1).lower(), m.group(2), m.group(3)) if m else ("", url or "", "")
        found = [x for x in lines(page or "") if not x[2] & FURNITURE]
        hashes = np.array([_hash(x[0]) for x in found], "<i8").tobytes()
        places = np.array([x[1] & 0x7FFFFFF8 | x[2] for x in found], "<i4").tobytes()
        digest = lambda *parts: hashlib.blake2b(host.encode(errors="surrogatepass") + b"\x00" + b"".join(parts), digest_size=16).digest()
        return k1, k2, digest(hashes, places), digest(hashes), host, path, query, hashes, places

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(batches, ["k1", "k2", "url", "html"]):
            rows = [of(*x) for x in part]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return keyed.select("k1", "k2", "url", "html").mapInArrow(run, PARSED)


def units(parsed: DataFrame) -> DataFrame:
    """(unit, sig, host, c, path, query, hashes, places): pages of a host with equal lines; path and query are the first ones."""
    same = [F.min(c).alias(c) for c in ("sig", "host", "hashes", "places")]
    u = parsed.groupBy("unit").agg(*same, F.min(F.struct("path", "query")).alias("x"), F.count("*").alias("c"))
    return materialise(u.select("unit", "sig", "host", "c", "x.*", "hashes", "places"), "units")


def partners(found: DataFrame) -> DataFrame:
    """(unit, other): each unit with the units of other text that come before and after its text's first page by path, on its host."""
    with_lines = found.where(F.octet_length("hashes") > 0)
    texts = with_lines.groupBy("sig").agg(F.min("host").alias("host"), F.min(F.struct("path", "query", "unit")).alias("x"), F.count("*").alias("c")).select("sig", "host", "c", "x.*")
    placed = materialise(ordered_ids(materialise(texts, "texts"), ["host", "path", "query", "unit"], "at").select("at", "host", "sig", "c", "unit"), "by-url")
    beside = placed.select("host", "sig", "c", F.explode(F.array(F.col("at") - 1, F.col("at") + 1)).alias("at"))
    beside = beside.join(placed.select("at", F.col("host").alias("h"), F.col("unit").alias("other")).hint("merge"), "at").where("h = host").select("sig", "c", "other")
    beside = materialise(beside, "beside")
    return materialise(join_counted(with_lines.select("sig", "unit"), beside.hint("merge"), ["sig"], "c", found.count()).select("unit", "other"), "partners")


def differences(found: DataFrame) -> DataFrame:
    """(unit, host, places, same): for each pair that is no copy, which lines of the unit the other page has too."""
    pairs = partners(found)
    asked = pairs.groupBy("other").agg(F.count("*").alias("c"))
    others = asked.join(found.select(F.col("unit").alias("other"), F.col("hashes").alias("b_hashes"), F.col("places").alias("b_places")).hint("merge"), "other")
    others = materialise(others, "others")
    rows = join_counted(pairs, others.hint("merge"), ["other"], "c", pairs.count()).select("unit", "b_hashes", "b_places")
    rows = rows.join(found.select("unit", "host", "hashes", "places").hint("merge"), "unit")
    ship(found.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(batches, ["unit", "host", "places", "hashes", "b_places", "b_hashes"]):
            out = []
            for unit, host, pa_, ha, pb, hb in part:
                same = shared(np.frombuffer(ha, "<i8").tolist(), np.frombuffer(hb, "<i8").tolist())
                prose = np.frombuffer(pa_, "<i4") & PROSE > 0
                smaller = min(int(prose.sum()), int((np.frombuffer(pb, "<i4") & PROSE > 0).sum()))
                if not smaller or (same & prose).sum() < COPY * smaller:
                    out.append((unit, host, pa_, np.packbits(same, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.string(), pa.binary(), pa.binary()))], names=["unit", "host", "places", "same"])

    return materialise(rows.mapInArrow(run, "unit binary, host string, places binary, same binary"), "differences")


def _bits(same: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(same, np.uint8), bitorder="little", count=n).astype(bool)


def templates(different: DataFrame) -> DataFrame:
    """(host, place, rate, n_pages): the share of shared lines of each place of a host, and the pairs that were compared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(batches, ["host", "places", "same"]):
            counts: dict[tuple[str, int], list[int]] = {}
            for host, places, same in part:
                p = np.frombuffer(places, "<i4") >> 3
                which, at = np.unique(p, return_inverse=True)
                lines_, shared_ = np.bincount(at, minlength=len(which)), np.bincount(at, weights=_bits(same, len(p)), minlength=len(which))
                for w, n, s in zip(which.tolist(), lines_.tolist(), shared_.tolist(), strict=True):
                    c = counts.setdefault((host, w), [0, 0, 0])
                    c[0], c[1], c[2] = c[0] + n, c[1] + int(s), c[2] + 1
            rows = [(*k, *c) for k, c in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), *[pa.int64()] * 4))], names=["host", "place", "n", "s", "pairs"])

    per = different.select("host", "places", "same").mapInArrow(run, "host string, place long, n long, s long, pairs long")
    return per.groupBy("host", "place").agg((F.sum("s") / F.sum("n")).alias("rate"), F.sum("pairs").alias("n_pages"))


@F.pandas_udf(ArrayType(LongType()))
def _distinct_places(places: pd.Series) -> pd.Series:
    return places.map(lambda x: np.unique(np.frombuffer(x, "<i4") >> 3).tolist())


def losses(found: DataFrame) -> DataFrame:
    """(unit, c, gone): the units that lose lines besides furniture, and a bit a line."""
    different = differences(found)
    likely = materialise(templates(different).where(F.col("rate") >= OWN_TEMPLATE), "templates")
    own = found.where(F.octet_length("hashes") > 0).select("unit", "host", "places")
    if likely.count() <= BROADCAST_PAGES:
        own = own.join(F.broadcast(likely.select("host").distinct()), "host", "left_semi")
    # Each unit's places that may be templates: places are few a page, hosts may be large.
    own = materialise(own.select("unit", "host", F.explode(_distinct_places("places")).alias("place")), "places")
    counted = materialise(own.groupBy("host", "place").agg(F.count("*").alias("c")).join(likely, ["host", "place"]), "template-places")
    own = join_counted(own, counted, ["host", "place"], "c", own.count()).groupBy("unit").agg(F.collect_list(F.struct("place", "rate", "n_pages")).alias("likely"))
    both = different.where(F.regexp_like(F.hex("same"), F.lit("[^0]"))).groupBy("unit").agg(F.collect_list("same").alias("same"))
    asked = materialise(own.join(both, "unit", "full"), "asked")
    rows = found.select("unit", "c", "places").join(asked, "unit").select("unit", "c", "places", "likely", "same")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(batches, ["unit", "c", "places", "likely", "same"]):
            out = []
            for unit, c, places, known, same in part:
                p = np.frombuffer(places, "<i4")
                rate = {x["place"]: x["rate"] for x in known or () if x["n_pages"] >= EVIDENCE}
                rates = np.array([rate.get(x, 0.0) for x in (p >> 3).tolist()])
                either = np.logical_or.reduce([_bits(x, len(p)) for x in same or ()], initial=False) if same else np.zeros(len(p), bool)
                mine = p & OWN > 0
                gone = (rates >= TEMPLATE) | either & (~mine | (rates >= OWN_TEMPLATE))
                if gone.any():
                    out.append((unit, c, np.packbits(gone, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], names=["unit", "c", "gone"])

    return materialise(rows.mapInArrow(run, "unit binary, c long, gone binary"), "losses")


def extract(pages: DataFrame, broadcast_pages: int = BROADCAST_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars. Pages are read twice; they are only shuffled where more than broadcast_pages of them lose lines besides furniture."""
    keyed = _keyed(pages)
    parsed = materialise(parse(keyed), "parsed")
    lost = losses(units(parsed))
    per = join_counted(parsed.select("k1", "k2", "unit"), lost, ["unit"], "c", parsed.count()).select("k1", "k2", "gone").dropDuplicates(["k1", "k2"])
    per = materialise(per, "page-losses")
    rows = keyed.join(F.broadcast(per) if per.count() <= broadcast_pages else per.hint("merge"), ["k1", "k2"], "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(batches, ["page_id", "url", "html", "gone"]):
            out = []
            for page_id, url, page, gone in part:
                kept = [x[0] for x in lines(page or "") if not x[2] & FURNITURE]
                if gone is not None:
                    kept = [x for x, g in zip(kept, _bits(gone, len(kept)).tolist(), strict=True) if not g]
                out.append((page_id, url, " ".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "text"])

    texts = rows.mapInArrow(run, "page_id long, url string, text string")
    return texts.select("*", F.char_length("text").cast("long").alias("n_chars"))
