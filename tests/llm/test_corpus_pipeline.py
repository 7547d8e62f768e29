"""The pipeline's stages in order over a small corpus, each against a plain version of it, with nulls, empty texts, copies and clashing names."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_dedup import ascii_lower, jaccard_brute, windows_brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def lines_brute(rows):
    """Texts without their repeated lines: equal ones at any length, and ones of 8 words and more at one edited word."""
    norm = lambda x: " ".join(ascii_lower(x).split(" ")) if "\t" not in x else " ".join(ascii_lower(x).split())

    def near(a, b):
        if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        s, t = sorted((a, b), key=len)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    seen, out = [], {}
    for i, t in sorted(rows):
        if t is None:
            out[i] = None
            continue
        kept = []
        for x in t.split("\n"):
            w = norm(x).split(" ")
            if w == [""] or not any(w == v or near(w, v) for v in seen):
                kept.append(x)
            if w != [""] and w not in seen:
                seen.append(w)
        out[i] = "\n".join(kept)
    return out


def test_stages(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    import corpus_pipeline

    rng = random.Random(12)
    words = {x: ["".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(150)] for x, letters in (("en", "abcdefghijk"), ("xx", "lmnopqrstuv"))}
    line = lambda x, n: " ".join(rng.choices(words[x], k=n))
    items = [(i, line("en", 14)) for i in range(3)] + [(9, None)]
    rows = []
    for i in range(1, 61):
        x = "en" if i % 2 else "xx"
        rows.append((i * 7 % 101, "\n".join(line(x, rng.randrange(9, 30)) for _ in range(3)), x))
    text = {i: t for i, t, _ in rows}
    rows += [(200, text[7], "en"), (201, text[7].replace("\n", " "), "en"), (202, line("en", 40) + "\n" + items[1][1].upper() + "!", "en"), (203, None, "en"), (204, "", None), (205, "12 34 !", "xx")]
    rows += [(206, "thanks\n" + line("en", 40), "en"), (207, line("en", 40) + "\nThanks", "en"), (208, (text[14] + " ").replace(text[14].split(" ")[2], "zzz", 1), "xx")]
    base = line("en", 60)
    rows += [(210, base, "en"), (211, base + " more", "en"), (212, base.replace(" ", "\n", 30).replace("\n", " ", 29), "en")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, x, "web", len(t) if t is not None else None) for i, t, x in rows], COLUMNS)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))

    now = {i: t for i, t, _ in rows}
    expect = {}
    now = {i: t for i, t in now.items() if t and i != 205}  # documents without a letter have no language
    expect["language_id"] = now
    now = lines_brute(now.items())
    expect["line_dedup"] = now
    groups = jaccard_brute(list(now.items()))
    now = {i: t for i, t in now.items() if groups[i][1] == i}
    expect["jaccard_join"] = now
    hits = windows_brute(list(now.items()), items)
    now = {i: t for i, t in now.items() if not hits[i][4]}
    expect["decontamination"] = now
    assert 202 not in now and not {201, 212} & set(expect["jaccard_join"]) and expect["line_dedup"][211] == "" and expect["line_dedup"][200] == ""

    sf = str(tmp_path)
    got = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, got, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{sf}/{name}")
        got = spark.read.parquet(f"{sf}/{name}")
        assert {r.doc_id: r.text for r in got.collect()} == expect[name], name
        if name != "language_id":
            assert all(r.n_chars == len(r.text) for r in got.collect())
    tokens = Tokenizer.from_file(path("word_bpe_49k.json"))
    pieces = {}
    for i, t in now.items():
        ids = np.array([*tokens.encode(t, add_special_tokens=False).ids, 2], "<u4")
        pieces[i] = [(0, len(ids), zlib.crc32(ids.tobytes()))]
    final = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: [(r.start, r.length, r.ids_crc32)] for r in final} == pieces


def test_clashing_names(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["row", "gone", "id", "lines", "score", "spans", "node", "n_hit"]
    docs = spark.createDataFrame([(1, "one two three", "en", "web", 13), (1, "one two three", "en", "web", 13), (2, "vier elf acht", "de", None, 13)], COLUMNS)
    for n in names:
        docs = docs.selectExpr("*", f"'x' as {n}")
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2}, name
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 3


def python_bytes(df):
    """What the Python nodes of df's plan are sent and return while df is collected."""
    df.collect()
    sent = got = 0
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.metrics().contains("pythonDataSent"):
            sent += node.metrics().apply("pythonDataSent").value()
            got += node.metrics().apply("pythonDataReceived").value()
    return sent, got


def test_rows_stay_in_spark(spark, tmp_path):
    """Stages that drop documents send their texts to Python once and get flags back: rows there and back cost executors their memory."""
    from strandloom.llm import decontaminate, language_id

    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh" if i % 2 else "rstuvwxy", k=5)) for _ in range(200)), "en" if i % 2 else "xx", "web", 1199) for i in range(400)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs, size = spark.read.parquet(str(tmp_path / "documents.parquet")), sum(len(r[1]) for r in rows)
    items = spark.createDataFrame([(1, rows[0][1][:120]), (2, rows[1][1][-90:])], "item_id long, text string")
    for kept, n in ((language_id.keep_identified(docs), 400), (decontaminate.clean(docs, items), 398)):
        sent, got = python_bytes(kept)
        assert size <= sent < 1.3 * size and 0 < got < 0.1 * size and kept.count() == n
    assert {r.doc_id for r in decontaminate.clean(docs, items, per_pass=5).collect()} == set(range(2, 400))


def test_blocks_are_small():
    """A worker's arrays follow the block, not the batch: under 24 MB for 8 MB of text."""
    import tracemalloc

    from strandloom.llm import jaccard_join, language_id

    data, off = np.frombuffer(b"some words of a text " * 400_000, np.uint8), np.arange(0, 8_400_001, 4200)
    model = language_id.Model(["a", "b"], language_id.codewords(2), np.ones((1, language_id.DIMS), np.float32), np.ones(1), np.zeros(1), np.ones(1))
    for run in (lambda: model.averages(data, off), lambda: sum(len(x) for _, _, _, x in jaccard_join.sets(data, off))):
        tracemalloc.start()
        run()
        assert tracemalloc.get_traced_memory()[1] < 24e6
        tracemalloc.stop()


def test_batches_are_bounded(spark):
    from corpus_pipeline import STAGES
    from strandloom.session import BATCH, BATCH_CONF

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    docs = spark.createDataFrame([(i, "a word " * 20, "en", "s", 140) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in STAGES:
        if name in ("language_id", "jaccard_join", "packing"):
            spark.conf.unset(BATCH_CONF)
            stage(spark, docs, "")
            assert int(spark.conf.get(BATCH_CONF).rstrip("b")) == BATCH, name
    got = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("word "), 500).alias("text")).mapInArrow(count, "size long, n long").collect()
    assert sum(r.n for r in got) == 8000 and max(r.size for r in got) < 1.1 * BATCH  # one batch of 20 MB before
    spark.conf.set(BATCH_CONF, 1 << 20)
    STAGES[0][1](spark, docs, "")
    assert int(spark.conf.get(BATCH_CONF)) == 1 << 20  # the user's own
    spark.conf.unset(BATCH_CONF)


def test_languages_start_no_other_workers(spark, monkeypatch):
    from strandloom.llm import language_id

    docs = spark.createDataFrame([(i, f"a word {i}", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string").cache()
    docs.count()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)  # rows of Python go through it and workers with an environment of their own
    assert language_id.fit(docs, F.col("doc_id")).langs == ["de", "en"]
    monkeypatch.undo()
    docs.unpersist()


def test_counting_holds_little():
    import tracemalloc

    from strandloom.llm import jaccard_join

    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(300)])
    texts = [" ".join(words[rng.integers(0, 300, 900)]) for _ in range(2500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 500])], names=["text"]) for i in range(0, 2500, 500)]
    tracemalloc.start()
    out = list(jaccard_join._counted(6, 32)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak  # over 70 MB when all of a task's shingles were made unique at once
    assert sum(sum(b) for r in out for b in r.column("counts").to_pylist()) == 2500 * 896  # every shingle once


def test_workers_forget():
    from strandloom.llm import worker

    made = []
    make = lambda: made.append(1) or len(made)
    run = lambda batches: (worker.remembered("a", make) + b for b in batches)
    assert list(worker.tidy(run, keep=True)(iter([0, 0]))) == [1, 1] == list(worker.tidy(run, keep=True)(iter([0, 0])))
    assert list(worker.tidy(lambda batches: batches)(iter([5]))) == [5] and not worker._remembered
    assert list(worker.tidy(run, keep=True)(iter([0]))) == [2]
