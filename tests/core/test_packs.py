"""Packs by next-pointers and folds in segments against walks through each key's rows, on keys that spread over many cells and ranges."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import captions, chunking, folds, memory, packs


@pytest.fixture
def spread(spark):
    """Small ranges stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, before)


def walked(rows, limit, at_least):
    out = {}
    for key in {r[0] for r in rows}:
        done, held, total = [], [], 0
        for _, n, size in sorted(((0, r[1], r[2]) for r in rows if r[0] == key)):
            if not at_least and held and total + size > limit:
                done.append(held)
                held, total = [], 0
            held, total = [*held, n], total + size
            if at_least and total >= limit:
                done.append(held)
                held, total = [], 0
        out[key] = done + ([held] if held else [])
    return out


@pytest.mark.parametrize(("at_least", "limit", "cell", "seed"), [(False, 20, 1, 1), (True, 20, 1, 2), (False, 5, 40, 3), (True, 50, 10, 4), (True, 5, 100_000, 5)])
def test_packs_equal_a_walk(spread, at_least, limit, cell, seed):
    rng = random.Random(seed)
    low = 0 if at_least else 1
    size = lambda: rng.choice([low, limit, limit + 1, limit + rng.randint(0, 9 * limit)]) if rng.random() < 0.2 else rng.randint(low, 9)
    rows = [(rng.choice([1, 1, 1, 2, None]) if rng.random() < 0.9 else rng.randint(3, 30), i, size()) for i in range(1200)]
    df = spread.createDataFrame([(*r, "x") for r in rows], "k long, n long, size long, rows string").repartition(5)
    got = {}
    for r in packs.packs(df, ["k"], ["n"], "size", limit, at_least, cell).collect():
        assert got.setdefault(r.k, {}).setdefault(r.pack_no, [x.n for x in r.rows]) == [x.n for x in r.rows]
    assert {k: [v[i + 1] for i in range(len(v))] for k, v in got.items()} == walked(rows, limit, at_least)
    assert packs.packs(df.limit(0), ["k"], ["n"], "size", limit, at_least, cell).count() == 0


def test_one_key_spreads_over_tasks(spread):
    df = spread.range(40_000, numPartitions=4).select(F.lit("chat").alias("k"), F.col("id").alias("n"), F.lit(3).cast("long").alias("size"))
    placed = packs.numbered(df, ["k"], ["n"], "size")
    by_part = [r["count"] for r in placed.groupBy(F.shiftright("_seq", packs.PART)).count().collect()]
    assert len(by_part) == 4 and max(by_part) < 20_000 and placed.where("`_at_size` <> 3 * n").count() == 0
    out = packs.packs(df, ["k"], ["n"], "size", 100, cell=1000)
    assert out.agg(F.max("pack_no"), F.count("*"), F.sum(F.size("rows"))).first() == (1213, 1213, 40_000)


def test_messages_equal_a_walk(spread):
    rng = random.Random(4)
    rows = [(1 if i % 5 else 2, i, "m" * rng.choice([3, 50, 90, 300])) for i in range(400)]
    df = spread.createDataFrame(rows, "chat long, n long, text string")
    got = sorted((r.chat, r.pack_no, r.n_messages, r.pack) for r in memory.message_packs(df, "chat", ["n"], F.concat(F.lit("#"), "n"), "text", 250, cell=300).collect())
    blocks = [(k, n, f"#{n}\n{t}") for k, n, t in rows]
    texts = {(k, n): b for k, n, b in blocks}
    want = walked([(k, n, len(b) + 2) for k, n, b in blocks], 250, False)
    assert got == sorted((k, i, len(p), "\n\n---\n\n".join(texts[k, n] for n in p)) for k, ps in want.items() for i, p in enumerate(ps, start=1))


def walked_sections(sections, tokens, share):
    """The rules of section packs, one section after the other; yields (number, titles, chunk)."""
    estimate = lambda t: max(1, len(t) // 4)
    overlap, made, tail = int(tokens * share), [], ""

    def close(parts, titles):
        nonlocal tail
        text = "\n\n".join(parts).strip()
        text = f"{tail}\n\n{text}" if tail and overlap else text
        tail = " ".join(text.split()[-max(2 * overlap, 40) :]) if overlap else ""
        made.append((len(made) + 1, titles, text))

    held = []
    for level, name, body in sections:
        whole = f"{'#' * level} {name}\n\n{body}".strip()
        n = estimate(whole)
        if held and sum(estimate(w) for _, w in held) + n > tokens:
            close([w for _, w in held], " | ".join(t for t, _ in held))
            held = []
        if n <= tokens:
            held.append((name, whole))
            continue
        own, size = [], 1
        for block in (f"## {name}\n\n{p.strip()}" for p in body.split("\n\n") if p.strip()):
            if own and size + estimate(block) > tokens:
                close(own, name)
                own, size = [], 0
            own, size = [*own, block], size + estimate(block)
        if own:
            close(own, name)
    if held:
        close([w for _, w in held], " | ".join(t for t, _ in held))
    return made


@pytest.mark.parametrize("share", [0.1, 0.6, 0.0])
def test_sections_equal_a_walk(spread, share):
    rng = random.Random(int(10 * share))
    words = lambda n: " ".join(rng.choice(["ab", "cde", "f g", "hijkl\n", "m\n\nn"]) for _ in range(n))
    docs = {d: [(rng.randint(1, 3), f"T{k}", words(rng.choice([0, 1, 3, 20, 90, 400]))) for k in range(40)] for d in (1, 2, 3)}
    df = spread.createDataFrame([(d, k, *s) for d, own in docs.items() for k, s in enumerate(own)], "doc long, n int, level int, title string, body string")
    got = sorted((r.doc, r.chunk_no, r.titles, r.chunk) for r in chunking.section_packs(df, "doc", "n", "level", "title", "body", 60, share, cell=100).collect())
    assert got == [(d, *c) for d, own in docs.items() for c in walked_sections(own, 60, share)]


def test_short_chunks_over_cells(spread):
    rng = random.Random(8)
    rows = [(i, rng.choice(["b", None]), rng.choice(["x", "x", None]), rng.randint(0, 60), "w " * rng.choice([0, 1, 5, 20, 45, 60])) for i in range(300)]
    got = {r.id: r.merged for r in memory.merged_shorts(spread.createDataFrame(rows, "id long, source_book string, chapter_title string, chunk_index long, content string"), cell=150).collect()}
    want = {}
    for key in {r[1:3] for r in rows}:
        own, last, held = sorted((r for r in rows if r[1:3] == key), key=lambda r: (r[3], r[0])), None, []
        for r in own:
            held.append(r)
            text = "\n\n".join(x[4] for x in held)
            if len(" ".join(text.split())) >= memory.SHORT:
                want |= {x[0]: None for x in held} | {r[0]: text}
                last, held = r, []
        if held:
            want |= {x[0]: None for x in held}
            text = "\n\n".join(x[4] for x in held)
            if last is None:
                want[held[-1][0]] = text
            else:
                want[last[0]] = "\n\n".join([want[last[0]], text] if last[3] < held[-1][3] else [text, want[last[0]]])
    assert got == want


def test_segments_equal_one_fold(spread):
    def chained(state, rows):
        """Never forgets how it started."""
        total = state or 0
        for r in rows:
            total = (total * 3 + r["x"]) % 1009
            if total % 2:
                yield r | {"x": total}
        return total

    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randint(0, 99)) for i in range(500)]
    df = spread.createDataFrame(rows, "k long, n long, x long").repartition(3)
    got = sorted(((r.k or 0, r.n, r.x) for r in folds.in_segments(df, ["k"], ["n"], chained, lambda total: [{"k": -1, "n": total, "x": 0}] if total else []).collect()))
    want = []
    for key in (1, 2, None):
        total = 0
        for k, n, x in rows:
            if k == key:
                total = (total * 3 + x) % 1009
                if total % 2:
                    want.append((k or 0, n, total))
        want.append((-1, total, 0))
    assert got == sorted(want)


def test_long_tracks_of_rolling_captions(spread):
    rng = random.Random(7)
    said = [rng.choice("abcdefg") for _ in range(900)]
    rows = [(v, float(i), i + 1.5, " ".join(said[i : i + rng.randint(1, 6)]).upper(), i) for v in (1, 2) for i in range(400 if v == 1 else 30)]
    df = spread.createDataFrame(rows, "video long, start double, end double, text string, cue int").repartition(3)
    got = sorted(tuple(r) for r in captions.without_rolling_repeats(df, "video").collect())
    want = []
    for v in (1, 2):
        fold = captions._rolled(None, (dict(zip(df.columns, r, strict=True)) for r in rows if r[0] == v))
        try:
            while True:
                want.append(tuple(next(fold).values()))
        except StopIteration as done:
            want.append(tuple(done.value[0].values()))
    assert got == sorted(want) and len(got) > 40
    assert captions.without_rolling_repeats(df.limit(0), "video").count() == 0


def test_a_plan_sends_contents_once(spread, tmp_path, monkeypatch):
    """Packs of short chunks are made of ids and sizes, and a plan is worked out once for what stays and what is inserted."""
    seen, written = [], memory.scratch.written
    monkeypatch.setattr(memory.scratch, "written", lambda df, name: (seen.append((name, df.dtypes)), written(df, name))[1])
    rows = [(i, "b", "x", i, "w " * n) for i, n in enumerate([5, 60, 4000, 0, 70, 60, 3])]
    k = spread.createDataFrame(rows, "id long, source_book string, chapter_title string, chunk_index long, content string")
    plan = memory.cleanup_plan(k)
    assert seen and not any("content" in str(kinds) or "text" in dict(kinds) for _, kinds in seen)  # before, every table of the packs had the contents
    done = memory.applied_plan(k, plan)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("chunk-fates") <= plan._jdf.queryExecution().optimizedPlan().toString().count("chunk-fates")
    assert {r.id: r.action for r in plan.collect()} == {0: "delete", 1: "update", 2: "update", 3: "delete", 4: "update", 5: "delete", 6: "delete"}
    assert {(r.id, r.chunk_index) for r in done.collect() if r.id == 2} == {(2, 2), (2, 2003)}  # equal pieces stay once


def test_section_packs_carry_a_body_once(spread, monkeypatch):
    widths, written = [], chunking.scratch.written

    def noted(df, name):
        out = written(df, name)
        if name == "section-packs":
            widths.append(sum(len(str(r.rows)) for r in out.collect()))
        return out

    monkeypatch.setattr(chunking.scratch, "written", noted)
    rows = [(1, i, 1, "t", "word " * 200) for i in range(10)]
    df = spread.createDataFrame(rows, "doc_id long, section long, level int, title string, body string")
    got = chunking.section_packs(df, "doc_id", "section", "level", "title", "body", 1000).collect()
    assert sum(r.chunk.count("# t") for r in got) == 10
    assert 10_000 < widths[0] < 15_000  # a body and the whole text with it, before
