"""Every registered text-memory query against its SQL, on the smallest tables; and cases that the tables lack."""

import itertools
import json
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import captions, chunking, lifecycle, matching, memory, retrieval, tables
from textloom.plans.queries import ORACLE, QUERIES
from textloom.sources import exports
from textloom.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = ("region", "customer", "orders", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(v):
    if isinstance(v, float):
        return f"{v:.8g}"
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({ORACLE[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(plain, map(list, got))) == sorted(map(plain, map(list, want)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_greedy_packs_fill_and_cut(spark):
    df = spark.createDataFrame([(1, "aaaa\n\nbb\n \ncccccccccccc\n\ndd\n\ne"), (2, ""), (3, None)], "id int, text string")
    chunks = lambda x: [(r.id, r.chunk) for r in x.orderBy("id", "chunk_no").collect()]
    assert chunks(chunking.paragraph_packs(df, "text", ["id"], 8)) == [(1, "aaaa\n\nbb"), (1, "cccccccc"), (1, "cccc"), (1, "dd\n\ne")]
    lines = spark.createDataFrame([(1, "aaaa\nbb\ncccccccccccc\n\nd\n"), (2, "")], "id int, text string")
    assert chunks(chunking.line_packs(lines, "text", ["id"], 8)) == [(1, "aaaa\nbb"), (1, "cccccccccccc"), (1, "\nd")]


def test_section_packs(spark):
    """By hand, at 10 tokens (40 characters) a chunk: an overlap of one token is 40 words of the chunk before."""
    rows = [(1, 0, 1, "Preamble", "start"), (1, 1, 2, "One", "short"), (1, 2, 1, "Two", "p" * 30 + "\n\n" + "q" * 30 + "\n\nr"), (1, 3, 3, "Three", "end"), (2, 0, 1, "Document", "alone")]
    s = spark.createDataFrame(rows, "doc long, n int, level int, title string, body string")
    got = [(r.doc, r.chunk_no, r.titles, r.chunk) for r in chunking.section_packs(s, "doc", "n", "level", "title", "body", 10).orderBy("doc", "chunk_no").collect()]
    first = "# Preamble\n\nstart\n\n## One\n\nshort"
    second = " ".join(first.split()) + "\n\n## Two\n\n" + "p" * 30
    third = " ".join(second.split()) + "\n\n## Two\n\n" + "q" * 30
    fourth = " ".join(third.split()[-40:]) + "\n\n## Two\n\nr"
    assert got[:4] == [(1, 1, "Preamble | One", first), (1, 2, "Two", second), (1, 3, "Two", third), (1, 4, "Two", fourth)]
    assert got[4:] == [(1, 5, "Three", " ".join(fourth.split()[-40:]) + "\n\n### Three\n\nend"), (2, 1, "Document", "# Document\n\nalone")]
    titles = chunking.sections(spark.createDataFrame([(1, "no heading"), (2, "text\n# A\nb"), (3, "")], "id int, t string"), "t", "id").orderBy("id", "section").collect()
    assert [(r.id, r.title, r.body) for r in titles] == [(1, "Document", "no heading"), (2, "Preamble", "text"), (2, "A", "b"), (3, "Document", "")]


def test_semantic_branch_of_routing(spark):
    d = spark.createDataFrame([(1, "it", "x" * 1200), (2, "islam", "a\n\nb"), (3, "other", "one two three")], "id long, category string, text string")
    sentences = spark.createDataFrame([(3, 1, "one", [1.0, 0.0]), (3, 2, "two", [1.0, 0.01]), (3, 3, "three", [0.0, 1.0]), (1, 1, "no", [1.0, 0.0])], "id long, n int, text string, embedding array<float>")
    out = chunking.routed(d, "text", "category", ["id"], ["it"], ["islam", "finance"], chunking.semantic_chunks(sentences, "id", "n", "embedding", "text", 0.5))
    assert sorted((r.id, r.chunk_no, len(r.chunk)) for r in out.collect() if r.id < 3) == [(1, 1, 1000), (1, 2, 400), (2, 1, 1), (2, 2, 1)]
    assert sorted((r.chunk_no, r.chunk) for r in out.collect() if r.id == 3) == [(1, "one two"), (2, "three")]


@pytest.mark.parametrize("n, m", [(20, 20), (1000, 20), (12345, 20), (50000, 7)])
def test_systematic_sample(spark, n, m):
    ids = [7 * i % 100003 for i in range(n)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    got = sorted((r.position, r.id) for r in tables.systematic_sample(df, "id", m, 8).collect())
    assert got == [(i * n // m, sorted(ids)[i * n // m]) for i in range(m)]


def test_sample_of_large_table(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = [(r.doc_id, r.position) for r in QUERIES["w6_systematic_sample"](spark, sf).collect()]
    assert sorted(got) == sorted(con.execute(f"select doc_id, position from ({ORACLE['w6_systematic_sample']})").fetchall()) and len(got) == 20


def test_nearest_skips_null_and_zero_vectors(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id long, embedding array<float>")
    q = c.select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r.id) for r in retrieval.nearest(q, c, 2).collect()}
    assert got == {(1, 1), (1, 4), (4, 4), (4, 1)}


def test_semantic_duplicates_behind_other_kinds(spark):
    rows = [(1, "a", [1.0, 0.0])] + [(i, "b", [1.0, i / 1000]) for i in range(2, 22)] + [(30, "a", [1.0, 0.5]), (31, "a", [1.0, 0.6]), (32, "a", [0.0, 1.0]), (33, "a", None)]
    c = spark.createDataFrame(rows, "id long, kind string, embedding array<float>")
    found = lambda **o: [(r.query_id, r.duplicate_of) for r in retrieval.semantic_duplicates(c, c.where("id = 1"), "kind", 0.85, **o).collect()]
    assert found() == [(1, 30)] and found(compat=True) == []


def test_conflict_ledger_and_decisions(spark):
    r = spark.createDataFrame([(1, "t", 1, "draft"), (2, "t", 2, "approved"), (3, "t", 3, "approved")], "request_id int, token string, at int, state string")
    assert [x.outcome for x in tables.publish_ledger(r).orderBy("request_id").collect()] == ["rejected", "accepted", "duplicate"]
    c = spark.createDataFrame([(1, "a", "X y"), (2, "a", " x  Y"), (3, "a", None)], "id int, kind string, content string")
    d = spark.createDataFrame([(1, "accept", 2), (2, "accept", 1)], "id int, decision string, at int")
    assert [x.status for x in lifecycle.apply_decisions(c, d, c.limit(0)).orderBy("id").collect()] == ["duplicate", "active", "pending"]


def test_edits_and_semantic_duplicates_in_review(spark):
    c = spark.createDataFrame([(1, "a", "one"), (2, "a", "two"), (3, "a", "three"), (4, "a", "four"), (5, "a", "known")], "id long, kind string, content string")
    d = spark.createDataFrame([(1, "edit", 1, "other"), (1, "edit", 2, "KNOWN "), (1, "accept", 3, None), (2, "accept", 1, None), (3, "edit", 1, "new"), (4, "skip", 1, None), (4, "reject", 2, None)], "id long, decision string, at int, text string")
    active = spark.createDataFrame([(70, "a", "known"), (71, "a", "near two")], "id long, kind string, content string")
    similar = spark.createDataFrame([(2, 71), (3, 71)], "query_id long, duplicate_of long")
    got = {r.id: tuple(r)[2:] for r in lifecycle.apply_decisions(c, d, active, similar).collect()}
    assert got == {1: ("duplicate", "KNOWN ", "exact_content", 70), 2: ("duplicate", "two", "semantic_similarity", 71), 3: ("pending", "new", None, None), 4: ("rejected", "four", None, None), 5: ("pending", "known", None, None)}


def test_chat_exports_and_quarantine(spark, tmp_path):
    one = {"id": 5, "name": "n", "type": "public_channel", "messages": [{"id": 1, "type": "message", "from_id": "channel1", "text": ["a longer text ", {"text": "in parts"}]}, {"id": 2, "type": "message", "from_id": "u", "text": " plain text of some length "}, {"id": 3, "type": "message", "from_id": "u", "text": "", "photo": "p.jpg"}, {"id": 4, "type": "message", "from_id": "u", "text": "token: abc def ghi jkl"}, {"id": 5, "type": "message", "from_id": "x", "text": "somebody else says this"}]}
    for name, text in (("a", json.dumps({"chats": {"list": [one, {"name": "m", "messages": [{"id": "text", "type": 4}]}, {"name": "z", "messages": {"x": 1}}]}})), ("b", json.dumps(one)), ("c", "{broken"), ("d", '{"other": 1}'), ("e", "[1, 2]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(text)
    (tmp_path / "a" / "notes.json").write_text(json.dumps(one))
    messages, bad = exports.chat_exports(spark, str(tmp_path))
    assert messages.count() == 11 and {r.text for r in messages.where("id < 3").collect()} == {"a longer text in parts", "plain text of some length"}
    assert sorted((r.path[-13], r.chat_pos, r.reason) for r in bad.collect()) == [("a", 2, "messages of other types"), ("c", None, "not JSON"), ("d", None, "no export"), ("e", None, "no export")]
    clean = exports.cleaned_chats(messages, "u")
    assert sorted((r.text, r.char_count, r.kind) for r in clean.collect()) == [("a longer text in parts", 22, "posts"), ("plain text of some length", 25, "posts")]
    written = exports.write_corpus(clean, str(tmp_path / "out"))
    assert written.where("kind = 'posts'").count() == 2
    stats = {r.kind: r for r in spark.read.json(str(tmp_path / "out/stats")).collect()}
    assert stats["all"].message_count == 2 and stats["posts"].total_characters == 47 and [tuple(x) for x in stats["all"].top_chats] == [("n", 2)]


def test_text_tree_replaced_books_and_logs(spark, tmp_path):
    for name, text in (("islam/A_book.md", "x"), ("b/finance_notes.md", " "), ("b/Draft_skip.md", "y")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    rows = {r.source_book: (r.category, r.status) for r in exports.text_tree(spark, str(tmp_path / "in"), excluded=["draft"]).collect()}
    assert rows == {"A book": ("islam", "ok"), "finance notes": ("it", "empty"), "Draft skip": ("it", "excluded")}
    assert {r.category for r in exports.text_tree(spark, str(tmp_path / "in"), by_name=True).collect()} == {"psychology", "finance"}
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "source_book string, n int")
    exports.replace_books(chunks, str(tmp_path / "books"))
    exports.replace_books(chunks.where("source_book = 'a'").withColumn("n", F.lit(9)), str(tmp_path / "books"))
    assert sorted((r.source_book, r.n) for r in spark.read.parquet(str(tmp_path / "books")).collect()) == [("a", 9), ("b", 2)]
    log = spark.createDataFrame([("s" * 1200,), (None,)], "summary string")
    for _ in range(2):
        exports.append_log(log, str(tmp_path / "log"))
    assert sorted(len(r.summary or "") for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [0, 0, 1000, 1000]
    tables.export(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "json"))
    assert [r.value for r in spark.read.text(str(tmp_path / "json")).collect()] == ['{"a":null,"b":1}']


def test_stream_equals_batch_and_survives_replay(spark, tmp_path):
    rows = [(1, 1, "x" * 90, "2024-01-01 00:00:00", False), (1, 1, "x" * 90, "2024-01-01 00:00:00", False), (1, 2, "short", "2024-01-01 00:00:00", False), (None, 3, "y" * 90, "2024-01-01 00:00:00", True)]
    posts = spark.createDataFrame(rows, "channel_id long, message_id long, text string, date string, forwarded boolean").withColumn("date", F.to_timestamp("date"))
    posts.write.parquet(str(tmp_path / "in"))
    for run in ("one", "two"):
        stream = spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in"))
        ingest.channel_posts(stream, str(tmp_path / "ledger"), str(tmp_path / f"dead-{run}"), str(tmp_path / f"check-{run}")).awaitTermination()
    assert [(r.channel_id, r.message_id) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()] == [(1, 1)]


def test_expressions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(T.strip(F.lit("  a ")), T.seconds(F.lit("01:02:03.5")), T.chapter_title(F.lit("x\n# One\ny")), T.urls(F.lit("http://a.b/x). http://c.d"), ["a.b"]), T.without_urls(F.lit("see http://a.b/x). and http://c.d"), ["a.b"])) == ("a", 3723.5, "One", ["http://a.b/x"], "see and http://c.d")
    assert one(*[T.caption_text(F.lit(x)) for x in ("<i>a</i>&amp; b -", "&lt;b&gt;bold&lt;/b&gt; &eacute;&#8217;", "a&amp;lt;b")]) == ("a& b", "bold é’", "a&lt;b")
    cut = lambda x, n: one(T.enforce_length(F.lit(x), n))[0]
    assert [cut("  short  ", 10), cut("one two. three four", 12), cut("one two, three", 10), cut("abcdefghijklmno", 10), cut("ab. cdefgh ijk", 10)] == ["short", "one two.", "one two…", "abcdefghij", "ab. cdefgh…"[:3] + "…"]
    assert one(*[T.length_class(F.lit("x" * n)) for n in (179, 180, 649, 650)]) == ("short", "normal", "normal", "expanded") and one(*[T.length_class(F.lit("x" * n), True) for n in (299, 300, 800)]) == ("short", "normal", "expanded")
    noise = [T.is_noise(F.lit(x)) for x in ("password is not a word to fear", "Password : hunter2 and more", "HTTPS://example.org/path/to", "пароль= что-то длинное", "login page is broken again", "short", None)]
    assert one(*noise) == (False, True, True, True, False, True, True)
    assert one(T.tagged_section(F.lit("x <OWN> mine\n</OWN> <ext>no</ext>"), "own", "ext"), T.tagged_section(F.lit("a <ext>no</ext>\n<b>c</b> <!--source:youtube-->"), "own", "ext")) == ("mine", "a <b>c</b>")
    assert one(T.clean_markdown(F.lit('### <span id="page-1-2"></span>Head\nbroken\nline [\\[3\\]](#page-1-2)\n\ngoes on [4](#page-1-2).\n\n\n\n- item')), T.clean_markdown(F.lit(" "))) == ("## Head\nbroken line [3]\n\ngoes on [4].\n\n- item\n", "")
    event = F.struct(F.lit("error").alias("status"), F.lit("2024-01-01").alias("created_at"), F.lit("bad").alias("summary"))
    assert one(T.status_map(event, F.create_map(F.lit("k"), F.lit("v"), F.lit("at"), F.lit("x"))))[0] == {"status": "error", "at": "2024-01-01", "error": "bad", "k": "v"}


def test_broken_lines_are_joined(spark):
    """By the rules, line by line: over one blank line too, never onto a heading or a sentence's end, never before a heading or a list item."""
    def walk(text):
        out, lines, i = [], text.splitlines(), 0
        ends, item = re.compile(r"[.!?;:»\"')\]]$"), re.compile(r"(\d+\.|[-*+])\s")
        takes = lambda: bool(out and out[-1] and not out[-1].startswith("#") and not ends.search(out[-1]))
        may = lambda x: bool(x) and not x.startswith("#") and not item.match(x)
        while i < len(lines):
            now, after = lines[i].strip(), lines[i + 1].strip() if i + 1 < len(lines) else ""
            if not now and takes() and may(after):
                out[-1] += " " + after
                i += 1
            elif takes() and may(now):
                out[-1] += " " + now
            else:
                out.append(now)
            i += 1
        return "\n".join(out)

    rng = random.Random(3)
    pool = ["abc", "def.", "# head", "- item", "1. one", "", "", "  x y ", "end)", "##no"]
    rows = [(i, rng.choice(["\n", "\n\r\n"]).join(rng.choices(pool, k=rng.randrange(1, 12)))) for i in range(500)]
    for r in spark.createDataFrame(rows, "i int, t string").select("t", T.joined_lines(F.col("t")).alias("j")).collect():
        assert r.j == walk(r.t)


def test_context_gate_budget_and_fallback(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], True, False), (2, [1.0, 0.0], False, False), (3, [1.0, 0.0], False, True)], "query_id long, embedding array<float>, factual boolean, religious boolean")
    k = spark.createDataFrame([(i, [1.0, i / 10], "verified" if i % 2 else "unverified") for i in range(8)], "id long, embedding array<float>, verification_status string")
    got = {}
    for r in retrieval.gated_knowledge(q, k).collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert {i: sorted(x) for i, x in got.items()} == {1: [0, 1, 2], 3: [1, 3, 5]}
    rows = spark.createDataFrame([(1, 1, "v" * 5000), (1, 2, "w" * 5000), (2, 1, "short")], "query_id long, rank int, t string")
    voice = retrieval.layer(rows, F.col("t"), "voice")
    rules = retrieval.layer(rows.where("query_id = 1"), F.lit("r" * 2000), "rules")
    out = {r.query_id: r for r in retrieval.context(q.select("query_id"), {"rules": (rules, "none"), "voice": (voice, "no voice")}, budget=9000, frame=100).collect()}
    assert (out[1].context_chars, len(out[1].voice), out[1].voice[-1], out[1].n_voice) == (9000, 4899, "…", 2)
    assert (out[2].voice, out[2].rules, out[3].voice, out[3].n_rules) == ("short", "none", "no voice", 0)
    tight = {r.query_id: len(r.voice) for r in retrieval.context(q.select("query_id"), {"rules": (rules, "-"), "voice": (voice, "-")}, budget=10).collect()}
    assert tight == {1: 1000, 2: 5, 3: 1}
    r = spark.createDataFrame([(i, [1.0, i / 10], i < 2, f"2024-01-0{i + 1}") for i in range(6)], "id long, embedding array<float>, is_global boolean, updated string")
    near = retrieval.nearest(q, r, 4)
    chosen = lambda rules, near: {q: [x.id for x in xs] for q, xs in itertools.groupby(memory.rules_for(q_only, near, rules, F.col("is_global"), [F.desc("updated")], 4).orderBy("query_id", "rank").collect(), key=lambda x: x.query_id)}
    q_only = q.where("query_id = 1").select("query_id", "embedding")
    assert chosen(r, near.where("query_id = 1")) == {1: [1, 0]}  # the two nearest are the global ones themselves
    assert chosen(r.withColumn("is_global", F.lit(False)), near.limit(0)) == {1: [5, 4, 3, 2]}


def test_matching_functions(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], 2, "a", True, False), (2, [1.0, 0.0], 5, None, False, True)], "query_id long, embedding array<float>, match_count int, filter_category string, verified_only boolean, include_regrets boolean")
    rows = [(i, [1.0, i / 10], "ab"[i % 2], "verified" if i % 3 == 0 else "no", i % 4 == 0, "active" if i else "archived", 1.0 - i / 10) for i in range(7)] + [(9, None, "a", "verified", False, "active", 1.0)]
    t = spark.createDataFrame(rows, "id long, embedding array<float>, category string, verification_status string, is_regret boolean, status string, quality_weight double")
    ids = lambda df: {k: [r.id for r in x] for k, x in itertools.groupby(df.orderBy("query_id", "rank").collect(), key=lambda r: r.query_id)}
    assert ids(matching.match_knowledge_chunks(q, t)) == {1: [2, 4], 2: [1, 2, 3, 4, 5]}
    assert ids(matching.match_knowledge_chunks_v21(q, t)) == {1: [3, 6], 2: [1, 2, 3, 4, 5]}
    assert ids(matching.match_life_experiences(q, t)) == {1: [1, 2], 2: [1, 2, 3, 4, 5]}
    assert ids(matching.match_life_experience(q.drop("match_count"), t)) == {1: [1, 2, 3, 5, 6], 2: [0, 1, 2, 3, 4]}
    assert ids(matching.match_persona_rules(q, t)) == {1: [1, 2], 2: [1, 2, 3, 4, 5]}
    assert ids(matching.match_voice_examples(q, t)) == ids(matching.match_voice_examples(q, t, mode="exact")) == {1: [1, 2], 2: [1, 2, 3, 4, 5]}


def test_nearest_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 11)
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], rng.choice("xyz")) for i in range(300)]
    c = spark.createDataFrame(rows, "id long, embedding array<float>, kind string").repartition(5)
    q = c.where("id % 5 = 0").select(F.col("id").alias("query_id"), "embedding", F.when(F.col("id") % 10 == 0, F.col("kind")).alias("kind"))
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    for null_for_all in (False, True):
        got = {}
        for r in retrieval.nearest(q, c, 4, kind="kind", null_for_all=null_for_all).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for i, v, k in rows:
            if i % 5 == 0:
                k = k if i % 10 == 0 else None
                near = sorted((-round(sum(a * b for a, b in zip(unit(v), unit(w))), 9), j) for j, w, other in rows if any(v) and any(w) and (other == k or k is None and null_for_all))
                assert got.get(i, []) == [j for _, j in near[:4]]


def test_drafts_from_their_change_log(spark):
    rows = [(1, 1, "created", {}), (1, 2, "patched", {"length_mode": "short", "pending_instruction": "again"}), (1, 3, "version", {"text": "v1"}), (1, 4, "patched", {"length_mode": None}), (2, 1, "created", {"state": "idea"})]
    events = spark.createDataFrame(rows, "draft_id int, at int, event string, patch map<string, string>")
    fields = ["state", "length_mode", "final_text", "pending_instruction"]
    got = {r.draft_id: tuple(r)[1:] for r in memory.current_drafts(memory.draft_changes(events, fields), "draft_id", F.col("at"), fields).collect()}
    assert got == {1: ("drafted", None, "v1", None, 4), 2: ("idea", "normal", None, None, 1)}


def test_modes_urls_and_parts(spark):
    text = F.lit("x\nURL: https://a.b/c d\n<YouTube_post_mode> Deep </youtube_post_mode>")
    row = spark.range(1).select(T.post_mode(text, ["deep", "short"], "short"), T.post_mode(F.lit("none"), ["deep"], "short"), T.stated_url(text), T.stated_url(F.lit("no")), T.json_part(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))).first()
    assert tuple(row) == ("deep", "short", "https://a.b/c", None, '{"a":2,"b":1}')
    log = tables.conflict_log(spark.createDataFrame([("k", 1, 5, [3, 4])], "a string, b int, winner int, losers array<int>"), ["a", "b"], F.lit("2024-01-01"))
    assert tuple(log.first()) == ("k|1", 5, [3, 4], "2024-01-01")


def test_confirmed_rows_mark_their_journal(spark):
    pending = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    journal = spark.createDataFrame([(1, "pending"), (3, "pending")], "id int, status string")
    rows, marked = memory.confirmed(pending, spark.createDataFrame([(1,), (1,)], "id int"), journal)
    assert [r.id for r in rows.collect()] == [1] and {(r.id, r.status) for r in marked.collect()} == {(1, "applied"), (3, "pending")}


def test_lists_find_what_exact_search_finds(spark):
    c = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = c.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact = pairs(retrieval.nearest(q, c, 6))
    assert pairs(retrieval.nearest_in_lists(q, c, 6, 8, 8)) == exact
    assert len(pairs(retrieval.nearest_in_lists(q, c, 6, 16, 10)) & exact) >= 0.9 * len(exact)


def test_list_query_has_its_recall(spark):
    c = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact = pairs(retrieval.nearest(c.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), c, 6))
    assert len(pairs(QUERIES["j11_nearest_in_lists"](spark, "/root/testdata/sf0.1")) & exact) >= 0.9 * len(exact)


def test_rolling_captions(spark):
    rows = [(1, 0, 0.0, 1.0, "one two three"), (1, 1, 4.0, 5.0, "ONE two three four"), (1, 2, 5.0, 6.0, "Two three four five six"), (1, 3, 6.0, 7.0, "five SIX"), (2, 0, 0.0, 9.0, "five six"), (2, 1, 9.5, 10.0, "five six seven")]
    df = spark.createDataFrame(rows, "video int, cue int, start double, end double, text string")
    got = [(r.video, r.start, r.end, r.text) for r in captions.without_rolling_repeats(df, "video").orderBy("video", "start").collect()]
    # 4 s after the last one's start: replaced; 9.5 s after: kept, two shared words are too few to cut
    assert got == [(1, 0.0, 5.0, "ONE two three four"), (1, 5.0, 6.0, "five six"), (2, 0.0, 9.0, "five six"), (2, 9.5, 10.0, "five six seven")]


def test_caption_files(spark):
    text = "WEBVTT\nKind: captions\n\n1\n00:01.000 --> 00:02.000 align:start\n<c>one</c>\ntwo\n00:02.000 --> 00:03.000\nthree\n\n00:03.000 --> 00:04.000\nthree\n\nNOTE\nlost\n\n01:00:00,500 --> 01:00:01,000\nlast &lt;i&gt;x"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert [(r.start, r.end, r.text) for r in captions.vtt(df, "t", ["id"]).orderBy("cue").collect()] == [(1.0, 2.0, "one two"), (2.0, 3.0, "three"), (3600.5, 3601.0, "last x")]
    items = spark.createDataFrame([(1, json.dumps([{"text": "a", "offset": 1500, "duration": 500}, {"text": " "}, {"text": "b", "start": "2000"}, {"text": "c", "offset": "bad", "duration": None}])), (2, "no")], "id int, t string")
    assert [(r.start, r.end, r.text) for r in captions.provider(items, "t", ["id"]).orderBy("cue").collect()] == [(1.5, 2.0, "a"), (2.0, 2.0, "b"), (0.0, 0.0, "c")]


def brute_plan(rows):
    """Rows (id, book, chapter, index, content) merged one by one as the rules say: (what was deleted, contents left by id)."""
    norm = lambda x: " ".join(x.split()).lower()
    gone, seen, texts = set(), {}, {r[0]: r[4] or "" for r in rows}
    for r in sorted(rows):
        if seen.setdefault(norm(r[4] or ""), r[0]) != r[0]:
            gone.add(r[0])
    left = sorted((r for r in rows if r[0] not in gone), key=lambda r: (r[1] or "unknown", r[3] or 0, r[0]))
    for k, r in enumerate(left):
        if len(norm(texts[r[0]])) >= memory.SHORT:
            continue
        near = [x for x in left[k + 1 :] + left[:k][::-1] if x[1] == r[1] and x[2] == r[2] and x[0] not in gone]
        if near:
            x = near[0]
            after = (x[3] or 0) >= (r[3] or 0)
            texts[x[0]] = f"{texts[r[0]]}\n\n{texts[x[0]]}" if after else f"{texts[x[0]]}\n\n{texts[r[0]]}"
            gone.add(r[0])
    return gone, {r[0]: texts[r[0]] for r in left if r[0] not in gone}


def test_cleanup_plan_merges_splits_and_deletes(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["b", "c", None]), rng.choice(["x", "y", None]), rng.choice([None, 1, 2, 3, i]), rng.choice(["s" * rng.randrange(1, 60) + str(i), "long " * 30 + str(i), "same text", "", None])) for i in range(150)]
    schema = "id long, source_book string, chapter_title string, chunk_index int, content string"
    gone, texts = brute_plan(rows)
    plan = memory.cleanup_plan(spark.createDataFrame(rows, schema)).collect()
    assert {r.id for r in plan if r.action == "delete"} == gone and {r.id: r.content for r in plan if r.action != "delete"} == texts
    given = {r[0]: r[4] or "" for r in rows}
    assert all((r.action == "keep") == (r.content == given[r.id]) for r in plan if r.action != "delete")
    long = "\n\n".join(["p" * 2000 + str(i) for i in range(3)])
    k = spark.createDataFrame([(1, "b", "x", 4, long), (2, "b", "x", 5, "q" * 6000), (3, "b", "y", 1, "r" * 5001)], schema)
    plan = memory.cleanup_plan(k)
    assert {(r.id, r.action, len(r.content), len(r.split)) for r in plan.collect()} == {(1, "update", 2001, 2), (2, "update", 2500, 2), (3, "update", 2500, 2)}
    assert {(r.split_from_id, r.chunk_index) for r in memory.inserted_rows(plan).collect()} == {(1, 4001), (1, 4002), (2, 5001), (2, 5002), (3, 1001), (3, 1002)}
    done = memory.applied_plan(k, plan, {"b": "The Book"}).collect()
    # pieces of equal text meet in the first: 2500 q's come twice, and so do 2500 r's
    assert sorted((r.id, r.chunk_index) for r in done) == [(1, 4), (1, 4001), (1, 4002), (2, 5), (2, 5002), (3, 1), (3, 1002)] and {r.canonical_source for r in done} == {"The Book"}


def test_parsing_and_text_expressions(spark):
    row = spark.range(1).select(T.style_entries(T.parsed(F.lit('```json\n{"style": ["a", {"value": "b", "source_quote": "q", "confidence": 7}, {"x": 1}]}\n```')), "$.style").alias("style"), T.parsed(F.lit("[1]")).isNull().alias("no"), T.timestamp(F.lit("bad")).alias("bad"), T.with_source(F.lit("a http://x"), F.lit("http://x"), True).alias("moved")).first()
    assert [tuple(x) for x in row.style] == [("a", "", 0.5), ("b", "q", 1.0)]
    assert (row.no, row.bad, row.moved) == (True, None, "a\n\nhttp://x")


def test_lists_or_objects_of_items(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"t": 1}, 2]')
    (tmp_path / "b.json").write_text('{"regrets": [{"t": 3}]}')
    items, skipped = exports.json_items(spark, str(tmp_path), "regrets")
    assert items.count() == 2 and sum(r.skipped for r in skipped.collect()) == 1


def test_streams_of_status_and_feedback(spark, tmp_path):
    e = spark.createDataFrame([("sync", "error", 1, "2024-01-01 00:00:00"), ("sync", "success", 2, "2024-01-02 00:00:00")], "event_type string, status string, event_id long, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    e.write.parquet(str(tmp_path / "e"))
    ingest.ops_status(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), str(tmp_path / "c1"), str(tmp_path / "out")).awaitTermination()
    assert [(r.error_id, r.error_shown) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, False)]
    d = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "draft_id long, final_text string")
    d.write.parquet(str(tmp_path / "d"))
    ingest.publish_feedback(spark.readStream.schema(d.schema).parquet(str(tmp_path / "d")), str(tmp_path / "voice"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "voice")).count() == 2
    beliefs = "array<struct<content: string, quote: string, confidence: string>>"
    e = spark.createDataFrame([(1, "x", [("c", "q", "1")]), (3, "y", [("C ", "q", "1"), ("new", "q", "2")])], f"draft_id long, final_text string, beliefs {beliefs}")
    for n in (1, 2):  # the second time all comes again
        e.write.mode("append").parquet(str(tmp_path / "e2"))
        ingest.publish_feedback(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e2")), str(tmp_path / "voice2"), str(tmp_path / "c3"), str(tmp_path / "cand"), ["beliefs"]).awaitTermination()
        assert sorted(r.draft_id for r in spark.read.parquet(str(tmp_path / "voice2")).collect()) == [1, 3]
        assert sorted((r.id, r.content) for r in spark.read.parquet(str(tmp_path / "cand")).collect()) == [(1, "c"), (3, "new")]
