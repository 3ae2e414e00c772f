"""The ten operators against brute force, exact round trips and the edge cases of their docstrings."""

import collections
import hashlib
import html
import math
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from textloom.llm import common, gif, html_mss, lattice_lm, lgs_pack, line_align, phrase_automata, shingle_sets, simhash_vp, sp_unigram, warc_chunks, weak_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null and repeated ids, ties, a long text, columns with telling names."""
    rows = [(1, "alpha beta gamma delta " + PASSAGE), (2, PASSAGE + " tail"), (3, None), (4, ""), (None, "lost id " + PASSAGE), (5, "same same"), (5, "same same"), (6, "x " * 30000), (7, "one\ntwo three four five six\n\nend"), (8, "other\ntwo three four five six\n\nend")]
    return spark.createDataFrame([(a, b, "s", "f", 1, 2) for a, b in rows], "doc_id long, text string, fingerprint string, component_id string, block int, row int")


def empty(df):
    return df.limit(0)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_lzw(samples):
    """LZW bit by bit: the table holds byte strings, codes widen when the table's next entry needs it."""
    bits, table, size = [], {bytes([i]): i for i in range(256)}, 258

    def put(code):
        width = max(9, min(12, (size - 1).bit_length()))
        bits.extend(code >> k & 1 for k in range(width))

    put(256)
    run = b""
    for b in samples:
        both = run + bytes([b])
        if both in table:
            run = both
            continue
        put(table[run])
        run = bytes([b])
        if size == 4096:
            size = 4096
            put(256)
            table, size = {bytes([i]): i for i in range(256)}, 258
        else:
            table[both] = size
            size += 1
    if run:
        put(table[run])
        size += size < 4096
    put(257)
    return np.packbits(bits, bitorder="little").tobytes()


def test_gif_round_trip_and_edges(spark, odd):
    rng = random.Random(1)
    for n in (64, 192, 64 * 1024 + 64, 300_032):
        for payload in (bytes(rng.choices(b"abc \xc3\x00", k=n)), rng.randbytes(n), bytes(n)):
            data = gif.encode_samples(payload)
            assert b"".join(x["canvas"][: x["height"], :, 0].tobytes() for x in gif.frames(data)) == payload
            assert gif.lzw_encode(payload[:65536]) == plain_lzw(payload[:65536])
    assert gif.lzw_encode(b"") == plain_lzw(b"") and gif.lzw_decode(gif.lzw_encode(b"a"), 8, 1).tolist() == [97]
    got = gif.text_media(odd).collect()
    assert len(got) == 10 and gif.text_media(empty(odd)).count() == 0
    want = {r.text or "" for r in odd.collect()}
    pad = lambda b: b + bytes(-len(b) % 64 or (0 if b else 64))
    assert {r.payload_sha256 for r in got} == {hashlib.sha256(pad(t.encode())).hexdigest() for t in want}
    assert {r.tail_crc32 for r in got} == {zlib.crc32(pad(t.encode())[-64:]) for t in want}
    for r in got:
        text = next(t for t in want if hashlib.sha256(pad(t.encode())).hexdigest() == r.payload_sha256)
        payload, media = pad(text.encode()), gif.encode_samples(pad(text.encode()))
        bins = [sum(32 * k <= b < 32 * (k + 1) for b in payload) for k in range(8)]
        frames = -(-len(payload) // 65536)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes, r.media_sha256) == (len(text.encode()), len(payload), len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == f"frames={frames};ms={100 * frames};grey=" + ",".join(map(str, bins))


def test_gif_palette_transparency_and_disposal(spark):
    def frame(w, h, left, top, samples, disposal, clear):
        control = b"!\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 5, clear or 0) + b"\0"
        code = gif.lzw_encode(bytes(samples))
        return control + b"," + struct.pack("<HHHHB", left, top, w, h, 0) + b"\x08" + bytes([len(code)]) + code + b"\0"

    palette = bytes([255, 0, 0, 0, 255, 0]) + bytes(254 * 3)
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0xF7, 0, 0) + palette + frame(2, 1, 0, 0, [0, 0], 1, None) + frame(2, 1, 0, 0, [1, 9], 3, 9) + frame(1, 1, 0, 0, [1], 2, None) + frame(1, 1, 1, 0, [1], 0, None) + b";"
    shown = [x["canvas"][0].tolist() for x in ((x | {"canvas": x["canvas"].copy()}) for x in gif.frames(data))]
    red, green, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 0, 0]
    assert shown == [[red, red], [green, red], [green, red], [none, green]]
    table = spark.createDataFrame([(1, data), (2, None), (3, data[:-12]), (4, b"no")], "id int, gif binary")
    rows = gif.gif_frames(table).collect()
    assert gif.gif_frames(table.limit(0)).count() == 0 and gif.gif_frames(table.union(table)).count() == 2 * len(rows)
    clash = table.withColumn("frame_no", F.lit("x")).withColumn("source", F.lit(1))
    assert {r.source.frame_no for r in gif.gif_frames(clash).collect()} == {"x"}
    assert [r.start_ms for r in rows if r.source.id == 1] == [0, 50, 100, 150] and sum(r.error is not None for r in rows) == 2


def brute_components(rows, bits):
    prints = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        h = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxh64_intdigest(x, 42) for x in h]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= bits and root[a] > root[b]:
                    root[a], changed = root[b], True
    return {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_simhash_components(spark, odd):
    d = docs(spark)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_vp.near_duplicate_components(d).collect()}
    assert got == brute_components(rows, 2)
    out = simhash_vp.near_duplicate_components(odd).collect()
    assert len(out) == 10 and {r.component_id for r in out if r.fingerprint == "0" * 16} == {3}
    assert simhash_vp.near_duplicate_components(empty(odd)).count() == 0
    assert sorted(simhash_vp.keep_one_per_group(odd, 2, 3).columns) == sorted(odd.columns)


def test_vp_tree_links_equal_brute_force():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ np.uint64(0) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for c in centres] + [rng.integers(0, 1 << 63, 3000, dtype=np.uint64)]))
    for found in (simhash_vp.links(points, 2, leaf=64), simhash_vp._by_flips(points, 2), simhash_vp._exact(points, 2)):
        root = {int(p): int(p) for p in points}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for members, r in found:
            for m in members.tolist():
                a, b = find(m), find(r)
                root[max(a, b)] = min(a, b)
        groups = collections.Counter(find(int(p)) for p in points)
        pairs = [(i, j) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= 2) + i + 1]
        assert all(find(int(points[i])) == find(int(points[j])) for i, j in pairs) and sum(n > 1 for n in groups.values()) == 60
    nodes = simhash_vp.fit(points, 100, 2)
    shards = [set(points[at].tolist()) for _, at in simhash_vp.route(nodes, points, 2)]
    assert len(shards) > 4 and all(any({int(points[i]), int(points[j])} <= s for s in shards) for i, j in pairs)


def united(points, found):
    root = {int(p): int(p) for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for members, r in found:
        for m in members.tolist():
            a, b = find(m), find(r)
            root[max(a, b)] = min(a, b)
    return {int(p): find(int(p)) for p in points}


def test_unsplittable_balls_keep_chains():
    chain = np.array([3, 12, 15], np.uint64)
    assert set(united(chain, simhash_vp._by_flips(chain, 2)).values()) == {3}
    rng = np.random.default_rng(2)
    shell = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(9700)], np.uint64))
    assert len(shell) > 8192
    want = united(shell, simhash_vp._walked(shell, 2))
    assert united(shell, simhash_vp.links(shell, 2)) == united(shell, simhash_vp._by_flips(shell, 2)) == want
    spread = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, 8, replace=False)) for _ in range(3000)], np.uint64))
    want = united(spread, simhash_vp._walked(spread, 6))
    assert 1 < len(set(want.values())) < len(spread) and united(spread, simhash_vp._by_blocks(spread, 6)) == want


def test_pipeline_near_duplicates_by_similarity(spark, odd):
    rng = random.Random(11)
    texts = {}
    for g in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts[2 * g] = " ".join(words)
        for at in rng.sample(range(300), g % 12):
            words[at] = f"z{rng.randrange(5000)}"
        texts[2 * g + 1] = " ".join(words)
    common_part = [f"c{i}" for i in range(200)]
    for i in range(1000, 1060):  # share a long passage, but are not alike
        texts[i] = " ".join(common_part + [f"u{rng.randrange(10**6)}" for _ in range(150)])
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    want = set(texts) - {i for i in texts if i % 2 and i < 240 and len(sets[i] & sets[i - 1]) >= 0.8 * len(sets[i] | sets[i - 1])}
    assert 120 < len(want) - 60 < 239
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == want
    d = docs(spark)
    given = {r.doc_id: shingle_sets.shingles(r.text, 5) for r in d.collect()}
    root = {i: i for i in given}
    changed = True
    pairs = [(a, b) for a in given for b in given if a < b and shingle_sets.similarity(given[a], given[b]) >= 0.8]
    while changed:
        changed = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()} == {i for i, r in root.items() if i == r}
    kept = corpus_pipeline.near_duplicates(spark, odd, SF).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 5, 6, 7, 8]


def brute_near(rows):
    """doc_id to the smallest doc_id that a chain of pairs of similarity 0.8 joins it to."""
    given = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, (t or "").encode().lower().split()) for i, t in rows)}
    root = {i: i for i in given}
    pairs = [(a, b) for a in given for b in given if a < b and len(given[a] & given[b]) >= 0.8 * len(given[a] | given[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def test_sketch_keeps_similar_sets():
    rng = np.random.default_rng(3)
    far = []
    for n in (20, 100, 2000):
        for _ in range(300):
            both, own = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)
            a, b = np.concatenate((both, own[: n // 8])), np.concatenate((both, own[n // 8 :]))  # similarity 0.8
            far.append((shingle_sets.sketch(a) ^ shingle_sets.sketch(b)).bit_count())
    assert max(far) <= shingle_sets.BITS and 6 < np.mean(far) < 13
    h = rng.integers(0, 1 << 63, 70000, dtype=np.uint64)
    assert shingle_sets.sketch(h) == sum(1 << (63 - k) for k, ones in enumerate(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0)) if 2 * int(ones) > 70000)


def test_weak_supervision_base_counts_and_verdicts(spark, odd):
    d = docs(spark)
    got = {r.doc_id: r for r in weak_rules.judged(d).collect()}
    for r in d.collect():
        w, g = WORD.findall(r.text), got[r.doc_id]
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text), len(lines) - len(set(lines)), len(cover))
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (g.kept and g.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[i] == 1) == g.kept for i, g in got.items() if i in labels and not g.base_failed]
    assert sum(judged) >= 0.97 * len(judged)
    assert len(weak_rules.judged(odd).collect()) == 10 and weak_rules.judged(empty(odd)).count() == 0
    assert weak_rules.keep_good(odd).columns == odd.columns
    assert {r.doc_id for r in weak_rules.keep_good(d).collect()} == {i for i, g in got.items() if g.kept}


def brute_em(votes, rounds):
    """The same EM, document by document: posterior of good for each row of votes."""
    k = len(votes[0])
    prior, good, bad = weak_rules.PRIOR, [weak_rules.START] * k, [1 - weak_rules.START] * k

    def post(v):
        score = math.log(prior / (1 - prior))
        for x, g, b in zip(v, good, bad):
            score += math.log(g / b) if x == 1 else math.log((1 - g) / (1 - b)) if x == -1 else 0.0
        return 1 / (1 + math.exp(-score))

    for _ in range(rounds):
        p = [post(v) for v in votes]
        prior = min(max((sum(p) + weak_rules.PRIOR) / (len(p) + 1), 0.01), 0.99)
        share = lambda j, w, s: (sum(x for v, x in zip(votes, w) if v[j] == 1) + s) / (sum(x for v, x in zip(votes, w) if v[j]) + 1)
        good = [max(share(j, p, weak_rules.START), 0.5) for j in range(k)]
        bad = [min(share(j, [1 - x for x in p], 1 - weak_rules.START), 0.5) for j in range(k)]
    return [post(v) for v in votes]


def test_weak_supervision_verdict_equals_brute_force_em(spark):
    d = docs(spark)
    f = F.col("quality")
    rows = weak_rules.with_features(d).select("doc_id", weak_rules.base_failed(f).alias("failed"), *[v.alias(n) for n, v in weak_rules.votes(f).items()]).collect()
    chance = brute_em([tuple(r[2:]) for r in rows], weak_rules.ROUNDS)
    want = {r.doc_id: not r.failed and p >= weak_rules.THRESHOLD for r, p in zip(rows, chance)}
    assert all(abs(p - weak_rules.THRESHOLD) > 1e-6 for p in chance)
    assert {r.doc_id: r.kept for r in weak_rules.judged(d).collect()} == want and 0 < sum(want.values()) < len(want)


def plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute_pieces(rows):
    """(doc_id, piece, start, length, ids_crc32) of (doc_id, text) rows, with their counts."""
    tokenizer, want = plain_tokenizer(), collections.Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate([(0, first)] + [(s, s + 1024) for s in range(first, len(ids), 1024)]):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return want


def check_packing(rows, want):
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 1024
    assert len(by) <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 2


def test_packing(spark, odd):
    special = spark.createDataFrame([(1, "ab <|endoftext|> cd"), (2, "<|endoftext|>"), (3, "<|endoftext|><|endoftext|>x <|end"), (4, "  <|endoftext|>\n y<|endoftext|>  z"), (5, "é<|endoftext|>é" * 300), (6, "long " * 200000)], "doc_id long, text string")
    for d in (docs(spark).select("doc_id", "text"), odd, special):
        check_packing(lgs_pack.packed(d).collect(), brute_pieces([(r.doc_id, r.text) for r in d.collect()]))
    assert lgs_pack.packed(empty(odd)).count() == 0


def test_html(spark):
    page = '<body><nav><a href=x>Home page menu</a></nav><div class="ad">Buy now please all of you</div><article><h1>T &amp; U</h1><p>One  two<br>three <a href=y>four</a></p><script>"</p>" x</script><p>Five six seven</p><div class="comments"><p>Nice post indeed</p></div></article><footer>foot words</footer>'
    table = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "u", ""), (1, "u", page)], "page_id long, url string, html string")
    rows = html_mss.extracted(table).collect()
    assert [r.text for r in rows] == ["T & U\n\nOne two three four\n\nFive six seven", "", "", rows[0].text] and rows[0].n_chars == len(rows[0].text)
    assert html_mss.extracted(table.limit(0)).count() == 0
    clash = table.withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(7))
    assert [r.text for r in html_mss.extracted(clash).collect()] == [r.text for r in rows]
    scores = [random.Random(3).choice((-2.0, -1.0, 1.0, 2.0)) for _ in range(60)]
    a, b = html_mss.best_region(scores)
    assert sum(scores[a:b]) == max(sum(scores[i:j]) for i in range(60) for j in range(i, 61))


def test_html_layouts_with_known_text(spark):
    """Generated pages: article, main and plain div layouts, boilerplate around and inside, text with telling words in harmless places."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    para = lambda n: " ".join(word() for _ in range(n))
    boiler = [lambda: f'<nav><ul>{"".join(f"<li><a href=/{word()}>{para(2)}</a></li>" for _ in range(6))}</nav>', lambda: f'<div class="sidebar-left"><p>{para(25)}</p></div>', lambda: f'<div id=cookieNotice class="box">{para(20)}</div>', lambda: f'<form action=x><label>{para(40)}</label><input name=q></form>', lambda: f"<aside>{para(30)}</aside>", lambda: f'<div class="ad-slot ad">{para(12)}</div>', lambda: f'<section id="comments"><h3>{para(2)}</h3><div class="comment"><p>{para(40)}</p></div></section>', lambda: f'<div style="color:red; display : none">{para(30)}</div>', lambda: f"<script>var a = '<p>{para(9)}</p>';</script>"]
    harmless = ["", " class=legal-history", " class='tags-and-types'", ' class="search-theory"', ' class="post related"', " title=it's", ' style="overflow: hidden ; color: red"', ' class="with-sidebar"', ' data-x="hidden"', " class=entry-header"]
    pages, want = [], []
    for k in range(90):
        blocks = [para(rng.randrange(20, 60)) for _ in range(rng.randrange(3, 7))]
        body = [f"<p{rng.choice(harmless)}>{x}</p>" if rng.random() < 0.7 else f"<div{rng.choice(harmless)}><p>{x}</div>" for x in blocks]
        for _ in range(rng.randrange(3)):
            body.insert(rng.randrange(1, len(body)), rng.choice(boiler)())
        title = para(5)
        inner = f"<h1>{title}</h1>" + "".join(body)
        wrap = (("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div class="content has-sidebar">', "</div>"), ("<div>", "</div>"), ('<div class="layout sidebar-right"><article>', "</article></div>"))[k % 5]
        top, bottom = "".join(rng.choice(boiler)() for _ in range(2)), "".join(rng.choice(boiler)() for _ in range(2))
        pages.append((k, "u", f"<!DOCTYPE html><html><head><title>{para(4)}</title></head><body class=has-nav><header><a href=/>{para(3)}</a></header>{top}{wrap[0]}{inner}{wrap[1]}{bottom}<footer>{para(9)}</footer></body></html>"))
        want.append("\n\n".join([title, *blocks]))
    got = {r.page_id: r.text for r in html_mss.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(90)] == want
    out = [html_mss.prior(x) <= html_mss.FROM for x in "comments comment-list commentlist comment-text topnav adSlot ad_box related-posts recent-posts article-comments site-footer menu-toggle cookieNotice main-nav".split()]
    stay = [html_mss.prior(x) > html_mss.FROM for x in "entry-content content post-header legal-history tags-and-types search-theory with-sidebar no-ads addendum commentary metadata container row shadow navy".split()]
    assert all(out) and all(stay)
    began = time.process_time()
    assert html_mss.extract("<b>" * 30000 + "word " * 10 + "</i>" * 30000, html_mss.START_WEIGHTS) == ("word " * 10).strip()
    assert html_mss.extract("<p a='x b='y>one two three four five</p>" * 3000, html_mss.START_WEIGHTS).count("five") >= 1 and time.process_time() - began < 5
    real = spark.read.parquet(f"{SF}/pages.parquet").collect()
    texts = {r.page_id: r.text for r in html_mss.extracted(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in real:  # these mark their content with one article that holds nothing else
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", " ", inner)).split()
        assert texts[r.page_id].split() == plain


def segmentations(word, pieces):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield (word[:n], *rest)


def test_sentencepiece(spark, odd):
    m = sp_unigram.unigram()
    v = m.vocabulary
    for w in ("▁the", "▁anoth", "▁été", "▁xyzq"):
        ids, score = m.viterbi(w)
        assert abs(score - max(sum(v.score[v.by_piece[p]] for p in s) for s in segmentations(w, v.by_piece))) < 1e-9
        assert all(t == i for p, i in list(v.by_piece.items())[::997] for e, t in m.trie.prefixes(p.encode(), 0) if e == len(p.encode()))
    def whole(text):
        """Viterbi over the whole text at once: (score, ids), of equal scores the first found from the left."""
        data = "".join(("▁" if k == 0 else "\0") + p.replace(" ", "▁") for k, p in enumerate(text.split("▁")))
        best = [(0.0, [])] + [None] * len(data)
        for i in range(len(data)):
            if best[i] is None:
                continue
            score, ids = best[i]
            ends = [(j, v.score[k], [k]) for j in range(i + 1, min(len(data), i + v.longest) + 1) if (k := v.by_piece.get(data[i:j])) is not None]
            if not any(j == i + 1 for j, _, _ in ends):
                ends.append((i + 1, v.unknown, [v.byte_ids[b] for b in ("▁" if data[i] == "\0" else data[i]).encode()]))
            for j, s, new in ends:
                if best[j] is None or score + s > best[j][0] + 1e-9:
                    best[j] = (score + s, ids + new)
        return best[-1]

    texts = ["", " ", "a▁b  c\n\n", "日本 \U0001f600\t", "é" * 300, "▁▁ x", "Hello, world! It's 3.14; e.g. \"this\"...", "tab\there\nline"] + [r.text[:1500] for r in docs(spark).limit(40).collect()]
    for t in texts:
        ids = m.encode(t)
        assert m.decode(ids).decode() == t
        if t:
            score, want = whole(t)
            assert abs(float(m.id_score[ids].sum()) - score) < 1e-6 and (len(ids) == len(want) or abs(score - sum(m.id_score[want])) < 1e-6)
    assert all(m.viterbi(w) == m.viterbi(w) for w in ("aaaa", "▁▁▁"))
    rows = sp_unigram.coded(odd).collect()
    assert len(rows) == 10 and all(r.round_trip for r in rows) and sp_unigram.coded(empty(odd)).count() == 0
    by = {r.doc_id: r for r in sp_unigram.coded(docs(spark)).collect()}
    for r in docs(spark).limit(20).collect():
        ids = m.encode(r.text)
        assert (by[r.doc_id].n_pieces, by[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(ids)) and by[r.doc_id].n_byte_pieces == sum(i in v.byte_ids.values() for i in ids.tolist())


def test_lattice_lm(spark, odd):
    lattice = lattice_lm.first_lattice()
    for w in ("then", "été", "a"):
        want = math.log10(sum(math.exp(sum(lattice.pieces[p] for p in s)) for s in segmentations("▁" + w, lattice.pieces)))
        assert abs(lattice.log10(w) - want) < 1e-9 and abs(lattice_lm.Arrays(lattice).log10([w])[0] - want) < 1e-9
    d = docs(spark).select("doc_id", "text")
    rows, counts, ends = {r.doc_id: r for r in lattice_lm.scored(d).collect()}, collections.Counter(), 0
    texts = {r.doc_id: r.text.encode().lower().split() for r in d.collect()}
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
            ends += 1
    n, types = sum(counts.values()) + ends, len(counts) + 1
    for i, w in texts.items():
        base = sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (types + 1))) for x in w) + math.log10((ends + 0.5) / (n + 0.5 * (types + 1)))
        r = rows[i]
        assert abs(r.base_score - base) < 1e-6 * abs(base) and (r.n_tokens, r.train_tokens, r.n_known) == (len(w) + 1, n, sum(counts[x] > 0 for x in w) + 1)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and r.score < 0
    assert len(lattice_lm.scored(odd).collect()) == 10 and lattice_lm.scored(empty(odd)).count() == 0


def test_lattice_lm_score_equals_enumerated_segmentations(spark):
    texts = {i: t for i, t in enumerate(["then the cat", "Then a cat sat", "", None, "cats eat ヷ then", "the end", "sat ヷヷ on"])}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    v, bytes_of = lattice_lm.vocabulary(), [f"byte {b}" for b in range(256)]

    def ways(word, logs):
        """(pieces or bytes, log probability) of every segmentation."""
        if not word:
            yield (), 0.0
        for n in range(1, len(word) + 1):
            if word[:n] in v.by_piece:
                use = (word[:n],)
            elif n == 1:
                use = tuple(bytes_of[b] for b in word[0].encode())
            else:
                continue
            for rest, p in ways(word[n:], logs):
                yield (*use, *rest), p + sum(logs(u) for u in use)

    start = lambda u: v.score[v.by_piece[u]] if u in v.by_piece else v.unknown
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    logs = start
    for _ in range(lattice_lm.ROUNDS):
        uses = collections.Counter()
        for t in train:
            for w in (t or "").lower().split():
                every = list(ways("▁" + w, logs))
                total = sum(math.exp(p) for _, p in every)
                for pieces, p in every:
                    for u in pieces:
                        uses[u] += math.exp(p) / total
        whole = sum(uses.values()) + len(train) + lattice_lm.SMOOTHING * (len(v.by_piece) + 257)
        logs = lambda u, uses=uses, whole=whole: math.log((uses[u] + lattice_lm.SMOOTHING) / whole)
    end = math.log10((len(train) + lattice_lm.SMOOTHING) / whole)
    for r in lattice_lm.scored(table).collect():
        want = end + sum(math.log10(sum(math.exp(p) for _, p in ways("▁" + w, logs))) for w in (texts[r.doc_id] or "").lower().split())
        assert abs(r.score - want) < 1e-6 * max(1, abs(want))


def brute_removal(texts):
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return collections.Counter(out)


def brute_text(texts):
    """Texts without the words of repeated windows, each of which goes with the white space after it."""
    words = [list(WORD.finditer(t or "")) for t in texts]
    seen = collections.Counter(tuple(x[0] for x in w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for t, w in zip(texts, words):
        gone = {j for i in range(len(w) - 34) if seen[tuple(x[0] for x in w[i : i + 35])] > 1 for j in range(i, i + 35)}
        cut = [(w[j].start(), w[j + 1].start() if j + 1 < len(w) else len(t)) for j in sorted(gone)]
        kept, at = [], 0
        for a, b in cut:
            a = 0 if a == w[0].start() and at == 0 else a
            kept.append(t[at:a])
            at = b
        out.append(t if not gone else "".join(kept) + t[at:])
    return out


def test_phrase_automata(spark, odd):
    for d in (docs(spark), odd):
        got = phrase_automata.removal_report(d).collect()
        assert collections.Counter((r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removal([r.text for r in d.collect()])
    assert phrase_automata.removal_report(empty(odd)).count() == 0
    # Windows shared in part, at different offsets, often and seldom; and two long words that collide in every polynomial modulo 2 ** 64.
    rng = random.Random(8)
    base = [f"b{i}" for i in range(400)]
    texts = [" ".join(base[i : i + rng.randrange(30, 90)] + [f"u{rng.random()}"] + base[j : j + rng.randrange(30, 90)]) for i, j in ((rng.randrange(320), rng.randrange(320)) for _ in range(80))]
    texts += ["y " * 200, " ".join(f"z{i % 9}" for i in range(150)), " ".join(f"once{i}" for i in range(300))]
    signs = np.array([0])
    while len(signs) < 2048:
        signs = np.concatenate((signs, 1 - signs))
    for x in (signs, 1 - signs):
        texts.append(" ".join(["".join("ab"[v] for v in x), *[f"same{i}" for i in range(34)]] + [f"tail{x[0]}"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = phrase_automata.removal_report(df).collect()
    assert collections.Counter((r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removal(texts)
    assert [r.n_removed for r in got if r.doc_id >= len(texts) - 2] == [0, 0]
    rows = phrase_automata.deduplicated(odd).select("row.*").collect()
    assert {r.text for r in rows if r.doc_id == 3} == {None} and {r.text.strip() for r in rows if r.doc_id == 1} == {"alpha beta gamma delta"}


def brute_patience(a, b):
    """Patience diff by recursion on slices: equal heads and tails, unique common lines and the subsequence that patience sorting gives, by the square of their number."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in brute_patience(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*brute_patience(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    common = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    if not common:
        return []
    length = []
    for k, (_, j) in enumerate(common):
        length.append(1 + max([length[m] for m in range(k) if common[m][1] < j], default=0))
    chain, k = [], max(m for m in range(len(common)) if length[m] == max(length))
    while True:
        chain.insert(0, common[k])
        if length[k] == 1:
            break
        k = max(m for m in range(k) if length[m] == length[k] - 1)
    out, i0, j0 = [], 0, 0
    for i, j in chain:
        out += [(i0 + x, j0 + y) for x, y in brute_patience(a[i0:i], b[j0:j])] + [(i, j)]
        i0, j0 = i + 1, j + 1
    return out + [(i0 + x, j0 + y) for x, y in brute_patience(a[i0:], b[j0:])]


def brute_blocks(later, earlier, telling):
    """Places of ``later`` in aligned runs that count."""
    to = dict(brute_patience(later, earlier))
    gone = set()
    for i in to:
        run = {i}
        for step in (-1, 1):
            k = i
            while k + step in to and to[k + step] == to[k] + step:
                k += step
                run.add(k)
        if len(run) >= 3 or any(telling[k] for k in run):
            gone |= run
    return gone


def brute_lines(rows, rare):
    """All pairs of documents, one after the other: (doc_id, text left) in order of the ids."""
    seqs = [(i, [" ".join(x.split()) for x in (t or "").split("\n") if x.split()]) for i, t in rows]
    telling = lambda x: len(x.split()) >= 5 or len(x.encode()) >= 40

    def marks(seq):
        found = {}
        for i, x in enumerate(seq):
            if telling(x):
                found.setdefault(x, []).append((i, i))
            elif i >= 2 and not any(map(telling, seq[i - 2 : i])):
                found.setdefault(tuple(seq[i - 2 : i + 1]), []).append((i - 2, i))
        return {m: (min(a for a, _ in at), max(b for _, b in at)) for m, at in found.items()}

    first, distinct = {}, []
    for k, (_, seq) in enumerate(seqs):
        if tuple(seq) not in first:
            first[tuple(seq)] = k
            distinct.append((k, seq, marks(seq)))
    holders = collections.defaultdict(list)
    for k, seq, m in distinct:
        for x in m:
            holders[x].append(k)
    gone = {k: set(range(len(seq))) if first[tuple(seq)] != k else set() for k, (_, seq) in enumerate(seqs)}
    for n, (k, seq, m) in enumerate(distinct):
        for e, other, o in distinct[:n]:
            shared = [x for x in m if x in o and (len(holders[x]) <= rare or holders[x][0] == e)]
            if shared:
                (a, b), (c, d) = ((max(0, min(y[x][0] for x in shared) - 2), max(y[x][1] for x in shared) + 3) for y in (m, o))
                gone[k] |= {a + i for i in brute_blocks(seq[a:b], other[c:d], [telling(x) for x in seq[a:b]])}
    out = []
    for k, (i, t) in enumerate(rows):
        left, number, dropped = [], -1, False
        for line in (t or "").split("\n"):
            if line.split():
                number += 1
                dropped = number in gone[k]
            if not dropped:
                left.append(line)
        out.append((i, None if t is None else "\n".join(left)))
    return out


def test_line_dedup(spark, odd):
    rows = {r.doc_id: r for r in line_align.deduplicated(odd).select("row.*", "lines.*").collect()}
    assert rows[7].n_deleted == 0 and rows[8].text == "other" and rows[3].text is None and rows[4].text == ""
    assert line_align.report(empty(odd)).count() == 0 and len(line_align.report(odd).collect()) == 10
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = line_align.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert pairs == brute_patience(a, b)
        telling = [rng.random() < 0.3 for _ in a]
        assert set(line_align.common_lines(a, b, telling)) == brute_blocks(a, b, telling)
    assert len(line_align.patience(list(range(50)), list(range(50)))) == 50
    assert line_align.common_lines([2, 1, 0], [0, 1, 2], [True] * 3) == [2]  # one line aligns, two stay


def test_line_dedup_of_a_very_long_text(spark):
    """Beyond a block of documents, in its middle what an earlier document has."""
    told = [f"passage line {i} of more than five words" for i in range(40)]
    far = [f"unlike line number {i} of more than five words" for i in range(130_000)]
    rows = [(1, "\n".join(told)), (2, "\n".join([*far[:70_000], *told[5:25], *far[70_000:]])), (3, "\n".join(far))]
    got = {r.doc_id: r for r in line_align.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("row.*", "lines.*").collect()}
    assert len(rows[1][1]) > line_align.BLOCK and got[1].n_deleted == 0 and got[2].n_deleted == 20 and got[2].text == rows[2][1] and got[3].text == ""


def test_line_dedup_equals_all_pairs(spark):
    one, two = "the first line has many words", "the second line has many words too"
    rng = random.Random(6)
    pool = [f"line {i} with more than five words" for i in range(30)] + [f"short {i}" for i in range(20)] + ["", "  ", "行" * 20]
    rows = [(1, f"{one}\n{two}"), (2, f"{two}\n{one}"), (3, f"{two}\n{one}\nx"), (4, f"{two}\n{one}\nx"), (5, "a b\nc d\n\ne f\ng h"), (6, "new\na b\nc d\ne f\ng h\nnew"), (7, one), (8, f"{one}\nx\n{one}"), (9, f"{one}\nx\n{one}"), (10, None), (11, ""), (12, "\n \n")]
    rows += [(20 + k, "\n".join(rng.choices(pool, k=rng.randrange(1, 14)))) for k in range(120)]
    rows += [(200 + k, rows[12 + k][1] + "\n" + pool[k]) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for rare in (2, 8):
        got = {r.doc_id: r.text for r in line_align.deduplicated(df, rare=rare).select("row.*").collect()}
        assert got == dict(brute_lines(rows, rare))
    assert (got[2], got[3], got[4], got[6], got[7], got[9]) == (two, "x", "", "new\nnew", "", "")
    d = docs(spark)
    given = sorted((r.doc_id, r.text) for r in d.collect())
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in brute_lines(given, line_align.RARE)}
    assert {r.doc_id: r.kept_sha256 for r in line_align.report(d).collect()} == want


def test_warc(spark):
    big = "é" * (3 << 20)
    table = spark.createDataFrame([(5, "u", "x" * 200), (2, None, "x" * 200), (9, "u", "tiny"), (8, "u", "tiny"), (7, "u", None), (6, "u", big), (10, "u", "\r\n\r\n" * 40)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc_chunks.round_trip(table).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in rows.items()} == {i: ("revisit", 2) if i == 5 else ("response", None) for i in (5, 2, 9, 8, 7, 6, 10)}
    for r in table.collect():
        data = (r.html or "").encode()
        assert (rows[r.page_id].payload_bytes, rows[r.page_id].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    chunks = [r for r in warc_chunks.read_archives(warc_chunks.write_archives(table)).collect() if r.page_id == 6]
    assert len(chunks) == 6 and b"".join(bytes(r.chunk) for r in sorted(chunks, key=lambda r: r.chunk_no)).decode() == big
    assert warc_chunks.round_trip(table.limit(0)).count() == 0
    # Records beyond a piece, even compressed, between small ones; null and repeated ids; extra and clashing columns.
    rng = random.Random(4)
    far = [rng.randbytes(9 << 20).hex() for _ in range(2)]
    page = "p" * 150
    more = spark.createDataFrame([(1, "u", far[0]), (2, "u", "small"), (3, "u", far[1]), (4, None, far[0]), (5, "u", page), (5, "u", page), (None, "u", page), (None, "u", "alone" * 30), (6, "u", page)], "page_id long, url string, html string").withColumn("split", F.lit(1)).withColumn("record_type", F.lit("x")).coalesce(1)
    archives = warc_chunks.write_archives(more)
    assert archives.where("split is not null").groupBy("archive", "split").count().count() == 2
    got = warc_chunks.round_trip(more).collect()
    want = [(1, far[0], None), (2, "small", None), (3, far[1], None), (4, far[0], 1), (5, page, None), (5, page, None), (None, page, 5), (None, "alone" * 30, None), (6, page, 5)]
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == collections.Counter((i, len(t), hashlib.sha256(t.encode()).hexdigest(), "response" if to is None else "revisit", to) for i, t, to in want)


def test_pipeline_stages(spark, odd):
    frame = docs(spark)
    columns, n = frame.columns, frame.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == columns, name
        assert stage(spark, empty(frame), SF).count() == 0 and stage(spark, odd, SF).columns == odd.columns
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = [(r.doc_id, r.text) for r in weak_rules.judged(frame).where("kept").join(frame, "doc_id").select("doc_id", "text").collect()]
    kept = brute_lines(sorted(kept), line_align.RARE)
    near = brute_near(kept)
    kept = [(i, t) for i, t in kept if near[i] == i]
    assert 0 < len(kept) < n
    check_packing(rows, brute_pieces(zip([i for i, _ in kept], brute_text([t for _, t in kept]))))


def test_stage_drops_what_earlier_ones_left(spark, tmp_path):
    other = common.written(docs(spark), "other")
    first = corpus_pipeline.lines(spark, docs(spark), SF)
    left = set(corpus_pipeline.LEFT)
    assert left
    first.write.parquet(str(tmp_path / "one"))
    chained = corpus_pipeline.quality(spark, first, SF)  # reads the first stage's tables: they stay
    assert left < set(corpus_pipeline.LEFT) and chained.count()
    second = corpus_pipeline.quality(spark, spark.read.parquet(str(tmp_path / "one")), SF)
    assert not left & set(corpus_pipeline.LEFT) and second.count() and other.count()
