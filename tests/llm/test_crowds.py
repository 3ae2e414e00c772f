"""Near-duplicates inside crowds: all of them, against a comparison of all pairs."""

import random

from textloom.llm import shingle_sets as S


def test_no_pair_of_a_crowd_is_lost(spark, monkeypatch):
    """Texts that all share a template, most pairs a little under the similarity that counts: each has links to a few others only."""
    rng = random.Random(8)
    template = [f"w{i}" for i in range(150)]
    texts = ["", None]
    for i in range(420):
        words = list(template)
        for k in rng.sample(range(150), rng.randrange(2, 8)):
            words[k] = f"x{i}_{k}"
        texts.append(" ".join(words))
    sets = [S.shingles(t, 5) for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(sets)):
        for i in range(j):
            if top(i) != top(j) and S.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {i for i in range(len(sets)) if top(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 2 < len(want) < len(texts)
    for name, value in (("CELL", 50), ("BLOCK_SETS", 60)):
        monkeypatch.setattr(S, name, value, raising=False)
    assert {r.doc_id for r in S.keep_one_per_group(docs, 6, 5, 0.8).collect()} == want


def test_links_that_join_as_much_as_all():
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(a, b) for a in range(100, 140) for b in range(100, a)]
    groups = lambda links: sorted({frozenset(g) for g in merged(links).values()}, key=sorted)

    def merged(links):
        of = {x: {x} for pair in pairs for x in pair}
        for a, b in links:
            of[a] |= of[b]
            for x in of[a]:
                of[x] = of[a]
        return of

    kept = S._joining(pairs)
    assert groups(kept) == groups(pairs) and len(kept) < len({x for pair in pairs for x in pair})


def test_only_sets_in_pairs_are_read_for_a_crowd(spark, monkeypatch):
    """Texts that share a passage and little else: they are one crowd, but nearly no two of them share enough keys to be compared."""
    rng = random.Random(3)
    passage = [f"w{i}" for i in range(60)]
    texts = [" ".join([*passage, *[f"x{i}_{rng.random()}" for _ in range(160)]]) for i in range(200)]
    template = [f"y{i}" for i in range(150)]
    for i in range(60):
        words = list(template)
        for k in rng.sample(range(150), 7):
            words[k] = f"z{i}_{k}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, written = [], S.common.written

    def noted(df, name):
        out = written(df, name)
        if name in ("near-crowd-sets", "near-texts"):
            sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(S.common, "written", noted)
    S.keep_one_per_group(docs, 6, 5, 0.8).collect()
    crowd = next(k for k, (name, _) in enumerate(sizes) if name == "near-crowd-sets")
    held, read = sizes[crowd][1], sizes[crowd + 1][1]
    assert held > 200 and 1 < read <= 75  # all of them were read, and their blocks sent whole for each pair of blocks, before
