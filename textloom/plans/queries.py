"""Registered queries of the text-memory operators, bound to the given tables, and the same results in DuckDB SQL.

Bindings: knowledge = documents, chat = conversations, vectors = embeddings with events, operations = events, decisions = labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import audit, bounds, buckets, captions, chunking, graph_index, lifecycle, matching, memory, retrieval, scratch, tables
from textloom.sources import exports, split_exports
from textloom.streaming import ingest

AS_OF = "2024-02-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


#: SQL pieces.
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NORM = r"lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"


def norm(c: str) -> str:
    return NORM.format(c)


def knowledge(t) -> DataFrame:
    labels = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    status = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "rejected").otherwise("unverified")
    return t("documents").join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("category"), F.col("source").alias("source_book"), status.alias("verification_status"))


K_SQL = "k AS (SELECT doc_id AS id, text AS content, lang AS category, source AS source_book, CASE quality WHEN 1 THEN 'verified' WHEN 0 THEN 'rejected' ELSE 'unverified' END AS verification_status FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id))"


def vectors(t) -> DataFrame:
    e = t("events").select(F.col("event_id").alias("id"), F.col("ts").alias("occurred_at"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 500)).alias("quality_weight"), F.col("event_type").alias("kind"))
    return t("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label").join(e, "id")


V_SQL = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label, ts AS occurred_at, greatest(0.0, least(1.0, value / 500)) AS quality_weight, event_type AS kind FROM embeddings JOIN events ON vec_id = event_id)"
NEAR_SQL = V_SQL + ", s AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.embedding, v.embedding) AS similarity FROM v AS q, v WHERE q.id % 20 = 0), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s))"


def questions(t) -> DataFrame:
    return vectors(t).where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


def chat(t) -> DataFrame:
    return t("conversations").where("role in ('user', 'assistant')").withColumn("kind", F.when(F.col("role") == "assistant", "posts").otherwise("chats"))


C_SQL = "c AS (SELECT *, CASE WHEN role = 'assistant' THEN 'posts' ELSE 'chats' END AS kind FROM conversations WHERE role IN ('user', 'assistant'))"


# ---- expressions


@query(f"SELECT doc_id, {norm('text')} AS normalised, sha256(concat(source, ':', {norm('text')})) AS fingerprint, sha256(text) AS content_hash, length(text) AS n_chars FROM documents")
def p2_p4_normalise_fingerprint(t):
    d = t("documents")
    return d.select("doc_id", T.normalise(F.col("text")).alias("normalised"), T.fingerprint(F.col("source"), F.col("text")).alias("fingerprint"), F.sha2("text", 256).alias("content_hash"), F.length("text").alias("n_chars"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
CASE WHEN regexp_matches(lower(text), 'finance|money|invest|econom') THEN 'finance' WHEN regexp_matches(lower(text), 'islam|quran|hadith|fiqh') THEN 'islam' WHEN regexp_matches(lower(text), 'python|software|program|data') THEN 'it' WHEN regexp_matches(lower(text), 'psycholog|mind|habit') THEN 'psychology' WHEN regexp_matches(lower(text), 'brand|market|content') THEN 'branding' ELSE 'psychology' END AS category,
CASE WHEN length(text) > 120 THEN concat(rtrim(substr(text, 1, 119), ' '), '…') ELSE text END AS clipped,
least(length(text) // 10, 200) + CASE WHEN source = 'src0' THEN 100 ELSE 0 END + CASE WHEN length(text) > 500 THEN 50 ELSE 0 END AS score, greatest(1, length(text) // 4) AS tokens,
CASE WHEN length(""" + STRIP.format("text") + r""") < 180 THEN 'short' WHEN length(""" + STRIP.format("text") + """) < 650 THEN 'normal' ELSE 'expanded' END AS length_class FROM documents""")
def p5_p12_text_expressions(t):
    c = F.col("text")
    return t("documents").select("doc_id", T.slug(c).alias("slug"), T.category(c).alias("category"), T.clip(c, 120).alias("clipped"), T.message_score(c, F.col("source") == "src0").alias("score"), T.token_estimate(c).alias("tokens"), T.length_class(c).alias("length_class"))


@query(r"""WITH s AS (SELECT doc_id, """ + STRIP.format("text") + r""" AS text FROM documents), h AS (SELECT doc_id, text, substr(text, 1, 300) AS h FROM s),
e AS (SELECT *, greatest(CASE WHEN instr(reverse(h), ' .') = 0 THEN 0 ELSE length(h) - instr(reverse(h), ' .') END, CASE WHEN instr(reverse(h), ' !') = 0 THEN 0 ELSE length(h) - instr(reverse(h), ' !') END,
 CASE WHEN instr(reverse(h), ' ?') = 0 THEN 0 ELSE length(h) - instr(reverse(h), ' ?') END, CASE WHEN instr(reverse(h), chr(10)) = 0 THEN 0 ELSE length(h) - instr(reverse(h), chr(10)) + 1 END) AS e,
 CASE WHEN instr(reverse(h), ' ') = 0 THEN 0 ELSE length(h) - instr(reverse(h), ' ') + 1 END AS s FROM h)
SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN e - 1 >= 165 THEN regexp_replace(substr(h, 1, e), '\s+$', '') WHEN s > 1 THEN concat(regexp_replace(substr(h, 1, s - 1), '[ ,;:]+$', ''), '…') ELSE regexp_replace(h, '\s+$', '') END AS cut FROM e""")
def p10_enforce_length(t):
    return t("documents").select("doc_id", T.enforce_length(F.col("text"), 300).alias("cut"))


@query("SELECT event_id, greatest(0.0, least(1.0, value / 100)) AS confidence, concat('see https://site.example/watch?v=', event_id) AS url, CAST(event_id AS VARCHAR) AS video_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def p13_p21_values_urls(t):
    body = F.concat(F.lit("see https://site.example/watch?v="), F.col("event_id"), F.lit(". and http://other.example/x"))
    found = F.get(T.urls(body, ["site.example"]), 0)
    return t("events").select("event_id", T.clamp(F.col("value") / 100, 0.5).alias("confidence"), F.concat(F.lit("see "), found).alias("url"), F.try_parse_url(found, F.lit("QUERY"), F.lit("v")).alias("video_id"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query(f"WITH {V_SQL} SELECT id, len(embedding[1:32]) AS dim, round(list_sum(embedding[1:32]), 5) AS total, round(quality_weight * exp(-0.002 * greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(occurred_at), 0) / 86400e6), 9) AS recency FROM v")
def p24_p29_vectors_recency(t):
    short = V.fit_dimension(F.col("embedding"), 32)
    return vectors(t).select("id", F.size(short).alias("dim"), F.round(F.aggregate(short, F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"), F.round(V.recency(F.col("quality_weight"), F.col("occurred_at"), AS_OF), 9).alias("recency"))


@query(r"WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(list_transform(x, lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g'))) AS x FROM (SELECT doc_id, CASE WHEN len(x) > 1 AND x[-1] = '' THEN x[:-2] ELSE x END AS x FROM (SELECT doc_id, string_split(concat('## ', text), chr(10)) AS x FROM documents))), p AS (SELECT *, lag(x) OVER w AS b, lag(x, 2) OVER w AS bb FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)), g AS (SELECT *, CASE WHEN b = '' THEN bb ELSE b END AS last FROM p), j AS (SELECT *, i > 1 AND x <> '' AND coalesce(last, '') <> '' AND NOT starts_with(last, '#') AND NOT regexp_matches(last, '[.!?;:»\"'')\]]$') AND NOT starts_with(x, '#') AND NOT regexp_matches(x, '^(\d+\.|[-*+])\s') AS on_ FROM g), n AS (SELECT *, lead(on_) OVER (PARTITION BY doc_id ORDER BY i) AS next_on FROM j), o AS (SELECT doc_id, string_agg(CASE WHEN x = '' AND b <> '' AND coalesce(next_on, false) THEN '' WHEN on_ THEN ' ' || x WHEN i > 1 THEN chr(10) || x ELSE x END, '' ORDER BY i) AS t FROM n GROUP BY doc_id) SELECT doc_id, CASE WHEN regexp_matches(t, '\S') THEN regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) ELSE '' END AS cleaned FROM o")
def p27_c9_markdown_cleanup(t):
    raw = F.concat(F.lit('### <span id="page-1-2"></span>'), "text")
    return t("documents").select("doc_id", T.clean_markdown(raw).alias("cleaned"))


# ---- filters, sets and joins


@query(f"WITH {C_SQL} SELECT conv_id, turn, kind FROM c WHERE length({STRIP.format('text')}) >= 80 AND length({STRIP.format('text')}) <= 1500")
def f1_f11_chat_filters(t):
    n = F.length(T.strip(F.col("text")))
    return chat(t).where(~T.is_noise(F.col("text")) & n.between(80, 1500)).select("conv_id", "turn", "kind")


@query(f"WITH {K_SQL} SELECT id, {norm('substr(content, 5)')} <> '' AND contains({norm('content')}, {norm('substr(content, 5)')}) AS grounded, {norm('substr(content, 5)')} <> '' AND length(content) >= 200 AND verification_status = 'verified' AS queued FROM k")
def f9_f10_grounding_gate(t):
    k, quote = knowledge(t), F.expr("substring(content, 5)")
    g = T.grounded(F.col("content"), quote)
    return k.select("id", g.alias("grounded"), (g & (F.length("content") >= 200) & (F.col("verification_status") == "verified")).alias("queued"))


def _prints(t) -> DataFrame:
    return t("documents").withColumn("print", T.fingerprint(F.col("text")))


@query(f"WITH f AS (SELECT doc_id, sha256({norm('text')}) AS print FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY print ORDER BY doc_id) AS r FROM f WHERE doc_id % 3 <> 0) SELECT doc_id, print FROM n WHERE r = 1 AND print NOT IN (SELECT print FROM f WHERE doc_id % 3 = 0)")
def s9_j1_insert_if_new(t):
    p = _prints(t)
    return tables.insert_new(p.where("doc_id % 3 <> 0"), p.where("doc_id % 3 = 0"), "print", [F.col("doc_id")]).select("doc_id", "print")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 2 = 1 THEN 'new' ELSE lang END AS lang FROM documents")
def s10_upsert(t):
    d = t("documents").select("doc_id", "lang")
    return tables.upsert(d.where("doc_id % 2 = 0"), d.where("doc_id % 5 = 0 or doc_id % 2 = 1").withColumn("lang", F.lit("new")), "doc_id")


def _snapshot_sql(table: str, *columns: str) -> str:
    field = lambda c: f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"SELECT '{table}' AS table_name, count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(md5(concat({', '.join(map(field, columns))})), 1, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM {table}"


@query(" UNION ALL ".join([_snapshot_sql("documents", "doc_id", "text", "lang", "source", "n_chars"), _snapshot_sql("conversations", "conv_id", "turn", "role", "text"), _snapshot_sql("labels", "doc_id", "quality", "toxic"), _snapshot_sql("pages", "page_id", "url", "html")]))
def s7_snapshot_manifest(t):
    columns = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "conversations": ["conv_id", "turn", "role", "text"], "labels": ["doc_id", "quality", "toxic"], "pages": ["page_id", "url", "html"]}
    return tables.manifest({n: t(n).select(*c) for n, c in columns.items()})


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s12_resume(t):
    done = t("labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    return tables.pending(t("documents").select("doc_id"), done, "doc_id")


@query(f"WITH {NEAR_SQL} SELECT query_id, id, rank, round(similarity, 6) AS similarity FROM n WHERE rank <= 6")
def j3_knn(t):
    return retrieval.nearest(questions(t), vectors(t), 6).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {NEAR_SQL} SELECT query_id, id, rank, round(similarity, 6) AS similarity FROM n WHERE rank <= 6")
def j3_bounded_knn(t):
    """As j3_knn, by blocks of which those that can't matter never meet."""
    found, _ = bounds.search(questions(t), vectors(t), 6)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query()
def j3_block_pairs(t):
    """The share of block pairs that met."""
    return bounds.search(questions(t), vectors(t), 6)[1]


@query("WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), c AS (SELECT min(id) AS class_id, v, label FROM e GROUP BY v, label), p AS (SELECT a.class_id, b.class_id AS other, list_cosine_similarity(a.v, b.v) AS s FROM c AS a JOIN c AS b ON a.label = b.label AND a.class_id <> b.class_id WHERE list_cosine_similarity(a.v, b.v) >= 0.25), n AS (SELECT class_id, count(*) AS links, arg_max(other, (s, -other)) AS nearest, max(s) AS s FROM p GROUP BY class_id) SELECT e.id, c.class_id, coalesce(links, 0) AS links, nearest, round(n.s, 6) AS similarity FROM e JOIN c ON e.v = c.v AND e.label = c.label LEFT JOIN n USING (class_id)")
def j5_similar_rows(t):
    """Semantic duplicates of all rows inside their label, at a similarity that these vectors reach."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return bounds.linked_rows(e, 0.25, kind="label").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH f AS (SELECT doc_id, source, sha256({norm('text')}) AS p FROM documents) SELECT a.doc_id, min(b.doc_id) AS duplicate_of FROM f a JOIN f b ON a.p = b.p AND b.doc_id < a.doc_id GROUP BY a.doc_id")
def j4_g6_exact_duplicates(t):
    p = scratch.written(_prints(t).select("doc_id", "print"), "prints")  # both sides read these; a text is hashed once
    return p.join(p.groupBy("print").agg(F.min("doc_id").alias("duplicate_of")), "print").where("doc_id > duplicate_of").select("doc_id", "duplicate_of")


@query(f"WITH {V_SQL}, s AS (SELECT q.id AS query_id, q.label, v.id, v.label AS other, list_cosine_similarity(q.embedding, v.embedding) AS s FROM v AS q, v WHERE q.id % 20 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS r FROM s) SELECT query_id, arg_max(id, s) AS duplicate_of, round(max(s), 6) AS similarity FROM n WHERE r <= 9 AND id <> query_id AND label = other AND s >= 0.2 GROUP BY query_id")
def j5_semantic_duplicates(t):
    v = vectors(t)
    found = retrieval.semantic_duplicates(v, v.where("id % 20 = 0"), "label", 0.2, compat=True)
    return found.select("query_id", "duplicate_of", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {V_SQL} SELECT q.id AS query_id, arg_max(v.id, (list_cosine_similarity(q.embedding, v.embedding), -v.id)) AS duplicate_of, round(max(list_cosine_similarity(q.embedding, v.embedding)), 6) AS similarity FROM v AS q JOIN v ON q.label = v.label AND q.id <> v.id WHERE q.id % 20 = 0 AND list_cosine_similarity(q.embedding, v.embedding) >= 0.2 GROUP BY q.id")
def j5_semantic_duplicates_in_kind(t):
    v = vectors(t)
    found = retrieval.semantic_duplicates(v, v.where("id % 20 = 0"), "label", 0.2)
    return found.select("query_id", "duplicate_of", F.round("similarity", 6).alias("similarity"))


@query("SELECT count(DISTINCT e.user_id) AS published, count(DISTINCT CASE WHEN c.c_custkey IS NULL OR c.c_custkey % 2 = 1 THEN e.user_id END) AS inconsistent FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def j8_consistency(t):
    users, c = t("events").select("user_id").distinct(), t("customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, "published").otherwise("draft").alias("state"))
    return users.join(c, "user_id", "left").agg(F.count("user_id").alias("published"), F.count_if(~F.col("state").eqNullSafe(F.lit("published"))).alias("inconsistent"))


# ---- aggregates and windows


@query(f"WITH {C_SQL} SELECT coalesce(kind, 'all') AS kind, count(*) AS n, sum(length(text)) AS chars, count(DISTINCT conv_id) AS chats FROM c GROUP BY ROLLUP (kind)")
def g1_corpus_stats(t):
    return chat(t).rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("conv_id").alias("chats")).withColumn("kind", F.coalesce("kind", F.lit("all")))


@query(f"WITH {K_SQL}, m AS (SELECT count(*) FILTER (verification_status = 'verified') AS verified, count(*) FILTER (verification_status = 'rejected') AS rejected, count(*) FILTER (length(content) < 100) AS short, count(*) FILTER (length(content) > 5000) AS long FROM k) SELECT unnest(['verified', 'rejected', 'short', 'long']) AS metric, unnest([verified, rejected, short, long]) AS value FROM m")
def g2_q1_counts(t):
    n, s = F.length("content"), F.col("verification_status")
    return lifecycle.counts(knowledge(t), {"verified": s == "verified", "rejected": s == "rejected", "short": n < 100, "long": n > 5000})


@query(f"WITH {K_SQL}, m AS (SELECT 'knowledge' AS table_name, unnest(['rows', 'verified', 'rejected', 'unverified', 'short', 'long', 'empty', 'books_src0']) AS metric, unnest([count(*), count(*) FILTER (verification_status = 'verified'), count(*) FILTER (verification_status = 'rejected'), count(*) FILTER (verification_status = 'unverified'), count(*) FILTER (length(content) < 100), count(*) FILTER (length(content) > 5000), count(*) FILTER (content = ''), count(*) FILTER (source_book = 'src0')]) AS value FROM k UNION ALL SELECT 'voice', unnest(['rows', 'posts', 'chats', 'short']), unnest([count(*), count(*) FILTER (role = 'assistant'), count(*) FILTER (role = 'user'), count(*) FILTER (length(text) < 80)]) FROM conversations UNION ALL SELECT 'operations', unnest(['rows', 'errors', 'no_value']), unnest([count(*), count(*) FILTER (event_type = 'error'), count(*) FILTER (value IS NULL)]) FROM events UNION ALL SELECT 'vectors', unnest(['rows', 'no_vector']), unnest([count(*), count(*) FILTER (embedding IS NULL)]) FROM embeddings) SELECT * FROM m")
def g2_q1_dashboard(t):
    return lifecycle.dashboard(_dashboard(t))


def _dashboard(t):
    n, s, e = F.length("content"), F.col("verification_status"), F.col("event_type")
    every = F.lit(True)
    return {
        "knowledge": (knowledge(t), {"rows": every, "verified": s == "verified", "rejected": s == "rejected", "unverified": s == "unverified", "short": n < 100, "long": n > 5000, "empty": F.col("content") == "", "books_src0": F.col("source_book") == "src0"}),
        "voice": (t("conversations"), {"rows": every, "posts": F.col("role") == "assistant", "chats": F.col("role") == "user", "short": F.length("text") < 80}),
        "operations": (t("events"), {"rows": every, "errors": e == "error", "no_value": F.col("value").isNull()}),
        "vectors": (t("embeddings"), {"rows": every, "no_vector": F.col("embedding").isNull()}),
    }


@query("WITH c AS (SELECT count(*) FILTER (role = 'assistant') AS posts, count(*) FILTER (role = 'user') AS chats, count(*) FILTER (role = 'system') AS pending FROM conversations) SELECT 'before' AS mode, unnest(['posts', 'chats', 'other']) AS \"check\", unnest([posts, chats, 0]) AS value, unnest([posts >= 62, chats >= 1800, true]) AS ok FROM c UNION ALL SELECT 'after', unnest(['posts', 'chats', 'other', 'pending']), unnest([posts, chats, 0, pending]), unnest([posts >= 62, chats >= 1800, true, pending <= 0]) FROM c")
def q2_review_gates(t):
    r = F.col("role")
    values = lifecycle.counts(t("conversations"), {"posts": r == "assistant", "chats": r == "user", "pending": r == "system"})
    limits = {"posts": (62, None), "chats": (1800, None), "other": (None, 5), "pending": (None, 0)}
    both = [lifecycle.gates(values, limits, reviewed, ("pending",)).withColumn("mode", F.lit("after" if reviewed else "before")) for reviewed in (False, True)]
    return both[0].unionByName(both[1])


@query("WITH i AS (SELECT lang AS owner, CASE WHEN doc_id % 7 < 3 THEN 'experience' WHEN doc_id % 7 < 6 THEN 'rule' ELSE 'candidate' END AS kind, doc_id AS id, n_chars AS created_at FROM documents WHERE n_chars % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY CASE kind WHEN 'candidate' THEN 1 WHEN 'rule' THEN 2 ELSE 3 END, created_at, id) AS n FROM i) SELECT owner, kind, id, created_at FROM r WHERE n = 1")
def l7_next_items(t):
    kind = F.when(F.col("doc_id") % 7 < 3, "experience").when(F.col("doc_id") % 7 < 6, "rule").otherwise("candidate")
    return lifecycle.next_items(t("documents").select(F.col("lang").alias("owner"), kind.alias("kind"), F.col("doc_id").alias("id"), F.col("n_chars").alias("created_at"), F.when(F.col("n_chars") % 5 == 0, "done").otherwise("pending").alias("status")))


@query("SELECT 'has_text' AS \"check\", count(*) FILTER (coalesce(text, '') = '') AS violations, count(*) FILTER (coalesce(text, '') = '') = 0 AS ok FROM documents UNION ALL SELECT 'known_lang', count(*) FILTER (lang NOT IN ('en', 'es', 'fr')), count(*) FILTER (lang NOT IN ('en', 'es', 'fr')) = 0 FROM documents UNION ALL SELECT 'chars_match', count(*) FILTER (n_chars <> length(text)), count(*) FILTER (n_chars <> length(text)) = 0 FROM documents")
def q2_q4_checks(t):
    return lifecycle.checks(t("documents"), {"has_text": F.coalesce("text", F.lit("")) == "", "known_lang": ~F.col("lang").isin("en", "es", "fr"), "chars_match": F.col("n_chars") != F.length("text")})


@query("WITH e AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS w FROM events) SELECT user_id, event_type, any_value(w) AS winner, list(event_id ORDER BY event_id) FILTER (event_id <> w) AS losers FROM e GROUP BY user_id, event_type HAVING count(*) > 1")
def g7_l9_conflicts(t):
    return tables.conflicts(t("events"), ["user_id", "event_type"], "event_id", F.struct("ts", "event_id"))


@query("SELECT label AS owner, list(word ORDER BY pos) AS \"values\" FROM (SELECT source AS label, lower(lang || (doc_id % 7)) AS word, min(doc_id) AS pos FROM documents GROUP BY ALL) GROUP BY label")
def g8_g11_profile_fold(t):
    items = t("documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("ord"), F.concat("lang", F.col("doc_id") % 7).alias("item"))
    return lifecycle.profile_fold(items, "owner", "ord", "item")


@query("SELECT source, round(count(*) FILTER (quality = 1) / count(*), 4) AS coverage FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source")
def g12_s14_coverage(t):
    return knowledge(t).groupBy(F.col("source_book").alias("source")).agg(F.round(F.count_if(F.col("verification_status") == "verified") / F.count(F.lit(1)), 4).alias("coverage"))


@query(f"WITH f AS (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY sha256({norm('text')}) ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT doc_id, CASE WHEN r = 1 THEN 'active' ELSE 'archived' END AS status, CASE WHEN r > 1 THEN 'duplicate' END AS reason FROM f")
def w1_l11_archive_duplicates(t):
    return lifecycle.archive_duplicates(_prints(t), ["print"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "status", "reason")


@query(f"WITH {C_SQL}, f AS (SELECT conv_id, turn, kind, text, row_number() OVER (PARTITION BY sha256({norm('text')}) ORDER BY conv_id, turn) AS r FROM c WHERE length({STRIP.format('text')}) >= 15 AND NOT regexp_matches({STRIP.format('text')}, '^https?://\\S+$') AND NOT regexp_matches({STRIP.format('text')}, '(?i)^(password|login|token|api[_ -]?key)\\b')) SELECT conv_id, turn, kind, sha256(text) AS content_hash FROM f WHERE r = 1")
def w2_l1_chat_cleaning(t):
    clean = chat(t).where(~T.is_noise(F.col("text"))).withColumn("print", T.fingerprint(F.col("text")))
    return tables.first_of(clean, ["print"], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn", "kind", F.sha2("text", 256).alias("content_hash"))


@query("SELECT event_id, user_id, coalesce(v, 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events LEFT JOIN (SELECT o_custkey AS user_id, count(*) AS v FROM orders GROUP BY ALL) USING (user_id)")
def w5_next_versions(t):
    existing = t("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("version"))
    return tables.next_versions(t("events").select("event_id", "user_id"), existing, "user_id", F.col("event_id"))


@query("WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents) SELECT doc_id, position FROM n WHERE position IN (SELECT (i * n) // 20 FROM range(20) r(i))")
def w6_systematic_sample(t):
    return tables.systematic_sample(t("documents").select("doc_id"), "doc_id", 20).select("doc_id", "position")


@query(f"WITH {V_SQL}, s AS (SELECT id, label, 1 - list_cosine_similarity(lag(embedding) OVER (PARTITION BY label ORDER BY id), embedding) AS distance FROM v), b AS (SELECT label, quantile_cont(distance, 0.95) AS bound FROM s GROUP BY label) SELECT id, label, CAST(sum(CASE WHEN distance > bound THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY id) AS BIGINT) AS chunk_no FROM s JOIN b USING (label)")
def w9_semantic_breaks(t):
    return chunking.semantic_breaks(vectors(t), "label", "id", "embedding").select("id", "label", "chunk_no")


@query(f"WITH {C_SQL}, b AS (SELECT kind, conv_id, count(*) AS n, sum(length(text)) AS chars FROM c GROUP BY ALL UNION ALL SELECT 'all', conv_id, count(*), sum(length(text)) FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, conv_id) AS rank FROM b) SELECT kind, CAST(sum(n) AS BIGINT) AS message_count, CAST(sum(chars) AS BIGINT) AS total_characters, string_agg(conv_id || ':' || n, ',' ORDER BY rank) FILTER (rank <= 15) AS top_chats FROM r GROUP BY kind")
def g1_s6_top_chats(t):
    stats = exports.corpus_stats(chat(t), "conv_id")
    return stats.withColumn("top_chats", F.array_join(F.transform("top_chats", lambda x: F.concat(x["chat"].cast("string"), F.lit(":"), x["messages"].cast("string"))), ","))


@query("SELECT CASE quality WHEN 1 THEN 'ok' WHEN 0 THEN 'failed' ELSE 'unknown' END AS status, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY ALL")
def s14_run_report(t):
    done = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return tables.run_report(t("documents").join(done, "doc_id", "left").withColumn("status", F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "failed")))


@query(f"WITH f AS (SELECT doc_id, {norm('text')} AS p FROM documents), k AS (SELECT DISTINCT p FROM f WHERE doc_id % 3 = 0), s AS (SELECT p FROM f WHERE doc_id % 3 <> 0) SELECT count(DISTINCT p) FILTER (p NOT IN (SELECT p FROM k)) AS remaining, count(*) - count(DISTINCT p) FILTER (p NOT IN (SELECT p FROM k)) AS skipped FROM s")
def j1_import_report(t):
    p = _prints(t)
    return tables.import_report(p.where("doc_id % 3 <> 0"), p.where("doc_id % 3 = 0"), "print")


@query("WITH s AS (SELECT conv_id, turn, length(text) AS n, least(length(text) // 10, 200) + CASE WHEN role = 'assistant' THEN 100 ELSE 0 END + CASE WHEN length(text) > 500 THEN 50 ELSE 0 END AS score FROM conversations) SELECT conv_id, turn, score FROM s WHERE score >= 25")
def f8_selected_messages(t):
    m = t("conversations").select("conv_id", "turn", "role", "text")
    return T.selected(m, T.message_score(F.col("text"), F.col("role") == "assistant"), 25).select("conv_id", "turn", "score")


@query("SELECT conv_id, turn FROM conversations WHERE NOT (turn % 3 = 0 AND turn % 2 = 0)")
def f2_with_text_or_no_media(t):
    m = t("conversations").withColumn("shown", F.when(F.col("turn") % 3 != 0, F.col("text"))).withColumn("photo", F.when(F.col("turn") % 2 == 0, F.lit("p")))
    return m.where(~T.is_media_only(F.col("shown"), F.col("photo"))).select("conv_id", "turn")


@query("SELECT event_id, event_id NOT IN (SELECT arg_max(event_id, (ts, event_id)) FROM events GROUP BY user_id, event_type) AS is_deprecated FROM events")
def l9_deprecated(t):
    losers = tables.conflicts(t("events"), ["user_id", "event_type"], "event_id", F.struct("ts", "event_id"))
    return tables.deprecated(t("events").select("event_id"), losers, "event_id")


@query(f"WITH c AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'), r AS (SELECT *, row_number() OVER (PARTITION BY {norm('text')} ORDER BY id) AS n FROM c WHERE {STRIP.format('text')} <> '') SELECT id, 'pending' AS status, 1.0::DOUBLE AS confidence, sha256(concat('style:', {norm('text')})) AS fingerprint FROM r WHERE n = 1")
def l3b_style_corrections(t):
    c = t("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("instruction"))
    return memory.style_corrections(c).select("id", "status", "confidence", "fingerprint")


@query(f"WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN source ELSE 'Reflection' END AS topic, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 2 = 0 THEN text WHEN doc_id % 4 = 0 THEN source ELSE 'Reflection' END AS quote, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 0.85 END AS confidence, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS lessons FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY {norm('topic')}, {norm('lessons')} ORDER BY id) AS nth FROM r) SELECT id, topic, sha256(quote) AS quote, CAST(confidence AS DOUBLE) AS confidence FROM n WHERE nth = 1")
def l5_regret_candidates(t):
    r = t("documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("event_title"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("source_quote"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("consequences_lessons"), F.lit("").alias("context"), F.when(F.col("doc_id") % 5 == 0, 0.5).alias("confidence"))
    return memory.regret_candidates(r).select("id", "topic", F.sha2("quote", 256).alias("quote"), "confidence")


@query(f"WITH l AS (SELECT item_id, text, sha256(concat('rule:', {norm('text')})) AS fingerprint FROM benchmark WHERE {STRIP.format('text')} <> ''), e AS (SELECT fingerprint FROM l WHERE item_id % 4 = 0) SELECT fingerprint, min(item_id) AS legacy_id FROM l WHERE fingerprint NOT IN (SELECT fingerprint FROM e) GROUP BY fingerprint")
def l8_backfilled(t):
    b = t("benchmark")
    known = b.where("item_id % 4 = 0").select(T.fingerprint(F.lit("rule"), F.col("text")).alias("fingerprint"))
    return memory.backfilled(b, known, "rule", F.col("text"), "item_id").select("fingerprint", "legacy_id")


@query("SELECT source AS owner, part, count(*) AS n FROM (SELECT source, 0 AS part FROM documents WHERE lang = 'en' UNION ALL SELECT source, 1 FROM documents WHERE lang = 'es' UNION ALL SELECT source, 2 FROM documents WHERE lang NOT IN ('en', 'es')) GROUP BY ALL")
def u3_manual_entries(t):
    d = t("documents").select(F.col("source").alias("owner"), F.col("text").alias("value"), "lang")
    merged = memory.with_manual_entries(d.where("lang = 'en'"), d.where("lang = 'es'"), d.where("lang not in ('en', 'es')").drop("lang"))
    return merged.groupBy("owner", "part").agg(F.count(F.lit(1)).alias("n"))


# ---- top-k


@query(f"WITH {NEAR_SQL}, r AS (SELECT query_id, id, similarity * exp(-0.002 * greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(occurred_at), 0) / 86400e6) AS score FROM n JOIN v USING (id) WHERE rank <= 5) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r")
def k1_recency_rerank(t):
    v = vectors(t).drop("embedding")
    out = retrieval.reranked(retrieval.nearest(questions(t), vectors(t), 5), v, V.recency(F.col("similarity"), F.col("occurred_at"), AS_OF), 5)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {NEAR_SQL}, r AS (SELECT query_id, id, similarity * quality_weight AS score FROM n JOIN v USING (id) WHERE rank <= 24), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) SELECT query_id, id, round(score, 6) AS score, rank FROM w WHERE rank <= 6")
def k2_overfetch_quality(t):
    out = retrieval.reranked(retrieval.nearest(questions(t), vectors(t), 24), vectors(t).drop("embedding"), F.col("similarity") * F.col("quality_weight"), 6)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {NEAR_SQL}, r AS (SELECT query_id, id, similarity * quality_weight AS score, occurred_at, similarity FROM n JOIN v USING (id) WHERE rank <= 24), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r), x AS (SELECT query_id, id, score * exp(-0.002 * greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(occurred_at), 0) / 86400e6) AS score FROM w WHERE rank <= 6) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x")
def k2_k1_voice_examples(t):
    out = retrieval.voice_examples(questions(t), vectors(t), AS_OF)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {K_SQL} SELECT id, category FROM k WHERE verification_status = 'unverified' AND category = 'en' ORDER BY id DESC LIMIT 50")
def k6_verification_queue(t):
    return knowledge(t).where("verification_status = 'unverified' and category = 'en'").select("id", "category").orderBy(F.desc("id")).limit(50)


@query(f"WITH {V_SQL}, s AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.embedding, v.embedding) AS similarity FROM v AS q, v WHERE q.id % 20 = 0 AND v.kind = 'purchase'), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, id, rank FROM n WHERE rank <= 5")
def k8_filtered_top_k(t):
    return retrieval.nearest(questions(t), vectors(t).where("kind = 'purchase'"), 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT * FROM ((SELECT 'candidate' AS kind, doc_id AS id FROM documents ORDER BY doc_id LIMIT 30) UNION ALL (SELECT 'rule', item_id FROM benchmark ORDER BY item_id LIMIT 30) UNION ALL (SELECT 'experience', page_id FROM pages ORDER BY page_id LIMIT 30)) ORDER BY id, kind LIMIT 30")
def u1_l7_review_queue(t):
    parts = [t(n).select(F.lit(k).alias("kind"), F.col(c).cast("long").alias("id")).orderBy("id").limit(30) for k, n, c in (("candidate", "documents", "doc_id"), ("rule", "benchmark", "item_id"), ("experience", "pages", "page_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("id", "kind").limit(30)


# ---- chunking


@query(r"WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 1000) / 800), 0) AS BIGINT) * 800 + 1, 800)) AS s FROM documents), c AS (SELECT doc_id, s, " + STRIP.format("substr(text, s + 1, 1000)") + " AS chunk FROM s) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS chunk_no, chunk FROM c WHERE chunk <> ''")
def c1_sliding_windows(t):
    return chunking.windows(t("documents"), "text", ["doc_id"]).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query("WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS x FROM documents), c AS (SELECT doc_id, i, " + STRIP.format("x") + " AS chunk FROM p) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_no, chunk FROM c WHERE chunk <> ''")
def c2_w7_paragraphs(t):
    return chunking.paragraphs(t("documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "text", ["doc_id"]).withColumn("chunk_no", F.col("chunk_no").cast("long"))


#: Sections in SQL; the walk of c5 goes on from there.
C4_SQL = r"""WITH RECURSIVE p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS x FROM documents), l AS (SELECT doc_id, i, x, i % 5 = 0 AND regexp_matches(x, '^\S') AS head FROM p),
n AS (SELECT *, CAST(sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS section FROM l), g AS (SELECT doc_id, section, max(CASE WHEN head THEN x END) AS title, regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN CASE WHEN i % 5 = 0 THEN '# ' || x ELSE x END END, chr(10) ORDER BY i), ''), '^\s+|\s+$', '', 'g') AS body FROM n GROUP BY doc_id, section), h AS (SELECT doc_id, section, coalesce(title, CASE WHEN max(section) OVER (PARTITION BY doc_id) = 0 THEN 'Document' ELSE 'Preamble' END) AS title, body FROM g), sections AS (SELECT * FROM h WHERE section > 0 OR body <> '' OR title = 'Document')"""


@query(C4_SQL + " SELECT * FROM sections")
def c4_markdown_sections(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# "), x)).otherwise(x))
    return chunking.sections(t("documents").select("doc_id", F.array_join(lines, "\n").alias("text")), "text", "doc_id").drop("level")


@query(r"WITH RECURSIVE p AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM (SELECT doc_id, CASE WHEN len(x) > 1 AND x[-1] = '' THEN x[:-2] ELSE x END AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''))), g AS (SELECT doc_id, i, length(x) + 1 AS size, 1 AS n FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN g.size + length(x) + 1 > 2500 THEN length(x) + 1 ELSE g.size + length(x) + 1 END, g.n + CASE WHEN g.size + length(x) + 1 > 2500 THEN 1 ELSE 0 END FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1) SELECT doc_id, CAST(n AS BIGINT) AS chunk_no, string_agg(x, chr(10) ORDER BY i) AS chunk FROM g JOIN p USING (doc_id, i) GROUP BY doc_id, n")
def c7_line_packs(t):
    return chunking.line_packs(t("documents"), "text", ["doc_id"], 2500).withColumn("chunk_no", F.col("chunk_no").cast("long"))


C6_SQL = r"""WITH RECURSIVE p AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS x, len(x) AS n FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '') AS x FROM documents)),
c AS (SELECT doc_id, 0 AS i, CAST(NULL AS VARCHAR) AS open, CAST([] AS VARCHAR[]) AS done FROM p WHERE i = 1
 UNION ALL SELECT c.doc_id, p.i, CASE WHEN length(p.x) > 500 THEN NULL WHEN c.open IS NOT NULL AND length(c.open) + 2 + length(p.x) <= 500 THEN c.open || chr(10) || chr(10) || p.x ELSE p.x END,
  CASE WHEN length(p.x) > 500 THEN list_concat(CASE WHEN c.open IS NULL THEN [] ELSE [c.open] END, list_transform(range(0, length(p.x), 500), lambda s: regexp_replace(substr(p.x, s + 1, 500), '^\s+|\s+$', '', 'g'))) WHEN c.open IS NOT NULL AND length(c.open) + 2 + length(p.x) > 500 THEN [c.open] ELSE [] END
 FROM c JOIN p ON p.doc_id = c.doc_id AND p.i = c.i + 1),
a AS (SELECT doc_id, i, unnest(done) AS chunk, generate_subscripts(done, 1) AS j FROM c UNION ALL SELECT c.doc_id, c.i + 1, c.open, 1 FROM c JOIN p ON p.doc_id = c.doc_id AND p.i = c.i AND p.i = p.n WHERE c.open IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS chunk_no, chunk FROM a WHERE chunk <> ''"""


@query(C6_SQL)
def c6_greedy_pack(t):
    d = t("documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n")))
    return chunking.paragraph_packs(d, "text", ["doc_id"], 500).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query("SELECT user_id, string_agg(printf('[%02d:%02d] ', event_id // 60, event_id % 60) || event_type, chr(10) ORDER BY event_id) AS transcript FROM events GROUP BY user_id")
def c12_transcript(t):
    return chunking.transcript(t("events"), "user_id", "event_id", "event_type")


# ---- lifecycle and streams' batch twins


@query(f"""WITH c AS (SELECT doc_id AS id, source AS kind, sha256(concat({norm('source')}, ':', {norm('text')})) AS print FROM documents), d AS (SELECT doc_id AS id, min(CASE WHEN toxic = 1 OR quality = 0 THEN 'reject' ELSE 'accept' END) AS decision FROM labels GROUP BY doc_id),
a AS (SELECT print, min(id) AS held FROM c WHERE id % 10 = 0 GROUP BY print), j AS (SELECT c.*, decision, a.held, sum(CASE WHEN decision = 'accept' THEN 1 ELSE 0 END) OVER (PARTITION BY c.print ORDER BY CASE WHEN decision IS NULL THEN NULL ELSE id END NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS nth FROM c LEFT JOIN d USING (id) LEFT JOIN a ON c.print = a.print)
SELECT id, kind, CASE WHEN decision IS NULL THEN 'pending' WHEN decision = 'reject' THEN 'rejected' WHEN held IS NOT NULL OR nth > 1 THEN 'duplicate' ELSE 'active' END AS status, CASE WHEN decision = 'accept' AND (held IS NOT NULL OR nth > 1) THEN 'exact_content' END AS match_type, CASE WHEN decision = 'accept' AND (held IS NOT NULL OR nth > 1) THEN held END AS duplicate_of FROM j""")
def l6_apply_decisions(t):
    c = t("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("kind"), F.col("text").alias("content"))
    d = t("labels").groupBy(F.col("doc_id").alias("id")).agg(F.min(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "reject").otherwise("accept")).alias("decision"), F.max("doc_id").alias("at"))
    return lifecycle.apply_decisions(c, d, c.where("id % 10 = 0")).drop("content")


@query("WITH r AS (SELECT event_id AS request_id, user_id AS token, ts, CASE WHEN event_type = 'error' THEN 'draft' ELSE 'approved' END AS state FROM events), n AS (SELECT *, sum(CASE WHEN state = 'approved' THEN 1 ELSE 0 END) OVER (PARTITION BY token ORDER BY ts, request_id) AS nth FROM r) SELECT request_id, CASE WHEN state = 'draft' THEN 'rejected' WHEN nth = 1 THEN 'accepted' ELSE 'duplicate' END AS outcome FROM n")
def l19_publish_ledger(t):
    r = t("events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("token"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "draft").otherwise("approved").alias("state"))
    return tables.publish_ledger(r).select("request_id", "outcome")


@query("WITH e AS (SELECT user_id % 50 AS event_type, ts, event_id, event_type = 'error' AS bad FROM events) SELECT event_type, max(ts) FILTER (NOT bad) AS last_success, max(ts) FILTER (bad) AS last_error, arg_max(event_id, (ts, event_id)) FILTER (bad) AS error_id, max(ts) FILTER (bad) IS NOT NULL AND (max(ts) FILTER (NOT bad) IS NULL OR max(ts) FILTER (bad) > max(ts) FILTER (NOT bad)) AS error_shown FROM e GROUP BY event_type")
def q3_t2_latest_status(t):
    e = t("events").select((F.col("user_id") % 50).alias("event_type"), F.col("ts").alias("created_at"), "event_id", F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))
    return lifecycle.latest_status(e)


T1_SQL = f"WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS r FROM conversations WHERE length({STRIP.format('text')}) >= 80 AND conv_id % 4 <> 0) SELECT conv_id AS channel_id, turn AS message_id, text, sha256(concat('channel:', {norm('text')})) AS fingerprint, CAST(CASE WHEN turn % 2 = 1 THEN 0.85 ELSE 1.0 END AS DOUBLE) AS quality_weight FROM p WHERE r = 1"


def _posts(t) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("channel_id"), F.col("turn").alias("message_id"), "text", F.lit(AS_OF).cast("timestamp").alias("date"), (F.col("turn") % 2 == 1).alias("forwarded"))


@query(T1_SQL)
def t1_channel_posts(t):
    posts = _posts(t)
    return ingest.channel_posts_batch(posts, posts.where("channel_id % 4 = 0").select("channel_id", "message_id").distinct())


@query(T1_SQL)
def t1_keyed_stream(t):
    """The stream itself: posts arrive in a folder, a fourth of the channels stands in the ledger already."""
    posts, spark = _posts(t), t("conversations").sparkSession
    place = scratch.place(spark, "keyed-stream")
    posts.write.parquet(f"{place}/in")
    ingest.voice_rows(posts.where("channel_id % 4 = 0")).write.parquet(f"{place}/ledger/run=earlier/batch=0")
    ingest.channel_posts(spark.readStream.schema(posts.schema).parquet(f"{place}/in"), f"{place}/ledger", f"{place}/dead", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/ledger").where("run <> 'earlier'").drop("run", "batch")


#: Fixed values of the binding: words that make a question of these tables factual or religious.
ASKS_FACTS, ASKS_RELIGION = r"(?i)\b(for|para|pour)\b", r"(?i)\b(than|der|les)\b"


def _asked(t) -> DataFrame:
    """Questions with the text of the document of the same id, its flags and the style mode asked for."""
    flags = T.topics(F.col("text"), ASKS_FACTS, ASKS_RELIGION)
    d = t("documents").select(F.col("doc_id").alias("query_id"), flags["factual"].alias("factual"), flags["religious"].alias("religious"), (F.col("n_chars") % 4).alias("mode"))
    return questions(t).join(d, "query_id")


def _knowledge_vectors(t) -> DataFrame:
    return knowledge(t).join(t("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


def _context(t) -> DataFrame:
    q, v, k = _asked(t), vectors(t), _knowledge_vectors(t)
    rules, lived = v.where("label < 5"), v.where("label >= 5")
    facts = v.drop("embedding")
    chosen = memory.rules_for(q.select("query_id", "embedding"), retrieval.nearest(q, rules, retrieval.RULES), rules, F.col("label") == 0, [F.desc_nulls_first("occurred_at"), F.asc("id")], retrieval.RULES).join(facts, "id")
    voice = retrieval.voice_examples(q, v, AS_OF)
    lives = retrieval.reranked(retrieval.nearest(q, lived, retrieval.EXPERIENCES), facts, V.recency(F.col("similarity"), F.col("occurred_at"), AS_OF), retrieval.EXPERIENCES)
    known = retrieval.gated_knowledge(q, k).join(k.drop("embedding"), "id")
    text = F.concat(F.lit("vector "), "id")
    layers = {
        "rules": (retrieval.layer(chosen, retrieval.rule_line(F.col("kind"), F.col("label"), text), "rules"), "No confirmed rules yet."),
        "voice": (retrieval.layer(voice, retrieval.voice_line(F.col("rank"), F.col("kind"), text), "voice", "\n\n"), "No examples of speech yet."),
        "experiences": (retrieval.layer(lives, retrieval.experience_line(F.col("kind") == "error", F.col("label"), F.col("kind"), F.col("quality_weight"), text), "experiences"), "No confirmed stories yet."),
        "knowledge": (retrieval.layer(known, retrieval.knowledge_line(F.col("source_book"), F.lit(None).cast("string"), F.col("verification_status"), F.col("content")), "knowledge"), "No outside knowledge is used."),
    }
    modes = t("region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("mode"), F.col("r_name").alias("style_mode"))
    asked = memory.lookup(q.select("query_id", "religious", F.col("mode").cast("long").alias("mode")), modes, "mode", 0).select("query_id", F.col("religious").alias("religious_guardrail"), "style_mode")
    return retrieval.context(asked, layers)


@query()
def r1_context(t):
    return _context(t)


@query(f"""WITH {NEAR_SQL}, a AS (SELECT q.id AS query_id, regexp_matches(text, '(?i)\\b(for|para|pour)\\b') AS factual, regexp_matches(text, '(?i)\\b(than|der|les)\\b') AS religious, CASE WHEN n_chars % 4 < 3 THEN n_chars % 4 ELSE 0 END AS mode FROM v AS q JOIN documents ON q.id = doc_id WHERE q.id % 20 = 0), {K_SQL},
g AS (SELECT id, row_number() OVER (ORDER BY occurred_at DESC NULLS FIRST, id) AS rank FROM v WHERE label = 0), l AS (SELECT query_id, s.id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, s.id) AS rank FROM s JOIN v USING (id) WHERE v.label < 5),
t AS (SELECT query_id, count(*) AS n FROM (SELECT query_id, g.id FROM a, g WHERE g.rank <= 10 UNION SELECT query_id, id FROM l WHERE rank <= 20 - (SELECT least(10, count(*)) FROM g)) GROUP BY query_id),
e AS (SELECT verification_status, id FROM k JOIN embeddings ON vec_id = id), w AS (SELECT a.query_id, least(3, count(e.id) FILTER (NOT a.religious OR e.verification_status = 'verified')) AS n FROM a CROSS JOIN e WHERE a.factual OR a.religious GROUP BY a.query_id)
SELECT a.query_id, religious AS religious_guardrail, r_name AS style_mode, t.n AS n_rules, least(6, (SELECT count(*) FROM v)) AS n_voice, least(4, (SELECT count(*) FROM v WHERE label >= 5)) AS n_experiences, coalesce(w.n, 0) AS n_knowledge FROM a JOIN t USING (query_id) LEFT JOIN w USING (query_id) JOIN region ON r_regionkey = mode""")
def r1_r5_run_metrics(t):
    return _context(t).select("query_id", "religious_guardrail", "style_mode", "n_rules", "n_voice", "n_experiences", "n_knowledge")


@query(f"WITH {NEAR_SQL}, k AS (SELECT query_id, s.id, similarity, v.kind, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, s.id) AS rank FROM s JOIN v ON s.id = v.id JOIN v AS q ON q.id = query_id WHERE q.label >= 5 OR v.kind = q.kind), e AS (SELECT query_id, s.id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, s.id) AS rank FROM s JOIN v ON s.id = v.id WHERE query_id % 40 = 0 OR v.kind <> 'error'), x AS (SELECT query_id, s.id, row_number() OVER (PARTITION BY query_id ORDER BY similarity * quality_weight DESC, s.id) AS rank FROM s JOIN v ON s.id = v.id) SELECT 'knowledge' AS source, query_id, id, rank FROM k WHERE rank <= 1 + query_id % 5 UNION ALL SELECT 'experience', query_id, id, rank FROM e WHERE rank <= 4 UNION ALL SELECT 'voice', query_id, id, rank FROM x WHERE rank <= 6")
def x1_matches(t):
    v = vectors(t).withColumn("category", F.col("kind")).withColumn("is_regret", F.col("kind") == "error")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding", F.when(F.col("label") < 5, F.col("kind")).alias("filter_category"), (1 + F.col("id") % 5).alias("match_count"), (F.col("id") % 40 == 0).alias("include_regrets"))
    fixed = q.drop("match_count")
    found = {"knowledge": matching.match_knowledge_chunks(q, v), "experience": matching.match_life_experiences(fixed, v), "voice": matching.match_voice_examples(fixed, v, mode="exact")}
    parts = [df.select(F.lit(n).alias("source"), "query_id", "id", F.col("rank").cast("long").alias("rank")) for n, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- memory tables, captions and the rest


@query("SELECT event_id, event_id % 7 <> 0 AS ok, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, ts AS at, printf('%02d:%02d', event_id // 60, event_id % 60) AS clock FROM events WHERE event_id < 3600 UNION ALL SELECT event_id, event_id % 7 <> 0, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END, ts, printf('%02d:%02d:%02d', event_id // 3600, (event_id // 60) % 60, event_id % 60) FROM events WHERE event_id >= 3600")
def p13_p15_p20_parsed(t):
    raw = F.when(F.col("event_id") % 7 == 0, "[1, 2]").otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return t("events").select("event_id", T.parsed(raw).isNotNull().alias("ok"), F.try_variant_get(T.parsed(raw), "$.k", "bigint").alias("k"), T.timestamp(F.concat(F.lit(" "), F.col("ts").cast("string"))).cast("timestamp_ntz").alias("at"), T.clock(F.col("event_id")).alias("clock"))


@query(f"WITH {V_SQL} SELECT id, CASE WHEN kind = 'purchase' THEN 0.4::DOUBLE ELSE quality_weight END AS quality_weight, kind AS source, CASE WHEN kind = 'purchase' THEN round(quality_weight, 6) END AS previous FROM v")
def p17_l12_reweighted(t):
    v = vectors(t).withColumn("metadata", F.create_map(F.lit("source"), "kind", F.lit("previous_weight"), F.lit(None).cast("string")))
    return memory.reweighted(v, F.col("kind") == "purchase", 0.4).select("id", "quality_weight", F.col("metadata")["source"].alias("source"), F.round(F.col("metadata")["previous_weight"].cast("double"), 6).alias("previous"))


@query(f"WITH t AS (SELECT doc_id, {STRIP.format('text')} AS s, text, source, lang FROM documents) SELECT doc_id, CASE WHEN s <> '' THEN s ELSE source END AS rule, concat(lang, chr(10), chr(10), source) AS experience, regexp_matches(text, '(?i)\\b(what|when|who|how many|fact|statistic)\\b') AS factual, regexp_matches(text, '(?i)\\b(quran|hadith|islam|prayer)\\b') AS religious, concat(s, chr(10), chr(10), 'https://x.example/', doc_id) AS moved FROM t")
def p18_p23_p26_texts(t):
    url = F.concat(F.lit("https://x.example/"), "doc_id")
    flags = T.topics(F.col("text"))
    return t("documents").select("doc_id", T.rule_text(F.col("text"), F.col("source")).alias("rule"), T.experience_text(F.col("lang"), F.lit(None).cast("string"), F.col("source")).alias("experience"), flags["factual"].alias("factual"), flags["religious"].alias("religious"), T.with_source(F.concat(url, F.lit(" "), "text"), url, True).alias("moved"))


@query(f"SELECT doc_id, CASE source WHEN 'src0' THEN 'main' WHEN 'src1' THEN 'main' ELSE source END AS source, sha256({norm('text')}) AS fingerprint, CASE WHEN lang = 'es' THEN 'unverified' ELSE 'kept' END AS status FROM documents")
def p7_l10_canonical(t):
    d = memory.canonical(t("documents"), "source", {"src0": "main", "src1": "main"})
    return d.select("doc_id", "source", T.fingerprint(F.col("text")).alias("fingerprint"), F.when(F.col("lang") == "es", "unverified").otherwise("kept").alias("status"))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' OR (role = 'assistant' AND turn % 2 = 0) OR (conv_id % 10 = 0 AND role = 'system')")
def f1_owner_messages(t):
    m = t("conversations").withColumn("m", F.struct(F.when((F.col("role") == "system") & (F.col("conv_id") % 10 != 0), "service").otherwise("message").alias("type"), F.when(F.col("role") == "user", "owner").otherwise(F.concat(F.lit("channel"), "conv_id")).alias("author"), F.when((F.col("role") == "system") | (F.col("turn") % 2 == 0), "public_channel").otherwise("group").alias("chat_type")))
    return m.where(T.is_owned(F.col("m"), "owner")).select("conv_id", "turn")


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src3', 'src13') AND NOT contains(lower(source), 'src1')")
def f4_excluded(t):
    return t("documents").where(~T.is_excluded(F.col("source"), ["SRC3", "src1"])).where("source <> 'src3'").select("doc_id")


@query("SELECT conv_id, turn FROM conversations c WHERE conv_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.turn = 3 AND d.text = c.text)")
def j2_unpublished(t):
    c = t("conversations")
    return memory.unpublished(c, (c.where("conv_id % 4 = 0"), ["conv_id", "turn"]), (c.where("turn = 3"), ["text"])).select("conv_id", "turn")


@query("SELECT event_id, CASE WHEN user_id % 10 < 3 THEN user_id % 10 ELSE 0 END AS used_mode, r_name AS name FROM events JOIN region ON r_regionkey = CASE WHEN user_id % 10 < 3 THEN user_id % 10 ELSE 0 END")
def j7_mode_fallback(t):
    modes = t("region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("long").alias("mode"), F.col("r_name").alias("name"))
    return memory.lookup(t("events").select("event_id", (F.col("user_id") % 10).alias("mode")), modes, "mode", 0).select("event_id", "used_mode", "name")


@query(f"WITH {K_SQL} SELECT id, CASE WHEN id > 0 AND id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'rejected' ELSE verification_status END AS verification_status FROM k")
def j10_set_status(t):
    return memory.set_status(knowledge(t), t("labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "rejected").select("id", "verification_status")


@query()
def j11_nearest_in_lists(t):
    c = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.nearest_in_lists(c.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), c, 6, 16, 10).select("query_id", "id", "rank")


def grown_index(t) -> str:
    """The folder of a graph index of nine tenths of the vectors, with the rest inserted afterwards."""
    c = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = scratch.place(c.sparkSession, "graph-index")
    graph_index.build(c.where("id % 10 <> 3"), path)
    graph_index.append(c.where("id % 10 = 3"), path)
    return path


@query()
def j11_graph_index(t):
    q = t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return graph_index.search(q, grown_index(t), 6).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("WITH e AS (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) SELECT (SELECT count(*) FROM e) AS indexed, count(*) AS queries, CAST(count(*) * least(6, (SELECT count(*) FROM e)) AS BIGINT) AS wanted, true AS recall_reached FROM e WHERE vec_id % 20 = 0")
def j11_graph_recall(t):
    """Rows that the grown index holds, and whether its search finds nine tenths of the rows of the exact one."""
    q, path = t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), grown_index(t)
    found = graph_index.recall(graph_index.search(q, path, 6), graph_index.search(q, path, 6, exact=True))
    indexed = graph_index.stored(q.sparkSession, path).agg(F.sum("n").alias("indexed"))
    return indexed.join(found).select("indexed", "queries", "wanted", (F.col("recall") >= 0.9).alias("recall_reached"))


@query(f"SELECT CAST(conv_id AS VARCHAR) AS chat_name, CAST(turn AS BIGINT) AS id, role AS author, coalesce({STRIP.format('text')}, '') AS text FROM conversations")
def s1_split_exports(t):
    """The conversations as exports, and these read back in splits."""
    c = t("conversations")
    path = scratch.place(c.sparkSession, "exports")
    split_exports.write_exports(c, path, "conv_id", "turn", "text", "role")
    return split_exports.chat_exports(c.sparkSession, path, "*.txt")[0].select("chat_name", "id", "author", "text")


@query("SELECT count(text) AS n, count(text) - count(DISTINCT text) AS duplicates, count(*) FILTER (text IS NULL) AS missing, count(*) FILTER (lang = 'en') + count(*) FILTER (source = 'src0') AS total FROM documents")
def g3_g5_duplicates_nulls(t):
    return t("documents").agg(F.count("text").alias("n"), (F.count("text") - F.countDistinct("text")).alias("duplicates"), F.count_if(F.col("text").isNull()).alias("missing"), (F.count_if(F.col("lang") == "en") + F.count_if(F.col("source") == "src0")).alias("total"))


@query("SELECT source, string_agg(lang, chr(10) ORDER BY p) AS merged FROM (SELECT source, lang, min(doc_id) AS p FROM documents GROUP BY source, lang) GROUP BY source")
def g8_topic_merge(t):
    return memory.topic_merge(t("documents"), ["source"], "doc_id", "lang")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE trim(source) <> '' GROUP BY lower(source) UNION ALL SELECT min(doc_id) FROM documents WHERE trim(lang) <> '' GROUP BY lower(lang)")
def g9_first_by_title(t):
    d = t("documents")
    return memory.first_by_title(d, "source", "doc_id").select("doc_id").unionAll(memory.first_by_title(d, "lang", "doc_id").select("doc_id"))


@query("SELECT user_id, list(event_type ORDER BY p) AS markers FROM (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id")
def g10_marker_union(t):
    return memory.marker_union(t("events"), ["user_id"], "event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type <> 'error') WHERE r = 1 ORDER BY event_id DESC")
def w3_w4_k7_current(t):
    return tables.first_of(t("events").where("event_type <> 'error'"), ["user_id"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id").orderBy(F.desc("event_id"))


@query("WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'auto' END AS origin, CASE event_type WHEN 'click' THEN 'en' WHEN 'view' THEN 'ru' ELSE event_type END AS lang FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY origin DESC, CASE lang WHEN 'ru' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, lang, event_id) AS r FROM e) SELECT user_id, origin, lang FROM n WHERE r = 1")
def w10_best_track(t):
    lang = F.when(F.col("event_type") == "click", "en").when(F.col("event_type") == "view", "ru").otherwise(F.col("event_type"))
    tracks = t("events").select("user_id", F.when(F.col("event_id") % 3 == 0, "manual").otherwise("auto").alias("origin"), lang.alias("lang"), F.lit("vtt").alias("ext"))
    return captions.best_track(tracks, "user_id", ["ru", "en"]).select("user_id", "origin", "lang")


@query(f"WITH {V_SQL}, b AS (SELECT id, row_number() OVER (ORDER BY quality_weight DESC NULLS FIRST, occurred_at DESC NULLS FIRST, id) AS rank FROM v) SELECT q.id AS query_id, b.id, rank FROM v AS q, b WHERE q.id % 20 = 0 AND rank <= 6")
def k3_without_vector(t):
    q = questions(t).withColumn("embedding", F.lit(None).cast("array<float>"))
    return memory.without_vector(q, vectors(t), [F.desc_nulls_first("quality_weight"), F.desc_nulls_first("occurred_at"), F.asc("id")], 6).select("query_id", "id", "rank")


@query(f"WITH {NEAR_SQL}, g AS (SELECT id, row_number() OVER (ORDER BY occurred_at DESC NULLS FIRST, id) AS rank FROM v WHERE label = 0), t AS (SELECT q.id AS query_id, g.id, 0 AS part, g.rank FROM v AS q, g WHERE q.id % 20 = 0 AND g.rank <= 10), a AS (SELECT * FROM t UNION ALL SELECT query_id, id, 1, rank FROM n WHERE rank <= 20 - (SELECT least(10, count(*)) FROM g) AND (query_id, id) NOT IN (SELECT (query_id, id) FROM t)), r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS rank FROM a) SELECT * FROM r WHERE rank <= 20")
def k4_j9_rules(t):
    q, v = questions(t), vectors(t)
    return memory.rules_for(q, retrieval.nearest(q, v, 20), v, F.col("label") == 0, [F.desc_nulls_first("occurred_at"), F.asc("id")], 20).select("query_id", "id", "rank")


@query(f"WITH {V_SQL}, t AS (SELECT * FROM v ORDER BY quality_weight DESC, id LIMIT 40), s AS (SELECT id, quality_weight * exp(-0.002 * greatest(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(occurred_at), 0) / 86400e6) AS score FROM t) SELECT id, round(score, 9) AS score FROM s ORDER BY score DESC, id LIMIT 10")
def k5_style_patterns(t):
    top = vectors(t).orderBy(F.desc("quality_weight"), "id").limit(40)
    return top.select("id", F.round(V.recency(F.col("quality_weight"), F.col("occurred_at"), AS_OF), 9).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(r"WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 1000) / 800), 0) AS BIGINT) * 800 + 1, 800)) AS s FROM documents WHERE lang = 'en'), c AS (SELECT doc_id, s, " + STRIP.format("substr(text, s + 1, 1000)") + " AS chunk FROM s UNION ALL SELECT doc_id, 0, " + STRIP.format("text") + " FROM documents WHERE lang <> 'en') SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS chunk_no, sha256(chunk) AS chunk FROM c WHERE chunk <> ''")
def c3_routed(t):
    return chunking.routed(t("documents"), "text", "lang", ["doc_id"], ["en"], ["es"]).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.sha2("chunk", 256).alias("chunk"))


#: Sections as in c4, packed by a recursive walk, large ones by one through their paragraphs; words before a chunk from all words of its document.
C5_SQL = C4_SQL + r""", o AS (SELECT *, greatest(1, length(whole) // 4) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS i, title, body, """ + STRIP.format("concat('# ', title, chr(10), chr(10), body)") + r""" AS whole FROM sections)),
g5 AS (SELECT doc_id, i, n AS size, 1 AS pack FROM o WHERE i = 1 UNION ALL SELECT o.doc_id, o.i, CASE WHEN g5.size + o.n > 400 THEN o.n ELSE g5.size + o.n END, g5.pack + CASE WHEN g5.size + o.n > 400 THEN 1 ELSE 0 END FROM g5 JOIN o ON o.doc_id = g5.doc_id AND o.i = g5.i + 1),
a5 AS (SELECT doc_id, pack, string_agg(title, ' | ' ORDER BY i) AS titles, string_agg(whole, chr(10) || chr(10) ORDER BY i) AS text, max(n) AS most, any_value(body) AS body FROM g5 JOIN o USING (doc_id, i) GROUP BY doc_id, pack),
b5 AS (SELECT *, greatest(1, length(block) // 4) + CASE WHEN j = 1 THEN 1 ELSE 0 END AS n FROM (SELECT doc_id, pack, titles, generate_subscripts(x, 1) AS j, concat('## ', titles, chr(10), chr(10), unnest(x)) AS block FROM (SELECT doc_id, pack, titles, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda y: """ + STRIP.format("y") + r"""), lambda y: y <> '') AS x FROM a5 WHERE most > 400))),
h5 AS (SELECT doc_id, pack, j, n AS size, 1 AS sub FROM b5 WHERE j = 1 UNION ALL SELECT b5.doc_id, b5.pack, b5.j, CASE WHEN h5.size + b5.n > 400 THEN b5.n ELSE h5.size + b5.n END, h5.sub + CASE WHEN h5.size + b5.n > 400 THEN 1 ELSE 0 END FROM h5 JOIN b5 ON b5.doc_id = h5.doc_id AND b5.pack = h5.pack AND b5.j = h5.j + 1),
c5 AS (SELECT doc_id, pack, 0 AS sub, titles, text FROM a5 WHERE most <= 400 UNION ALL SELECT doc_id, pack, sub, any_value(titles), string_agg(block, chr(10) || chr(10) ORDER BY j) FROM h5 JOIN b5 USING (doc_id, pack, j) GROUP BY doc_id, pack, sub),
d5 AS (SELECT doc_id, titles, row_number() OVER w AS chunk_no, """ + STRIP.format("text") + r""" AS text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS words FROM c5 WINDOW w AS (PARTITION BY doc_id ORDER BY pack, sub)),
e5 AS (SELECT *, coalesce(sum(len(words)) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d5), f5 AS (SELECT doc_id, flatten(list(words ORDER BY chunk_no)) AS spoken FROM d5 GROUP BY doc_id)
SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, titles, CASE WHEN before > 0 THEN array_to_string(spoken[CAST(greatest(before - 80, 0) AS BIGINT) + 1:CAST(before AS BIGINT)], ' ') || chr(10) || chr(10) || text ELSE text END AS chunk FROM e5 JOIN f5 USING (doc_id)"""


@query(C5_SQL)
def c5_section_packs(t):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# "), x)).otherwise(x))
    s = chunking.sections(t("documents").select("doc_id", F.array_join(lines, "\n").alias("text")), "text", "doc_id")
    return chunking.section_packs(s, "doc_id", "section", "level", "title", "body", 400)


@query("WITH RECURSIVE l AS (SELECT *, concat('[', role, ' | ', conv_id, ']', chr(10), coalesce(text, '')) AS line FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) AS i, length(line) + 2 AS n FROM l), g AS (SELECT conv_id, i, n AS size, 1 AS pack_no FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.i, CASE WHEN g.size + o.n > 500 THEN o.n ELSE g.size + o.n END, g.pack_no + CASE WHEN g.size + o.n > 500 THEN 1 ELSE 0 END FROM g JOIN o ON o.conv_id = g.conv_id AND o.i = g.i + 1) SELECT conv_id, CAST(pack_no AS BIGINT) AS pack_no, count(*) AS n_messages, string_agg(line, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS pack FROM g JOIN o USING (conv_id, i) GROUP BY conv_id, pack_no")
def c8_message_packs(t):
    head = F.concat(F.lit("["), "role", F.lit(" | "), "conv_id", F.lit("]"))
    m = t("conversations").withColumn("line", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))))
    return memory.message_packs(m, "conv_id", ["turn", "line"], head, "text", 500)


CAPTION_SQL = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[​‌‍﻿]', '', 'g'), '\s+', ' ', 'g'), '^[ -]+|[ -]+$', '', 'g')".replace('\\"', '"')


def _caption_files(t) -> DataFrame:
    words = F.regexp_replace("text", r"\s+", " ")
    cue = F.concat(F.format_string("00:%02d:%02d.500 --> 00:%02d:%02d.000\n", F.floor(F.col("turn") / 60), F.col("turn") % 60, F.floor((F.col("turn") + 1) / 60), (F.col("turn") + 1) % 60), F.lit("<c>"), words, F.lit("</c>"))
    return t("conversations").where("text is not null").select("conv_id", "turn", F.concat(F.lit("WEBVTT\n\n"), cue).alias("vtt"), F.to_json(F.struct(F.array(F.struct((F.col("turn") * 1000).alias("tStartMs"), F.array(F.struct(words.alias("utf8"))).alias("segs"))).alias("events"))).alias("json"))


@query("WITH s AS (SELECT conv_id, turn, " + CAPTION_SQL.format("text") + " AS text FROM conversations) SELECT conv_id, turn, 'vtt' AS form, CAST(turn + 0.5 AS DOUBLE) AS start, CAST(turn + 1 AS DOUBLE) AS \"end\", text FROM s WHERE text <> '' UNION ALL SELECT conv_id, turn, 'json', CAST(turn AS DOUBLE), CAST(turn AS DOUBLE), text FROM s WHERE text <> ''")
def c10_c11_captions(t):
    files, keep = _caption_files(t), ["conv_id", "turn"]
    both = captions.vtt(files, "vtt", keep).withColumn("form", F.lit("vtt")).unionByName(captions.json3(files, "json", keep).withColumn("form", F.lit("json")))
    return both.select(*keep, "form", "start", "end", "text")


#: A recursive walk through each track: the last segment kept, what it says, and what the step gave out.
W8_SQL = "WITH RECURSIVE s AS (SELECT conv_id, turn, CAST(turn + 0.5 AS DOUBLE) AS start, CAST(turn + 1 AS DOUBLE) AS stop, " + CAPTION_SQL.format("text") + r""" AS text FROM conversations), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start, turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM s WHERE text <> ''),
g AS (SELECT conv_id, i, n, turn, start, stop, text, lower(text) AS said, CAST(NULL AS STRUCT(turn BIGINT, start DOUBLE, stop DOUBLE, text VARCHAR)) AS done FROM o WHERE i = 1
 UNION ALL SELECT conv_id, i, n, CASE WHEN way = 'same' THEN turn ELSE new_turn END, CASE WHEN way = 'next' THEN new_start ELSE start END, CASE WHEN way = 'same' THEN stop ELSE new_stop END, CASE WHEN way = 'same' THEN text ELSE rest END, CASE WHEN way = 'same' THEN said ELSE lower(rest) END, CASE WHEN way = 'next' THEN {'turn': turn, 'start': start, 'stop': stop, 'text': text} END
 FROM (SELECT *, CASE WHEN contains(said, lower(full_text)) THEN 'same' WHEN contains(lower(full_text), said) AND new_start - start <= 5 THEN 'grown' WHEN rest = '' OR lower(rest) = said THEN 'same' ELSE 'next' END AS way
  FROM (SELECT *, CASE WHEN contains(lower(full_text), said) AND new_start - start <= 5 THEN full_text ELSE array_to_string(string_split(full_text, ' ')[shared + 1:], ' ') END AS rest
   FROM (SELECT g.conv_id, o.i, g.n, g.turn, g.start, g.stop, g.text, g.said, o.turn AS new_turn, o.start AS new_start, o.stop AS new_stop, o.text AS full_text,
     coalesce(list_max(list_filter(range(3, least(len(string_split(g.said, ' ')), len(string_split(o.text, ' '))) + 1), lambda k: string_split(g.said, ' ')[-k:] = string_split(lower(o.text), ' ')[1:k])), 0) AS shared FROM g JOIN o ON o.conv_id = g.conv_id AND o.i = g.i + 1))))
SELECT conv_id, done.turn AS turn, done.start AS start, done.stop AS "end", done.text AS text FROM g WHERE done IS NOT NULL UNION ALL SELECT conv_id, turn, start, stop, text FROM g WHERE i = n"""


@query(W8_SQL)
def w8_rolling_captions(t):
    """Each conversation as a track, each turn as a segment of it."""
    segments = captions.vtt(_caption_files(t), "vtt", ["conv_id", "turn"]).withColumn("cue", F.col("turn"))
    return captions.without_rolling_repeats(segments, "conv_id").select("conv_id", "turn", "start", "end", "text")


@query(f"WITH {C_SQL} SELECT conv_id, turn, sha256(concat(kind, ':', {norm('text')})) AS fingerprint, CASE kind WHEN 'chats' THEN 0.45::DOUBLE ELSE 1.0::DOUBLE END AS quality_weight, kind = 'chats' AS style_only FROM c")
def l2_voice_rows(t):
    return memory.voice_rows(chat(t)).select("conv_id", "turn", "fingerprint", "quality_weight", "style_only")


@query(f"WITH b AS (SELECT doc_id AS id, 'beliefs' AS kind, text AS content, greatest(0.0, least(1.0, (doc_id % 130) / 100)) AS confidence FROM documents UNION ALL SELECT doc_id, 'decisions', source, 0.0 FROM documents), f AS (SELECT *, sha256(concat(kind, ':', {norm('content')})) AS fingerprint, row_number() OVER (PARTITION BY kind, {norm('content')} ORDER BY id) AS r FROM b WHERE {STRIP.format('content')} <> '') SELECT id, kind, round(confidence, 6) AS confidence, fingerprint FROM f WHERE r = 1")
def l3_u2_candidates(t):
    entry = lambda c, n: F.array(F.struct(c.alias("content"), c.alias("quote"), n.alias("confidence")))
    d = t("documents").select(F.col("doc_id").alias("id"), entry(F.col("text"), ((F.col("doc_id") % 130) / 100).cast("string")).alias("beliefs"), entry(F.col("source"), F.lit("unclear")).alias("decisions"))
    return memory.candidates(d, ["beliefs", "decisions"]).select("id", "kind", F.round("confidence", 6).alias("confidence"), "fingerprint")


@query(f"WITH d AS (SELECT *, CASE WHEN {norm('substr(text, 5)')} <> '' AND contains({norm('text')}, {norm('substr(text, 5)')}) AND doc_id % 100 >= 75 AND (lang <> 'en' OR length(source) >= 40 OR length(substr(text, 5)) >= 30) THEN 'queue' ELSE 'pending_confirm' END AS decision, CASE WHEN {norm('substr(text, 5)')} <> '' AND contains({norm('text')}, {norm('substr(text, 5)')}) AND (lang = 'es' OR lang = 'fr' AND doc_id % 100 >= 75) THEN 'queue' ELSE 'pending_confirm' END AS style, {norm('text')} AS n FROM documents), k AS (SELECT DISTINCT n FROM d WHERE doc_id % 3 = 0), r AS (SELECT lang AS kind, CASE WHEN n IN (SELECT n FROM k) THEN 'skipped' WHEN decision = 'queue' THEN 'inserted' ELSE 'pending_confirm' END AS outcome FROM d UNION ALL SELECT 'style', CASE WHEN n IN (SELECT n FROM k) THEN 'skipped' WHEN style = 'queue' THEN 'inserted' ELSE 'pending_confirm' END FROM d) SELECT kind, outcome, count(*) AS n FROM r GROUP BY ALL")
def l4_f10_gate_report(t):
    sure, quote = (F.col("doc_id") % 100) / 100, F.expr("substring(text, 5)")
    d = t("documents").withColumn("fingerprint", T.fingerprint(F.col("text")))
    facts = d.select("doc_id", "fingerprint", F.col("lang").alias("kind"), memory.gate(sure, F.col("text"), quote, F.col("source"), F.when(F.col("lang") == "en", "channel").otherwise("note")).alias("decision"))
    kind = F.when(F.col("lang") == "es", "tone_markers").when(F.col("lang") == "fr", "stop_words").otherwise("syntax")
    style = d.select("doc_id", "fingerprint", F.lit("style").alias("kind"), memory.style_gate(sure, F.col("text"), quote, kind).alias("decision"))
    return memory.gate_report(facts.unionByName(style), d.where("doc_id % 3 = 0"))


#: The plan in SQL: a recursive walk through each book's chunks in order, ``carried`` being the short ones that wait for a longer one.
PLAN_SQL = K_SQL + f""", f AS (SELECT id, content, source_book, chapter, row_number() OVER (PARTITION BY {norm('content')} ORDER BY id) AS nth FROM (SELECT *, CASE WHEN category = 'en' THEN 'one' ELSE 'two' END AS chapter FROM k)),
o AS (SELECT *, row_number() OVER (PARTITION BY source_book, chapter ORDER BY id) AS i, count(*) OVER (PARTITION BY source_book, chapter) AS n FROM f WHERE nth = 1),
w AS (SELECT id, source_book, chapter, i, n, content AS own, content AS t FROM o WHERE i = 1 UNION ALL SELECT o.id, o.source_book, o.chapter, o.i, o.n, o.content, CASE WHEN length(trim(regexp_replace(w.t, '\\s+', ' ', 'g'))) < 100 THEN w.t || chr(10) || chr(10) || o.content ELSE o.content END FROM w JOIN o ON o.source_book = w.source_book AND o.chapter = w.chapter AND o.i = w.i + 1),
s AS (SELECT *, length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) < 100 AS short FROM w), z AS (SELECT *, max(CASE WHEN NOT short THEN i END) OVER (PARTITION BY source_book, chapter) AS lastlong, max(CASE WHEN i = n AND short THEN t END) OVER (PARTITION BY source_book, chapter) AS tail FROM s),
m AS (SELECT id, own, CASE WHEN NOT short AND i = lastlong AND tail IS NOT NULL THEN t || chr(10) || chr(10) || tail WHEN NOT short OR (lastlong IS NULL AND i = n) THEN t END AS merged FROM z)"""


def _chapters(t) -> DataFrame:
    return knowledge(t).withColumn("chapter_title", F.when(F.col("category") == "en", "one").otherwise("two")).withColumn("chunk_index", F.col("id"))


@query(f"WITH RECURSIVE {PLAN_SQL} SELECT id, CASE WHEN merged IS NULL THEN 'delete' WHEN merged <> own THEN 'update' ELSE 'keep' END AS action, sha256(coalesce(merged, '')) AS digest FROM m WHERE length(coalesce(merged, '')) <= 5000 UNION ALL SELECT id, 'delete', sha256('') FROM f WHERE nth > 1")
def l13_cleanup_plan(t):
    """Chunks that are not split; the others are in l13_c6_split_rows."""
    return memory.cleanup_plan(_chapters(t)).where("size(split) = 0").select("id", "action", F.sha2("content", 256).alias("digest"))


#: Splits in SQL: paragraphs of the long chunks walked in order; ``open`` is the chunk being filled, ``done`` what the step closed.
SPLIT_SQL = r""", p AS (SELECT id, generate_subscripts(x, 1) AS i, unnest(x) AS x, len(x) AS n FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(merged, '\n\s*\n'), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '') AS x FROM m WHERE length(merged) > 5000)),
c AS (SELECT id, 0 AS i, CAST(NULL AS VARCHAR) AS open, CAST([] AS VARCHAR[]) AS done FROM p WHERE i = 1
 UNION ALL SELECT c.id, p.i, CASE WHEN length(p.x) > 2500 THEN NULL WHEN c.open IS NOT NULL AND length(c.open) + 2 + length(p.x) <= 2500 THEN c.open || chr(10) || chr(10) || p.x ELSE p.x END,
  CASE WHEN length(p.x) > 2500 THEN list_concat(CASE WHEN c.open IS NULL THEN [] ELSE [c.open] END, list_transform(range(0, length(p.x), 2500), lambda s: regexp_replace(substr(p.x, s + 1, 2500), '^\s+|\s+$', '', 'g'))) WHEN c.open IS NOT NULL AND length(c.open) + 2 + length(p.x) > 2500 THEN [c.open] ELSE [] END
 FROM c JOIN p ON p.id = c.id AND p.i = c.i + 1),
a AS (SELECT id, i, unnest(done) AS chunk, generate_subscripts(done, 1) AS j FROM c UNION ALL SELECT c.id, c.i + 1, c.open, 1 FROM c JOIN p ON p.id = c.id AND p.i = c.i AND p.i = p.n WHERE c.open IS NOT NULL)"""


@query(f"WITH RECURSIVE {PLAN_SQL}{SPLIT_SQL} SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) AS chunk_no, sha256(chunk) AS digest FROM a WHERE chunk <> ''")
def l13_c6_split_rows(t):
    """Pieces of the chunks that are too long, the first one in place and the others inserted."""
    plan = memory.cleanup_plan(_chapters(t)).where("size(split) > 0")
    pieces = F.concat(F.array("content"), "split")
    return plan.select("id", F.posexplode(pieces).alias("n", "chunk")).select("id", (F.col("n") + 1).cast("long").alias("chunk_no"), F.sha2("chunk", 256).alias("digest"))


@query(f"WITH RECURSIVE {PLAN_SQL}{SPLIT_SQL}, q AS (SELECT id, 0 AS chunk_no, merged AS content FROM m WHERE length(merged) <= 5000 UNION ALL SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j), chunk FROM a WHERE chunk <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY {norm('content')} ORDER BY id, chunk_no) AS nth FROM q) SELECT r.id, CASE source WHEN 'src0' THEN 'main' ELSE source END AS canonical_source, sha256({norm('content')}) AS fingerprint FROM r JOIN documents ON r.id = doc_id WHERE nth = 1")
def l14_applied_plan(t):
    return memory.applied_plan(_chapters(t), memory.cleanup_plan(_chapters(t)), {"src0": "main"}).select("id", "canonical_source", "fingerprint")


@query("""SELECT doc_id, '{"lang":"' || lang || '"}' AS old_value, CASE WHEN doc_id % 11 <> 0 THEN '{"lang":"new"}' END AS new_value FROM documents WHERE doc_id % 5 = 0 OR doc_id % 11 = 0""")
def l15_audit(t):
    d = t("documents").select("doc_id", "lang")
    return memory.audit(d, d.where("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("lang"))), "doc_id")


@query(f"WITH {K_SQL} SELECT id FROM k WHERE verification_status <> 'rejected' OR EXISTS (SELECT 1 FROM k WHERE verification_status = 'pending')")
def l16_purged(t):
    s = F.col("verification_status")
    return memory.purged(knowledge(t), s == "rejected", s == "pending").select("id")


@query("WITH a AS (SELECT source, lang, min(text) AS old FROM documents WHERE doc_id % 3 = 1 GROUP BY ALL) SELECT CASE WHEN old IS NULL THEN 'insert' WHEN NOT (contains(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), lower(regexp_replace(old, '^\\s+|\\s+$', '', 'g'))) OR contains(lower(regexp_replace(old, '^\\s+|\\s+$', '', 'g')), lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')))) THEN 'update' ELSE 'skip' END AS outcome, count(*) AS n FROM documents LEFT JOIN a USING (source, lang) WHERE doc_id % 3 <> 1 GROUP BY outcome")
def l17_seed_outcomes(t):
    d = t("documents").select("doc_id", "source", "lang", F.col("text").alias("value"))
    active = d.where("doc_id % 3 = 1").groupBy("source", "lang").agg(F.min("value").alias("value"))
    return memory.seed_outcomes(d.where("doc_id % 3 <> 1"), active, ["source", "lang"], "value").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, 'langs' AS pattern_type, list(DISTINCT lang ORDER BY lang) AS patterns FROM documents GROUP BY source UNION ALL SELECT source, 'long', list(DISTINCT lang ORDER BY lang) FILTER (length(text) > 15000) FROM documents GROUP BY source HAVING count(*) FILTER (length(text) > 15000) > 0")
def l18_style_rows(t):
    far = F.sort_array(F.collect_set(F.when(F.length("text") > 15000, F.col("lang"))))
    m = t("documents").groupBy("source").agg(F.create_map(F.lit("langs"), F.sort_array(F.collect_set("lang")), F.lit("long"), far).alias("m"))
    return memory.style_rows(m, "m")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS amount, coalesce(max(CASE WHEN event_type = 'error' THEN event_id END), max(event_id)) AS journal_id FROM events GROUP BY user_id")
def l20_l21_current_drafts(t):
    e = t("events").withColumn("at", F.struct("ts", "event_id")).withColumn("set_state", F.struct(F.col("event_type").alias("value"))).withColumn("set_amount", F.when(F.col("event_type") == "purchase", F.struct("value")))
    journal = e.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "error", F.col("event_id"))), F.max("event_id")).alias("journal_id"))
    return memory.current_drafts(e, "user_id", F.col("at"), ["state", "amount"]).drop("updated").join(journal, "user_id")


@query("SELECT doc_id, list_transform(range(8), lambda i: len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 8 = i))) AS counts FROM documents WHERE doc_id % 4 <> 0")
def s15_embedded(t):
    d = t("documents").select(F.col("doc_id").alias("id"), "text")
    known = d.where("id % 4 = 0").select("id", T.fingerprint(F.col("text")).alias("fingerprint"))
    return retrieval.embedded(d, known, "text", n=8).select(F.col("id").alias("doc_id"), F.col("embedding").cast("array<bigint>").alias("counts"))


@query(f"SELECT event_id AS draft_id, sha256(concat('draft:', {norm('event_type')})) AS fingerprint, 0.4::DOUBLE AS quality_weight FROM events WHERE event_type = 'purchase'")
def t3_publish_feedback(t):
    return ingest.feedback_rows(t("events").where("event_type = 'purchase'").select(F.col("event_id").alias("draft_id"), F.col("event_type").alias("final_text"))).drop("text")


# ---- nested fingerprints, audits, merges by bucket, chunks of raw documents


NESTED_SQL = "concat('{\"lang\": ', to_json(lang), ', \"nested\": {\"Tokens\": ', CAST(n_chars / 4 AS DOUBLE), ', \"chars\": [', n_chars, ', ', doc_id, ', null], \"source\": ', to_json(source), '}, \"text\": ', to_json(text), '}')"


@query(f"SELECT doc_id, sha256(concat('payload:', {norm(NESTED_SQL)})) AS fingerprint FROM documents")
def p3_nested_prints(t):
    nested = F.struct(F.col("source"), (F.col("n_chars") / 4).alias("Tokens"), F.array("n_chars", "doc_id", F.lit(None)).alias("chars"))
    payload = F.to_json(F.struct("text", nested.alias("nested"), "lang"), {"ignoreNullFields": "false"})
    return t("documents").select("doc_id", payload.alias("payload")).select("doc_id", T.fingerprint(F.lit("payload"), T.canonical_json(F.col("payload"))).alias("fingerprint"))


def _shown_sql(columns: tuple[str, ...]) -> str:
    return f"substr(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in columns)}), 1, {audit.SHOWN})"


def _rule_sql(rule: audit.Rule) -> str:
    head = f"SELECT '{rule.rule}' AS rule, '{rule.table}' AS table_name, '{type(rule).__name__.lower()}' AS kind, "
    if isinstance(rule, audit.Domain):
        return head + f"count(*) AS violations, NULL::BIGINT AS bad_keys, min({_shown_sql(rule.shown)}) AS sample FROM {rule.table} WHERE {rule.bad}"
    keys = ", ".join(rule.columns)
    held = " AND ".join(f"{c} IS NOT NULL" for c in rule.columns)
    grouped = f"SELECT count(*) AS n, min({_shown_sql(rule.columns)}) AS shown FROM {rule.table} WHERE {held}"
    if isinstance(rule, audit.Unique):
        return head + f"coalesce(CAST(sum(n - 1) AS BIGINT), 0) AS violations, count(*) AS bad_keys, min(shown) AS sample FROM ({grouped} GROUP BY {keys} HAVING count(*) > 1)"
    lacks = " AND ".join(f"p.{b} = {rule.table}.{a}" for a, b in zip(rule.columns, rule.parent_columns))
    return head + f"coalesce(CAST(sum(n) AS BIGINT), 0) AS violations, count(*) AS bad_keys, min(shown) AS sample FROM ({grouped} AND NOT EXISTS (SELECT 1 FROM {rule.parent} AS p WHERE {lacks}) GROUP BY {keys})"


#: Rules of the given tables.
RULES = [
    audit.Domain("chars_match", "documents", "n_chars <> length(text)", ("doc_id",)),
    audit.Domain("known_lang", "documents", "lang NOT IN ('en', 'es', 'fr')", ("lang", "doc_id")),
    audit.Domain("value_range", "events", "value < 1 OR value > 100", ("event_type",)),
    audit.Unique("one_id", "documents", ("doc_id",)),
    audit.Unique("one_text", "documents", ("text",)),
    audit.Unique("one_turn", "conversations", ("conv_id", "turn")),
    audit.Unique("one_type_a_user", "events", ("user_id", "event_type")),
    audit.Foreign("label_of_document", "labels", ("doc_id",), "documents", ("doc_id",)),
    audit.Foreign("document_with_label", "documents", ("doc_id",), "labels", ("doc_id",)),
    audit.Foreign("event_of_customer", "events", ("user_id",), "customer", ("c_custkey",)),
    audit.Foreign("order_of_customer", "orders", ("o_custkey",), "customer", ("c_custkey",)),
]


@query(" UNION ALL ".join(map(_rule_sql, RULES)))
def q4_constraints(t):
    return audit.audited(t, RULES)


@query("SELECT doc_id, lang, 1::BIGINT AS version FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 2 = 1 THEN 'new' ELSE lang END, 2 FROM documents")
def s10_bucket_merge(t):
    d = t("documents").select("doc_id", "lang")
    spark, path = d.sparkSession, scratch.place(d.sparkSession, "bucketed")
    buckets.create(d.where("doc_id % 2 = 0"), path, "doc_id", 16)
    buckets.merge(d.where("doc_id % 5 = 0 or doc_id % 2 = 1").withColumn("lang", F.lit("new")), path, "doc_id", base=1)
    both = [buckets.read(spark, path, v).withColumn("version", F.lit(v).cast("long")) for v in (1, 2)]
    return both[0].unionByName(both[1])


#: Sentences with the buckets of their words; each with its neighbours' as a vector; steps (billionths), bounds, and chunks between the breaks.
#: Bounds are compared in whole numbers: quantile_cont's rounding would decide between distances that are equal.
W9_SQL = r"""WITH x AS (SELECT doc_id, string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM x),
w AS (SELECT *, list_transform(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 16) AS b FROM p),
c AS (SELECT doc_id, i, s, list_concat(list_concat(coalesce(lag(b) OVER o, []), b), coalesce(lead(b) OVER o, [])) AS b FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT doc_id, i, s, list_transform(range(16), lambda k: CAST(len(list_filter(b, lambda y: y = k)) AS DOUBLE)) AS v FROM c),
n AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM v),
d AS (SELECT *, CASE WHEN u IS NOT NULL THEN CAST(floor(coalesce(1 - list_dot_product(v, u) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u)), 0), 0) * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT) END AS distance FROM n),
l AS (SELECT doc_id, list_sort(list(distance) FILTER (distance IS NOT NULL)) AS l, (count(distance) - 1) * 95 AS place FROM d GROUP BY doc_id),
q AS (SELECT doc_id, l[place // 100 + 1] AS low, coalesce(l[place // 100 + 2], l[place // 100 + 1]) AS high, place % 100 AS part FROM l),
g AS (SELECT doc_id, i, s, coalesce(sum(CASE WHEN (distance - low) * 100 > (high - low) * part THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM d JOIN q USING (doc_id)),
k AS (SELECT doc_id, g, count(*) AS sentences, """ + STRIP.format("string_agg(s, ' ' ORDER BY i)") + r""" AS chunk FROM g GROUP BY doc_id, g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS chunk_no, sentences, sha256(chunk) AS chunk FROM k WHERE chunk <> ''"""


@query(W9_SQL)
def w9_document_chunks(t):
    chunks = chunking.document_chunks(t("documents"), "doc_id", "text", lambda s: V.hashed_words(s, 16))
    return chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("sentences").cast("long").alias("sentences"), F.sha2("chunk", 256).alias("chunk"))
