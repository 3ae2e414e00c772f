"""Column expressions over text. All but ``unescaped`` and ``canonical_json`` are built-in functions, so they stay in the JVM; null in, null out unless said otherwise."""

from __future__ import annotations

import html
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Category keywords in the order in which they are tried.
CATEGORIES = (("finance", "finance|money|invest|econom"), ("islam", "islam|quran|hadith|fiqh"), ("it", "python|software|program|data"), ("psychology", "psycholog|mind|habit"), ("branding", "brand|market|content"))
DEFAULT_CATEGORY = "psychology"
FACTUAL, RELIGIOUS = r"(?iu)\b(what|when|who|how many|fact|statistic)\b", r"(?iu)\b(quran|hadith|islam|prayer)\b"


#: White space as Unicode has it, for functions that take characters one by one: several times faster than a class of them in a pattern.
WHITE = "".join(map(chr, [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def rstrip(c: Column, chars: str = WHITE) -> Column:
    return F.rtrim(c, F.lit(chars))


def squeezed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(c, WHITE, " " * len(WHITE)), " {2,}", " "))


def normalise(c: Column) -> Column:
    """Stripped, lower case, white space (Unicode's) squeezed."""
    return F.lower(squeezed(c))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the normalised parts joined by colons; a null part counts as empty."""
    return F.sha2(F.concat_ws(":", *[normalise(F.coalesce(p, F.lit(""))) for p in parts]), 256)


def json_part(m: Column) -> Column:
    """A map as JSON with its keys in order, for a part of a fingerprint."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


@F.pandas_udf(StringType())
def canonical_json(c: pd.Series) -> pd.Series:
    """JSON of any depth in one form: keys of every object in order, one space after commas and colons, characters outside ASCII as they are, numbers as Python writes them
    (``1.50`` is ``1.5``, ``1e2`` is ``100.0``, whole numbers of any length stay). Of a key that comes twice the last counts. What is not JSON, or nested too deeply to be read, is null.
    """

    def form(x: str) -> str | None:
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True).encode("utf-8", "replace").decode()
        except (ValueError, RecursionError):
            return None

    return c.map(form, na_action="ignore")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def category(c: Column, keywords: tuple[tuple[str, str], ...] = CATEGORIES, default: str = DEFAULT_CATEGORY) -> Column:
    """The first category whose configured pattern is in the text."""
    return F.coalesce(*[F.when(F.lower(c).rlike(pattern), name) for name, pattern in keywords], F.lit(default))


def chapter_title(c: Column, limit: int = 300) -> Column:
    title = F.regexp_extract(c, r"(?m)^[ \t]*#+[ \t]*(.*)$", 1)
    return F.when(title == "", "General").when(F.length(title) > limit, F.concat(F.substring(title, 1, limit - 3), F.lit("..."))).otherwise(title)


def clip(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def last_index(c: Column, mark: str) -> Column:
    """1-based place of the last ``mark``, 0 if there is none."""
    at = F.instr(F.reverse(c), mark[::-1])
    return F.when(at == 0, 0).otherwise(F.length(c) - at - len(mark) + 2)


def enforce_length(c: Column, limit: int) -> Column:
    """The stripped text, cut after the last sentence end in the limit if that keeps 55 % of it, else before the last space, with an ellipsis."""

    def cut(s: Column) -> Column:
        head = F.substring(s, 1, limit)
        end = F.greatest(*[last_index(head, m) for m in (". ", "! ", "? ", "\n")])
        space = last_index(head, " ")
        word = F.concat(rstrip(F.substring(head, F.lit(1), space - 1), " ,;:"), F.lit("…"))
        return F.when(F.length(s) <= limit, s).when(end - 1 >= int(limit * 0.55), rstrip(F.substring(head, F.lit(1), end))).when(space > 1, word).otherwise(rstrip(head))

    return let(strip(c), cut)


def length_class(c: Column, improve: bool = False) -> Column:
    low, high = (300, 800) if improve else (180, 650)
    n = F.length(strip(c))
    return F.when(n < low, "short").when(n < high, "normal").otherwise("expanded")


def message_score(c: Column, channel: Column) -> Column:
    n = F.length(c)
    return (F.least(F.floor(n / 10), F.lit(200)) + F.when(channel, 100).otherwise(0) + F.when(n > 500, 50).otherwise(0)).cast("long")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def clamp(c: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(default))))


#: Fixed pattern: a message that starts so holds a credential.
CREDENTIAL = r"(?iu)^(password|пароль|pass|логин|login|token|api[_-]?key)\s*[:=]"


def is_noise(c: Column) -> Column:
    """Too short, nothing but a URL, or a credential; null counts as empty."""
    s = F.coalesce(strip(c), F.lit(""))
    return (F.length(s) < 15) | s.rlike(r"(?i)^https?://\S+$") | s.rlike(CREDENTIAL)


def is_media_only(text: Column, *media: Column) -> Column:
    """A message without text that has any of the media fields."""
    return (F.coalesce(strip(text), F.lit("")) == "") & reduce(lambda a, b: a | b, [m.isNotNull() for m in media], F.lit(False))


def selected(df, score: Column, least: int):
    """Rows whose score is ``least`` or more, the highest first."""
    return df.withColumn("score", score).where(F.col("score") >= least).orderBy(F.desc("score"))


def urls(c: Column, hosts: list[str]) -> Column:
    """Distinct URLs of the allowed hosts, in order, without trailing punctuation."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"https?://[^\s]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[).,;!?]+$", ""))
    return F.array_distinct(F.filter(found, lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/?#]+)", 1)).isin(*hosts)))


def without_urls(c: Column, hosts: list[str]) -> Column:
    """The text without URLs of the hosts, white space squeezed."""
    host = "|".join(h.replace(".", r"\.") for h in hosts)
    return squeezed(F.regexp_replace(c, rf"(?i)https?://(?:{host})(?=[/?#\s]|$)[^\s]*", ""))


def clean_markdown(c: Column) -> Column:
    """Page spans and back-links out, anchors as plain numbers, third-level headings up one level, broken lines joined, blank lines squeezed; ends with a line end."""
    steps = ((r"(?i)<span[^>]*>\s*</span>", ""), (r"\[Вернуться\]\(#page-\d+-\d+\)", ""), (r"\[\\\[(\d+)\\\]\]\(#page-\d+-\d+\)", "[$1]"), (r"\[(\d+)\]\(#page-\d+-\d+\)", "[$1]"), (r"(?m)^###\s+", "## "))
    out = strip(F.regexp_replace(joined_lines(reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)), r"\n{3,}", "\n\n"))
    return F.when(out != "", F.concat(out, F.lit("\n"))).otherwise(out)


def tagged_section(c: Column, own: str, external: str, marker: str = "<!--source:youtube-->") -> Column:
    """What stands in the first ``own`` section; without one the text less ``external`` sections and the marker, white space squeezed."""
    section = rf"(?is)<{own}>(.*?)</{own}>"
    rest = F.regexp_replace(F.regexp_replace(c, rf"(?is)<{external}>.*?</{external}>", ""), f"(?i){marker}", "")
    return F.when(c.rlike(section), strip(F.regexp_extract(c, section, 1))).otherwise(squeezed(rest))


def grounded(source: Column, quote: Column) -> Column:
    q = normalise(F.coalesce(quote, F.lit("")))
    return (q != "") & F.contains(normalise(F.coalesce(source, F.lit(""))), q)


def differs(new: Column, old: Column) -> Column:
    a, b = F.lower(strip(new)), F.lower(strip(old))
    return ~(F.contains(a, b) | F.contains(b, a))


@F.pandas_udf(StringType())
def unescaped(c: pd.Series) -> pd.Series:
    """Character references of HTML decoded, all two thousand names of them."""
    return c.map(html.unescape, na_action="ignore")


def caption_text(c: Column) -> Column:
    """Character references decoded, then tags and zero-width characters out, white space squeezed."""
    plain = F.regexp_replace(F.regexp_replace(F.when(F.contains(c, F.lit("&")), unescaped(c)).otherwise(c), "<[^>]+>", ""), "[\\u200B\\uFEFF]", "")
    return F.regexp_replace(squeezed(plain), "^[ -]+|[ -]+$", "")


def sentences(c: Column) -> Column:
    """The pieces between runs of white space that follow a full stop, question or exclamation mark; white space elsewhere stays. An empty text is one empty piece."""
    return F.split(c, f"(?<=[.?!])[{WHITE}]+")


def seconds(c: Column) -> Column:
    """``MM:SS`` or ``HH:MM:SS`` (fractions allowed) as seconds."""
    return F.aggregate(F.split(F.replace(c, F.lit(","), F.lit(".")), ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))


def clock(s: Column) -> Column:
    """Seconds as ``MM:SS``, from an hour on as ``HH:MM:SS``."""
    n = F.floor(s).cast("long")
    return F.when(n >= 3600, F.format_string("%02d:%02d:%02d", F.floor(n / 3600), F.floor(n / 60) % 60, n % 60)).otherwise(F.format_string("%02d:%02d", F.floor(n / 60), n % 60))


def timestamp(c: Column) -> Column:
    """Lenient ISO time; without a zone it is the session's; what cannot be read is null."""
    return F.try_to_timestamp(F.regexp_replace(strip(c), "(?i)z$", "+00:00"))


def parsed(c: Column) -> Column:
    """The JSON object in a text, code fence or not, as a variant; null for anything else."""
    v = F.try_parse_json(F.regexp_replace(strip(c), r"(?is)^```(?:json)?\s*|\s*```$", ""))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def style_entries(v: Column, path: str) -> Column:
    """Entries of a list as (value, source_quote, confidence): a bare string has no quote and confidence 0.5; others without a value go."""
    one = lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$.value", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))).alias("value"), F.coalesce(F.try_variant_get(x, "$.source_quote", "string"), F.lit("")).alias("source_quote"), clamp(F.try_variant_get(x, "$.confidence", "string"), 0.5).alias("confidence"))
    return F.filter(F.transform(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), one), lambda x: x["value"].isNotNull())


def rule_text(value: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(strip(value), F.lit("")), F.nullif(strip(fallback), F.lit("")), F.lit(""))


def experience_text(*parts: Column) -> Column:
    """Parts on lines of their own; an empty part keeps its line."""
    return F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), "\n")


def topics(c: Column, factual: str = FACTUAL, religious: str = RELIGIOUS) -> Column:
    """Whether a question asks for facts or speaks of religion, by configured patterns."""
    text = F.coalesce(c, F.lit(""))
    return F.struct(text.rlike(factual).alias("factual"), text.rlike(religious).alias("religious"))


def post_mode(c: Column, allowed: list[str], default: str) -> Column:
    """The mode named in a ``youtube_post_mode`` section, if it is an allowed one; else the default."""
    named = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)<youtube_post_mode>\s*([^<\s]+)\s*</youtube_post_mode>", 1))
    return F.when(named.isin(*allowed), named).otherwise(default)


def stated_url(c: Column) -> Column:
    """The URL of the first line that states one; null without such a line."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?m)^URL:\s*(https?://\S+)", 1), F.lit(""))


def with_source(c: Column, url: Column, keep: bool) -> Column:
    """The text without the URL, which comes last on a line of its own if it is to be kept."""
    bare = strip(F.replace(c, url, F.lit("")))
    return F.when(url.isNull() | (url == ""), c).otherwise(F.concat(bare, F.lit("\n\n"), url) if keep else bare)


def status_map(event: Column, metadata: Column) -> Column:
    """An event's fields and metadata as one map of strings; the error text only for errors."""
    own = F.create_map(F.lit("status"), event["status"], F.lit("at"), event["created_at"].cast("string"), F.lit("error"), F.when(event["status"] == "error", event["summary"]))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.map_concat(own, F.map_filter(F.coalesce(metadata, empty), lambda k, _: ~k.isin("status", "at", "error")))


def is_owned(message: Column, owner: str) -> Column:
    """Messages by the owner, or by the channel itself in a public channel."""
    author = F.coalesce(message["author"], F.lit(""))
    return (message["type"] == "message") & ((author == owner) | ((message["chat_type"] == "public_channel") & author.startswith("channel")))


def is_excluded(name: Column, patterns: list[str]) -> Column:
    both = F.concat(F.lower(name), F.lit(" "), slug(name))
    return F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(both, F.lower(p))) if patterns else F.lit(False)


def joined_lines(c: Column) -> Column:
    """Lines broken inside a paragraph joined again, over one blank line too: a line goes on where the one before ends no sentence and neither is a heading nor the later a list item.

    Whether a line goes on depends on it and the two before only, so the text is put together once.
    """
    lines = F.transform(F.split(F.regexp_replace(c, rf"(?:{LINE_END})\z", ""), LINE_END), strip)

    def goes_on(x: Column, i: Column) -> Column:
        line, before, blank = F.get(x, i), F.get(x, i - 1), F.get(x, i - 1) == ""
        last = F.when(blank, F.get(x, i - 2)).otherwise(before)
        return (i > 0) & (line != "") & (F.coalesce(last, F.lit("")) != "") & ~last.startswith("#") & ~last.rlike(r"[.!?;:»\"')\]]$") & ~line.startswith("#") & ~line.rlike(r"^(\d+\.|[-*+])\s")

    def placed(x: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            joins_next = (line == "") & (i > 0) & F.coalesce(goes_on(x, i + 1), F.lit(False))
            return F.when(joins_next & (F.get(x, i - 1) != ""), "").when(F.coalesce(goes_on(x, i), F.lit(False)), F.concat(F.lit(" "), line)).when(i > 0, F.concat(F.lit("\n"), line)).otherwise(line)

        return F.array_join(F.transform(x, one), "")

    return let(lines, placed)
