"""String functions over columns: tokens, fingerprints, HTML to text, markers, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft import vocab

TOKEN = "[0-9a-zA-ZÀ-ỹ]+"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def collapsed(text: Column) -> Column:
    """White space, no-break spaces included, made single spaces and trimmed."""
    return F.trim(F.regexp_replace(text, "[\\s\\x{a0}]+", " "))


def html_text(html: Column, cap: int = vocab.CONTENT_CAP) -> Column:
    """Text of an HTML column: scripts and styles out, tags to spaces, entities decoded, white space collapsed, cut at cap; null to empty."""
    out = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "noscript", "iframe"):
        out = F.regexp_replace(out, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", " ")
    out = F.regexp_replace(out, "(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.substring(collapsed(out), 1, cap)


def fingerprint(url: Column, title: Column) -> Column:
    """SHA-256 of trimmed lower-case address and title."""
    return F.sha2(F.concat(F.lower(F.trim(url)), F.lit("::"), F.lower(F.trim(title))), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words_of(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def question_terms(text: Column) -> Column:
    """Tokens of two letters or more that are no stop words, repeats kept."""
    stop = words_of(vocab.STOPWORDS)
    return F.filter(tokens(text), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def sentences(text: Column) -> Column:
    """A text split at white space after the end of a sentence."""
    return F.split(text, "(?<=[.!?…])\\s")


def to_last_sentence(text: Column) -> Column:
    """The text up to its last sentence end; empty where it has none."""
    return F.regexp_extract(text, "(?s)^.*[.!?…]", 0)


def shortened(text: Column, size: int) -> Column:
    """At most size characters, cut at the last space, with an ellipsis where cut."""
    cut = F.regexp_replace(F.substring(text, 1, size), " [^ ]*$", "")
    return F.when(F.length(text) <= size, text).otherwise(F.concat(cut, F.lit("…")))


def markers(answer: Column) -> Column:
    """Citation numbers [n] of an answer, in order, repeats kept; numbers beyond an int cite nothing and are left out."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit("\\[(\\d+)\\]"), F.lit(1)), lambda n: n.try_cast("int"))
    return F.filter(numbers, lambda n: n.isNotNull())


def without_unmapped(answer: Column, mapped: Column) -> Column:
    """An answer without the markers whose number mapped lacks, its spaces set right."""
    written = F.array_distinct(F.regexp_extract_all(answer, F.lit("\\[\\d+\\]"), F.lit(0)))
    missing = F.filter(written, lambda m: ~F.coalesce(F.array_contains(mapped, F.regexp_extract(m, "\\d+", 0).try_cast("int")), F.lit(False)))
    out = F.aggregate(missing, answer, lambda text, m: F.replace(text, m, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, "(?U)\\s+([.,;:!?])", "$1"), "[ \\t]{2,}", " ")
    return F.regexp_replace(out, "(?U)^\\s+|\\s+$", "")


def says_not_found(answer: Column) -> Column:
    return F.lower(answer).rlike("|".join(vocab.NOT_FOUND))


def grounded(answer: Column, n_citations: Column, message: str) -> Column:
    """The answer where it cites or says that nothing was found, else a fixed message."""
    return F.when((n_citations > 0) | says_not_found(answer), answer).otherwise(F.lit(message))


def star_count(text: Column) -> Column:
    """1.2k to 1200; plain digits with separators; null where there are none."""
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), "([0-9]+(?:\\.[0-9]+)?)", 1)
    thousands = F.lower(F.trim(text)).rlike("[0-9]k$")
    return F.when(number == "", F.lit(None).cast("bigint")).otherwise(F.round(number.cast("double") * F.when(thousands, 1000).otherwise(1)).cast("bigint"))


def email(text: Column) -> Column:
    """A trimmed lower-case address; null where it is none."""
    out = F.lower(F.trim(text))
    return F.when(out.rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"), out)


def masked_email(text: Column) -> Column:
    return F.regexp_replace(text, "^(.{0,2})[^@]*(@.*)$", "$1***$2")


def listed(text: Column) -> Column:
    """Parts of a comma-separated text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def escaped(text: Column) -> Column:
    out = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/:?#]+)", 1))


def absolute(base: Column, link: Column) -> Column:
    """A link made absolute by its page's address: whole, protocol-relative, rooted or relative."""
    scheme, root = F.regexp_extract(base, "^([a-zA-Z]+):", 1), F.regexp_extract(base, "^[a-zA-Z]+://[^/?#]+", 0)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^([a-zA-Z]+://[^/]+(?:/.*)?)/[^/]*$", 1)
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.when(folder == "", root).otherwise(folder), F.lit("/"), link))
    )


def verdict(line: Column) -> Column:
    """A judge's line claim|S or P or N|reason as a struct; null fields where the verdict is no such letter."""
    parts = F.transform(F.split(line, "[|｜]"), lambda x: F.trim(x))
    mark = F.upper(F.element_at(parts, 2))
    ok = (F.size(parts) >= 3) & mark.isin("S", "P", "N")
    return F.struct(F.when(ok, F.element_at(parts, 1)).alias("claim"), F.when(ok, mark).alias("mark"), F.when(ok, F.element_at(parts, 3)).alias("reason"))


def is_vietnamese(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(f"[{vocab.VIETNAMESE_LETTERS}]")


def display_title(title: Column, summary: Column) -> Column:
    """The summary for titles without Vietnamese letters, where there is one; else the title."""
    has = summary.isNotNull() & (summary != "")
    return F.when(has & ~is_vietnamese(title), F.trim(summary)).otherwise(F.trim(F.when(F.coalesce(title, F.lit("")) == "", F.lit(vocab.NO_TITLE)).otherwise(title)))


def primary_image(html: Column, meta: Column | None = None) -> Column:
    """Address of a page's main image: given, og:image, twitter:image, or the first picture that is no pixel, logo or data."""
    found = lambda pattern: F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1), F.lit(""))
    picture = found("(?i)<img\\s+[^>]*src=[\"']([^\"']+)[\"']")
    plain = ~F.lower(picture).contains("pixel") & ~F.lower(picture).contains("logo") & ~picture.startswith("data:")
    steps = [found(f"(?i)<meta\\s+{a}=[\"']{b}[\"']\\s+content=[\"']([^\"']+)[\"']") for a, b in (("property", "og:image"), ("name", "twitter:image"))]
    return F.coalesce(*([F.nullif(meta, F.lit(""))] if meta is not None else []), *steps, F.when(plain, picture))


def card_title(body: Column, cap: int = 120) -> Column:
    """The first line of more than 25 characters, else the first line; cut with an ellipsis."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.coalesce(F.get(F.filter(lines, lambda x: F.length(x) > 25), F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))
    return F.when(F.length(line) > cap, F.concat(F.substring(line, 1, cap), F.lit("…"))).otherwise(line)


VOLATILE_LINE = (
    "(?i)^\\s*(?:[0-9,]+\\s+followers|[0-9,]+\\s+(?:comments?|reposts?|impressions?)|[0-9,]+|[0-9]+[smhdwy]\\s*•?.*|feed post number [0-9]+|"
    "follow|like|comment|repost|send|…more|play|pause|mute|unmute|fullscreen)\\s*$"
)


def stable_lines(body: Column) -> Column:
    """A card's text without the lines that change from visit to visit."""
    return F.array_join(F.filter(F.split(body, "\n"), lambda x: ~x.rlike(VOLATILE_LINE) & (F.trim(x) != "")), "\n")


def synthetic_url(index: Column, body: Column) -> Column:
    return F.concat(index, F.lit("#post-"), F.substring(F.sha2(body, 256), 1, 16))


def sse_frame(kind: Column, payload: Column) -> Column:
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), payload, F.lit("\n\n"))
