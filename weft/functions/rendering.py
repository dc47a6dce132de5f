"""Texts made from columns: embedding texts, context lines, prompts, digests, and what is read back from answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft import vocab
from weft.functions import text


def filled(*parts: Column, sep: str = "\n") -> Column:
    """Trimmed parts that are neither null nor blank, joined."""
    return F.array_join(F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != ""), sep)


def embedding_text(title: Column, signal: Column, so_what: Column, summary: Column, topics: Column) -> Column:
    return filled(title, signal, so_what, summary, F.array_join(F.coalesce(topics, F.array().cast("array<string>")), " · "))


def date_label(published_at: Column, created_at: Column, none: str = "không rõ ngày") -> Column:
    return F.coalesce(F.date_format(F.coalesce(published_at, created_at), "dd/MM/yyyy"), F.lit(none))


def index_line(n: Column, title: Column, signal: Column, date: Column) -> Column:
    """One item of the compact index; ids stay out of it."""
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), title, F.lit(" ("), date, F.lit(")"), F.when(F.coalesce(signal, F.lit("")) != "", F.concat(F.lit("\n    "), signal)).otherwise(""))


def deep_block(n: Column, title: Column, date: Column, fields: list[tuple[str, Column]], body: Column, expired: str = "(nội dung gốc đã hết hạn)") -> Column:
    """An item in full: labelled fields that are filled, then the body or a note that it is gone."""
    lines = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c)).otherwise("") for label, c in fields]
    return filled(F.concat(F.lit("["), n.cast("string"), F.lit("] "), title, F.lit(" ("), date, F.lit(")")), *lines, F.when(F.coalesce(body, F.lit("")) == "", F.lit(expired)).otherwise(body))


def with_titles(content: Column, citations: Column) -> Column:
    """A turn with its markers [n] put as the titles cited; citations array<struct<n, title>>; markers without one are taken out."""
    named = F.aggregate(citations, content, lambda t, c: F.replace(t, F.concat(F.lit("["), c["n"].cast("string"), F.lit("]")), F.concat(F.lit("«"), c["title"], F.lit("»"))))
    return F.trim(F.regexp_replace(named, " *\\[\\d+\\]", ""))


def prompt(question: Column, context: Column, history: Column | None = None, web: Column | None = None, instructions: str = "") -> Column:
    """The sections of a prompt that are filled, in fixed order."""
    section = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), c)).otherwise("")
    none = F.lit("")
    return filled(F.lit(instructions), section("Context", context), section("History", history if history is not None else none), section("Web", web if web is not None else none), section("Question", question), sep="\n\n")


def window(content: Column, size: int) -> Column:
    """The part of a content that a model is shown."""
    return F.substring(F.coalesce(content, F.lit("")), 1, size)


def bullets(parts: list[Column], body: Column, n: int) -> Column:
    """The first n of the filled parts and then the body's sentences of more than ten characters, each once."""
    more = F.filter(F.transform(text.sentences(F.coalesce(body, F.lit(""))), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    given = F.filter(F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts]), lambda x: x != "")
    return F.slice(F.array_distinct(F.concat(given, more)), 1, n)


def mentioned_roles(question: Column, roles: list[str] = vocab.ROLES) -> Column:
    """Roles whose words stand in a question one after another, as whole words."""
    said = F.concat(F.lit(" "), F.array_join(text.tokens(question), " "), F.lit(" "))
    return F.filter(F.array(*map(F.lit, roles)), lambda r: F.contains(said, F.concat(F.lit(" "), F.array_join(text.tokens(r), " "), F.lit(" "))))


def is_sentinel(answer: Column, sentinel: str) -> Column:
    """Whether an answer is the sentinel and nothing else, back-ticks and space aside."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(answer, F.lit(""))), "^`+|`+$", "")) == sentinel


def web_query(answer: Column, name: str = "WEB") -> Column:
    """The query inside [[NAME: query]]; null without one."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(answer, F.lit("")), f"(?s)\\[\\[{name}:(.+?)\\]\\]", 1)), F.lit(""))


def without_web_query(answer: Column, name: str = "WEB") -> Column:
    return F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), f"(?s)\\[\\[{name}:.+?\\]\\]", ""))


def status_line(key: Column, found: Column, read: Column) -> Column:
    """A status text with its real counts; null for keys outside the closed set."""
    known = key.isin(vocab.STATUS_KEYS)
    return F.when(known, F.when(key == "ranking", F.format_string("ranking: %d items", found)).when(key == "reading", F.format_string("reading: %d of %d items", read, found)).otherwise(key))


def digest_text(subject: Column, lines: Column, overflow: Column) -> Column:
    """Plain text of a digest: subject, numbered lines, and how many more there are."""
    numbered = F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return filled(subject, F.array_join(numbered, "\n"), F.when(overflow > 0, F.concat(F.lit("+"), overflow.cast("string"), F.lit(" more"))).otherwise(""), sep="\n\n")


def digest_html(subject: Column, lines: Column) -> Column:
    listed = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<li>"), text.escaped(x), F.lit("</li>"))), "")
    return F.concat(F.lit("<h1>"), text.escaped(subject), F.lit("</h1><ol>"), listed, F.lit("</ol>"))
