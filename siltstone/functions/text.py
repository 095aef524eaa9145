"""Text assembly: Markdown choice, metadata, citations, context, prompts and messages."""

from __future__ import annotations

import functools

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_SOURCE, UNTITLED = "Unknown source", "Untitled source"
SNIPPET = 280


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def markdown_choice(fit: Column, raw: Column) -> Column:
    """The cleaned Markdown if it isn't blank, else the raw one if that isn't, else nothing; neither is stripped."""
    return F.when(strip(fit) != "", fit).when(strip(raw) != "", raw).otherwise("")


def content_text(doc_id: Column, content: Column, text: Column, body: Column, page_content: Column, full_text: Column) -> Column:
    """``content``, else the first of the others that is present (an empty one ends the search), else a notice."""
    first = F.coalesce(text, body, page_content, full_text)
    return F.coalesce(F.nullif(content, F.lit("")), F.nullif(first, F.lit("")), F.concat(F.lit("Empty document: "), doc_id))


def _truthy(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def citation(citation_url: Column, source_url: Column, url: Column, title: Column, content: Column) -> Column:
    """(source, title, snippet) of a retrieved chunk."""
    return F.struct(
        F.coalesce(_truthy(citation_url, source_url, url), F.lit(UNKNOWN_SOURCE)).alias("source"),
        F.coalesce(title, F.lit(UNTITLED)).alias("title"),
        F.substring(content, 1, SNIPPET).alias("snippet"),
    )


def context_line(citation_url: Column, source_url: Column, url: Column, content: Column) -> Column:
    """The content after its source; the first source that is present counts, and an empty one is none."""
    source = F.coalesce(citation_url, source_url, url)
    return F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("Source: "), source, F.lit("\n"), content)).otherwise(content)


def display_block(rank: Column, title: Column, source_url: Column, url: Column, content: Column) -> Column:
    return F.concat(
        F.lit("### "), F.coalesce(title, F.concat(F.lit("Document "), rank.cast("string"))), F.lit("\n**Source**: "), F.coalesce(source_url, url, F.lit(UNKNOWN_SOURCE)), F.lit("\n\n"), content, F.lit("\n\n")
    )


def joined_in_order(rank: Column, line: Column, separator: str) -> Column:
    """Aggregate: lines in rank order, joined; nothing for no rows."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), line.alias("l")))), lambda x: x["l"]), separator)


_MARK = re.compile(r"\$(?:\$|([_a-zA-Z][_a-zA-Z0-9]*)|\{([_a-zA-Z][_a-zA-Z0-9]*)\})")


def substitute(template: str, values: dict[str, Column]) -> Column:
    """Put values in a template's ``$name`` and ``${name}`` in one pass, so nothing that a value holds is expanded again.

    ``$$`` is a dollar sign; unknown names and other dollar signs stay as they are.
    """
    out, at = [], 0
    for m in _MARK.finditer(template):
        name = m[1] or m[2]
        if name is not None and name not in values:
            continue
        out += [F.lit(template[at : m.start()]), F.lit("$") if name is None else values[name]]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def fill(template: str, context: Column, question: Column) -> Column:
    """A template with its context and question."""
    return substitute(template, {"context": context, "question": question})


@functools.cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case letters that aren't their own folded form: those with a form of one letter, and of several."""
    letters = (chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    found = {c: c.casefold() for c in letters if c.lower() == c != c.casefold()}
    return {c: f for c, f in found.items() if len(f) == 1}, {c: f for c, f in found.items() if len(f) > 1}


def casefold(x: Column) -> Column:
    """Lower case for comparing, as Unicode folds it: letters whose case forms are several letters, or differ by place, are put together."""
    single, several = _folds()
    low = F.translate(F.lower(x), "".join(single), "".join(single.values()))
    table = F.create_map(*[F.lit(y) for pair in several.items() for y in pair])
    whole = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    return F.when(low.rlike("[" + "".join(several) + "]"), whole).otherwise(low)


def flatten_blocks(blocks: Column) -> Column:
    """Text of a message given as blocks (type, text): the texts that are there, one a line.  A bare string is a block without a type."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")


def history_tail(history: Column, most: int = 10) -> Column:
    return F.slice(history, F.greatest(F.size(history) - (most - 1), F.lit(1)), most)


def messages(system: Column, history: Column, prompt: Column) -> Column:
    """System message (if there is any), the last of the history, then the prompt."""

    def one(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    none = F.array().cast("array<struct<role:string,content:string>>")
    first = F.when(F.coalesce(system, F.lit("")) != "", F.array(one("system", system))).otherwise(none)
    return F.concat(first, F.coalesce(history, none), F.array(one("user", prompt)))


def system_prompt(base: Column, specialist: Column) -> Column:
    return F.when(F.coalesce(specialist, F.lit("")) == "", base).otherwise(strip(F.concat(base, F.lit("\n\n"), specialist)))


def sse_blocks(body: Column) -> Column:
    """Events of a captured event stream as (event, data): blocks without data are dropped, ``message`` is the default event."""
    blocks = F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n\n", -1)

    def block(b: Column) -> Column:
        lines = F.split(b, "\n", -1)

        def of(name: str) -> Column:
            return F.transform(F.filter(lines, lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(F.substring(x, len(name) + 2, 1 << 30), "^ ", ""))

        return F.struct(F.coalesce(F.nullif(F.trim(F.try_element_at(of("event"), F.lit(-1))), F.lit("")), F.lit("message")).alias("event"), F.array_join(of("data"), "\n").alias("data"))

    whole = F.filter(blocks, lambda b: F.exists(F.split(b, "\n", -1), lambda x: x.startswith("data:")))
    return F.transform(whole, block)
