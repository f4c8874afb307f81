"""String expressions: white space, normalisation for search, slugs, embedding keys, blocks, HTML to text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schemas import KEY_CAP, SNIPPET_CAP

#: Latin letters with marks, and what they are without them.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"

#: Named character references of page texts; the ampersand comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&ordm;": "º", "&ordf;": "ª", "&sect;": "§", "&ndash;": "–", "&mdash;": "—", "&middot;": "·", "&copy;": "©", "&deg;": "°", "&amp;": "&"}


#: Every Latin, Greek or Cyrillic letter that decomposes into a letter and marks, by that rule, and the marks themselves.
FOLDED = {chr(c): u for c in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)) if (u := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) != chr(c) and len(u) == 1}


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normalise(s: Column) -> Column:
    """Lower case without accents (letters by canonical decomposition, and free marks U+0300 to U+036F), white space collapsed; ß keeps."""
    bare = F.translate(F.coalesce(s, F.lit("")), "".join(FOLDED), "".join(FOLDED.values()))
    return collapse(F.lower(F.regexp_replace(bare, "[\u0300-\u036F]", "")))


def slug(s: Column) -> Column:
    """Document slug: ASCII letters and digits, other runs one hyphen."""
    wide = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), {"æ": "ae", "Æ": "ae", "ß": "ss", "º": "o", "°": "o", "ª": "a"}.items(), s)
    return F.trim(F.regexp_replace(F.lower(F.translate(wide, MARKED, PLAIN)), "[^a-z0-9]+", "-"), F.lit("-"))


def system_slug(s: Column) -> Column:
    """Slug of a system's name: another table than slug(), without å, ý, º, ª, æ or ß."""
    drop = str.maketrans("", "", "åýÅÝ")
    pairs = [(m, p) for m, p in zip(MARKED, PLAIN) if m not in "åýÅÝ"]
    assert len(MARKED.translate(drop)) == len(pairs)
    return F.trim(F.regexp_replace(F.lower(F.translate(F.trim(s), "".join(m for m, _ in pairs), "".join(p for _, p in pairs))), "[^a-z0-9]+", "-"), F.lit("-"))


def cut_slug(s: Column, most: int) -> Column:
    """At most most characters, cut at the last hyphen within them if there is one."""
    head = F.left(s, F.lit(most))
    return F.when(F.char_length(s) <= most, s).otherwise(F.when(F.contains(head, F.lit("-")), F.regexp_replace(head, "-[^-]*$", "")).otherwise(head))


def compose_key(*parts: Column, cap: int = KEY_CAP) -> Column:
    """Non-empty parts on lines of their own, the first cap characters."""
    return F.left(F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n"), F.lit(cap))


def service_key(kind: Column, title: Column, description: Column) -> Column:
    return F.trim(compose_key(kind, title, F.lit(""), F.trim(F.left(description, F.lit(SNIPPET_CAP)))))


def faq_key(origin: Column, question: Column, answer: Column, provision: Column | None = None) -> Column:
    """Origin, provision (legislation only), question and answer, each with white space collapsed."""
    reply = collapse(answer)
    return compose_key(collapse(origin), F.concat(F.lit("P: "), collapse(question)), F.lit("") if provision is None else collapse(provision), F.when(reply == "", "").otherwise(F.concat(F.lit("R: "), reply)))


def block(question: Column, answer: Column, link: Column) -> Column:
    """A context block; parts without text are left out."""
    part = lambda head, x: F.when(x == "", F.lit("")).otherwise(F.concat(F.lit(head), x))
    return F.array_join(F.filter(F.array(part("## pergunta\n", question), part("## resposta\n", answer), part("Link: ", link)), lambda x: x != ""), "\n")


def degraded(body: Column, summary: Column, requires_summary: Column, notice: str) -> Column:
    return F.coalesce(body, F.when(requires_summary & (summary != ""), summary), F.lit(notice))


def split_trail(trail: Column) -> tuple[Column, Column]:
    """The part before the first ' | ' and the rest ('' if there is none)."""
    at = F.instr(trail, " | ")
    return F.when(at > 0, F.left(trail, at - 1)).otherwise(trail), F.when(at > 0, F.substring(trail, at + 3, F.char_length(trail))).otherwise(F.lit(""))


def decode_entities(s: Column) -> Column:
    """Named references, &amp; last."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), s)


def html_to_text(html: Column) -> Column:
    """Styles, scripts and comments go, ends of blocks and <br> become lines, tags become blanks, references are decoded."""
    s = F.regexp_replace(html, r"(?is)<(style|script)[^>]*>.*?</(style|script)>|<!--.*?-->", "")
    s = F.regexp_replace(s, r"(?i)<br[^>]*>|</(p|div|li|tr|h[1-6])>", "\n")
    s = decode_entities(F.regexp_replace(s, r"<[^>]*>", " "))
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def link_text(html: Column) -> Column:
    """Links kept as `text (url)`."""
    return F.regexp_replace(html, r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "$2 ($1)")


def page_title(html: Column) -> Column:
    return collapse(decode_entities(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)))


def safe_name(url: Column) -> Column:
    return F.regexp_replace(url, "[^A-Za-z0-9._-]", "_")


def canonical_url(url: Column, base: str = "") -> Column:
    """Without fragment and final slash, lower-case scheme and host; relative paths under base."""
    whole = F.when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)
    whole = F.regexp_replace(F.regexp_replace(whole, "#.*$", ""), "/+$", "")
    head = F.regexp_extract(whole, r"^[A-Za-z]+://[^/?]*", 0)
    return F.concat(F.lower(head), F.substring(whole, F.char_length(head) + 1, F.char_length(whole)))


def human_size(n: Column) -> Column:
    """1,5 MB."""
    mb, kb = n / F.lit(1_000_000.0), n / F.lit(1_000.0)
    text = F.when(n >= 1_000_000, F.format_string("%.1f MB", mb)).when(n >= 1_000, F.format_string("%.1f kB", kb)).otherwise(F.format_string("%d B", n))
    return F.translate(text, ".", ",")


def pieces(texts: Iterator[pd.Series], most: int = 1 << 19) -> Iterator[list[str]]:
    """The texts of Arrow batches (null: empty), in lists of at most `most` characters or one text, so that what a function makes of a batch is never held whole."""
    for batch in texts:
        held, size = [], 0
        for t in batch:
            t = t or ""
            if held and size + len(t) > most:
                yield held
                held, size = [], 0
            held.append(t)
            size += len(t) + 64
        yield held
