"""Documents of a catalogue by kind: keys, paths, payloads, listings, services and their audiences, validators, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hashed_name
from tessera.functions.text import compose_key, cut_slug, faq_key, service_key, slug, split_trail
from tessera.operators.relational import number_in_parts, number_rows

#: Label of a document, plural and title of each kind, in the order of the kinds.
KINDS = [
    ("servicos", "Serviço", "serviços", "Serviços"),
    ("faqs", "FAQ", "perguntas frequentes", "Perguntas Frequentes"),
    ("legislacao", "Legislação", "perguntas de legislação", "Legislação"),
    ("pareceres", "Parecer", "pareceres", "Pareceres"),
    ("tarf", "Acórdão TARF", "acórdãos", "Acórdãos TARF"),
]


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ruling_key(number: Column, subject: Column, summary: Column) -> Column:
    """Embedding key of a ruling: number, subject and summary on lines of their own; empty ones are left out."""
    return compose_key(F.lit(""), number, subject, summary)


def with_labels(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """rows with label, plural and title of their kind; the kinds are a table of fixed size."""
    names = rows.sparkSession.createDataFrame(KINDS, f"{kind} string, label string, plural string, title string")
    return rows.join(F.broadcast(names), kind, "left")


#: Longest slugs in the names of services and of questions.
SERVICE_SLUG, QUESTION_SLUG = 200, 60


def doc_path(kind: Column, title: Column, link: Column, trail: Column) -> Column:
    """docs/<kind>/<name>.md. Rulings are named by their title's slug, services by slug and hash of the link, questions by slug and hash of link and question; provisions likewise, in a folder that is the first part of their trail."""
    service = hashed_name(cut_slug(slug(title), SERVICE_SLUG), link)
    question = hashed_name(cut_slug(slug(title), QUESTION_SLUG), F.concat(link, F.lit("\n"), title))
    law = F.substring_index(trail, " | ", 1)
    file = F.when(kind.isin("pareceres", "tarf"), slug(title)).when(kind == "servicos", service).when(kind == "legislacao", F.concat(law, F.lit("/"), question)).otherwise(question)
    return F.concat(F.lit("docs/"), kind, F.lit("/"), file, F.lit(".md"))


def embedding_key(kind: Column, trail: Column, title: Column, subject: Column, summary: Column, body: Column) -> Column:
    """What is embedded of a document, by its kind: rulings by number, subject and summary; services by trail, title and the body's start; questions by trail, question and answer, provisions with the provision too."""
    service = service_key(F.concat_ws(" | ", *split_trail(trail)), title, body)
    return F.when(kind.isin("pareceres", "tarf"), ruling_key(title, subject, summary)).when(kind == "servicos", service).when(kind == "legislacao", faq_key(trail, title, body, subject)).otherwise(faq_key(trail, title, body))


def misplaced(rows: DataFrame, derived: str, path: str) -> DataFrame:
    """Rows whose derived path is not the one they were read from."""
    return rows.filter(~F.col(derived).eqNullSafe(F.col(path)))


def payload(*fields: str) -> Column:
    """The JSON that goes beside a vector: the fields named, without body and key."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def decode_payload(payload: Column) -> Column:
    """struct(titulo, ementa, resumo, link); of a payload that is no JSON object of these texts the whole text is the ementa."""
    got = F.from_json(payload, "titulo string, ementa string, resumo string, link string", {"mode": "PERMISSIVE"})
    whole = got.isNotNull() & F.forall(F.array(*[got[c].isNotNull() for c in ("titulo", "ementa", "resumo", "link")]), lambda x: x)
    return F.struct(*[F.when(whole, got[c]).otherwise(payload if c == "ementa" else F.lit("")).alias(c) for c in ("titulo", "ementa", "resumo", "link")])


def context(rows: DataFrame, part: list[str], order: list[str], label: str, block: str) -> DataFrame:
    """One context text a list: blocks under numbered headings, numbers restart in each list. Lists are what a query returns: short."""
    line = F.concat(F.lit("\n## documento "), F.col("n"), F.lit(": "), F.col(label), F.lit("\n"), F.col(block), F.lit("\n"))
    numbered = number_rows(rows, part, [F.col(c) for c in order])
    return numbered.groupBy(*part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "").alias("context"))


def adherence_line(label: Column, n: Column, distance: Column) -> Column:
    """How near a numbered document of a context is; one that no search found says so."""
    near = F.format_string("%s %s · aderência %.3f · distância %.3f\n", label, n.cast("string"), 1 - distance, distance)
    return F.when(distance.isNull(), F.concat(label, F.lit(" "), n, F.lit(" · por co-citação de dispositivos (sem busca vetorial)\n"))).otherwise(near)


def missing_summary(rows: DataFrame, kind: str, name: str, summary: str, named: int = 5) -> DataFrame:
    """A row a kind with rulings that lack a summary: their number and the names of the first few."""
    bad = rows.filter(F.col(kind).isin("pareceres", "tarf") & (_strip(F.coalesce(F.col(summary), F.lit(""))) == ""))
    # a filter on the number right above the window: a task sends no more than `named` rows a kind
    first = number_rows(bad.select(kind, name), [kind], [F.col(name)]).filter(F.col("n") <= named).groupBy(kind)
    names = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", name))), lambda x: x[name].cast("string")), ", ").alias("names"))
    return bad.groupBy(kind).agg(F.count(F.lit(1)).alias("refused")).join(names, kind)


def valid_summary(text: Column, description: str, keywords: str) -> Column:
    """What is wrong with a summary of two sections, '' if nothing: both in order, a description of 1 to 2000 characters, 3 bullets."""
    p1, p2 = F.instr(text, description), F.instr(text, keywords)
    said = _strip(F.substring(text, p1 + len(description), p2 - p1 - len(description)))
    lines = F.filter(F.split(F.substring(text, p2 + len(keywords), F.char_length(text)), "\n"), lambda x: F.regexp_replace(x, r"^\s+", "").startswith("- "))
    return F.when(p1 == 0, "no description").when(p2 == 0, "no keywords").when(p2 <= p1, "order").when(said == "", "empty").when(F.char_length(said) > 2000, "too long").when(F.size(lines) < 3, "few keywords").otherwise("")


def unfenced(text: Column) -> Column:
    """A text without a code fence around it."""
    return _strip(F.regexp_replace(F.regexp_replace(_strip(text), "^```(?:json)?", ""), "```$", ""))


def below_minimum(rows: DataFrame, part: str, least: int) -> DataFrame:
    """Parts with fewer rows than a complete source has."""
    return rows.groupBy(part).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") < least)


def fan_out(services: DataFrame, audiences: DataFrame, service: str) -> DataFrame:
    """A row a service, audience and occurrence, numbered in the order of services in each audience; audiences: (audience, rank), a declared list that is broadcast."""
    rows = services.join(F.broadcast(audiences), "audience")
    return number_in_parts(rows, ["audience"], [F.col(service), F.col("seq")], "id")


def primary_occurrence(services: DataFrame, audiences: DataFrame, service: str) -> DataFrame:
    """Of each service the occurrence in the first audience of the declared order, else its first one."""
    ranked = services.join(F.broadcast(audiences), "audience", "left")
    return ranked.groupBy(service).agg(F.min_by("audience", F.struct(F.coalesce(F.col("rank"), F.lit(2**31 - 1)), "seq")).alias("audience"))


def predominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smallest, null where a key has none."""
    counts = rows.groupBy(key, value).agg(F.count(value).alias("_n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(value))


def keep_dates(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """current (key, hash, updated) with the previous date where the hash has not changed."""
    old = previous.select(key, F.col("hash").alias("_hash"), F.col("updated").alias("_updated"))
    same = F.col("hash") == F.col("_hash")
    return current.join(old, key, "left").withColumn("updated", F.when(same, F.col("_updated")).otherwise(F.col("updated"))).drop("_hash", "_updated")


def token_dictionary(rows: DataFrame, name: str, least: int) -> DataFrame:
    """Tokens of least distinct names or more, and their number."""
    tokens = rows.select(F.col(name), F.explode(F.split(F.lower(F.col(name)), " ")).alias("token"))
    return tokens.groupBy("token").agg(F.count_distinct(name).alias("names")).filter(F.col("names") >= least)


def blocks_between(marks: DataFrame, part: str, at: str, end: str) -> DataFrame:
    """[start, stop) of the block that each mark opens: up to the next mark of the part, the last one up to end."""
    order = Window.partitionBy(part).orderBy(at)
    return marks.select(part, F.col(at).alias("start"), F.coalesce(F.lead(at).over(order), F.col(end)).alias("stop"))


def effective_url(own: Column, above: Column) -> Column:
    """A node's own URL, else that of its nearest ancestor that has one; above: URLs from the root down. An empty URL is none."""
    return F.coalesce(F.nullif(own, F.lit("")), F.try_element_at(F.filter(F.reverse(above), lambda x: x != ""), F.lit(1)))


def letters(text: Column) -> Column:
    """Only the letters of a text, without accents, upper case: what a label is told by however it is written."""
    return F.upper(F.regexp_replace(slug(text), "[^a-z]", ""))


def shouted(text: Column) -> Column:
    """Whether fewer than 15 % of a line's letters are small; false without letters."""
    every = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce(F.try_divide(F.char_length(F.regexp_replace(text, r"[^\p{Ll}]", "")), every) < 0.15, F.lit(False))


def thousands(n: Column) -> Column:
    """1.234.567"""
    return F.translate(F.format_number(n, 0), ",", ".")


def day(text: Column) -> Column:
    """dd/mm/yyyy of an ISO date."""
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(text), "dd/MM/yyyy")


def links(text: Column) -> Column:
    """URLs in a text without the sentence's marks after them; a last bracket goes only where none opens inside."""
    found = F.regexp_extract_all(text, F.lit(r"https?://\S+"), F.lit(0))
    bare = lambda x: F.when(x.endswith(")") & ~F.contains(x, F.lit("(")), F.regexp_replace(x, r"\)$", "")).otherwise(x)
    return F.transform(found, lambda x: F.regexp_replace(bare(x), r"[.,;:!?'\"]+$", ""))


def decode_bytes(data: Column, charset: str) -> Column:
    """The text of bytes in a page's own charset (ISO-8859-1, windows-1252, UTF-8)."""
    return F.decode(data, charset)
