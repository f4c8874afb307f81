"""Canonical keys of legal citations and system names, and the sort keys of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.functions.text import collapse, system_slug

# What refers back, and the patterns of components with their tags, in the order of keys.
ANAPHORA = r"(?iu)(?:^|[^\p{L}])(?:referid[oa]|dess[ae]|dest[ae]|seu|sua|mesm[oa]|citad[oa])(?:[^\p{L}]|$)"
ARTICLE_DUMP = r"(?iu)^art\.?\s*\d+\s*[-–—]\s"
ROMAN = "[ivxlcdm]+"
COMPONENTS = [
    ("livro", "l", rf"(?iu)\blivro\s+({ROMAN})\b"),
    ("apendice", "ap", rf"(?iu)\bap[êe]ndice\s+({ROMAN})\b"),
    ("titulo", "t", rf"(?iu)\bt[íi]tulo\s+({ROMAN})\b"),
    ("capitulo", "cap", rf"(?iu)\bcap[íi]tulo\s+({ROMAN})\b"),
    ("secao", "sec", rf"(?iu)\bse[çc][ãa]o\s+(\d+(?:\.\d+)*|{ROMAN})\b"),
    ("artigo", "art", r"(?iu)\bart(?:igo|\.)?\s*(\d+(?:[º°.]*-[a-z])?)"),
    ("paragrafo", "§", r"(?iu)(?:§|par[áa]grafo)\s*(\d+|único|unico)"),
    ("inciso", "inc", rf"(?iu)\binciso\s+({ROMAN})\b"),
    ("alinea", "al", "(?iu)\\bal[íi]nea\\s+[\"“']?([a-z])"),
    ("item", "it", r"(?iu)\b(?:sub)?item\s+(\d+(?:\.\d+)*)"),
]
NUMBER = r"\s+n?[º.°]*\s*(\d+)\s*/\s*(\d+)"
LONG_NUMBER = r"n?[º.°]*\s*([\d.]+)(?:\s*/\s*(\d+)|,?\s*de\s+[\d.]+[./](\d+))"
NUMBERED = [
    ("ec", "EC nº ", r"(?iu)emenda constitucional" + NUMBER),
    ("lc", "LC nº ", r"(?iu)lei complementar" + NUMBER),
    ("convenio", "Convênio ICMS ", r"(?iu)conv[êe]nio\s+icms" + NUMBER),
    ("protocolo", "Protocolo ICMS ", r"(?iu)protocolo\s+icms" + NUMBER),
    ("resolucao-sf", "Resolução do Senado Federal ", r"(?iu)resolu[çc][ãa]o do senado federal" + NUMBER),
    ("portaria", "Portaria nº ", r"(?iu)portaria" + NUMBER),
    ("in-drp", "IN DRP ", r"(?iu)(?:instru[çc][ãa]o normativa|\bin)\s+drp" + NUMBER),
    ("in-re", "IN RE ", r"(?iu)instru[çc][ãa]o normativa\s+re" + NUMBER),
    ("in", "IN ", r"(?iu)instru[çc][ãa]o normativa" + NUMBER),
]
DATED = [("decreto", "Decreto nº ", r"(?iu)decreto\s+(?:estadual\s+|federal\s+)?" + LONG_NUMBER), ("lei", "Lei nº ", r"(?iu)\blei\s+(?:federal|estadual)?\s*" + LONG_NUMBER)]
FAMILIES = {"ricms-rs": "RICMS", "cf": "Constituição/EC", "ec": "Constituição/EC", "convenio": "Convênio/Protocolo", "protocolo": "Convênio/Protocolo", "lei": "Lei/LC", "lc": "Lei/LC", "ctn": "Lei/LC", "decreto": "Decreto", "in": "Instrução Normativa", "in-drp": "Instrução Normativa", "in-re": "Instrução Normativa"}

# Names that are agencies or general channels, and other spellings of systems.
AGENCIES = "receita-estadual sefaz sefaz-rs secretaria-da-fazenda secretaria-estadual-da-fazenda cage tesouro-do-estado tesouro estado-do-rio-grande-do-sul governo-do-estado detran detran-rs junta-comercial jucisrs banrisul auditor-fiscal procergs".split()
CHANNELS = "site internet e-mail email telefone portal sistema aplicativo app atendimento-presencial atendimento-virtual correio correios".split()
ALIASES = {
    "ecac": "e-cac", "portal-e-cac": "e-cac", "portal-ecac": "e-cac", "portal-pessoa-fisica-da-receita-estadual": "portal-pessoa-fisica",
    "dt-e": "dte", "domicilio-tributario-eletronico": "dte", "nfe": "nf-e", "nota-fiscal-eletronica": "nf-e", "portal-da-nf-e": "nf-e",
    "nfce": "nfc-e", "cte": "ct-e", "mdfe": "mdf-e", "nota-fiscal-gaucha": "nfg", "efd-icms-ipi": "efd", "cgc-te": "cgcte",
    "portal-redesim-rs": "redesim", "portal-redesim": "redesim", "rhe-producao": "rhe", "rhe-historico": "rhe", "rhe-servicos": "rhe",
    "sistema-de-agendamento-do-estado": "sistema-de-agendamento",
}


def _got(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def norm_of(text: Column) -> tuple[Column, Column]:
    """Key and name of the first norm that a citation matches, in a fixed order; null if none."""
    low = F.lower(text)
    has = lambda *xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(low, x))
    steps = [(has("ricms", "regulamento do icms"), F.lit("ricms-rs"), F.lit("RICMS/RS")), (has("constituição federal", "constituicao federal"), F.lit("cf"), F.lit("Constituição Federal")), (has("código tributário nacional", "codigo tributario nacional") | text.rlike(r"(?i)\bctn\b"), F.lit("ctn"), F.lit("CTN"))]
    for tag, name, pattern in NUMBERED:
        number = F.concat_ws("/", _got(text, pattern, 1), _got(text, pattern, 2))
        steps.append((text.rlike(pattern), F.concat(F.lit(f"{tag}:"), number), F.concat(F.lit(name), number)))
    for tag, name, pattern in DATED:
        number = F.concat(F.replace(_got(text, pattern, 1), F.lit("."), F.lit("")), F.lit("/"), F.coalesce(_got(text, pattern, 2), _got(text, pattern, 3), F.lit("?")))
        steps.append((text.rlike(pattern), F.concat(F.lit(f"{tag}:"), number), F.concat(F.lit(name), number)))
    key = name = None
    for test, k, n in steps:
        key = F.when(test, k) if key is None else key.when(test, k)
        name = F.when(test, n) if name is None else name.when(test, n)
    return key, name


def canonical_citation(text: Column) -> Column:
    """struct(canon_key, display) of a citation; null for what refers back, dumps an article, is over 120 characters or has no norm."""
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  a lambda's variable is evaluated once, however often it is used

    def norm(t: Column) -> Column:
        key, name = norm_of(t)
        return once(F.struct(t.alias("t"), key.alias("key"), name.alias("name")), lambda n: _cite(n["t"], n["key"], n["name"]))

    return once(collapse(text), norm)


def _cite(t: Column, key: Column, norm: Column) -> Column:
    part = {name: _got(t, pattern) for name, _, pattern in COMPONENTS}
    for name in ("livro", "apendice", "titulo", "capitulo", "secao", "inciso"):
        part[name] = F.upper(part[name])
    part["artigo"] = F.upper(F.regexp_replace(part["artigo"], "[º°.]", ""))
    part["paragrafo"] = F.when(F.lower(part["paragrafo"]) == "único", "unico").otherwise(part["paragrafo"])
    part["alinea"] = F.lower(part["alinea"])
    tagged = F.concat(key, *[F.coalesce(F.concat(F.lit(f":{tag}"), part[name]), F.lit("")) for name, tag, _ in COMPONENTS])
    said = lambda head, x, tail="": F.concat(F.lit(head), x, F.lit(tail))
    shown = [said("inc. ", part["inciso"]), said("al. ", part["alinea"]), F.when(part["paragrafo"] == "unico", "§ único").otherwise(said("§ ", part["paragrafo"], "º")), said("item ", part["item"]), said("art. ", part["artigo"]), said("Livro ", part["livro"]), said("Apêndice ", part["apendice"]), said("Seção ", part["secao"]), said("Capítulo ", part["capitulo"]), said("Título ", part["titulo"])]
    list_ = F.concat_ws(", ", *shown)
    display = F.when(list_ == "", norm).otherwise(F.concat(list_, F.lit(" do "), norm))
    fine = ~(t.rlike(ANAPHORA) | t.rlike(ARTICLE_DUMP) | (F.char_length(t) > 120)) & key.isNotNull()
    return F.when(fine, F.struct(tagged.alias("canon_key"), display.alias("display")))


def canonical_system(text: Column) -> Column:
    """The key of a system's name; null for names over 60 characters, empty ones, agencies and general channels."""
    raw = collapse(text)
    sign = system_slug(_got(raw, r"\(([^()]+)\)\s*$"))
    name = system_slug(raw)
    aliases = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    plain = F.when((name == "") | name.isin(*AGENCIES, *CHANNELS), None).otherwise(F.coalesce(F.try_element_at(aliases, name), name))
    return F.when(F.char_length(raw) > 60, None).otherwise(F.when(sign.isin(*set(ALIASES.values())), sign).otherwise(plain))


def family(key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), F.substring_index(key, ":", 1)), F.lit("Outros"))


def chronological_key(number: Column) -> Column:
    """struct(year, seq) of seq/YYYY, seq/YY or five trailing digits YYNNN; null for anything else."""
    slash = F.contains(number, F.lit("/"))
    digits = F.when(slash, F.regexp_extract(number, r"/(\d+)[^/]*$", 1)).otherwise(F.substring(F.regexp_extract(number, r"(?:^|\D)(\d{5})$", 1), 1, 2))
    seq = F.when(slash, F.regexp_extract(number, r"(\d+)/[^/]*$", 1)).otherwise(F.substring(F.regexp_extract(number, r"(?:^|\D)(\d{5})$", 1), 3, 3))
    year = digits.try_cast("int")
    full = F.when(F.char_length(digits) == 4, year).when(F.char_length(digits) == 2, F.when(year > 30, year + 1900).otherwise(year + 2000))
    return F.when(full.isNotNull() & (seq != ""), F.struct(full.alias("year"), seq.try_cast("int").alias("seq")))


VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman(s: Column) -> Column:
    """A Roman numeral's value: a sign before a larger one counts negative; null if a sign is none."""
    signs = F.transform(F.filter(F.split(F.upper(s), ""), lambda x: x != ""), lambda x: F.try_element_at(F.create_map(*[F.lit(v) for kv in VALUES.items() for v in kv]), x))
    total = F.aggregate(F.reverse(signs), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, v: F.struct((a["sum"] + F.when(v < a["last"], -v).otherwise(v)).alias("sum"), v.alias("last")))
    return total["sum"]


def _number(text: str) -> int | None:
    values, total, last = [VALUES.get(c) for c in text], 0, 0
    if not text or None in values:
        return None
    for v in reversed(values):
        total, last = total + (-v if v < last else v), v
    return total


def _provision(text: str | None) -> dict | None:
    import re

    m = re.match(r"Arts?\.\s*(\d[\d.]*)\s*[º°]?(?:-([A-Z]))?", text or "")
    if not m:
        return None
    key = {"artigo": int(m[1].replace(".", "")), "sufixo": ord(m[2]) - 64 if m[2] else 0, "paragrafo": 0, "paragrafo_sufixo": 0, "inciso": 0, "alinea": 0, "item": 0}
    parts = [p.strip() for p in re.split("[,;]", text[m.end() :]) if p.strip()]
    if not parts or parts[0] == "caput":
        parts = parts[1:]
    if parts and (p := re.match(r"§\s*(\d+)\s*[º°]?(?:-([A-Z]))?", parts[0]) or re.match(r"par[áa]grafo", parts[0], re.I)):
        key["paragrafo"], key["paragrafo_sufixo"] = (int(p[1]), ord(p[2]) - 64 if p[2] else 0) if p.lastindex else (1, 0)
        parts = parts[1:]
    if parts and (n := _number(parts[0].split(" ")[0])):
        key["inciso"] = n
        if len(parts) > 1 and (a := re.match(r"[\"“'‘]?([a-z])(?:[\"”'’])?(?:\.(\d+))?$", parts[1])):
            key["alinea"], key["item"] = ord(a[1]) - 96, int(a[2] or 0)
    return key


PROVISION = ["artigo", "sufixo", "paragrafo", "paragrafo_sufixo", "inciso", "alinea", "item"]


@F.pandas_udf(StructType([StructField(x, IntegerType()) for x in PROVISION]))
def provision_key(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The seven numbers a provision is sorted by; all null if it names no article. Absent parts are 0 and sort first."""
    for x in texts:
        yield pd.DataFrame([_provision(t) or dict.fromkeys(PROVISION) for t in x], columns=PROVISION).astype("Int32")
