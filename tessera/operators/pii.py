"""Personal data: detection, masking with placeholders, restoring, reports.

Overlaps are decided here: the longest span wins, then the higher confidence, then the leftmost.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from tessera.functions.text import pieces

DETECTION = ArrayType(StructType([StructField("cls", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType()), StructField("confidence", DoubleType()), StructField("recognizer", StringType())]))
MASKED = StructType([StructField("masked", StringType()), StructField("intact", BooleanType())])
WINDOW = 40  # bytes before a span that may hold a context word
FAILED = "[texto não anonimizado]"


def digits(s: str) -> list[int]:
    return [int(c) for c in s if c.isdigit()]


def weighted(ds: list[int], weights: list[int]) -> int:
    return sum(a * b for a, b in zip(ds, weights)) % 11


def valid_cpf(s: str) -> bool:
    d = digits(s)
    if len(d) != 11 or len(set(d)) == 1:
        return False
    return all((weighted(d[:n], list(range(n + 1, 1, -1))) * 10 % 11) % 10 == d[n] for n in (9, 10))


def cnpj_values(s: str) -> list[int]:
    return [ord(c) - 48 for c in s.upper() if c.isalnum()]


def valid_cnpj(s: str) -> bool:
    v = cnpj_values(s)
    if len(v) != 14 or len(set(v)) == 1:
        return False
    rest = lambda n: (lambda m: 0 if m < 2 else 11 - m)(weighted(v[:n], [*range(n - 7, 1, -1), *range(9, 1, -1)]))
    return rest(12) == v[12] and rest(13) == v[13]


def valid_ie_rs(s: str) -> bool:
    d = digits(s)
    return len(d) == 10 and (11 - weighted(d[:9], [2, 9, 8, 7, 6, 5, 4, 3, 2])) % 11 % 10 == d[9]


def valid_renavam(s: str) -> bool:
    d = digits(s)
    d = [0] * (11 - len(d)) + d
    return len(d) == 11 and (weighted(d[:10], [3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) * 10 % 11) % 10 == d[10]


def luhn(s: str) -> bool:
    d = digits(s)[::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def birthday(s: str) -> bool:
    return 1 <= int(s[:2]) <= 31 and 1 <= int(s[3:5]) <= 12


def person_id(s: str) -> bool:
    return valid_cpf(s) or valid_cnpj(s)


@dataclass(frozen=True)
class Rule:
    cls: str
    name: str
    pattern: re.Pattern
    confidence: float
    context: re.Pattern | None = None
    needs_context: bool = False
    gain: float = 0.0  # with a context word or a right check digit
    must: Callable[[str], bool] | None = None
    not_: Callable[[str], bool] | None = None
    raises: Callable[[str], bool] | None = None
    group: int = 0
    glue: bool = True  # neighbours that make a longer number or word disqualify
    edge: bool = False  # letters and digits of any script next to the span disqualify
    hints: tuple[str, ...] = ()  # a text without any of these has no match


c = lambda p: re.compile(p, re.I)
# Classes, patterns, confidences and context words of the recognizers.
NUCLEUS = r"\p{Lu}\p{L}+(?:\s+(?:d[aeo]s?\s+|e\s+)?\p{Lu}\p{L}+){1,3}"
STREETS = r"Rua Av\.? Avenida Travessa Trav\. Pra[çc]a Rodovia Rod\. Estrada Alameda Al\. Largo"
TOKEN = r"\p{Lu}[\p{L}\d'’.\-]*"
STRONG = "Ltda Ltda. EIRELI Cia Cia. Companhia".split()
STOP = set("Pessoa Física Fisica Jurídica Juridica Contribuinte Substituto Substituição Substituicao Vossa Senhoria Nota Fiscal Fiscais Simples Nacional Regime Especial Inscrição Inscricao Estadual Estaduais Cadastro Tributário Tributária Tributaria ICMS IPVA ITCD Auditor Analista Receita Fazenda Sefaz SEFAZ Secretaria Federal Portal Atendimento Junta Estado Município Municipio Prefeitura Porto Alegre Rio Grande Sul".split())
PHONE, CEP, PROTOCOL, PLATE = (c(r"telefone|celular|fone|whatsapp|zap|contato|ligar|ligue|tel"), c(r"\bcep\b|endere[çc]o|c[óo]digo\s+postal"), c(r"\bprotocolo\b|\bproc\w*\b"), c(r"\bplacas?\b|ve[íi]culo|\bcarro\b|caminh[ãa]o|\bmoto\b"))
RULES = [
    Rule("EMAIL", "email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), 0.95, glue=False, hints=("@",)),
    Rule("CPF", "cpf", re.compile(r"\d{3}\.?\d{3}\.?\d{3}-?\d{2}"), 0.95, must=valid_cpf),
    Rule("CNPJ", "cnpj", re.compile(r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}"), 0.95, must=valid_cnpj),
    Rule("CNPJ", "cnpj-alfanumerico", c(r"[0-9A-Z]{2}\.?[0-9A-Z]{3}\.?[0-9A-Z]{3}/?[0-9A-Z]{4}-?[0-9]{2}"), 0.95, must=lambda s: any(x.isalpha() for x in s) and valid_cnpj(s)),
    Rule("CARTAO", "cartao", re.compile(r"\d(?:[ -]?\d){12,18}"), 0.9, must=luhn),
    Rule("TELEFONE", "telefone", re.compile(r"(?:\+55[\s.\-]?)?\(?\d{2}\)?[\s.\-]?9?\d{4}[\s.\-]\d{4}"), 0.7, PHONE, gain=0.2, not_=valid_cpf),
    Rule("TELEFONE", "telefone-corrido", re.compile(r"\d{2}9\d{8}|\d{10}"), 0.75, PHONE, True, not_=valid_cpf),
    Rule("IE", "ie", re.compile(r"\d{3}[/\s]?\d{7}"), 0.7, c(r"\b(?:i\.?e\.?|inscri[çc][ãa]o\s+estadual|insc\.?\s*est(?:adual|\.)?)(?!\w)"), True, raises=valid_ie_rs, gain=0.2),
    Rule("CEP", "cep", re.compile(r"\d{5}-\d{3}"), 0.75, CEP, gain=0.15),
    Rule("CEP", "cep-corrido", re.compile(r"\d{8}"), 0.7, CEP, True),
    Rule("PROTOCOLO", "protocolo", re.compile(r"\d{4}/\d{6,12}"), 0.75, PROTOCOL, gain=0.15),
    Rule("PROTOCOLO", "protocolo-corrido", re.compile(r"\d{9,15}"), 0.7, PROTOCOL, True, not_=person_id),
    Rule("GA", "ga", re.compile(r"\d{10,17}"), 0.7, c(r"\bga\b|\bgnre\b|\bguia\b"), True, not_=person_id),
    Rule("RENAVAM", "renavam", re.compile(r"\d{9,11}"), 0.7, c(r"\brenavam\b"), True, raises=valid_renavam, gain=0.2),
    Rule("PLACA", "placa", c(r"[a-z]{3}\d[a-z]\d{2}"), 0.8, PLATE, gain=0.15),
    Rule("PLACA", "placa-antiga", c(r"[a-z]{3}-?\d{4}"), 0.75, PLATE, True),
    Rule("DATA_NASCIMENTO", "nascimento", re.compile(r"\d{2}/\d{2}/\d{4}"), 0.9, c("nasc"), True, must=birthday),
    Rule("RAZAO_SOCIAL", "razao-social", regex.compile(r"(\p{Lu}[\p{L}\d&'’.\-]*(?:\s+(?:(?:d[aeo]s?|e|&)\s+)?\p{Lu}[\p{L}\d&'’.\-]*){0,4}\s+(?:Ltda\.?|S\.?/A\.?|S\.?A\.?|SA|EIRELI|EPP|MEI|ME|Cia\.?|Companhia))(?:[^\p{L}\p{N}]|$)"), 0.7, group=1, glue=False, edge=True, must=lambda s: company(s), hints=("Ltda", "SA", "S.A", "S/A", "S./A", "EIRELI", "EPP", "ME", "Cia", "Companhia")),
    Rule("ENDERECO", "endereco", regex.compile(rf"(?:{'|'.join(STREETS.split())})\s+(?:(?:d[aeo]s?|e)\s+)?{TOKEN}(?:\s+(?:(?:d[aeo]s?|e)\s+)?{TOKEN}){{0,4}}(?:\s*,\s*|\s+)(?:n[ºo°]?\.?\s*)?\d{{1,6}}\b"), 0.7, glue=False, edge=True, hints=("Rua", "Av", "Trav", "Pra", "Rod", "Estrada", "Al", "Largo")),
    Rule("NOME", "nome", regex.compile(rf"\b(?:Srta\.?|Sra\.?|Sr\.?|[Cc]ontribuinte|[Rr]equerente|[Pp]rodutora?\s+rural|[Ss][óo]ci[oa]|[Nn]ome|[Tt]itular|[Rr]espons[áa]vel|[Cc]ontadora?)\s*[:,]?\s*(?:(?:d[aeo]s?|e)\s+)?({NUCLEUS})\b"), 0.7, group=1, glue=False, edge=True, must=lambda s: not stopped(s), hints=("Sr", "ontribuinte", "equerente", "rodutor", "óci", "oci", "nome", "Nome", "itular", "espons", "ontador")),
]


def stopped(s: str) -> bool:
    """Whether a token, without marks around it, is an institution's word: such a name is none."""
    return any(regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", t) in STOP for t in s.split())


def company(s: str) -> bool:
    """A strong suffix needs one capitalised token before it, a weak one two with small letters."""
    *before, suffix = s.split()
    capital = [t for t in before if t[0].isupper()]
    return not stopped(s) and (len(capital) >= 1 if suffix in STRONG else sum(any(x.islower() for x in t) for t in capital) >= 2)


def glued(text: str, a: int, b: int) -> bool:
    before, after = text[a - 1 : a], text[b : b + 1]
    if any(x and x.isascii() and x.isalnum() for x in (before, after)):
        return True
    return (before in {"/", ".", "-"} and text[a - 2 : a - 1].isdigit()) or (after in {"/", ".", "-"} and text[b + 1 : b + 2].isdigit())


def detect(text: str) -> list[dict]:
    found, numbers = [], re.search(r"\d", text)
    for r in RULES:
        if (r.glue and not numbers) or (r.hints and not any(h in text for h in r.hints)):
            continue
        for m in r.pattern.finditer(text):
            a, b = m.span(r.group)
            s = text[a:b]
            if r.edge and (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()):
                continue
            if (r.glue and glued(text, a, b)) or (r.must and not r.must(s)) or (r.not_ and r.not_(s)):
                continue
            behind = text[max(0, a - WINDOW) : a].encode("utf-8", "surrogatepass")[-WINDOW:].decode("utf-8", "ignore")
            near = bool(r.context and r.context.search(behind))
            if r.needs_context and not near:
                continue
            more = r.raises(s) if r.raises else near and not r.needs_context
            found.append({"cls": r.cls, "start": a, "end": b, "text": s, "confidence": round(r.confidence + r.gain * more, 2), "recognizer": r.name})
    kept: list[dict] = []
    starts: list[int] = []  # of kept, ascending: only the neighbours of a span can overlap it
    for x in sorted(found, key=lambda x: (x["start"] - x["end"], -x["confidence"], x["start"], x["recognizer"])):
        k = bisect.bisect_left(starts, x["start"])
        if (k == 0 or kept[k - 1]["end"] <= x["start"]) and (k == len(kept) or x["end"] <= starts[k]):
            starts.insert(k, x["start"])
            kept.insert(k, x)
    return kept


def mask(text: str) -> tuple[str, dict[str, str]]:
    """Placeholders [CLASS_n], one a distinct value of a class, numbered as they appear."""
    out, at, names, counts = [], 0, {}, {}
    for x in detect(text):
        key = (x["cls"], x["text"])
        if key not in names:
            counts[x["cls"]] = counts.get(x["cls"], 0) + 1
            names[key] = f"[{x['cls']}_{counts[x['cls']]}]"
        out += [text[at : x["start"]], names[key]]
        at = x["end"]
    return "".join([*out, text[at:]]), {n: v for (_, v), n in names.items()}


def restore(text: str, values: dict[str, str]) -> str:
    return re.sub(r"\[[A-Z_]+_\d+\]", lambda m: values.get(m[0], m[0]), text)


@F.pandas_udf(DETECTION)
def detect_pii(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in pieces(texts):
        yield pd.Series([detect(t) for t in x])


@F.pandas_udf(MASKED)
def mask_pii(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The masked text and whether restoring gives the text again; a failure gives a fixed text, never the original."""
    for x in pieces(texts):
        rows = []
        for t in x:
            try:
                masked, values = mask(t)
                rows.append((masked, restore(masked, values) == t))
            except Exception:  # fail closed
                rows.append((FAILED, False))
        yield pd.DataFrame(rows, columns=["masked", "intact"])


def report(found: DataFrame, doc: str) -> DataFrame:
    """Detections and documents of each class and recognizer, and its confidences. found: doc, cls, recognizer, confidence."""
    return found.groupBy("cls", "recognizer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(doc).alias("docs"), F.round(F.avg("confidence"), 4).alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))


def recall(expected: DataFrame, found: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """covered / expected by keys; an expected span is covered if a detection of its document overlaps it."""
    near = expected.alias("x").join(found.alias("f"), (F.col(f"x.{doc}") == F.col(f"f.{doc}")) & (F.col("x.start") < F.col("f.end")) & (F.col("f.start") < F.col("x.end")), "left_semi")
    rows = expected.withColumn("hit", F.lit(0)).unionByName(near.select("x.*").withColumn("hit", F.lit(1)))
    return rows.groupBy(*keys).agg(F.count_if(F.col("hit") == 0).alias("expected"), F.sum("hit").alias("covered")).withColumn("recall", F.round(F.try_divide("covered", "expected"), 4))
