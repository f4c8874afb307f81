"""Schemas of documents, vector records, manifests and logs, and the dimension of kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUMMARY_INFO = "struct<modelo string, prompt_versao int, gerada_em string>"
DOCUMENT = f"kind string, trilha string, titulo string, ementa string, resumo string, corpo string, link string, text_to_embed string, resumo_info {SUMMARY_INFO}"
RECORD = "id string, embedding array<float>, document string, key_hash string"
PAYLOAD = "kind string, trilha string, titulo string, ementa string, resumo string, link string, doc_path string"
SERVICE = "titulo string, descricao string, link string, orgao string, ocorrencias array<struct<publico string, classe string>>"
EXTRACTION = "numero string, link string, prompt_versao int, modelo string, gerada_em string, extracao struct<dispositivos array<struct<texto string>>, ncm array<string>, temas array<string>>"
COLLECTION_ENTRY = "kind string, count long, dim int, file string, bytes long, hash string"

#: The identity of the vectors that a search may be run over.
IDENTITY = {"model_id": "bge-m3-q-int8", "dim": 1024, "strategy": 3}
PACK_FORMAT, SNAPSHOT_VERSION = 2, 3
KEY_CAP, SNIPPET_CAP, BODY_CAP = 6_000, 300, 24_000
MAX_K, DEFAULT_K = 20, 5

# Kind, singular label, plural, requires a summary, incremental, nested folders, results of a search.
KINDS = [
    ("servicos", "serviço", "serviços", False, False, False, 10),
    ("faqs", "FAQ", "FAQs", False, False, False, 20),
    ("legislacao", "dispositivo", "legislação", False, False, True, 10),
    ("pareceres", "parecer", "pareceres", True, True, False, 10),
    ("tarf", "acórdão", "acórdãos", True, True, False, 10),
]


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KINDS, "kind string, label string, plural string, requires_summary boolean, incremental boolean, nested boolean, n_results int")
