"""Reader-facing labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of page sources, quality flags and structure hints.
SOURCES = {
    "nativo": "Texto nativo",
    "ocr": "OCR",
    "nativo+ocr": "Texto nativo + OCR de imagens",
    "imagem-ocr": "Imagem + OCR",
    "docx": "DOCX",
    "markdown": "Markdown",
    "sem-texto": "Sem texto",
}
FLAGS = {
    "sem-texto": "sem texto",
    "texto-curto": "texto curto",
    "caracteres-suspeitos": "caracteres suspeitos",
    "poucas-palavras": "poucas palavras",
    "baixa-separacao": "baixa separacao",
    "token-muito-longo": "token muito longo",
    "palavras-coladas": "palavras coladas",
    "quase-so-numeros": "quase so numeros",
    "camada-nativa-incompleta": "camada nativa incompleta",
}
HINTS = {
    "table-like": "tabela provavel",
    "chat-like": "conversa ou print com horario",
    "attachment-mention": "mencao a anexo ou imagem",
    "list-like": "lista ou enumeracao",
}
#: Language codes of OCR engines as BCP 47 tags.
LANGUAGES = {"por": "pt-BR", "pt": "pt-BR", "eng": "en-US", "en": "en-US", "spa": "es-ES", "es": "es-ES", "fra": "fr-FR", "fr": "fr-FR", "deu": "de-DE", "ger": "de-DE", "de": "de-DE", "ita": "it-IT", "it": "it-IT"}
DEFAULT_LANGUAGE = "en-US"


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])


def source_label(source: Column) -> Column:
    """An unknown source is its own label; an empty one is unknown."""
    known = F.try_element_at(_map(SOURCES), source)
    return F.when(F.coalesce(source, F.lit("")) == "", "Desconhecido").otherwise(F.coalesce(known, source))


def _each(values: Column, table: dict[str, str]) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.coalesce(F.try_element_at(_map(table), x), x))


def flag_labels(flags: Column) -> Column:
    return _each(flags, FLAGS)


def hint_labels(hints: Column) -> Column:
    return _each(hints, HINTS)


def language_tag(lang: Column) -> Column:
    """A tag stays, with hyphens; the first of a "+" list of codes is mapped; all else is the default."""
    code = F.lower(F.trim(F.split_part(lang, F.lit("+"), F.lit(1))))
    mapped = F.coalesce(F.try_element_at(_map(LANGUAGES), code), F.lit(DEFAULT_LANGUAGE))
    return F.when(F.coalesce(lang, F.lit("")) == "", DEFAULT_LANGUAGE).when(lang.rlike("[-_]"), F.translate(lang, "_", "-")).otherwise(mapped)
