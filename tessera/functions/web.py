"""Addresses: canonical form, predicates, first-match rule tables, file-name rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.expr import alternation

# Parameters that track visits, and addresses that aren't fetched.
TRACKING = r"(?i)^(?:utm_\w+|fbclid|gclid|mc_cid|mc_eid|_ga)$"
NO_FETCH = (
    r"/wp-(admin|json|login|content|includes)",
    r"/feed/?$",
    r"[?&](s|p|replytocom)=",
    r"/(account|profile|register|registration|password-reset|lost-password|sem-acesso)/?$",
    r"/agentes-e-profissionais/(entrar|registo)/?$",
    r"/(estrela|preco|tipos-de-alojamento|tipo-de-restaurante|ova_framework_hf_el)/",
    r"/(alojamentos|restaurantes)/[^/]+/?$",
    r"\.(pdf|jpe?g|png|gif|webp|svg|zip|docx?|xlsx?|mp4)$",
)
LANGUAGE_TOKEN = r"(?i)[_.-](esp?|fr|uk|en|de|it|pt)(?=[_.-])"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _decoded(text: Column) -> Column:
    """Form decoding; a % that begins no code stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(text: Column) -> Column:
    """Form encoding in which letters, digits and _ . - ~ stand for themselves."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Https, lower-case host without www., a closing slash unless the path has an extension, no fragment, no
    tracking parameters and no parameters without a value; the others are decoded and encoded anew."""
    url = F.trim(url)
    way = path(url)
    way = F.when(way == "", F.lit("/")).otherwise(way)
    way = F.when(way.rlike(r"(?i)\.[a-z0-9]{2,4}$") | way.endswith("/"), way).otherwise(F.concat(way, F.lit("/")))
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p.rlike(r"^[^=]*=.+$"))
    read = F.transform(pairs, lambda p: F.struct(_decoded(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(p, r"^[^=]*=(.+)$", 1)).alias("v")))
    kept = F.filter(read, lambda p: ~p["k"].rlike(TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(F.lit("https://"), host(url), way, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def is_internal(url: Column, site: str) -> Column:
    """T17"""
    return host(url) == site


def is_no_fetch(url: Column, patterns: Sequence[str] = NO_FETCH) -> Column:
    """T17"""
    return url.rlike(alternation(patterns))


@dataclass(frozen=True)
class Rule:
    pattern: str
    page_type: str
    category: str | None
    status: str
    reason: str


UNKNOWN = Rule("", "unknown", None, "review", "no rule matched")


def classify(url: Column, rules: Sequence[Rule]) -> Column:
    """struct<page_type, category, status, reason> of the first rule that matches the path."""

    def told(r: Rule) -> Column:
        return F.struct(F.lit(r.page_type).alias("page_type"), F.lit(r.category).cast("string").alias("category"), F.lit(r.status).alias("status"), F.lit(r.reason).alias("reason"))

    out = told(UNKNOWN)
    for r in reversed(rules):
        out = F.when(path(url).rlike(r.pattern), told(r)).otherwise(out)
    return out


def file_name(url: Column) -> Column:
    return F.regexp_extract(path(url), r"([^/]*)$", 1)


def classify_file(url: Column, known_id: Column) -> Column:
    """struct<status, reason> of a document's file name; known_id: the document that has this name, or null."""
    tokens = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(file_name(url), F.lit(LANGUAGE_TOKEN), F.lit(1)), lambda s: F.lower(s))))
    told = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    return (
        F.when(known_id.isNotNull(), told("already_in_corpus", F.concat(F.lit("same file name as "), known_id)))
        .when((F.size(tokens) > 0) & ~F.array_contains(tokens, "pt"), told("irrelevant", F.concat(F.lit("language of the edition: "), F.array_join(tokens, ", "))))
        .when(F.array_contains(tokens, "pt"), told("new_candidate", "Portuguese edition that the corpus lacks"))
        .otherwise(told("unknown", "no language token"))
    )
