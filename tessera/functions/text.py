"""Text scalars: white space, folding, noise lines, headings, sentences, mark-up, languages, counters.

All are column expressions, but for Unicode normal forms, which Spark has no function for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expr import bind

SPACES = r"(?U)\s+"
WORD = r"(?U)[^\W_]+"

# Function words that tell Portuguese and English apart.
PT_WORDS = "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao das à pela pelo são".split()
EN_WORDS = "the and of to in is for with on that this are from by at".split()

# Patterns of facts that go out of date.
VOLATILE = {
    "price": r"\d+(?:[.,]\d+)?\s?€|€\s?\d",
    "time": r"\b\d{1,2}[h:]\d{2}\b",
    "year_recent": r"\b202[3-9]\b",
    "operational_terms": r"(?iu)\b(?:horário|horários|bilhete|bilheteira|reserva|reservas|inscrições|preço|preços|marcação)\b",
}

# An explicit range of opening hours.
OPENING_HOURS = r"(?i)\b\d{1,2}h\d{0,2}\s*(?:às|a|-|–)\s*\d{1,2}h"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@F.pandas_udf(T.StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """NFKD without combining characters."""
    return text.map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)), na_action="ignore")


def stripped(text: Column) -> Column:
    """Without blanks of any width at either end, as SQL's trim (Spark's own knows the ASCII one alone)."""
    return F.regexp_replace(text, r"\A\p{Zs}+|\p{Zs}+\z", "")



def clean_inline(text: Column, normal: bool = True) -> Column:
    """Composed, soft hyphens gone, all white space runs one space, trimmed."""
    text = nfc(text) if normal else text
    return F.trim(F.regexp_replace(F.translate(text, "­", ""), SPACES, " "))


def clean_lines(text: Column, normal: bool = True) -> Column:
    """Composed, no-break spaces as spaces, soft hyphens gone, blanks squeezed and trimmed line by line."""
    text = nfc(text) if normal else text
    plain = F.translate(F.regexp_replace(text, r"\r\n?|[\x0b\x0c\x1c-\x1e\x85  ]", "\n"), " ­", " ")
    squeezed = F.regexp_replace(plain, r"[\t ]+", " ")
    return F.regexp_replace(F.regexp_replace(squeezed, r" *\n *", "\n"), r"^[ \n]+|[ \n]+$", "")


def fold(text: Column) -> Column:
    """Lower case without accents, punctuation as blanks, squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(without_marks(text)), r"(?U)[^\w\s]", " "), SPACES, " "))


def drop_noise(text: Column, tokens: Iterable[str] = (), lines: Iterable[str] = ()) -> Column:
    """T4: tokens blanked, private-use characters gone, lines that match a pattern gone, blank runs collapsed."""
    for t in tokens:
        text = F.replace(text, F.lit(t), F.lit(" "))
    text = F.regexp_replace(text, r"[\x{e000}-\x{f8ff}]", "")
    patterns = list(lines)
    kept = F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[\t ]+", " ")))
    if patterns:
        kept = F.filter(kept, lambda s: ~s.rlike("|".join(f"(?:{p})" for p in patterns)))
    return collapse_blank_lines(F.array_join(kept, "\n"))


def collapse_blank_lines(text: Column) -> Column:
    """Lines right-trimmed, runs of blank lines one, none at either end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def repair(text: Column, repairs: Mapping[str, str]) -> Column:
    """T5: exact artefacts replaced, in any case."""
    for bad, good in repairs.items():
        text = F.regexp_replace(text, r"(?iu)\Q" + bad + r"\E", good.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def join_wrapped(lines: Column, enclitics: Iterable[str] = ("se",)) -> Column:
    """Wrapped lines as one paragraph.

    A line that ends in a hyphen joins a following lower-case letter: without the hyphen, unless the next word is an
    enclitic pronoun after a vowel, r, m or z, where the hyphen belongs to the word.
    """
    clitic = "|".join(enclitics)

    def step(done: Column, line: Column) -> Column:
        hyphened = done.endswith("-") & line.rlike(r"^\p{Ll}")
        kept = done.rlike(r"(?iu)[aeiouáéíóúâêôãõrmz]-$") & line.rlike(rf"(?U)^(?:{clitic})(?!\w)")
        return F.when(done == "", line).when(hyphened & kept, F.concat(done, line)).when(hyphened, F.concat(F.substring(done, F.lit(1), F.char_length(done) - 1), line)).otherwise(F.concat(done, F.lit(" "), line))

    return F.aggregate(F.filter(lines, lambda s: s != ""), F.lit(""), step)


def paragraphs(text: Column) -> Column:
    """C14: array of paragraphs, each an array of right-trimmed lines; blank lines part them."""
    parts = F.split(text, r"\n(?:[ \t\r\f\v]*\n)+")
    lines = F.transform(parts, lambda p: F.filter(F.transform(F.split(p, "\n"), lambda s: F.regexp_replace(s, r"\s+$", "")), lambda s: s != ""))
    return F.filter(lines, lambda p: F.size(p) > 0)


def upper_share(text: Column) -> Column:
    """Share of upper-case letters among letters; null without letters."""
    return F.try_divide(F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"\p{L}")))


def numbered_heading(line: Column) -> Column:
    """struct<number, title> of a line like "3. TITLE" with 80 % upper-case letters, else null."""
    title = F.regexp_extract(line, r"(?d)^\d{1,2}\.\s+(.+)$", 1)
    number = F.regexp_extract(line, r"(?d)^(\d{1,2})\.\s+.+$", 1)
    return F.when((title != "") & (upper_share(title) >= 0.8), F.struct(number.cast("int").alias("number"), F.trim(title).alias("title")))


def is_heading(line: Column) -> Column:
    """At most 120 characters, 3 letters or more, 90 % of them upper-case, no closing punctuation."""
    short = (F.char_length(line) <= 120) & ~line.rlike(r"[.,;:]\z") & (F.regexp_count(line, F.lit(r"\p{L}")) >= 3)
    return F.coalesce(short & (upper_share(line) >= 0.9), F.lit(False))


def sentences(line: Column) -> Column:
    """Split after closing punctuation and blanks."""
    return F.split(line, r"(?<=[.!?])[ \t]+")


def drop_sentences(text: Column, pattern: str = OPENING_HOURS) -> Column:
    """Sentences that match go; lines left empty go."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(F.array_join(F.filter(sentences(s), lambda x: ~x.rlike(pattern)), " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def main_text(markdown: Column, boilerplate: Column | None = None) -> Column:
    """Blank and boilerplate lines gone, images blanked, links as their text."""
    kept = F.filter(F.split(markdown, "\n"), lambda s: F.trim(s) != "")
    if boilerplate is not None:
        kept = F.filter(kept, lambda s: ~F.array_contains(boilerplate, F.trim(s)))
    text = F.regexp_replace(F.array_join(kept, "\n"), r"!\[[^\]]*\]\([^)]*\)", " ")
    return F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")


def attribute(html: Column, pattern: str) -> Column:
    """The first group of a pattern in any case, null where there is none."""
    return F.nullif(F.regexp_extract(html, f"(?i){pattern}", 1), F.lit(""))


HTML_LANG = r"<html[^>]*\blang=\"([^\"]+)\""
HTML_CANONICAL = r"<link[^>]+rel=\"canonical\"[^>]+href=\"([^\"]+)\""


def stopword_language(text: Column) -> Column:
    """Pt with five or more Portuguese function words and more than twice the English ones, en likewise, else null."""

    def decide(words: Column) -> Column:
        count = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
        return bind(F.struct(count(PT_WORDS).alias("pt"), count(EN_WORDS).alias("en")), lambda n: F.when((n["pt"] > 2 * n["en"]) & (n["pt"] >= 5), "pt").when((n["en"] > 2 * n["pt"]) & (n["en"] >= 5), "en"))

    return bind(F.regexp_extract_all(F.lower(text), F.lit("[a-záàâãéêíóôõúç]+"), F.lit(0)), decide)


def volatility(text: Column) -> Column:
    """Map of counts."""
    pairs = [x for k, p in VOLATILE.items() for x in (F.lit(k), F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)))]
    return F.create_map(*pairs)


def redact(text: Column, pattern: str = r"sk-[A-Za-z0-9_-]{8,}", mark: str = "[REDACTED]") -> Column:
    """Secrets replaced by a mark."""
    return F.regexp_replace(text, pattern, mark)


def block(prompt: Column, title: str, unused: str = "(não utilizado)") -> Column:
    """What stands under "[title]" up to the next bracketed title or the end; null if it is marked unused or missing."""
    found = F.regexp_extract(prompt, r"(?s)(?:^|\n)\[\Q" + title + r"\E\]\n(.*?)(?=\n\n\[[A-Z][A-Z ]*\]\n|\z)", 1)
    return F.nullif(F.nullif(F.trim(found), F.lit(unused)), F.lit(""))


def chunk_body(text: Column, context: Column) -> Column:
    """The text after its heading context and a blank line."""
    return F.substring(text, F.char_length(context) + 3, F.char_length(text))


def heading_context(title: Column, path: Column) -> Column:
    """The title and the headings of a path array<struct<level, text>> as Markdown lines."""
    lines = F.transform(path, lambda h: F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"]))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.array_join(lines, "\n")) if path is None else F.when(F.size(path) > 0, F.concat(F.lit("# "), title, F.lit("\n"), F.array_join(lines, "\n"))).otherwise(F.concat(F.lit("# "), title))


def section_label(path: Column, missing: str = "(sem secção)") -> Column:
    """The headings of array<string>, joined; a fixed label without any."""
    return F.when(F.coalesce(F.size(path), F.lit(0)) > 0, F.array_join(path, " > ")).otherwise(F.lit(missing))


def location(source_type: Column, pages: Column, canonical_url: Column, url: Column) -> Column:
    """The pages of a PDF, the address of a page."""
    listed = F.array_join(F.transform(F.coalesce(pages, F.array().cast("array<int>")), lambda p: p.cast("string")), ", ")
    return F.when(source_type == "pdf", F.concat(F.lit("p. "), listed)).otherwise(F.coalesce(F.nullif(canonical_url, F.lit("")), url, F.lit("")))


def removed_percent(extracted: Column, processed: Column) -> Column:
    """Share of characters that processing removed, at least 0, two decimals; 0 of nothing."""
    return F.when(extracted == 0, F.lit(0.0)).otherwise(F.bround(F.greatest(F.lit(0.0), (extracted - processed) * 100.0 / extracted), 2))
