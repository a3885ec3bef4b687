"""Rule tables and conversations: first-match responses with reflection, entity tags, and a stateful guide."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import stripped

EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


@dataclass(frozen=True)
class Rule:
    pattern: str
    responses: tuple[str, ...]


def reflect(text: Column, table: Mapping[str, str]) -> Column:
    """Words of the lower-cased text by their counterparts, all at once."""
    words = F.split(F.lower(text), r"(?U)(?<=\W)(?=\w)|(?<=\w)(?=\W)")
    pairs = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(pairs, w), w)), "")


def _pattern(pattern: str, ascii_words: bool) -> str:
    r"""Without regard to case, lines ending at \n alone. ascii_words: \b is where \w, which is ASCII in Java, begins or ends;
    without, Java's own, which counts all letters as word characters (up to Java 18)."""
    if not ascii_words:
        return f"(?iud){pattern}"
    return "(?id)" + re.sub(r"\\.", lambda m: EDGE if m[0] == r"\b" else m[0], pattern)


def respond(text: Column, seed: Column, rules: Sequence[Rule], reflections: Mapping[str, str] | None = None, ascii_words: bool = False) -> Column:
    """struct<rule, response> of the first rule whose pattern matches from the start of the text.

    The response is chosen by a hash of seed; %1 to %9 stand for the pattern's groups, reflected. No rule: null.
    """
    said = stripped(text)
    out = F.lit(None).cast("struct<rule:int,response:string>")
    for n, r in reversed(list(enumerate(rules))):
        anchored = _pattern(rf"\A(?:{r.pattern})", ascii_words)
        groups = re.compile(r.pattern).groups

        def filled(response: str, anchored: str = anchored, groups: int = groups) -> Column:
            parts = []
            for x in re.split(r"(%[1-9])", response):
                if not re.fullmatch("%[1-9]", x) or int(x[1]) > groups:
                    parts.append(F.lit(x))
                    continue
                part = F.regexp_extract(said, anchored, int(x[1]))
                parts.append(reflect(part, reflections) if reflections else part)
            return F.concat(*parts)

        pick = F.element_at(F.array(*[filled(x) for x in r.responses]), (F.pmod(F.xxhash64(seed, F.lit(n)), F.lit(len(r.responses))) + 1).cast("int"))
        clean = F.when(F.char_length(pick) >= 2, F.regexp_replace(F.regexp_replace(pick, r"\?\.\z", "."), r"\?\?\z", "?")).otherwise(pick)
        out = F.when(said.rlike(anchored), F.struct(F.lit(n).cast("int").alias("rule"), clean.alias("response"))).otherwise(out)
    return out


def tags(text: Column, patterns: Sequence[tuple[str, str, str]], ascii_words: bool = False) -> Column:
    """array<struct<name, category>> of the patterns (regex, name, category) that occur, in order, each name once."""
    items = [F.when(text.rlike(_pattern(p, ascii_words)), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"))) for p, n, c in patterns]
    return F.array_distinct(F.array_compact(F.array(*items)))


def category(text: Column, patterns: Sequence[tuple[str, str]], ascii_words: bool = False) -> Column:
    """The category of the first pattern that occurs."""
    out = F.lit(None).cast("string")
    for p, c in reversed(patterns):
        out = F.when(text.rlike(_pattern(p, ascii_words)), c).otherwise(out)
    return out


@dataclass
class Guide:
    """What a guide knows: entities (regex, name, category), category words (regex, category), yes and no, and how to
    answer a resolved text (injected)."""

    entities: Sequence[tuple[str, str, str]]
    categories: Sequence[tuple[str, str]]
    answer: Callable[[str], str | None]
    yes: str = r"\s*(?:sim|claro|ok|yes|quero)\s*[.!?]*\s*"
    no: str = r"\s*(?:não|nao|no)\s*[.!?]*\s*"
    other: str = r"\b(?:outr[oa]s?|mais|another|other)\b"
    vague: str = r"\b(?:ele|ela|isso|esse|essa|lá|it|that|there)\b"
    where: str = r"\b(?:onde|fica|lá|where)\b"
    offer: str = "Queres saber mais sobre"
    fallback: str = "Sobre que categoria queres saber mais?"

    def find(self, text: str) -> list[tuple[str, str]]:
        return list(dict.fromkeys((n, c) for p, n, c in self.entities if re.search(p, text or "", re.IGNORECASE)))

    def sort_of(self, text: str) -> str | None:
        return next((c for p, c in self.categories if re.search(p, text, re.IGNORECASE)), None)


@dataclass
class Memory:
    """The place last talked about, its category, and what a yes would mean (a key of PENDING)."""

    place: str | None = None
    category: str | None = None
    pending: str | None = None


Outcome = tuple[str | None, Memory]


def _whole(pattern: str, text: str) -> bool:
    return re.fullmatch(rf"\s*(?:{pattern})\s*", text, re.IGNORECASE) is not None


def _within(pattern: str, text: str) -> bool:
    return re.search(pattern, text, re.IGNORECASE) is not None


def _another(guide: Guide, memory: Memory) -> Outcome:
    """The other places of the category: one is offered and remembered, several are listed."""
    match list(dict.fromkeys(n for _, n, c in guide.entities if c == memory.category and n != memory.place)):
        case []:
            return guide.fallback, memory
        case [only]:
            return f"{only}. {guide.offer} {only}?", replace(memory, place=only, pending="about")
        case [*most, last]:
            return f"{', '.join(most)} / {last}", memory


def _put(guide: Guide, memory: Memory, action: str) -> Outcome:
    return (guide.answer(f"{action} {memory.place}") if memory.place else guide.fallback), memory


# What a yes does, by what is pending.
PENDING: dict[str, Callable[[Guide, Memory], Outcome]] = {
    "about": lambda guide, memory: _put(guide, memory, "about"),
    "where": lambda guide, memory: _put(guide, memory, "where"),
    "another": lambda guide, memory: _another(guide, memory) if memory.category else (guide.fallback, memory),
}


def _ask(guide: Guide, memory: Memory, question: str) -> Outcome:
    """The rules' answer, and the memory after it: one place in the question, or else in the answer, is remembered; several in
    the answer forget the place; an offer about one place makes a yes mean it."""
    reply = guide.answer(question)
    named, shown = guide.find(question), guide.find(reply or "")
    topic = named if len(named) == 1 else shown
    if len(topic) == 1:
        memory = replace(memory, place=topic[0][0], category=topic[0][1])
    elif topic:
        memory = replace(memory, place=None)
    _, *offered = re.split(re.escape(guide.offer), reply or "", maxsplit=1, flags=re.IGNORECASE)
    match [guide.find(x) for x in offered]:
        case [[(place, category)]]:
            memory = replace(memory, place=place, category=category, pending="about")
    return reply, memory


# What a message can be, the first that holds: (test, what follows). Nothing is pending any more when it follows, but the
# test sees what was.
Test, Move = Callable[[Guide, Memory, str], bool], Callable[[Guide, Memory, str, str | None], Outcome]
INTENTS: dict[str, tuple[Test, Move]] = {
    "confirm": (lambda guide, memory, said: bool(memory.pending) and _whole(guide.yes, said), lambda guide, memory, said, pending: PENDING.get(pending or "", lambda g, m: (g.fallback, m))(guide, memory)),
    "decline": (lambda guide, memory, said: bool(memory.pending) and _whole(guide.no, said), lambda guide, memory, said, pending: (guide.fallback, memory)),
    "another": (
        lambda guide, memory, said: _within(guide.other, said) and bool(guide.sort_of(said) or memory.category),
        lambda guide, memory, said, pending: _another(guide, replace(memory, category=guide.sort_of(said) or memory.category)),
    ),
    "category": (
        lambda guide, memory, said: any(_whole(p, said) for p, _ in guide.categories),
        lambda guide, memory, said, pending: _ask(guide, replace(memory, place=None, category=guide.sort_of(said)), said),
    ),
    "reference": (
        lambda guide, memory, said: bool(memory.place) and _within(guide.vague, said),
        lambda guide, memory, said, pending: _ask(guide, memory, f"{'where' if _within(guide.where, said) else 'about'} {memory.place}"),
    ),
    "plain": (lambda guide, memory, said: True, lambda guide, memory, said, pending: _ask(guide, memory, said)),
}


def intent(guide: Guide, memory: Memory, text: str) -> str:
    return next(name for name, (test, _) in INTENTS.items() if test(guide, memory, text.strip()))


def turn(guide: Guide, memory: Memory, text: str) -> str | None:
    """One reply; memory is brought up to date."""
    move = INTENTS[intent(guide, memory, text)][1]
    reply, after = move(guide, replace(memory, pending=None), text.strip(), memory.pending)
    memory.place, memory.category, memory.pending = after.place, after.category, after.pending
    return reply


def converse(turns: DataFrame, guide: Guide, conv: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """R9 in batch: (conv, turn, reply, place, category, pending) for each turn, in order of turn within a conversation.

    Conversations are read in sorted partitions one turn at a time, so that none is gathered whole.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(order).alias("turn"), F.col(text).alias("text"))
    schema = rows.select("conv_id", "turn", *[F.lit(None).cast("string").alias(c) for c in ("reply", "place", "category", "pending")]).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, memory = object(), Memory()
        for pdf in frames:
            out = []
            for c, t, x in pdf.itertuples(index=False):
                if c != key:
                    key, memory = c, Memory()
                out.append((c, t, turn(guide, memory, x or ""), memory.place, memory.category, memory.pending))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "reply", "place", "category", "pending"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text").mapInPandas(run, schema)


def is_exit(text: Column, word: str = "sair") -> Column:
    """Exactly the exit word."""
    return F.lower(F.trim(text)) == word


def dispatch(messages: DataFrame, route: str, branches: Mapping[str, Callable[[DataFrame], DataFrame]], error: str = "error") -> DataFrame:
    """Each branch answers the rows that are routed to it; the answers are united, with a null `error`. Rows with a null route or
    one that has no branch come with all their columns and say so in `error`; none is lost."""
    told = F.when(F.col(route).isNull(), F.lit("no route")).otherwise(F.concat(F.lit("no branch for "), F.col(route).cast("string")))
    out = messages.where(~F.coalesce(F.col(route).cast("string").isin(*branches), F.lit(False))).withColumn(error, told)
    for label, branch in branches.items():
        answered = branch(messages.where(F.col(route).cast("string") == label))
        out = out.unionByName(answered.withColumn(error, F.lit(None).cast("string")), allowMissingColumns=True)
    return out


def routing_lines(probabilities: Column, route: Column) -> Column:
    """The debug text: each label of a map with its probability, in the map's order, and the selected label."""
    # The first line, and the last one's prefix.
    each = F.transform(F.map_entries(probabilities), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.format_string("%.2f", e["value"])))
    return F.concat(F.array_join(F.concat(F.array(F.lit("[router]")), each), "\n"), F.lit("\nselected="), route.cast("string"))
