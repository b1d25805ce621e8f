"""License scan by template markup: which license wordings a text holds, and where.

A template is compiled into an automaton over words. Its states are the boundaries between template words, kept as bits of
one number; a word of the text moves every state past a template word equal to it (or past a replaceable one), and
optional regions are jumps over their words. A text is accepted where the automaton gets through all mandatory
wording, word for word. Runs begin only where the first mandatory words stand, so a text without them costs one search.
The wording before the first mandatory word, which is optional or replaceable, is matched backwards from there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanvane.llm.license_templates import PHRASES, TEMPLATES
from loanvane.llm.shared import release_memory, text_bytes

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEXTS_PER_BATCH = 256
# Score of a text that accepts a template, and of one that only names a license.
ACCEPTED, NAMED = 1.0, 0.5

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def scan_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text_bytes(text).translate(_LOWER).split()


# ---------------------------------------------------------------- templates


@dataclass(frozen=True)
class Gap:
    """Up to ``most`` words of any kind."""

    most: int


@dataclass(frozen=True)
class Optional:
    parts: tuple = ()


def parse_template(markup: str) -> tuple:
    """Words (bytes), gaps and optional regions of a template."""
    open_parts: list[list] = [[]]
    for mark, plain in re.findall(r"<<(.*?)>>|([^<]+|<)", markup, re.S):
        name, *settings = mark.split(";")
        if not mark:
            open_parts[-1].extend(scan_words(plain))
        elif name == "beginOptional":
            open_parts.append([])
        elif name == "endOptional":
            if len(open_parts) < 2:
                raise ValueError("endOptional without beginOptional")
            part = Optional(tuple(open_parts.pop()))
            open_parts[-1].append(part)
        elif name == "var":
            values = dict(s.split("=", 1) for s in settings)
            open_parts[-1].append(Gap(int(values["max"])))
        else:
            raise ValueError(f"unknown markup: {mark}")
    if len(open_parts) > 1:
        raise ValueError("beginOptional without endOptional")
    return tuple(open_parts[0])


def _mirrored(parts: Sequence) -> tuple:
    return tuple(Optional(_mirrored(p.parts)) if isinstance(p, Optional) else p for p in reversed(parts))


@dataclass
class Automaton:
    """States are bits: bit ``i`` is set when the text can have brought the template to its boundary ``i``."""

    any_word: int = 0
    of_word: dict[bytes, int] = field(default_factory=dict)
    jumps: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    @classmethod
    def of(cls, parts: Sequence) -> Automaton:
        made = cls()
        made._add(parts)
        made.jumps.sort(key=lambda j: j[0] & -j[0])
        return made

    def _add(self, parts: Sequence) -> None:
        for part in parts:
            begin = self.size
            if isinstance(part, Gap):
                self.size += part.most
                inside = (1 << self.size) - (1 << begin)
                self.any_word |= inside
                self.jumps.append((inside, 1 << self.size))
            elif isinstance(part, Optional):
                self._add(part.parts)
                self.jumps.append((1 << begin, 1 << self.size))
            else:
                self.of_word[part] = self.of_word.get(part, 0) | 1 << begin
                self.size += 1

    def _jump(self, states: int) -> int:
        for sources, target in self.jumps:
            if states & sources:
                states |= target
        return states

    def longest(self, words: Sequence[bytes], begin: int, step: int = 1) -> int | None:
        """Words of the longest accepted stretch that starts at ``begin`` (going backwards for a step of -1), or None."""
        states, final, best = self._jump(1), 1 << self.size, None
        i, n = begin, 0
        while True:
            if states & final:
                best = n
            if not 0 <= i < len(words):
                return best
            states &= self.any_word | self.of_word.get(words[i], 0)
            if not states:
                return best
            states = self._jump(states << 1)
            i, n = i + step, n + 1


@dataclass(frozen=True)
class Template:
    """Compiled template: ``anchor`` are its first mandatory words, ``before`` the mirrored wording ahead of them."""

    label: str
    anchor: bytes
    before: Automaton
    body: Automaton

    @classmethod
    def compile(cls, label: str, markup: str) -> Template:
        parts = parse_template(markup)
        first = next((i for i, p in enumerate(parts) if isinstance(p, bytes)), None)
        if first is None:
            raise ValueError(f"template without mandatory words: {label}")
        last = first
        while last < len(parts) and isinstance(parts[last], bytes):
            last += 1
        return cls(label, b" " + b" ".join(parts[first:last]) + b" ", Automaton.of(_mirrored(parts[:first])), Automaton.of(parts[first:]))


def template_pattern(markup: str) -> str:
    """The mandatory wording onwards as a regular expression over words with a space ahead of each and one at the end."""

    def expression(parts: Sequence) -> str:
        out = ""
        for p in parts:
            if isinstance(p, Gap):
                out += f"(?: [^ ]+){{0,{p.most}}}"
            elif isinstance(p, Optional):
                out += f"(?:{expression(p.parts)})?"
            else:
                out += " " + p.decode()
        return out

    parts = parse_template(markup)
    first = next(i for i, p in enumerate(parts) if isinstance(p, bytes))
    return expression(parts[first:]) + " "


# ---------------------------------------------------------------- scan


def _places(joined: bytes, pattern: bytes) -> Iterator[int]:
    """Number of the first word of every occurrence of a pattern that begins and ends with the blank between words."""
    at, counted, word = joined.find(pattern), 0, 0
    while at >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        yield word
        at = joined.find(pattern, at + 1)


def scan_text(words: list[bytes], templates: Sequence[Template], phrases: Sequence[tuple[bytes, str]]) -> list[tuple[str, str, int, int]]:
    """``(kind, label, first word, words)`` of every phrase and every accepted template of a list of words."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases:
        found += [("phrase", label, i, phrase.count(b" ") - 1) for i in _places(joined, phrase)]
    for t in templates:
        for i in _places(joined, t.anchor):
            n = t.body.longest(words, i)
            if n is not None:
                ahead = t.before.longest(words, i - 1, -1) or 0
                found.append(("template", t.label, i - ahead, ahead + n))
    return found


def license_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES
) -> DataFrame:
    """``(key, n_words, spans)`` of every row; ``spans`` are structs ``(kind, label, start, words)``, words from 0.

    ``kind`` is ``phrase`` for a license named by one of ``phrases`` and ``template`` for wording that a template accepts;
    all places count, also those within others. Null, empty and wordless texts have no words and no spans; texts are read
    whole at any length; repeated rows and keys give a row each, null keys stay; other columns are ignored. An empty
    table gives no rows. One pass over the rows, no exchange.
    """
    compiled = [Template.compile(label, markup) for label, markup in templates]
    named = [(b" " + b" ".join(scan_words(p)) + b" ", label) for p, label in phrases]
    kind = docs.schema[key].dataType.simpleString()
    names = ("kind", "label", "start", "words")
    schema = f"`{key}` {kind}, n_words long, spans array<struct<kind:string,label:string,start:long,words:long>>"
    struct = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, TEXTS_PER_BATCH):
                batch = whole.slice(low, TEXTS_PER_BATCH)
                sizes, spans = [], []
                for value in batch.column(1):
                    words = scan_words(value.as_py())
                    sizes.append(len(words))
                    spans.append([dict(zip(names, s, strict=True)) for s in scan_text(words, compiled, named)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, struct)], [key, "n_words", "spans"])
        release_memory()

    return docs.select(key, text).mapInArrow(scan, schema)


def license_labels(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and labels of each row of :func:`license_spans`.

    ``score`` is 1 where a template accepts, 0.5 where a license is only named, else 0.
    """
    base = F.filter("spans", lambda s: s["kind"] == "phrase")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    starts = F.transform("base", lambda s: s["start"])
    score = F.when(F.exists("spans", lambda s: s["kind"] == "template"), ACCEPTED).when(F.size("spans") > 0, NAMED).otherwise(0.0)
    return spans.withColumn("base", base).select(
        key, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined("base").alias("base_labels"), joined("spans").alias("labels"), score.alias("score"),
    )
