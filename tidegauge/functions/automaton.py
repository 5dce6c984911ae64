"""Terms of a dictionary in texts, as whole words, by an Aho-Corasick automaton: one pass over a text however many terms there are."""

from __future__ import annotations

import functools

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the terms that one automaton holds (a node each at most, some 100 bytes); more terms are blocks that see a text in turn.
BLOCK_CHARS = 1 << 20
#: Characters of a dictionary that the driver takes.
MOST_CHARS = 64 << 20
HITS = "array<struct<start: int, stop: int, term: string>>"


def folded(text: str) -> str:
    """In lower case, with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _ascii(c: str) -> bool:
    return c.isascii() and c.isalnum()


@functools.lru_cache(maxsize=64)
def _built(terms: tuple[str, ...]) -> ahocorasick.Automaton | None:
    machine = ahocorasick.Automaton()
    for t in terms:
        machine.add_word(t, t)
    if not terms:
        return None
    machine.make_automaton()
    return machine


def occurrences(text: str, terms: tuple[str, ...], ignore_case: bool = True, ascii_words: bool = False) -> list[tuple[int, int, str]]:
    """(start, stop, term) of every occurrence of a term as whole words, overlapping ones too."""
    machine, inside = _built(terms), _ascii if ascii_words else _word
    if machine is None or not text:
        return []
    seen, out = folded(text) if ignore_case else text, []
    for last, term in machine.iter(seen):
        start, stop = last - len(term) + 1, last + 1
        if not (start and inside(text[start - 1])) and not (stop < len(text) and inside(text[stop])):
            out.append((start, stop, term))
    return out


def leftmost_longest(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The occurrences that a reader from left to right takes: at each place the longest, and none that begins inside another."""
    out, end = [], 0
    for hit in sorted(found, key=lambda h: (h[0], -h[1])):
        if hit[0] >= end:
            out.append(hit)
            end = hit[1]
    return out


def prepared(terms, ignore_case: bool = True) -> list[tuple[str, ...]]:
    """Distinct terms in blocks of about BLOCK_CHARS."""
    blocks, size = [[]], 0
    for t in sorted({folded(t.strip()) if ignore_case else t.strip() for t in terms if t and t.strip()}):
        if size + len(t) > BLOCK_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(t)
        size += len(t)
    return [tuple(b) for b in blocks]


def _finder(block: tuple[str, ...], ignore_case: bool, ascii_words: bool):
    @F.pandas_udf(HITS)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("start", "stop", "term"), h)) for h in occurrences(t or "", block, ignore_case, ascii_words)])

    return found


def matches(text: Column, terms, ignore_case: bool = True, ascii_words: bool = False) -> Column:
    """(start, stop, term) of the leftmost longest whole-word matches in each text; none in null ones.

    Words are of letters, digits and underscores, or of ASCII letters and digits
    only. Every block of terms is a pass over the text, without a shuffle.
    """
    passes = [_finder(block, ignore_case, ascii_words)(text) for block in prepared(terms, ignore_case)]

    @F.pandas_udf(HITS)
    def taken(hits: pd.Series) -> pd.Series:
        return hits.map(lambda x: [dict(zip(("start", "stop", "term"), h)) for h in leftmost_longest([(y["start"], y["stop"], y["term"]) for y in x])])

    return taken(passes[0] if len(passes) == 1 else F.concat(*passes))


def dictionary(rows: DataFrame) -> dict[str, list[str]]:
    """The terms of ``rows`` (name, term) by name, as ``read_term_lists`` gives them; an error beyond MOST_CHARS."""
    rows = rows.select("name", "term").where("name is not null and term <> ''")
    size = rows.agg(F.sum(F.length("term"))).first()[0] or 0
    if size > MOST_CHARS:
        raise ValueError(f"a dictionary of {size} characters; the limit is {MOST_CHARS}")
    out: dict[str, list[str]] = {}
    for r in rows.collect():
        out.setdefault(r.name, []).append(r.term)
    return out
