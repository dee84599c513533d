"""Tables of known misreadings: all entries are found and replaced in one pass over a text.

The entries are compiled once a task into an Aho-Corasick automaton, so that a text costs its own length and its matches, whatever
the table's size. As in an alternation of all entries, the longest first, matches are taken from left to right without overlap.
The table is the caller's and travels with the function: a list of known entries, not a table that grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may not stand beside a word of the table.
_BESIDE = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Table:
    """Entries and their replacements; bounded: an entry counts only where no ASCII letter or digit stands beside it."""

    def __init__(self, entries: dict[str, str], bounded: bool):
        import ahocorasick

        self.bounded, self.automaton = bounded, ahocorasick.Automaton()
        for old, new in entries.items():
            if old:
                self.automaton.add_word(old, (len(old), new))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, replacement) from left to right, the longest entry first, without overlap."""
        if not len(self.automaton):
            return []
        found = [(last + 1 - size, -size, new) for last, (size, new) in self.automaton.iter(text)]
        if self.bounded:
            found = [(a, n, new) for a, n, new in found if (not a or text[a - 1] not in _BESIDE) and (a - n == len(text) or text[a - n] not in _BESIDE)]
        out, free = [], 0
        for start, size, new in sorted(found, key=lambda x: x[:2]):
            if start >= free:
                out.append((start, start - size, new))
                free = start - size
        return out

    def replaced(self, text: str) -> str:
        pieces, at = [], 0
        for start, end, new in self.matches(text):
            pieces += (text[at:start], new)
            at = end
        return "".join([*pieces, text[at:]]) if at else text


#: Code points of texts that are spelt out in Python at once.
_AT_ONCE = 1 << 20


def _over(text: Column, kind: str, words: dict[str, str], phrases: dict[str, str], each) -> Column:
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables, made = (Table(words, True), Table(phrases, False)), pa.string() if kind == "string" else pa.bool_()
        for batch in batches:
            # a batch's texts are never all in Python: results go into Arrow by parts
            parts, part, size = [], [], 0
            for t in batch:
                t = t.as_py()
                part.append(None if t is None else each(t, *tables))
                size += len(t or "")
                if size >= _AT_ONCE:
                    parts.append(pa.array(part, made))
                    part, size = [], 0
            parts.append(pa.array(part, made))
            yield pa.concat_arrays(parts)
            del batch, parts, part
            pa.default_memory_pool().release_unused()

    return run(text)


def repaired(text: Column, words: dict[str, str], phrases: dict[str, str] | None = None) -> Column:
    """Known misreadings replaced: first words, where no letter or digit stands beside them, then phrases anywhere. Null stays null."""
    return _over(text, "string", dict(words), dict(phrases or {}), lambda t, w, p: p.replaced(w.replaced(t)))


def known(text: Column, words=(), phrases=()) -> Column:
    """Whether a known misread word or phrase occurs; null counts as empty."""
    found = _over(text, "boolean", dict.fromkeys(words, ""), dict.fromkeys(phrases, ""), lambda t, w, p: bool(w.matches(t) or p.matches(t)))
    return F.coalesce(found, F.lit(False))
