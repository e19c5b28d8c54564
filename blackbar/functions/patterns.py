"""A compiled pattern dictionary and the regular expressions derived from it.

Matching reports an occurrence as soon as one *ends*, then goes on after it. A pattern
that contains another one ending before its own end ("shadowed") can therefore never be
reported. Once shadowed patterns and duplicates are gone, no pattern is a prefix of
another one, and a plain alternation finds exactly those matches, in any order of the
alternatives. That is what lets every operator use Spark's native regexp functions.
"""

from __future__ import annotations

import json
import os.path
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[REDACTED]"

# Longer patterns do not become nested groups, which regex engines compile by recursion.
NESTED = 300
# A map of more entries is parsed from one literal instead of being built entry by entry.
_MAP_ENTRIES = 200
# Stands between a text and a pattern; a Unicode noncharacter.
_MARK = "\uffff"


@dataclass(frozen=True)
class Entry:
    pattern_id: int
    pattern: str
    replacement: str
    escaped_replacement: str


def quote(literal: str) -> str:
    """Quote a literal for a Java regex: a backslash before anything but letters and digits."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in literal)


def quote_replacement(literal: str) -> str:
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def as_bytes_text(literal: str) -> str:
    """The UTF-8 bytes of a literal as a Latin-1 string: one character per byte."""
    return literal.encode("utf-8").decode("latin-1")


def bytes_text(binary: Column) -> Column:
    """A BINARY column as a Latin-1 string, so string functions count and match bytes."""
    return F.decode(binary, "ISO-8859-1")


def text_bytes(latin1: Column) -> Column:
    return F.encode(latin1, "ISO-8859-1")


def _factored(words: list[str], depth: int = 0) -> str:
    """Alternation of prefix-free words, grouped by common leading characters."""
    if len(words) == 1:
        return quote(words[0])
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[0], []).append(word)
    parts = []
    for group in groups.values():
        shared = len(os.path.commonprefix([min(group), max(group)]))
        if len(group) == 1 or depth >= NESTED:
            parts += map(quote, group)
        else:
            rests = [w[shared:] for w in group]
            parts.append(quote(group[0][:shared]) + "(?:" + _factored(rests, depth + 1) + ")")
    return "|".join(parts)


def match_regex(words: list[str]) -> str | None:
    """Regex finding any of the prefix-free words; the lookahead rejects most positions cheaply."""
    if not words:
        return None
    firsts = "".join(quote(c) for c in dict.fromkeys(w[0] for w in words))
    return f"(?=[{firsts}])(?:{_factored(words)})"


def suffix_regex(words: list[str]) -> str | None:
    """Regex for the longest proper prefix of any word that ends a text (none: no match).

    The search starts as far left as possible, so the first hit is the longest suffix.
    Words must not be longer than the nesting a regex can have (see ``pending_length``).
    """
    prefixes: dict[str, dict] = {}
    for word in words:
        node = prefixes
        for c in word[:-1]:
            node = node.setdefault(c, {})

    def render(node: dict) -> str:
        parts = []
        for c, below in node.items():
            parts.append(quote(c) + (f"(?:{render(below)})?" if below else ""))
        return "|".join(parts)

    return f"(?:{render(prefixes)})\\z" if prefixes else None


@dataclass(frozen=True)
class Dictionary:
    """The patterns of a vault in driver memory, from where they travel as one regex literal."""

    entries: tuple[Entry, ...]

    @cached_property
    def live(self) -> tuple[Entry, ...]:
        seen: set[str] = set()
        distinct = []
        for e in sorted(self.entries, key=lambda e: e.pattern_id):
            if e.pattern not in seen:
                seen.add(e.pattern)
                distinct.append(e)

        lengths = sorted({len(w) for w in seen})

        def shadowed(word: str) -> bool:
            return any(
                word[i : i + n] in seen
                for n in lengths
                if n < len(word)
                for i in range(len(word) - n)
            )

        return tuple(e for e in distinct if not shadowed(e.pattern))

    @cached_property
    def words(self) -> list[str]:
        return [e.pattern for e in self.live]

    @cached_property
    def max_bytes(self) -> int:
        """Longest pattern in bytes, over all patterns (shadowed ones count too)."""
        return max((len(e.pattern.encode()) for e in self.entries), default=0)

    @cached_property
    def live_bytes(self) -> int:
        return max((len(w.encode()) for w in self.words), default=0)

    @cached_property
    def chains(self) -> bool:
        """Whether a live pattern ends in a proper prefix of a live pattern.

        If not, occurrences never overlap and the bytes just before a chunk settle what
        is pending there; if so, it depends on everything before.
        """
        prefixes = {w[:i] for w in self.words for i in range(1, len(w))}
        return any(w[i:] in prefixes for w in self.words for i in range(len(w)))

    @cached_property
    def regex(self) -> str | None:
        return match_regex(self.words)

    @cached_property
    def byte_regex(self) -> str | None:
        return match_regex([as_bytes_text(w) for w in self.words])

    @cached_property
    def uniform_replacement(self) -> str | None:
        """The one replacement all live patterns share, or None."""
        distinct = {e.replacement for e in self.live}
        return distinct.pop() if len(distinct) == 1 else None

    def lookup(self, attribute: str) -> Column:
        """Literal map from pattern text to one of its attributes."""
        pairs = {e.pattern: getattr(e, attribute) for e in self.live}
        if len(pairs) > _MAP_ENTRIES:
            kind = "int" if attribute == "pattern_id" else "string"
            return F.from_json(F.lit(json.dumps(pairs, ensure_ascii=False)), f"map<string,{kind}>")
        return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])

    def pending_bytes(self, latin1: Column) -> Column:
        """Length of the longest suffix that is a proper prefix of a live pattern."""
        return pending_length(latin1, [as_bytes_text(w) for w in self.words])

    def any_pending(self, text: Column, as_bytes: bool) -> Column:
        """The same over all patterns, shadowed ones too."""
        words = dict.fromkeys(e.pattern for e in self.entries)
        return pending_length(text, [as_bytes_text(w) for w in words] if as_bytes else list(words))


def pending_length(text: Column, words: list[str]) -> Column:
    """Length of the longest suffix of a text that is a proper prefix of a word."""
    short, long = [w for w in words if len(w) <= NESTED], [w for w in words if len(w) > NESTED]
    found = [F.lit(0)]

    def tail(n: int) -> Column:
        return F.substring(text, -n, n)

    regex = suffix_regex(short)
    if regex is not None:
        longest = max(map(len, short))
        found.append(F.length(F.regexp_extract(tail(longest - 1), regex, 0)))
    for word in long:
        # what stands before the mark must be repeated behind it, from the word's first character
        end = F.substring_index(tail(len(word) - 1), _MARK, -1)
        both = F.concat(end, F.lit(_MARK + word))
        found.append(F.length(F.regexp_extract(both, f"([^{_MARK}]+){_MARK}\\1", 1)))
    return F.greatest(*found) if len(found) > 1 else found[0]


def collect_dictionary(vault: DataFrame) -> Dictionary:
    """Fetch a vault table to the driver, whatever its size.

    A dictionary that does not fit there stays a table (see plans/wide_dictionary.py).
    """
    rows = vault.select("pattern_id", "pattern", "replacement", "escaped_replacement").collect()
    return Dictionary(tuple(sorted((Entry(*r) for r in rows), key=lambda e: e.pattern_id)))


def as_dictionary(vault: DataFrame | Dictionary) -> Dictionary:
    return vault if isinstance(vault, Dictionary) else collect_dictionary(vault)
