"""Fill-in-middle: texts cut at two units into prefix, middle and suffix, and put together for a trainer.

One Aho-Corasick automaton scans a text once and reports its events: sentinels, which must not occur, and the ASCII characters
that change the class of what follows. Between two events a text has one class, so the units of a gap follow by arithmetic:
as many as it has code points, or one where a run of a class is a unit. The events and the units before them are all that is
kept of a text; a rank is looked up by a binary search among the events and a subtraction within a gap.

Units: "points" (each code point is one: no character changes a class, sentinels are the only events), "words" (a run of the six
ASCII white-space characters is a unit, and so is a run of others) and "lines" (a line with its line feed).

Cuts and forms come from a digest of the document's id, so reruns agree and copies of a row are alike. restored() rebuilds texts
from outputs and forms with DataFrame functions.

Defined results: a null text is empty; empty texts and those that contain a sentinel stay plain; a null doc_id counts as an empty
name; repeated rows and ids stay rows of their own; texts of any length are cut whole; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import pieces_of, text_of

SENTINELS = ("<P>", "<S>", "<M>")
SPACES = "\t\n\v\f\r "
UNITS = ("points", "words", "lines")
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@lru_cache(maxsize=16)
def automaton(units: str, sentinels: tuple[str, ...]):
    """Events of a text: a sentinel, or a character that changes the class."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for s in sentinels:
        a.add_word(s, s)
    for c in {"points": "", "words": SPACES, "lines": "\n"}[units]:
        a.add_word(c, None)
    a.make_automaton()
    return a


class Ranks:
    """Where units end: at[i] is an offset and rank[i] the number of units that end there or before; in between each code point is a
    unit (points), or none ends (words, lines)."""

    def __init__(self, text: str, units: str = "points", sentinels: tuple[str, ...] = SENTINELS):
        self.points = units == "points"
        events = automaton(units, sentinels).iter(text)
        if self.points:  # every event is a sentinel, and the whole text one gap
            self.found = next(events, None) is not None
            self.at, self.rank = [0, len(text)], [0, len(text)]
            return
        self.found, self.at, self.rank = False, [0], [0]
        run = False  # whether the unit that ended last is white space, which may go on
        for end, name in events:
            if name is not None:
                self.found = True
            elif units == "lines":
                self._end(end + 1)
            elif run and self.at[-1] == end:
                self.at[-1] = end + 1
            else:
                if end > self.at[-1]:  # the gap was a word
                    self._end(end)
                self._end(end + 1)
                run = True
        if len(text) > self.at[-1]:
            self._end(len(text))

    def _end(self, at: int) -> None:
        self.at.append(at)
        self.rank.append(self.rank[-1] + 1)

    def __len__(self) -> int:
        return self.rank[-1]

    def offset(self, unit: int) -> int:
        """Code points before the end of the unit-th unit."""
        k = bisect_left(self.rank, unit)
        return self.at[k] - (self.rank[k] - unit if self.points else 0)


def _numbers(name: str) -> list[int]:
    h = hashlib.sha256(name.encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(name: str, text: str, units: str = "points", plain_from: int = 90, spm_below: int = 20, sentinels: tuple[str, ...] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix, of middle, output) of one text; name decides the cuts."""
    ranks = Ranks(text, units, sentinels)
    n, (h1, h2, h3, h4) = len(ranks), _numbers(name)
    if not text or ranks.found or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    a, z = (ranks.offset(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix, (p, s, m) = text[:a], text[a:z], text[z:], sentinels
    if h4 % 100 < spm_below:
        return n, "spm", a, z - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, z - a, p + prefix + s + suffix + m + middle


def fill_in_middle(docs: DataFrame, units: str = "points", seed: int = 1, plain_from: int = 90, spm_below: int = 20, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output for each row of docs.

    plain_from and spm_below are shares of a hundred; sentinels name prefix, suffix and middle and each begin with a character
    that none of them holds elsewhere, so that none can arise where parts meet."""
    if units not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}, not {units!r}")
    if len(set(sentinels)) != 3 or any(not s or s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError("sentinels are three different strings whose first characters occur nowhere else in them")

    def cuts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for b in (x for whole in batches for x in pieces_of(whole)):
            ids = b.column(0).to_pylist()
            rows = [(i, *cut(f"{seed}:{'' if i is None else i}", t, units, plain_from, spm_below, sentinels)) for i, t in zip(ids, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return text_of(docs).select("doc_id", "text").mapInArrow(cuts, SCHEMA)


def restored(output, form, sentinels: tuple[str, ...] = SENTINELS):
    """Column: the text that an output and its form stand for."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels))
    at = lambda k: F.element_at(parts, k)
    return F.when(form == "psm", F.concat(at(2), at(4), at(3))).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(output)
