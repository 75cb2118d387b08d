"""Removal of repeated passages: every byte covered by a 100-byte string that also starts earlier in the corpus.

The corpus is parsed into phrases, equal phrases are one entry of a dictionary, and run-length indexes over the entries
find the matches that end within phrases.

1. A window of LENGTH bytes is represented by the smallest hash among its GRAM-byte strings (leftmost of equal ones), so
   equal windows have equal representatives. Neighbouring windows with one representative form a phrase. Phrases whose
   representative occurs once in the corpus can't hold a repeated window and are dropped where equal hashes meet; a task
   first compares its own phrases and sends one row of a hash to that meeting, so frequent hashes stay spread. All but the
   first of equal phrases are repeated as a whole. Texts equal to an earlier text are settled by their digest before.
2. What is left are different phrases with one representative. A window of theirs reaches HALF bytes or more before its
   representative or HALF or more beyond it: a phrase is cut into these two kinds of windows, and only portions that share
   the HALF bytes as well are grouped.
3. Groups are dealt into lots of INDEX_BYTES. A lot's earlier portions are concatenated, a run-compressed Burrows-Wheeler
   transform with samples at both ends of each run is built over them, and the later portions stream through it for their
   matching statistics; a match of LENGTH bytes marks a window. Earlier and later are halves, quarters, eighths ... of each
   group in its order, so that a window is marked if and only if an earlier portion holds it. Groups of more than
   INDEX_BYTES, which no task should hold, compare the digests of their windows by groupBy: an exact way for the rest.

Order is by doc_id, then position. Defined results: a null text is empty; a null doc_id comes before all others; texts
shorter than LENGTH lose nothing; rows that repeat a doc_id and its text get equal results; different texts under one
doc_id (nulls too) are ordered by their digest; a text of any length is cut into slices of SLICE_BYTES that overlap by a
window; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import materialize, pieces_of, shared_dir, ship, shuffles_end, unwritten
from wayloom.llm.order_minhash import M1, mix, powers

LENGTH, GRAM = 100, 24
WIDTH, HALF = LENGTH - GRAM + 1, (LENGTH - GRAM) // 2
#: Bytes of portions that one index holds, and of text that a task parses at once.
INDEX_BYTES, SLICE_BYTES = 2 << 20, 4 << 20
#: Phrases that a task compares among themselves before they are shuffled.
CHUNK_RUNS = 1_000_000
PLACE = np.uint64(31)
FIRST = -(2**63)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Slice:
    """The bytes of some texts with prefix hashes: digests of any of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.begins = np.cumsum([0, *map(len, texts)])
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        up, self.down = powers(len(self.raw) + 1)
        one = self.raw.astype(np.uint64) + np.uint64(1)
        zero = np.zeros(1, np.uint64)
        self.prefix = np.concatenate([zero, np.cumsum(one * up[: len(one)], dtype=np.uint64)])
        self.second = None
        self.one, self.up = one, up

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * self.down[a])

    def digest2(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A second digest, of the squared codes."""
        if self.second is None:
            self.second = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.one) * self.up[: len(self.one)], dtype=np.uint64)])
        return mix((self.second[b] - self.second[a]) * self.down[a] + M1)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, representative hash, its position, first window, windows) of every phrase; positions within the slice."""
        none = np.empty(0, np.int64)
        n = len(self.raw)
        if n < LENGTH:
            return none, none.astype(np.uint64), none, none, none
        h = mix((self.prefix[GRAM:] - self.prefix[:-GRAM]) * self.down[: n - GRAM + 1])
        # hash and position in one number: the minimum is the smallest hash (of 33 bits), leftmost of equal ones
        low, width = ((h >> PLACE) << PLACE) | np.arange(len(h), dtype=np.uint64), 1
        while width * 2 <= WIDTH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: width - WIDTH], low[WIDTH - width :])
        sizes = np.diff(self.begins)
        start = np.flatnonzero(np.arange(len(low)) + LENGTH <= np.repeat(self.begins[1:], sizes)[: len(low)])
        if not len(start):
            return none, none.astype(np.uint64), none, none, none
        pos = (low[start] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        pos, windows = pos[first], np.diff(np.append(first, len(start)))
        return np.searchsorted(self.begins, pos, side="right") - 1, h[pos], pos, start[first], windows


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of some strings, with suffix samples at both ends of each run.

    Strings of different slots have different alphabets: a query meets strings of its own slot alone."""

    def __init__(self, strings: list[np.ndarray], slots: list[int]):
        n = len(strings)
        sizes = np.array([len(s) for s in strings])
        ends = np.cumsum(sizes + 1) - 1  # where the strings' end marks are
        wide = np.full(ends[-1] + 1, -1, np.int64)
        inside = np.ones(len(wide), bool)
        inside[ends] = False
        wide[inside] = np.concatenate(strings).astype(np.int64) + 256 * np.repeat(np.array(slots, np.int64), sizes)
        self.alphabet, text = np.unique(wide, return_inverse=True)  # 0 is the end mark
        order = self._sorted(text, np.repeat(np.arange(n), sizes + 1), np.repeat(ends, sizes + 1) - np.arange(len(wide)), n)
        bwt = text[order - 1]
        self.text = text
        self.start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.end = np.append(self.start[1:], len(text)) - 1
        self.code = bwt[self.start]
        self.at_start, self.at_end = order[self.start], order[self.end]
        runs = len(self.start)
        keys = self.code * runs + np.arange(runs)
        self.by_code = np.argsort(keys)
        self.keys = keys[self.by_code]
        length = self.end - self.start + 1
        self.to = np.empty(runs, np.int64)  # where a run's first row goes: rows are sorted by code, then by place
        self.to[self.by_code] = np.concatenate([[0], np.cumsum(length[self.by_code])[:-1]])

    @staticmethod
    def _sorted(text: np.ndarray, owner: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
        """Suffixes in order, each decided within its string: by its end mark's number at last. left is the distance to that mark."""
        size, bits, owners = len(text), int(text.max()).bit_length(), max(1, int(n - 1).bit_length())
        step = max(1, (62 - owners) // bits)
        padded, key = np.append(text, np.zeros(step, text.dtype)), np.zeros(size, np.int64)
        for j in range(step):
            key = key << bits | np.where(left > j, padded[j : j + size], 0)
        key = key << owners | np.where(left < step, owner, 0)
        order = np.argsort(key)
        head = np.concatenate([[True], np.diff(key[order]) != 0])
        rank = np.empty(size, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(size), 0))
        while True:
            tied = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(tied):
                return order
            at = order[tied]
            pair = rank[at] * size + rank[at + step]
            by = np.argsort(pair)
            at, pair = at[by], pair[by]
            order[tied] = at
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            head[tied] = new
            rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
            step *= 2

    def matches(self, queries: list[np.ndarray], slots: list[int]) -> list[np.ndarray]:
        """For each query the length, up to LENGTH, of the longest match in the text from each position."""
        q, runs = len(queries), len(self.start)
        size = np.array([len(x) for x in queries])
        longest = int(size.max())
        wide = np.concatenate(queries).astype(np.int64) + 256 * np.repeat(np.array(slots, np.int64), size)
        at = np.minimum(np.searchsorted(self.alphabet, wide), len(self.alphabet) - 1)
        codes = np.full((longest + LENGTH, q), -1, np.int64)  # by position: a step reads a row
        column = np.repeat(np.arange(q), size)
        codes[np.arange(len(wide)) - np.repeat(np.cumsum(size) - size, size), column] = np.where(self.alphabet[at] == wide, at, -2)
        place, row, pointer = np.full((longest, q), -1, np.int64), np.zeros(q, np.int64), np.full(q, self.at_start[0])
        for i in range(longest - 1, -1, -1):
            k = np.flatnonzero(i < size)
            c, r, p = codes[i, k], row[k], pointer[k]
            run = np.searchsorted(self.start, r, side="right") - 1
            miss = self.code[run] != c
            good = np.ones(len(k), bool)
            if miss.any():
                m = np.flatnonzero(miss)
                near = np.searchsorted(self.keys, c[m] * runs + run[m])
                after, before = self.by_code[np.minimum(near, runs - 1)], self.by_code[np.maximum(near - 1, 0)]
                has_after, has_before = self.code[after] == c[m], self.code[before] == c[m]
                far_after = np.where(has_after, self._common(p[m], self.at_start[after], has_after), -1)
                far_before = np.where(has_before, self._common(p[m], self.at_end[before], has_before), -1)
                down = far_after > far_before
                r[m] = np.where(down, self.start[after], self.end[before])
                p[m] = np.where(down, self.at_start[after], self.at_end[before])
                run[m] = np.where(down, after, before)
                good[m[~(has_after | has_before)]] = False
            row[k] = np.where(good, self.to[run] + r - self.start[run], 0)
            pointer[k] = np.where(good, p - 1, self.at_start[0])
            place[i, k] = np.where(good, p - 1, -1)
        # lengths from left to right: the match from i + 1 is at most one shorter than that from i
        out, have = np.zeros((longest, q), np.int64), np.zeros(q, np.int64)
        last = len(self.text) - 1
        for i in range(longest):
            p = place[i]
            have = np.where(p < 0, 0, np.maximum(have - 1, 0))
            live = np.flatnonzero((p >= 0) & (have < LENGTH))
            while len(live):
                far = p[live] + have[live]
                same = (self.text[np.minimum(far, last)] == codes[i + have[live], live]) & (far <= last)
                live = live[same]
                have[live] += 1
                live = live[have[live] < LENGTH]
            out[i] = have
        return [out[: size[k], k] for k in range(q)]

    def _common(self, a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Length of the common prefix, up to LENGTH, of the text's suffixes at a and b (within a string), where wanted."""
        far, last = np.zeros(len(a), np.int64), len(self.text) - 1
        live = np.flatnonzero(wanted)
        while len(live):
            x, y = a[live] + far[live], b[live] + far[live]
            code = self.text[np.minimum(x, last)]
            same = (x <= last) & (y <= last) & (code == self.text[np.minimum(y, last)]) & (code > 0) & (far[live] < LENGTH)
            live = live[same]
            far[live] += 1
        return far


def repeated_windows(groups: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """For each group of strings in order, and each string, which of its windows occur in an earlier string of its group.

    The first half of each group is indexed and its second half streams through, then quarters, and so on, for all groups
    at once; the halves of one level and group are told apart by slots."""
    marks = [[np.zeros(len(x) - LENGTH + 1, bool) for x in g] for g in groups]
    half, most = 1, max(map(len, groups))
    while half < most:
        left, left_slots, right, right_slots, at = [], [], [], [], []
        for i, g in enumerate(groups):
            for slot, a in enumerate(range(0, len(g) - half, 2 * half)):
                later = [j for j in range(a + half, min(a + 2 * half, len(g))) if not marks[i][j].all()]
                if later:
                    left += g[a : a + half]
                    left_slots += [slot] * half
                    right += [g[j] for j in later]
                    right_slots += [slot] * len(later)
                    at += [(i, j) for j in later]
        if right:
            for (i, j), m in zip(at, RunIndex(left, left_slots).matches(right, right_slots), strict=True):
                marks[i][j] |= m[: len(marks[i][j])] >= LENGTH
        half *= 2
    return marks


def _spans(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _code(pos: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A phrase in one number that sorts by position: its representative's position, windows before it, windows, two free bits."""
    return (pos << 16) | ((pos - first) << 9) | (windows << 2)


def _decoded(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, windows)."""
    pos = code >> 16
    return pos, pos - ((code >> 9) & 127), (code >> 2) & 127


#: The two free bits: alone in its chunk; equal to an earlier phrase of its chunk; first of its representative; another one.
ALONE, LATER, WITNESS, OTHER = range(4)


def _packed(batches: Iterator) -> Iterator:
    """(row, doc_id, text) to (row, doc_id, n_bytes, sha, z): texts of LENGTH or more compressed."""
    import pyarrow as pa
    import zstandard

    c = zstandard.ZstdCompressor(level=3)
    for b in (x for whole in batches for x in pieces_of(whole)):
        texts = b.column(2).cast(pa.binary()).to_pylist()
        n, sha, z = pa.array([len(t) for t in texts], pa.int64()), [hashlib.sha256(t).digest() for t in texts], [c.compress(t) if len(t) >= LENGTH else None for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(sha, pa.binary()), pa.array(z, pa.binary())], names=["row", "doc_id", "n_bytes", "sha", "z"])


def _slices(batches: Iterator) -> Iterator:
    """Of (n, z, ...) lists of (batch, row in it, n, offset, text) that take about SLICE_BYTES; longer texts are cut with an overlap of a window."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    held: list[tuple] = []
    size = 0
    for b in batches:
        for k, (n, z) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
            t = d.decompress(z.as_buffer())
            for a in range(0, len(t) - LENGTH + 1, SLICE_BYTES):
                part = t if len(t) <= SLICE_BYTES else t[a : a + SLICE_BYTES + LENGTH - 1]
                held.append((b, k, n, a, part))
                size += len(part)
                if size >= SLICE_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _chunk_rows(h: np.ndarray, s: np.ndarray, doc: np.ndarray, code: np.ndarray):
    """Rows of one chunk, marked: what the chunk itself shows needs no meeting with the same hash elsewhere."""
    import pyarrow as pa

    order = np.lexsort((code, doc, s, h))
    h, s, doc, code = h[order], s[order], doc[order], code[order]
    same = np.concatenate([[False], h[1:] == h[:-1]])
    equal = same & np.concatenate([[False], s[1:] == s[:-1]])
    more = np.concatenate([same[1:], [False]])
    mark = np.where(equal, LATER, np.where(same, OTHER, np.where(more, WITNESS, ALONE)))
    for a in range(0, len(h), 50_000):
        z = slice(a, a + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(h[z]), pa.array(s[z]), pa.array(doc[z]), pa.array(code[z] | mark[z])], names=["h", "s", "n", "code"])


def _all_runs(batches: Iterator) -> Iterator:
    """(n, z) to (h, s, n, code) of every phrase: hash of its representative, digest of the phrase."""
    held: list[tuple] = []
    for texts in _slices(batches):
        t = Slice([x[4] for x in texts])
        text, h, pos, first, windows = t.runs()
        if len(h):
            base = (t.begins[:-1] - np.array([x[3] for x in texts]))[text]
            s = t.digest(first, first + windows + LENGTH - 1)
            held.append((h.view(np.int64), s.view(np.int64), np.array([x[2] for x in texts])[text], _code(pos - base, first - base, windows)))
        if sum(len(x[0]) for x in held) > CHUNK_RUNS:
            yield from _chunk_rows(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield from _chunk_rows(*map(np.concatenate, zip(*held, strict=True)))


def _repeated(batches: Iterator) -> Iterator:
    """Of rows sorted by h those whose h isn't alone; only one row is held between batches."""
    import pyarrow as pa

    held, tied = None, False
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        h, code = b.column(0).to_numpy(), b.column(3).to_numpy()
        same = np.concatenate([[tied], h[1:] == h[:-1]])
        keep = same | np.append(same[1:], False) | ((code & 3) != ALONE)
        yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
        held, tied = b.slice(b.num_rows - 1), bool(same[-1])
    if held is not None and (tied or held.column(3)[0].as_py() & 3 != ALONE):
        yield held


def _portions(batches: Iterator) -> Iterator:
    """(n, z, edges) to (g, n, first, part): the two kinds of windows of each listed phrase, and the hash of what they surely share."""
    import pyarrow as pa

    def out(texts: list[tuple]) -> Iterator:
        s = Slice([x[4] for x in texts])
        h, code, row = [], [], []
        for k, (b, i, _, base, _) in enumerate(texts):
            flat = b.column(2)[i].values
            c = flat.field("code").to_numpy()
            _, first, _ = _decoded(c)
            mine = (first >= base) & (first < base + SLICE_BYTES)
            h.append(flat.field("h").to_numpy()[mine])
            code.append(c[mine])
            row.append(np.full(int(mine.sum()), k))
        h, code, row = np.concatenate(h).view(np.uint64), np.concatenate(code), np.concatenate(row)
        pos, first, windows = _decoded(code)
        shift = (s.begins[:-1] - np.array([x[3] for x in texts]))[row]
        least, most = pos - (first + windows - 1), pos - first  # how far windows reach before the representative
        far, near = most >= HALF, least < HALF
        raw = s.raw
        for which, a, z, x, y, salt in (
            (far, first, pos - np.maximum(least, HALF) + LENGTH, pos - HALF, pos + GRAM, 1),
            (near, pos - np.minimum(most, HALF - 1), first + windows - 1 + LENGTH, pos, pos + GRAM + HALF, 2),
        ):
            k = np.flatnonzero(which)
            a, z, x, y, of = a[k], (z + shift)[k], (x + shift)[k], (y + shift)[k], row[k]
            g = mix(h[k] ^ mix(s.digest(x, y) + np.uint64(salt)))
            begin = a + shift[k]
            parts = pa.array([raw[i:j].tobytes() for i, j in zip(begin.tolist(), z.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.array([t[2] for t in texts], np.int64)[of]), pa.array(a.astype(np.int32)), parts], names=["g", "n", "first", "part"])

    for texts in _slices(batches):
        yield from out(texts)


def _matched(batches: Iterator) -> Iterator:
    """Sorted (g, n, first, part) to (n, a, b): windows a to b - 1 of a document are repeated."""
    import pyarrow as pa

    lot: list[list[tuple]] = []
    size, last, seen = 0, None, {}
    rows: list[tuple] = []

    def settled() -> Iterator:
        groups = [g for g in lot if len(g) > 1]
        if groups:
            marks = repeated_windows([[np.frombuffer(r[2], np.uint8) for r in g] for g in groups])
            rows.extend((r[0], r[1] + x, r[1] + y) for g, m in zip(groups, marks, strict=True) for r, own in zip(g, m, strict=True) for x, y in zip(*(v.tolist() for v in _spans(own)), strict=True))
        n, a, z = zip(*rows, strict=True) if rows else ((), (), ())
        rows.clear()
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int32()), pa.array(z, pa.int32())], names=["n", "a", "b"])

    for batch in batches:
        for g, n, first, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != last:
                if lot and len(lot[-1]) < 2:
                    size -= sum(len(r[2]) for r in lot.pop())
                if size > INDEX_BYTES:
                    yield from settled()
                    lot, size = [], 0
                lot.append([])
                last, seen = g, {}
            if part in seen:  # an equal portion before: all its windows are repeated, but for the same place of a repeated row
                if seen[part] != (n, first):
                    rows.append((n, first, first + len(part) - LENGTH + 1))
            else:
                seen[part] = (n, first)
                lot[-1].append((n, first, part))
                size += len(part)
    yield from settled()


def _windowed(batches: Iterator) -> Iterator:
    """(g, n, first, part) to the digest of each window: (w1, w2, n, start)."""
    import pyarrow as pa

    for b in (x.slice(k, 2000) for x in batches for k in range(0, x.num_rows, 2000)):
        s = Slice(b.column(3).to_pylist())
        count = np.diff(s.begins) - LENGTH + 1
        row = np.repeat(np.arange(b.num_rows), count)
        off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        a = s.begins[row] + off
        start = b.column(2).to_numpy()[row] + off
        yield pa.RecordBatch.from_arrays([pa.array(s.digest(a, a + LENGTH).view(np.int64)), pa.array(s.digest2(a, a + LENGTH).view(np.int64)), b.column(1).take(pa.array(row)), pa.array(start.astype(np.int32))], names=["w1", "w2", "n", "start"])


#: Kinds of verdict rows: the first of equal phrases; a phrase that isn't alone; windows found by an index.
OWN, FOUND, SPAN = range(3)


def _merged(batches: Iterator) -> Iterator:
    """Verdict rows (n, a, b, kind) sorted by all to (n, a, b): arrays of the byte spans to remove, disjoint and in order."""
    import pyarrow as pa

    def out(n, a, z, kind) -> Iterator:
        block = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1])]))
        own = np.repeat(np.minimum.reduceat(kind, block) == OWN, np.diff(np.append(block, len(n))))
        keep = (kind == SPAN) | ((kind == FOUND) & ~own)
        n, a, z = n[keep], a[keep].astype(np.int64), z[keep].astype(np.int64) - 1 + LENGTH
        if not len(n):
            return
        start = np.concatenate([[True], n[1:] != n[:-1]])
        # the furthest end so far, within a document: documents are set apart by an offset
        doc = np.cumsum(start) - 1
        reach = np.maximum.accumulate(z + (doc << 32))
        new = np.concatenate([[True], (a + (doc << 32))[1:] > reach[:-1]])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(n)) - 1
        firsts = np.flatnonzero(np.concatenate([[True], doc[at][1:] != doc[at][:-1]]))
        offsets = pa.array(np.append(firsts, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (a[at], (reach[last] - (doc[last] << 32)))]
        yield pa.RecordBatch.from_arrays([pa.array(n[at][firsts]), *lists], names=["n", "a", "b"])

    held: list = []
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        n = held[-1][0]
        if len(n) and (len(held) == 1 or n[0] != n[-1] or held[0][0][0] != n[-1]):
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], n[-1]))  # n ascends: the last document may go on
            if cut:
                yield from out(*(c[:cut] for c in cols))
            held = [[c[cut:] for c in cols]]
    if held and sum(len(x[0]) for x in held):
        yield from out(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _cleaned(batches: Iterator, with_text: bool) -> Iterator:
    """(n, z, a, b) to what is left of each text."""
    import pyarrow as pa
    import zstandard

    d = zstandard.ZstdDecompressor()
    for b in (x.slice(k, 64) for x in batches for k in range(0, x.num_rows, 64)):
        rows = []
        for z, starts, ends in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            t = memoryview(d.decompress(z.as_buffer()))
            kept = b"".join(t[x:y] for x, y in zip([0, *ends], [*starts, len(t)], strict=True))
            rows.append((len(t) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        k, m, sha, kept = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k, pa.int64()), pa.array(m, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["n", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs; with_text: and kept, the remaining bytes of texts that lose some, else null."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = materialize(d.mapInArrow(_packed, "row long, doc_id long, n_bytes long, sha binary, z binary"), "packed")
    plain = materialize(every.select("row", F.coalesce("doc_id", F.lit(FIRST)).alias("key"), "n_bytes", "sha"), "plain")
    # of equal texts the first; n numbers them in the order of doc_id
    firsts = plain.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min(F.struct("key", "row")).alias("m")).select("sha", "m.key", "m.row")
    firsts = materialize(firsts.repartitionByRange("key", "sha").sortWithinPartitions("key", "sha").withColumn("n", F.monotonically_increasing_id()), "firsts")
    name = f"texts_{uuid.uuid4().hex[:12]}"
    with shuffles_end(spark):
        dealt = every.select("row", "z").join(firsts.select("row", "n").hint("merge"), "row").select("n", "z").repartition(parts, "n")
        dealt.write.format("parquet").bucketBy(parts, "n").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    unwritten(every)
    texts = spark.table(name)  # by n: joins on it don't shuffle the texts again
    # 1: phrases whose representative occurs twice. A chunk's own repeats meet there; only one row of a hash leaves it to meet others
    runs = texts.select("n", "z").mapInArrow(_all_runs, "h long, s long, n long, code long")
    mark = F.col("code").bitwiseAND(F.lit(3).cast("long"))
    route = F.when(mark == LATER, F.xxhash64("n", "code")).when(mark == OTHER, F.xxhash64("h", "s")).otherwise(F.col("h"))
    found = materialize(runs.repartition(parts, route).sortWithinPartitions("h").mapInArrow(_repeated, "h long, s long, n long, code long"), "runs")
    kinds = found.where(mark != LATER).groupBy("h", "s").agg(F.min(F.struct("n", "code")).alias("own"))
    kinds = materialize(kinds.select("h", "own.n", "own.code"), "kinds")
    # 2: different phrases with one representative, cut into the windows that reach far before it and the others
    edges = kinds.join(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "h")
    wanted = edges.groupBy("n").agg(F.collect_list(F.struct("h", "code")).alias("edges"))
    portions = texts.join(wanted, "n").select("n", "z", "edges").mapInArrow(_portions, "g long, n long, first int, part binary")
    portions = materialize(portions, "portions")
    groups = materialize(portions.groupBy("g").agg(F.count("*").alias("rows"), F.sum(F.octet_length("part")).alias("bytes")).where("rows > 1"), "groups")
    # 3: matching statistics of later portions; groups that no task should hold by their windows' digests
    fit, large = (portions.join(groups.where(c).select("g"), "g") for c in (F.col("bytes") <= INDEX_BYTES, F.col("bytes") > INDEX_BYTES))
    columns = ["g", "n", "first", "part"]
    few = materialize(fit.select(*columns).repartition(parts, "g").sortWithinPartitions("g", "n", "first").mapInArrow(_matched, "n long, a int, b int"), "matches")
    windows = materialize(large.select(*columns).mapInArrow(_windowed, "w1 long, w2 long, n long, start int"), "windows")
    own = windows.groupBy("w1", "w2").agg(F.min(F.struct("n", "start")).alias("own"), F.count("*").alias("k")).where("k > 1").drop("k")
    many = windows.join(own, ["w1", "w2"]).where(F.struct("n", "start") != F.col("own")).select("n", F.col("start").alias("a"), (F.col("start") + 1).alias("b"))
    # verdicts meet by document
    first = (F.shiftright("code", 16) - F.shiftright("code", 9).bitwiseAND(F.lit(127).cast("long"))).cast("int")
    width = F.shiftright("code", 2).bitwiseAND(F.lit(127).cast("long")).cast("int")
    phrases = lambda df, kind: df.select("n", first.alias("a"), (first + width).alias("b"), F.lit(kind).alias("kind"))
    verdicts = phrases(kinds, OWN).unionByName(phrases(found, FOUND)).unionByName(few.unionByName(many).withColumn("kind", F.lit(SPAN)))
    spans = verdicts.repartition(parts, "n").sortWithinPartitions("n", "a", "b", "kind").mapInArrow(_merged, "n long, a array<int>, b array<int>")
    cut = texts.join(spans, "n").select("n", "z", "a", "b").mapInArrow(lambda b: _cleaned(b, with_text), "n long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = materialize(cut if with_text else cut.drop("kept"), "cut")
    unwritten(texts, found, kinds, portions, groups, few, windows)
    spark.sql(f"DROP TABLE {name}")
    # all rows: copies of a text under another doc_id lose everything, repeated rows share a result
    judged = firsts.select("sha", F.col("key").alias("first"), "n").join(cut.hint("merge"), "n", "left").drop("n")
    copy, zero = F.col("first") != F.col("key"), F.lit(0).cast("long")
    out = plain.join(judged.hint("merge"), "sha", "left")
    result = out.select(
        F.when(F.col("key") != FIRST, F.col("key")).alias("doc_id"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"), F.when(copy, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"), *([F.when(copy, F.lit(b"").cast("binary")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    return result
