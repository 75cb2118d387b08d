"""SentencePiece encoding and decoding as batched numpy Viterbi.

encode_pieces adds to each row of a table with a text column the piece ids that the sentencepiece library gives for
the whole text (no begin or end pieces), the number of them, and the text decoded from them. Both model kinds work:

* UNIGRAM: the best path maximises the sum of piece scores.
* BPE: greedy merging is not a sum of scores, so the same lattice is searched with another path weight: a step from
  piece l to piece r is allowed only if merging would leave the pair (l, r) apart. The greedy segmentation is the only
  path all of whose neighbours are apart, so the maximum over the allowed steps is that one.

A batch's texts are cut into words before each run of spaces, words into parts that no piece spans; distinct parts are
encoded once. Parts of equal length advance together: at position i all substrings ending there are hashed from prefix
hashes, those that a table of bits may hold probe the sorted piece hashes, and vectorised maxima store the backpointers.

Defined results: null or empty text gives no pieces and decodes to ''; a character without a piece becomes its UTF-8
bytes' pieces, or the unknown piece where the model has none; repeated rows give repeated results; an empty table
gives an empty table; other columns pass through, and clashing names are replaced by this operator's columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.llm.common import pieces_of
from wayloom.shipping import ship

SPACE = "▁"
MUL = np.uint64(0x9E3779B97F4A7C15)
MOD_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: A run of spaces and the word after it; line breaks, which pieces seldom hold, stand alone.
WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Distinct words, and parts of words, that a worker keeps encoded between batches; slots for pairs of pieces.
CACHE, SLOTS = 700_000, 1 << 20
#: A substring's hash times MOD_MIX, shifted by this, is its place in a table that tells most substrings that are no pieces.
SHIFT = np.uint64(44)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MOD_MIX
    return h ^ (h >> np.uint64(29))


class PieceModel:
    """The pieces of a model file (its bytes), with sorted hashes, and the codec over lists of words."""

    def __init__(self, data: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = m.get_piece_size()
        self.pieces = [m.id_to_piece(i) for i in range(n)]
        self.unk = m.unk_id()
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i)}
        normal = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        scores = np.array([m.get_score(i) for i in range(n)])
        self.bpe = _model_type(data) == 2
        self.longest = max(len(self.pieces[i]) for i in normal)
        self.spaces = sorted((len(self.pieces[i]) for i in normal if set(self.pieces[i]) == {SPACE}), reverse=True)
        if any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in normal):
            raise ValueError("pieces that run over the start of a word aren't supported")
        self.id_of = {self.pieces[i]: i for i in normal}
        self.joined = np.unique(np.array([ord(p[i]) << 21 | ord(p[i + 1]) for p in self.id_of for i in range(len(p) - 1)], dtype=np.int64))
        self.raw, self.size = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
        self.raw[normal], self.size[normal] = [self._hash(self.pieces[i]) for i in normal], [len(self.pieces[i]) for i in normal]
        self.power = np.array([pow(int(MUL), i, 1 << 64) for i in range(self.longest + 1)], dtype=np.uint64)
        self.maybe = np.zeros(1 << 64 - int(SHIFT), bool)
        self.maybe[self.raw[normal] * MOD_MIX >> SHIFT] = True
        self.single = np.array([self.id_of.get(chr(c), n) for c in range(1 << 16)])
        keys = _mix(self.raw[normal])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, dtype=np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.score = np.append(scores, scores[normal].min() - 10)  # the last: a character without a piece
        self.none = n  # stands for a character without a piece
        self.words: dict[str, bytes] = {}  # the ids as int32
        self.cache = CACHE
        self.parts: dict[str, bytes] = {}
        self.pairs, self.pair_apart = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        if self.bpe:
            self._plan_merges()

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for ch in s:
            h = (h * int(MUL) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _find(self, raw: np.ndarray) -> np.ndarray:
        """The pieces with these hashes, -1 where there is none."""
        key = _mix(raw)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], -1)

    # -- what merging does to pairs of pieces

    def _merge(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain greedy merging of one string: its parts, and the two parts that the last merge joined."""
        parts, last = list(s), None
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score[self.id_of[parts[i] + parts[i + 1]]] if parts[i] + parts[i + 1] in self.id_of else -np.inf, -i))
            if parts[best] + parts[best + 1] not in self.id_of:
                break
            last = (parts[best], parts[best + 1])
            parts[best : best + 2] = ["".join(last)]
        return parts, last

    def _plan_merges(self) -> None:
        """left, right: the halves each piece's last merge joined; whole: whether merging its characters gives it."""
        n = len(self.pieces) + 1
        self.left, self.right, self.whole = np.full(n, -1), np.full(n, -1), np.zeros(n, bool)
        self.whole[-1] = True
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.whole[i] = True
            elif set(p) != {SPACE}:  # runs of spaces are cut apart from words
                parts, last = self._merge(p)
                if len(parts) == 1 and last:
                    self.whole[i] = True
                    self.left[i], self.right[i] = self.id_of[last[0]], self.id_of[last[1]]

    def _are_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of pieces: whether merging their joined characters leaves exactly the two. A table of fixed size keeps pairs seen before."""
        code = a * (self.none + 1) + b
        slot = (_mix(code.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        miss = self.pairs[slot] != code
        if not miss.any():
            return self.pair_apart[slot]
        out = self.pair_apart[slot]
        new, where = np.unique(code[miss], return_inverse=True)
        got = self._stay_apart(new // (self.none + 1), new % (self.none + 1))
        out[miss] = got[where]
        slot = (_mix(new.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        self.pairs[slot] = new
        self.pair_apart[slot] = got
        same = self.pairs[slot] == new  # of two new pairs in one slot the one that stayed keeps its own value
        self.pair_apart[slot[same]] = got[same]
        return out

    def _spines(self, x: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row k: the k-th of the pieces along one border of x, down to a character (which then repeats); and how many follow x."""
        spine, deep = [x], np.zeros(len(x), np.int64)
        while (more := self.left[spine[-1]] >= 0).any():
            spine.append(np.where(more, inner[spine[-1]], spine[-1]))
            deep += more
        return np.array(spine), deep

    def _stay_apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Replay the merges along the border: a pair stays apart if no merge over the border would come before the merges that build x and y."""
        # the pieces along the border at each moment: x's right spine and y's left spine, with the score of the merge that used each up
        s, apart = self.score, np.ones(len(x), bool)
        rows = np.flatnonzero((x != self.none) & (y != self.none))
        (xs, i), (ys, j) = self._spines(x[rows], self.right), self._spines(y[rows], self.left)  # start from single characters
        at = np.arange(len(rows))
        while len(at):
            a, b = xs[i, at], ys[j, at]
            grow_x = np.where(i > 0, s[xs[i - 1, at]], -np.inf)  # the merge that will swallow a
            grow_y = np.where(j > 0, s[ys[j - 1, at]], -np.inf)
            fits = self.size[a] + self.size[b] <= self.longest
            joint = np.where(fits, self._find(self.raw[a] * self.power[np.where(fits, self.size[b], 0)] + self.raw[b]), -1)
            # the border merge is left of y's and right of x's: ties go to the leftmost
            joined = (joint >= 0) & (s[joint] > grow_x) & (s[joint] >= grow_y)
            apart[rows[at[joined]]] = False
            on = ~joined & ((i > 0) | (j > 0))
            by_x = (grow_x >= grow_y)[on]
            at, i, j = at[on], i[on] - by_x, j[on] - ~by_x
        return apart

    # -- search

    def _search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids (self.none for characters without a piece) of words of one length, all advancing together: those of all words, and the number of each word's."""
        n, length = len(words), len(words[0])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        prefix = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * MUL + chars[:, i] + np.uint64(1)
        single = self.single[np.minimum(chars, len(self.single) - 1)]
        for r, k in zip(*np.nonzero(chars >= len(self.single)), strict=True):
            single[r, k] = self.id_of.get(words[r][k], self.none)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last, back = np.full((length + 1, n), -1, np.int64), np.zeros((length + 1, n), np.int64)
        rows = np.arange(n)
        for i in range(1, length + 1):
            raws, ats = [], [rows]
            for w in range(2, min(i, self.longest) + 1):
                raw = prefix[i] - prefix[i - w] * self.power[w]
                ats.append(np.flatnonzero(self.maybe[raw * MOD_MIX >> SHIFT]))
                raws.append(raw[ats[-1]])
            found = np.concatenate([single[:, i - 1], self._find(np.concatenate(raws))]) if raws else single[:, i - 1]
            at, start = np.concatenate(ats), i - np.repeat(np.arange(1, len(ats) + 1), [len(x) for x in ats])
            keep = (found >= 0) & (best[start, at] > -np.inf)
            if self.bpe:
                keep &= self.whole[found]
            at, found, start = at[keep], found[keep], start[keep]
            if self.bpe:
                before = last[start, at]
                keep = before < 0  # at the start of the word
                inside = np.flatnonzero(~keep)
                keep[inside] = self._are_apart(before[inside], found[inside])
                value = np.zeros(len(at))
            else:
                value = best[start, at] + self.score[found]
                keep = np.argsort(value, kind="stable")
            at, found, start, value = at[keep], found[keep], start[keep], value[keep]
            best[i, at], last[i, at], back[i, at] = value, found, i - start  # of a word's steps the last stays: the best; of ties the longest piece
        path, count, i = np.full((n, length), -1, np.int64), np.zeros(n, np.int64), np.full(n, length)
        for k in range(length - 1, -1, -1):  # from the last piece, written from the right
            path[rows, k] = last[i, rows]
            count[rows] += 1
            i = i - back[i, rows]
            rows, i = rows[i > 0], i[i > 0]
            if not len(rows):
                break
        return path[path >= 0], count

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Piece ids (self.none for characters without a piece) of words of one length."""
        flat, count = self._search(words)
        return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]

    def _coded(self, words: list[str]) -> list[bytes]:
        """The ids of words of one length, a character without a piece as its bytes' or the unknown piece."""
        flat, count = self._search(words)
        ends = np.cumsum(count)
        data, e = flat.astype(np.int32).tobytes(), [0, *(4 * ends).tolist()]
        out = [data[a:b] for a, b in zip(e, e[1:], strict=False)]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(flat == self.none), side="right")).tolist():
            path, at = [], 0
            for x in flat[ends[k] - count[k] : ends[k]].tolist():
                path += [x] if x != self.none else [self.byte[b] for b in words[k][at].encode()] if self.byte else [self.unk]
                at += len(self.pieces[x]) if x != self.none else 1
            out[k] = np.array(path, dtype=np.int32).tobytes()
        return out

    def _cut(self, words: list[str]) -> tuple[list[str], list[int]]:
        """Words in parts that no piece spans: the parts of all, and where each word's parts end."""
        text, ends = "".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = code[:-1] << 21 | code[1:]
        border = np.zeros(len(code) + 1, bool)
        if len(self.joined):
            border[1:-1] = self.joined[np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)] != pair
        else:
            border[:] = True
        border[ends] = border[0] = True
        cuts = np.flatnonzero(border)
        at = cuts.tolist()
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)], np.searchsorted(cuts, ends).tolist()

    def _run(self, k: int) -> list[int]:
        """k spaces that no word takes: equal scores merge leftmost first, so the longest pieces come first."""
        out = []
        while k:
            w = next(x for x in self.spaces if x <= k)
            out.append(self.id_of[SPACE * w])
            k -= w
        return out

    def encode_words(self, words: list[str]) -> None:
        """Put words (a run of spaces and what follows it) into self.words."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.cache:
            self.words = {w: self.words[w] for w in words if w in self.words}
        if len(self.parts) > self.cache:
            self.parts = {}
        lead = {}  # spaces before the one that a word takes
        for w in new:
            if w[:2] == SPACE + SPACE or w == SPACE:
                k = len(w) - len(w.lstrip(SPACE))
                lead[w] = k if k == len(w) else k - 1
        parts, ends = self._cut([w[lead[w] :] if w in lead else w for w in new] if lead else new)
        by_len: dict[int, list[str]] = {}
        for p in {p for p in parts if p not in self.parts}:
            by_len.setdefault(len(p), []).append(p)
        for length, items in by_len.items():
            step = max(1, 200_000 // (length + 1))
            for a in range(0, len(items), step):
                self.parts.update(zip(items[a : a + step], self._coded(items[a : a + step]), strict=True))
        ids = list(map(self.parts.__getitem__, parts))
        self.words.update(zip(new, [ids[a] if z - a == 1 else b"".join(ids[a:z]) for a, z in zip([0, *ends], ends, strict=False)], strict=True))
        lone = self.id_of.get(SPACE, -1)
        for w, k in lead.items():
            path = np.frombuffer(self.words[w], np.int32).tolist()
            if k and path and path[0] == lone:
                path, k = path[1:], k + 1  # no word took the last space
            self.words[w] = np.array(self._run(k) + path, dtype=np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.encode_words(list(set().union(*cut)))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), dtype=np.int32) for ws in cut]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        if not hasattr(self, "shown"):
            by_id = {i: bytes([b]) for b, i in self.byte.items()}
            self.shown = [by_id.get(i) or (b" \xe2\x81\x87 " if i == self.unk else b"" if i in self.special else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        shown = self.shown
        return [b"".join([shown[i] for i in x.tolist()]).decode("utf-8", "replace").removeprefix(" ") for x in ids]


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = k = 0
        while True:
            x |= (b[i] & 127) << k
            i, k = i + 1, k + 7
            if b[i - 1] < 128:
                return x

    while i < len(b):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, b[i : i + size]
            i += size


def _model_type(data: bytes) -> int:
    """trainer_spec.model_type (1 unigram, 2 BPE) from the file: field 2 of the file, field 3 within it."""
    spec = next((v for k, v in _fields(data) if k == 2), b"")
    return next((v for k, v in _fields(spec) if k == 3), 1)


def check_supported(data: bytes) -> None:
    """Raise for model files whose texts are changed before they are cut: this codec would give other ids."""
    parts = list(_fields(data))
    kinds = {dict(_fields(v)).get(3, 1) for k, v in parts if k == 1}
    norm = dict(_fields(next((v for k, v in parts if k == 3), b"")))
    train = dict(_fields(next((v for k, v in parts if k == 2), b"")))
    faults = {
        "a normaliser's character map": bool(norm.get(2)), "no dummy prefix": norm.get(3, 1) == 0, "extra white space removed": norm.get(4, 1) == 1,
        "white space kept as it is": norm.get(5, 1) == 0, "user-defined pieces": 4 in kinds, "white space as a suffix": train.get(24, 0) == 1, "a model of words or characters": train.get(3, 1) > 2,
    }
    if found := [k for k, bad in faults.items() if bad]:
        raise ValueError(f"this model file isn't supported: {', '.join(found)}")


_MODELS: dict[bytes, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model in a file, checked and built once in the driver; workers get it as a broadcast."""
    with open(path, "rb") as f:
        data = f.read()
    key = hashlib.sha256(data).digest()
    if key not in _MODELS:
        check_supported(data)
        _MODELS.clear()
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", cache: int = CACHE, slice_bytes: int = 2 << 20) -> DataFrame:
    """docs with ids array<int>, n_pieces int and decoded string; see the module's text. A worker keeps `cache` words and parts at most and
    cuts slice_bytes of texts at once: less of both takes less memory and more time."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model(model_path))
    docs = docs.drop("ids", "n_pieces", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value  # one for each worker process, with its caches
        m.cache = cache
        for b in (x for whole in batches for x in pieces_of(whole, text, slice_bytes)):
            texts = [x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            ids = m.encode(texts)
            offsets = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            arrays = [*b.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(np.diff(offsets), pa.int32()), pa.array(m.decode(ids), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that each array of piece ids stands for; null ids give ''."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model(model_path))

    @F.pandas_udf("string")
    def decode(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.decode([np.asarray(v if v is not None else [], dtype=np.int64) for v in x]))

    return df.withColumn(out, decode(F.col(ids)))
