"""A Brown class-based bigram language model, trained and applied by Spark jobs.

1. Words of the training rows are counted (partial counts in each task, then a groupBy): c, N, V cover all of them.
2. The HEAD most frequent words go to every task; the others ("tail") keep their exact counts in the table of counts and
   are known by SIGNATURES groups (kind and ending). Texts are encoded once as a table of numbers.
3. The classes: the ITEMS most frequent words and the groups start from an exchange on a matrix of their bigram counts.
   Then all head words and groups are exchanged between CLASSES classes by Spark jobs: a pass over the encoded training
   rows counts the classes before and after each of them, tasks that hold a block of words each find the class that
   raises the mutual information of adjacent classes most, and half of the words, another half each time, move. Rounds
   go on until the mutual information grows by less than LEAST_GAIN; the best classes found are kept.
4. P(word | previous) = P(class | previous class) * P(word | class). Transitions are interpolated with class frequencies;
   emissions add 0.5 to each count, with one further place in each class for words never seen.
5. Scoring: tasks score transitions and head words; tail words, grouped by row, join the table of counts, so nothing
   that grows with the corpus is broadcast.

Tokens: the text with A-Z lower-cased, cut at ASCII white space, then one end token. Defined results: a null text is
empty (its end token alone); rows that repeat are scored each, and train each time; without training rows every count is
0 and scores stay finite; null ids count as empty text for the split; an empty table gives an empty table; of equally
frequent words the smaller in byte order is in the head, of equally good classes the first; texts of any length are scored
whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import materialize, pieces_of, small_batches, text_of

#: Bounds of what is broadcast or gathered: words known to every task (each with a class of its own), words of the first exchange, groups, classes.
HEAD, ITEMS, SIGNATURES, CLASSES = 65_536, 1_000, 256, 48
#: Words of a block, rounds of the exchange at most, and the share by which a round must raise the mutual information.
BLOCK, ROUNDS, LEAST_GAIN = 1024, 6, 1e-3
TOKENS_AT_ONCE = 1 << 20
SLICE = 1 << 19  # bytes of texts whose words a worker holds as objects at once
DISTINCT_PER_TASK = 250_000
PUNCTUATION = set(b".,;:!?)]}\"'|")


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()  # of bytes: ASCII letters and white space alone


def signature(word: bytes) -> int:
    """The group of a word outside the items: four kinds, 64 endings each."""
    kind = 0 if word.isdigit() else 1 if any(48 <= x <= 57 for x in word) else 2 if word[-1] in PUNCTUATION else 3
    return kind * 64 + zlib.crc32(word[-3:]) % 64


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def count_words(train: DataFrame) -> DataFrame:
    """word (UTF-8 binary), c over all rows of train; each task sums what fits before the shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out() -> Iterator:
            words = list(counts)
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for b in (x for whole in batches for x in pieces_of(whole, max_bytes=SLICE)):
            for t in b.column(0).to_pylist():
                counts.update(tokens_of(t))
            if len(counts) > DISTINCT_PER_TASK:
                yield from out()
                counts = Counter()
        yield from out()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def encode(docs: DataFrame, words: list[bytes], counts: np.ndarray) -> DataFrame:
    """docs (row, doc_id, held_out, text) as row, doc_id, held_out, ids, n_tokens, n_head, half, rare.

    ids: k + 1 for the head's word k, head + 1 + group for others; half: the sum of log10(c + 0.5) of head words; rare: the others with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast((words, np.log10(counts + 0.5)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, half = shared.value
        head = len(own)
        half = np.concatenate([[0.0], half, np.zeros(SIGNATURES)])

        class Known(dict):
            """The id of every word; others than the head's are kept once seen, up to a bound."""

            def __missing__(self, w: bytes) -> int:
                if len(self) > head + DISTINCT_PER_TASK:
                    self.clear()
                    self.update(start)
                k = self[w] = head + 1 + signature(w)
                return k

        start = {w: k + 1 for k, w in enumerate(own)}
        known = Known(start)
        for b in (x for whole in batches for x in pieces_of(whole, max_bytes=SLICE)):
            cut = [tokens_of(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            sizes = np.array([len(ws) for ws in cut])
            words = [w for ws in cut for w in ws]
            ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
            doc = np.repeat(np.arange(len(cut)), sizes)
            tail = np.flatnonzero(ids > head)
            rare = Counter(zip(doc[tail].tolist(), [words[j] for j in tail.tolist()], strict=True))  # in the order of rows
            many = np.bincount(np.fromiter((d for d, _ in rare), np.int64, len(rare)), minlength=len(cut))
            rows = pa.StructArray.from_arrays([pa.array([w for _, w in rare], pa.binary()), pa.array(list(rare.values()), pa.int64())], names=["word", "tf"])
            offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            heads = sizes - np.bincount(doc[tail], minlength=len(cut))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(offsets(sizes), pa.array(ids)), pa.array(sizes + 1, pa.int64()), pa.array(heads, pa.int64()), pa.array(np.bincount(doc, half[ids], len(cut)), pa.float64()), pa.ListArray.from_arrays(offsets(many), rows)],
                names=["row", "doc_id", "held_out", "ids", "n_tokens", "n_head", "half", "rare"],
            )

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, "row long, doc_id long, held_out boolean, ids array<int>, n_tokens long, n_head long, half double, rare array<struct<word:binary,tf:long>>")


def _sequences(batches: Iterator) -> Iterator[np.ndarray]:
    """Of a column ids, stretches of whole texts with a border, 0, before and after each."""
    for b in batches:
        sizes = np.asarray(b.column(0).value_lengths())
        ends, a = np.cumsum(sizes), 0
        flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
        while a < len(sizes):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS_AT_ONCE, side="right")))
            part, n = flat[(ends[a - 1] if a else 0) : ends[z - 1]], sizes[a:z]
            out = np.zeros(len(part) + len(n) + 1, np.int64)
            out[np.arange(len(part)) + np.repeat(np.arange(1, len(n) + 1), n)] = part
            yield out
            a = z


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(z: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.int64)


def _summed(parts: DataFrame) -> DataFrame:
    """(block, x) summed by block, x being packed arrays of one length within a block; tasks add as rows come."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([_pack(total)], pa.binary())], names=["block", "x"])
        for b in batches:
            for block, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != last:
                    if last is not None:
                        yield row()
                    last, total = block, np.zeros(len(_unpack(x)), np.int64)
                total += _unpack(x)
        if last is not None:
            yield row()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, x binary")


def first_pairs(train: DataFrame, kept: np.ndarray) -> np.ndarray:
    """Bigram counts of the ids that kept renumbers (0 the border, and 0 too for ids outside: they don't count): a matrix."""
    size = int(kept.max()) + 1
    shared = train.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept, total = shared.value, np.zeros(size * size, np.int64)
        for s in _sequences(batches):
            k = kept[s]
            k = k[:-1] * size + k[1:]
            total += np.bincount(k, minlength=size * size)
        for block, a in enumerate(range(0, size, 64)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_pack(total[a * size : (a + 64) * size])], pa.binary())], names=["block", "x"])

    rows = {r.block: _unpack(r.x) for r in _summed(train.select("ids").mapInArrow(run, "block int, x binary")).toLocalIterator()}
    return np.concatenate([rows[k] for k in sorted(rows)]).reshape(size, size).astype(float) if rows else np.zeros((size, size))


def log_sum(n: np.ndarray) -> float:
    """The part of the mutual information of adjacent classes that classes can change: n log n over pairs less that over totals."""
    f = lambda x: float(np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0).sum())
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def best_class(n: np.ndarray, out: np.ndarray, back: np.ndarray, own: float, g: int) -> int:
    """The class that an item of class g should have, given the classes after (out) and before it (back) and its pairs with itself.

    n are the counts of class pairs, the item's included; classes and item change nothing else.
    """
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    out, back, n = out.copy(), back.copy(), n.copy()
    out[g] -= own  # to and from the others
    back[g] -= own
    n[g] -= out
    n[:, g] -= back
    n[g, g] -= own
    rows, cols = n + out, n + back[:, None]  # row c: if class c took the item's successors; column c: its predecessors
    gain = (f(rows) - f(n)).sum(1) + (f(cols) - f(n)).sum(0)
    d = np.diag(n)  # the cell on the diagonal takes both, and the item's own pairs
    gain += f(d + out + back + own) - f(d + out) - f(d + back) + f(d)
    r, c = n.sum(1), n.sum(0)
    gain -= f(r + out.sum() + own) - f(r) + f(c + back.sum() + own) - f(c)
    gain[0] = -np.inf
    return int(np.argmax(gain))


def exchange(pairs: np.ndarray, classes: int, passes: int = 4) -> np.ndarray:
    """The class of each item (rows and columns of pairs) by the exchange algorithm; item 0 keeps class 0 to itself. Each item in turn moves to its best class."""
    size = len(pairs)
    freq = pairs.sum(1) + pairs.sum(0)
    label = np.zeros(size, np.int64)
    order = np.argsort(-freq[1:], kind="stable") + 1
    label[order] = np.arange(len(order)) % (classes - 1) + 1
    one = np.zeros((size, classes))
    one[np.arange(size), label] = 1
    n = one.T @ pairs @ one
    for _ in range(passes):
        moved = 0
        for i in order:
            if not freq[i]:
                continue
            out, back, own, g = pairs[i] @ one, pairs[:, i] @ one, pairs[i, i], label[i]
            best = best_class(n, out, back, own, g)
            if best == g:
                continue
            moved += 1
            for k, sign in ((g, -1), (best, 1)):
                if sign > 0:
                    one[i, g], one[i, best], label[i] = 0, 1, best
                    out, back = pairs[i] @ one, pairs[:, i] @ one
                n[k] += sign * out
                n[:, k] += sign * back
                n[k, k] -= sign * own
        if not moved:
            break
    return label


def class_pairs(train: DataFrame, label: np.ndarray, classes: int) -> np.ndarray:
    """Counts of adjacent classes over all training rows."""
    shared = train.sparkSession.sparkContext.broadcast(label)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        label, total = shared.value, np.zeros(classes * classes, np.int64)
        for s in _sequences(batches):
            k = label[s]
            total += np.bincount(k[:-1] * classes + k[1:], minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([_pack(total)], pa.binary())], names=["block", "x"])

    rows = _summed(train.select("ids").mapInArrow(run, "block int, x binary")).collect()  # one row
    return (_unpack(rows[0].x) if rows else np.zeros(classes * classes)).reshape(classes, classes).astype(float)


def exchange_round(train: DataFrame, label: np.ndarray, joint: np.ndarray, half: int) -> np.ndarray:
    """label after the items of one half (odd or even numbers by turns) moved to their best classes, all at once."""
    classes, size = len(joint), len(label)
    shared = train.sparkSession.sparkContext.broadcast((label, joint))
    width = 2 * classes + 1

    def contexts(batches: Iterator) -> Iterator:
        """Of each item in the half: classes after it, classes before it, pairs with itself. Row i is item 2 * i + half."""
        import pyarrow as pa

        label, _ = shared.value
        rows = (size + 1 - half) // 2
        total = np.zeros(rows * width, np.int32)
        for s in _sequences(batches):
            k = label[s]
            a, z = s[:-1], s[1:]
            mine, next_mine, same = (a & 1 == half) & (a > 0), (z & 1 == half) & (z > 0), (a == z) & (a & 1 == half) & (a > 0)
            for at, item, shift in ((mine, a, k[1:]), (next_mine, z, classes + k[:-1]), (same, a, np.full(len(a), 2 * classes))):
                total += np.bincount((item[at] >> 1) * width + shift[at], minlength=len(total)).astype(np.int32)
        for block, at in enumerate(range(0, rows, BLOCK)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_pack(total[at * width : (at + BLOCK) * width].astype(np.int64))], pa.binary())], names=["block", "x"])

    def moved(batches: Iterator) -> Iterator:
        import pyarrow as pa

        label, joint = shared.value
        for b in batches:
            for block, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, own = _unpack(x).reshape(-1, width).astype(float), label[half::2][block * BLOCK : (block + 1) * BLOCK].copy()
                for i in np.flatnonzero(rows.any(1)).tolist():
                    own[i] = best_class(joint, rows[i, :classes], rows[i, classes : 2 * classes], rows[i, -1], own[i])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_pack(own.astype(np.int64))], pa.binary())], names=["block", "x"])

    found = _summed(train.select("ids").mapInArrow(contexts, "block int, x binary"))
    new = label.copy()
    for r in materialize(found.mapInArrow(moved, "block int, x binary"), "labels").collect():  # size numbers in all
        new[half::2][r.block * BLOCK : (r.block + 1) * BLOCK] = _unpack(r.x)
    return new


class ClassModel:
    """What every task gets: bounded by HEAD, SIGNATURES and CLASSES. label: the class of each id, 0 the border's; step: log10
    P(class | previous class); under: log10 of what emissions are divided by."""

    def __init__(self, words: list[bytes], label: np.ndarray, joint: np.ndarray, n: int, v: int, ends: int):
        self.words, self.label, self.n, self.v, self.ends = words, label, n, v, ends
        classes = len(joint)
        share = (joint.sum(0) + 0.5) / (joint.sum() + 0.5 * classes)
        self.step = np.log10((joint + 10 * share) / (joint.sum(1, keepdims=True) + 10))
        self.under = np.zeros(classes)
        self.base_under = np.log10(n + 0.5 * (v + 1))


def train_model(train: DataFrame, counts: DataFrame, words: list[bytes], ends: int, items: int = ITEMS, classes: int = CLASSES, rounds: int = ROUNDS) -> ClassModel:
    """train: encoded training rows, written; counts: count_words, written. The driver gets classes, sums and a matrix of (items + SIGNATURES + 1)^2."""
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    items, size = min(items, len(words)), len(words) + SIGNATURES + 1
    kept = np.zeros(size, np.int64)
    kept[1 : items + 1] = np.arange(1, items + 1)
    kept[len(words) + 1 :] = np.arange(items + 1, items + 1 + SIGNATURES)
    if items < len(words):  # other head words start with their group
        kept[items + 1 : len(words) + 1] = [items + 1 + signature(w) for w in words[items:]]
    label = exchange(first_pairs(train, kept), classes)[kept]
    joint = class_pairs(train, label, classes)
    best = log_sum(joint)
    for k in range(rounds):
        new = exchange_round(train, label, joint, k % 2)
        after = class_pairs(train, new, classes)
        gain = log_sum(after) - best
        if gain > 0:
            label, joint, best = new, after, best + gain
        if k % 2 and gain < LEAST_GAIN * abs(best):
            break
    model = ClassModel(words, label, joint, int(n) + ends, int(v) + bool(ends), ends)
    shared = train.sparkSession.sparkContext.broadcast((words, label))

    def classes_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, label = shared.value
        place = {w: label[k + 1] for k, w in enumerate(own)}
        for b in batches:
            k = np.array([place[w] if w in place else label[len(own) + 1 + signature(w)] for w in b.column(0).to_pylist()], dtype=np.int64)
            n = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(np.bincount(k, n, classes)), pa.array(np.bincount(k, minlength=classes).astype(float))], names=["class", "total", "kinds"])

    totals, kinds = np.zeros(classes), np.zeros(classes)
    for r in counts.select("word", "c").mapInArrow(classes_of, "class long, total double, kinds double").groupBy("class").agg(F.sum("total"), F.sum("kinds")).collect():
        totals[r[0]], kinds[r[0]] = r[1], r[2]
    model.under = np.log10(totals + 0.5 * (kinds + 1))
    return model


def score(encoded: DataFrame, counts: DataFrame, model: ClassModel) -> DataFrame:
    """encoded scored: row, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = encoded.sparkSession.sparkContext.broadcast((model.label, model.step, model.under))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        label, step, under = shared.value
        for b in (x.slice(a, 1000) for x in batches for a in range(0, x.num_rows, 1000)):
            sizes = np.asarray(b.column(0).value_lengths())
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            path = np.zeros(len(flat) + len(sizes) + 1, np.int64)
            path[np.arange(len(flat)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = label[flat]
            each = step[path[:-1], path[1:]]  # of every word, and of the end
            starts = np.cumsum(sizes + 1) - sizes - 1
            part = np.add.reduceat(each, starts) if len(starts) else np.empty(0)
            own = np.concatenate([[0.0], np.cumsum(under[label[flat]])])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(part - (own[ends] - own[ends - sizes]))], names=["row", "part"])

    parts = encoded.select("ids", "row").mapInArrow(run, "row long, part double")
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    looked = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_half"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_rare"))
    end = float(np.log10(model.ends + 0.5))
    all_half = F.col("half") + F.coalesce("rare_half", F.lit(0.0))
    known = F.col("n_head") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(model.ends > 0))
    whole = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_head", "half").join(parts, "row").join(looked, "row", "left")
    return whole.select(
        "row", "doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (all_half + F.lit(end) - F.col("n_tokens") * F.lit(float(model.base_under))).alias("base_score"), (F.col("part") + all_half).alias("score"),
    )


def fit(docs: DataFrame, head: int = HEAD, **kw) -> tuple[DataFrame, DataFrame, ClassModel]:
    """(encoded rows, counts, model) of docs, learning from those not held out."""
    d = text_of(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    with small_batches(docs.sparkSession):
        counts = materialize(count_words(d.where(~F.col("held_out"))), "counts")
        top = counts.orderBy(F.desc("c"), "word").limit(head).toArrow()
        words, c = top.column("word").to_pylist(), top.column("c").to_numpy().astype(float)
        encoded = materialize(encode(d, words, c), "encoded")
        train = encoded.where(~F.col("held_out"))
        return encoded, counts, train_model(train, counts, words, train.count(), **kw)


def lm_scores(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs, learning from those not held out."""
    s = score(*fit(docs, **kw)).drop("row")
    return s.withColumn("perplexity", F.pow(F.lit(10.0), F.least(F.lit(300.0), -F.col("score") / F.col("n_tokens"))))
