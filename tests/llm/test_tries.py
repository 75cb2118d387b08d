"""Prefix trie, fill-in-middle and top-k search against brute force, with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.llm import fill_middle, prefix_trie, top_k
from wayloom.llm.common import GAP

CONV = "conv_id long, turn long, role string, text string"


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, 90), 1000, 1001, 1019]:
        if c % 20 == 0 and c % 40:
            continue  # groups without their first conversation
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "one two", " a\tb  c ", "x"])))
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (40, None, None, "zero"), (None, 0, "user", "lost")]
    rows += [(200, t, "user", f"long {t % 5}") for t in range(60)] + [(203, t, "user", f"long {t % 5}") for t in range(45)]
    rng.shuffle(rows)
    return rows


def trie_by_hand(rows, order=lambda r: (r[1] is not None, r[1])):
    convs = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            convs[r[0]].append(r)
    turns = {c: [(r[2] or "", r[3] or "") for r in sorted(rs, key=order)] for c, rs in convs.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        made[c] = tuple(turns.get(base, [])[:h]) + tuple(own[h:])
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    out, sums = {}, {}
    for seq in sorted(members, key=len, reverse=True):
        own = (len(members[seq]) - 1) * (len([w for w in re.split(GAP, seq[-1][1]) if w]) if seq else 0)
        sums[seq] = (sum(sums[k][0] for k in kids[seq]) or 1, own + sum(sums[k][1] for k in kids[seq]))
        ends = ",".join(map(str, sorted(c for c in members[seq] if made[c] == seq)))
        out[min(members[seq]), len(seq)] = (min(members[seq[:-1]]) if seq else None, len(members[seq]), len(kids[seq]), *sums[seq], hashlib.sha256(ends.encode()).hexdigest())
    return out


def tried(df):
    nodes, ends = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(df)))
    rows = prefix_trie.with_ends(nodes, ends).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_trie_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 8)  # chains longer than a stretch
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).repartition(3)
    for c in ("key", "d", "x", "y", "owner", "n", "lo", "hi", "chunk", "words"):
        df = df.withColumn(c, F.lit("clash"))
    assert tried(df) == trie_by_hand(rows)


def test_trie_of_one_long_conversation_and_copies(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(700)] + [(c, 0, "user", "same") for c in range(100, 160)]
    df = spark.createDataFrame(rows, CONV).repartition(4)
    assert tried(df) == trie_by_hand(rows)


def test_trie_of_empty_tables(spark):
    assert tried(spark.createDataFrame([], CONV)) == {}
    assert tried(spark.createDataFrame([(None, 1, "user", "x")], CONV)) == {}


TEXTS = [None, "", "a", "naïve 日本語  two  words\n", "has <S> in it", "<P", "<<P<S<M", " \t lead", "line\n\nline\n", "x" * 300_000 + " é" * 900_000]


def test_fill_middle_by_brute_force(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab é\n<P>S日") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    rows = [(None if i == 5 else i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(3)
    made = fill_middle.fill_in_middle(df)
    got = made.withColumn("whole", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    seen = set()
    for i, t in rows:
        t, r = t or "", by_id[i]
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        n = len(t)
        a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = t[:a], t[a:z], t[z:]
        plain = not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output, r.whole) == (n, form, out, t)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if plain else (len(p), len(m)))
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize(("units", "pattern"), [("points", r"(?s)."), ("words", r"[ \t-\r]+|[^ \t-\r]+"), ("lines", r"[^\n]*\n|[^\n]+")])
def test_ranks_of_units(units, pattern):
    rng = random.Random(5)
    for t in [t or "" for t in TEXTS[:9]] + ["".join(rng.choice("ab é\n\t 日") for _ in range(rng.randint(0, 40))) for _ in range(300)]:
        r = fill_middle.Ranks(t, units)
        ends = [0, *(m.end() for m in re.finditer(pattern, t))]
        assert [r.offset(u) for u in range(len(r) + 1)] == ends
        assert r.found == any(s in t for s in fill_middle.SENTINELS)


def test_fill_middle_by_words_restores(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = fill_middle.fill_in_middle(df, units="words", plain_from=100).withColumn("whole", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {r.doc_id: r.whole for r in got} == {i: t or "" for i, t in enumerate(TEXTS)}
    with pytest.raises(ValueError, match="units"):
        fill_middle.fill_in_middle(df, units="tokens")
    with pytest.raises(ValueError, match="sentinels"):
        fill_middle.fill_in_middle(df, sentinels=("<P>", "<<S", "<M>"))


VECTORS = "vec_id long, embedding array<double>"


def best_by_hand(rows, k=20, every=20):
    ints = [(i, [math.floor(64 * Fraction(x)) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (q, e) in enumerate(ints):
        if q is None or q % every:
            continue
        found = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(e, f)))), c is None, c or 0, b) for b, (c, f) in enumerate(ints) if b != a)
        out += [(q, n + 1, None if none else c, -s) for n, (s, none, c, _) in enumerate(found[:k])]
    return sorted(out, key=repr)


def vectors():
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(12) * rng.choice([0.2, 1])).round(3).tolist()) for i in range(260)]
    rows += [(300 + i, rows[0][1]) for i in range(70)]  # copies: more ties than k
    rows += [(20, rows[3][1]), (None, rows[0][1]), (400, None), (420, [1.0, None]), (440, [math.nan] * 12), (460, [math.inf] * 12), (480, []), (500, [0.0] * 12), (520, [1.0]), (540, [3.0] * 15)]
    return rows + [rows[1], rows[20]]


@pytest.mark.parametrize("blocks", [{}, {"query_rows": 7, "candidate_rows": 40, "slice_rows": 16}])
def test_top_k_by_brute_force(spark, blocks):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("clash")).withColumn("score", F.lit("clash")).repartition(3)
    got = sorted((tuple(r) for r in top_k.top_k(df, **blocks).collect()), key=repr)
    assert got == best_by_hand(rows)


def test_top_k_of_huge_weights_and_few_rows(spark):
    rows = [(20 * i, [s * m, 1.5]) for i, (s, m) in enumerate([(1, 1e9), (-1, 1e9), (1, 1e18), (1, 1e300), (-1, 1.7e308), (1, 0.01)])]
    df = spark.createDataFrame(rows, VECTORS)
    assert sorted((tuple(r) for r in top_k.top_k(df).collect()), key=repr) == best_by_hand(rows)
    assert top_k.top_k(df.limit(1)).count() == 0
    assert top_k.top_k(df.limit(0)).count() == 0


def test_scores_of_sparse_rows():
    rng = np.random.default_rng(7)
    q, c = (rng.integers(-9, 9, (n, 30)) * (rng.random((n, 30)) < share) for n, share in ((25, 0.1), (64, 0.2)))
    assert (top_k.scores(q, top_k.post(c), len(c)) == c @ q.T).all()
