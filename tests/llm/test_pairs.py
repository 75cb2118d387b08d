"""Near-duplicates, embeddings, mixing, URLs and the pipeline against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from wayloom.llm import embed_dedup, mixing, order_minhash, queries, url_filter
from wayloom.llm.common import connected_components

from .data import docs, empty, prose, rows


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(30)]
    want = components({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in want} == want


def texts_of(rng, n, edits, kinds=1):
    """A text of n words and a copy with so many words changed, or dropped and inserted too."""
    words = [f"w{i}" for i in range(3000)]
    a = [rng.choice(words) for _ in range(n)]
    b = list(a)
    for k in sorted(rng.sample(range(n), edits), reverse=True):
        kind = rng.randrange(kinds)
        b[k : k + (kind < 2)] = [rng.choice(words)] if kind != 1 else []
    return a, b


def sequence(words):
    return order_minhash.labelled(order_minhash.word_hashes([" ".join(words).encode()])[0])


def test_alignment_by_brute_force():
    """Words under windows of five that match in the same order, over the longer text."""
    rng = random.Random(0)
    for _ in range(400):
        a, b = texts_of(rng, rng.randint(5, 60), rng.randint(0, 5), 3)
        windows = [["  ".join(x[i : i + 5]) for i in range(len(x) - 4)] for x in (a, b)]
        if any(len(set(w)) < len(w) for w in windows) or min(map(len, windows)) < 1:
            continue
        shared = set(windows[0]) & set(windows[1])  # edits keep the order
        sides = [len({k for i, w in enumerate(ws) if w in shared for k in range(i, i + 5)}) for ws in windows]
        true = min(sides) / max(len(a), len(b))
        s, t = sequence(a), sequence(b)
        got = order_minhash.alignment(s, t)
        assert got == order_minhash.alignment(t, s)
        assert abs(got - true) < 1e-12 if true >= 0.8 else got < 0.8
        assert (len(order_minhash.aligned([s, t], np.array([[False, True], [False, False]]))[0]) > 0) == (true >= 0.8)


def test_alignment_of_moved_words():
    """Matches out of order: one side of the move is left out, whichever text comes first."""
    rng = random.Random(6)
    for _ in range(100):
        a = [f"w{rng.randrange(40)}" for _ in range(120)]
        k, n = rng.randrange(90), rng.choice([6, 14])
        b = a[:k] + a[k + n : k + 2 * n] + a[k : k + n] + a[k + 2 * n :]
        s, t = sequence(a), sequence(b)
        got = order_minhash.alignment(s, t)
        assert got == order_minhash.alignment(t, s) and got <= 1 - n / 120 + 1e-9
        assert (len(order_minhash.aligned([s, t], np.array([[False, True], [False, False]]))[0]) > 0) == (got >= 0.8)


def test_recall_by_edit_rate():
    """Copies with 1 to 5 % of their words changed share a sketch and align."""
    rng = random.Random(1)
    for n in (30, 100, 400):
        for rate in (0.01, 0.02, 0.03, 0.05):
            found = 0
            for _ in range(150):
                s, t = map(sequence, texts_of(rng, n, max(1, int(rate * n)), 3))
                found += order_minhash.alignment(s, t) >= 0.8 and (order_minhash.sketches(s) == order_minhash.sketches(t)).any()
            assert found >= 0.9 * 150, (n, rate, found)


def test_texts_that_share_a_passage_stay_apart():
    rng = random.Random(2)
    passage, (a, _), (b, _) = (texts_of(rng, 60, 0)[0], texts_of(rng, 40, 0), texts_of(rng, 40, 0))
    assert order_minhash.alignment(sequence(passage + a), sequence(passage + b)) < 0.8
    assert order_minhash.alignment(sequence(a + passage), sequence(passage + b)) < 0.8


def near_brute(data):
    seq = {}
    for d, t in data:
        h, _ = order_minhash.word_hashes([(t or "").encode()])
        seq[d] = order_minhash.labelled(h)
    ids = sorted(seq)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(seq[a]) and len(seq[b]) and order_minhash.alignment(seq[a], seq[b]) >= 0.8]
    return components(ids, links)


def test_near_duplicates(spark):
    rng = random.Random(9)
    data = [(r[0], r[1]) for r in rows()]
    for g in range(6):  # groups of near copies, one of them large
        base = prose(rng, 150).split()
        for k in range(60 if g == 0 else 4):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"edit{g}{k}{rng.randrange(99)}"
            data.append((1000 + g * 100 + k, " ".join(w)))
    want = near_brute(data)
    got = order_minhash.near_classes(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(data)
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_duplicates_crowd(spark, monkeypatch):
    """Every link of a crowd around one passage counts: all pairs that share a sketch and align, with blocks of any size."""
    rng = random.Random(21)
    head, tails = prose(rng, 120).split(), [prose(rng, 60).split() for _ in range(6)]
    data = []
    for i in range(150):
        w = head + tails[i % 6]
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"edit{i}x{rng.randrange(99)}"
        data.append((i, " ".join(w)))
    data += [(500, data[140][1]), (140, data[140][1])]  # a copy and a repeated row
    seq = [order_minhash.labelled(order_minhash.word_hashes([t.encode()])[0]) for _, t in data[:150]]
    keys = [order_minhash.sketches(s) for s in seq]
    links = [(a, b) for a in range(150) for b in range(a + 1, 150) if (keys[a] == keys[b]).any() and order_minhash.alignment(seq[a], seq[b]) >= 0.8]
    want, n = components(range(150), links), [0] * 150
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert max(n) > 8 and len(set(want.values())) > 1
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for block in (256, 16):
        monkeypatch.setattr(order_minhash, "BLOCK", block)
        got = order_minhash.near_classes(df).collect()
        assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, want[i], n[i]) for i in range(150)} | {(500, want[140], n[140])}


def test_near_duplicates_small(spark):
    assert order_minhash.near_classes(empty(spark)).count() == 0
    data = [(1, None), (2, ""), (3, "one two"), (4, "one  two"), (5, "one three"), (None, "x y z")]
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, None: None}


def test_near_duplicates_ids(spark):
    """Null and repeated ids, equal rows, and columns named like the operator's own."""
    rng = random.Random(4)
    a, b, c = (prose(rng, 60) for _ in range(3))
    data = [(5, a), (5, b), (5, b), (None, a + " end"), (None, c), (9, c + " end"), (None, ""), (2, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    for name in ("id", "digest", "sketches", "n", "row", "class_id", "z", "key", "k"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted((r.doc_id or -1, r.class_id or -1, r.kept, r.n_links) for r in order_minhash.near_classes(df).collect())
    want = [(5, 5, True, 1), (5, 5, True, 0), (5, 5, True, 0), (-1, 5, False, 1), (-1, 9, False, 1), (9, 9, True, 1), (-1, -1, True, 0), (2, 2, True, 0)]
    assert got == sorted(want)


def test_vectors_ties(spark):
    """Repeated ids and cosines on the threshold."""
    x, y = [1.0, 0.0], [0.95, (1 - 0.95**2) ** 0.5]
    data = [(1, x), (1, y), (2, x), (3, [2.0, 0.0]), (None, x), (4, [-1.0, 0.0])]
    got = sorted((r.vec_id or -1, r.n_links) for r in embed_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), cosine=0.9499).collect())
    assert got == sorted([(1, 4), (1, 4), (2, 4), (3, 4), (-1, 4), (4, 0)])
    got = sorted((r.vec_id or -1, r.n_links) for r in embed_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>"), cosine=0.9501).collect())
    assert got == sorted([(1, 3), (1, 0), (2, 3), (3, 3), (-1, 3), (4, 0)])


def test_mixing_ties(spark):
    """Rows of one id share their hash: size decides, then any order, and nothing is lost."""
    data = [(7, " ".join(["w"] * (i % 5)), "ab"[i % 2]) for i in range(60)] + [(None, "x y z", None)] * 9
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    one, two = (sorted((r.doc_id or -1, r.size, r.taken, r.source or "") for r in mixing.mix(d).collect()) for d in (df, df.repartition(5)))
    assert one == two and len(one) == len(data)
    size = {}
    for _, n, _, s in one:
        size[s or None] = size.get(s or None, 0) + n
    for s, target in brute_targets(size).items():
        assert abs(sum(t for _, _, t, x in one if (x or None) == s) - target) <= 4  # the longest document


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    v = [base[i % 40] + (0.05 if i % 3 else 0.2) * rng.standard_normal(16) for i in range(300)] + [base[0]] * 50
    data = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    data += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0] * 8), (905, [float("inf")] + [1.0] * 15), (906, [2.0] * 8), (907, [])]
    good = {i: np.array(x) for i, x in data if x and None not in x and np.isfinite(x).all() and any(x)}
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    want = components([i for i, _ in data], links)
    n = {i: 0 for i, _ in data}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("e", F.lit(1))
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df, recall=0.9999, block=32).collect()}
    assert len(got) == len(data)
    found = sum(r.n_links for r in got.values())
    assert 0.99 * sum(n.values()) <= found <= sum(n.values()) and all(r.n_links <= n[i] for i, r in got.items())
    assert sum(r.component_id == want[i] for i, r in got.items()) >= 0.98 * len(got)
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_at_production_parameters(spark):
    """Recall against brute force with the default tables, buckets and blocks: pairs just above the threshold too."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((120, 32))
    v = np.concatenate([base[i % 120] + rng.choice([0.05, 0.2, 0.3]) * rng.standard_normal(32) for i in range(1500)]).reshape(-1, 32).astype(np.float32)
    v = np.concatenate([v, v[:50]])
    x = v.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    for kw in ({}, {"fill": 24}, {"block": 40}):  # one bucket's worth; many buckets; buckets of many blocks
        got = {r.vec_id: r for r in embed_dedup.near_vectors(df, **kw).collect()}
        n = np.array([got[i].n_links for i in range(len(v))])
        assert (n <= near.sum(1)).all() and n.sum() >= 0.98 * near.sum()
        band = near & (x @ x.T < 0.96)
        assert band.sum() > 100 and near.sum() - n.sum() <= 0.02 * band.sum()  # even if every lost pair is one of the band
        want = components(range(len(v)), np.argwhere(near).tolist())
        assert sum(got[i].component_id == want[i] for i in want) >= 0.97 * len(want)


def brute_targets(size):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > 2 * size[s]]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: 2.0 * size[s] for s in over}


def test_mixing(spark):
    df = docs(spark, extra=True)
    got = mixing.mix(df).collect()
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
    want = brute_targets(size)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
    for s in size:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= max(r.size for r in got)
    assert sum(r.taken for r in got) == int(1.5 * sum(size.values()) + 0.5)
    assert sum(0 < r.taken % r.size for r in got if r.size) <= 1  # the cut in virtual time ends the mix, not the targets
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs(spark, extra=True).repartition(5), bucket_rows=3).collect()))
    order = mixing.mixed_order(df).collect()
    assert [r.virtual_finish for r in order] == sorted(r.virtual_finish for r in order)
    assert sum(r.words for r in order) == sum(r.taken for r in got)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_budget(spark):
    """Packets are served in the order of virtual finish time, and the total budget cuts that order."""
    df = docs(spark)
    full = {r.source: r.target for r in mixing.mix(df).collect()}
    q = mixing.queue(df).select("*", F.monotonically_increasing_id().alias("row"))
    served = mixing._served(q, 0.7, 4).collect()
    packets = []
    for r in served:
        for n in (0, 1):
            before = r.before + n * r.source_size
            if r.size:
                packets.append(((before + r.size) / full[r.source], r.name, before, r.row, r.size))
    left, want = int(0.7 * sum(r.size for r in served) + 0.5), {}
    for _, _, _, row, words in sorted(packets):
        want[row] = want.get(row, 0) + min(words, left)
        left -= min(words, left)
    assert {r.row: sum(x.words for x in r.packets) for r in served} == {r.row: want.get(r.row, 0) for r in served}


def test_urls(spark):
    urls = ["http://example.org/es/1", "https://a.example.org/en/12?x", "http://b.org/x", "HTTP://EXAMPLE.COM/de/9#f", "x://c.com/fr/", "no host", None, "http://d.net", "http://notexample.org/es/", "http://e.com?q=/de/", "a://b://c/de/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("segment", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(df, queries.URL_RULES).collect()}
    assert got[0] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("b.org", "/x", "org/", "allow")
    assert got[3] == ("example.com", "/de/9", "com/de/", "block")
    assert got[4] == ("c.com", "/fr/", "com/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("d.net", "", None, "allow") and got[8][2] == "org/" and got[9] == ("e.com", "", None, "allow")
    assert got[10] == ("b:", "//c/de/", None, "allow")
    assert url_filter.url_verdicts(df.limit(0), queries.URL_RULES).count() == 0


def test_templates(spark):
    """A host's blocked branch stays apart and takes its unlabelled pages along; variable segments become wildcards."""
    rules = [("block", "h.com/ads/a"), ("allow", "h.com/news/a")]
    urls = [f"http://h.com/{kind}/{c}{i}/p{i}" for kind in ("ads", "news") for c in "ab" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.url_verdicts(df, rules).collect()
    assert {(r.template, r.verdict) for r in got} == {("/ads/*/*", "block"), ("/news/*/*", "allow")}


def test_templates_inherit(spark):
    """Branches without labels take their host's share; similar branches merge; deep and long paths are read whole."""
    rules = [("block", "spam.com/a"), ("block", "spam.com/b"), ("allow", "spam.com/c"), ("allow", "good.com/a")]
    urls = [f"http://{h}/{kind}/p{i}" for h in ("spam.com", "good.com", "www.spam.com") for kind in ("a", "b", "bb", "c", "d") for i in range(30)]
    urls += ["http://spam.com/" + "d/" * 3000, *urls[:5]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.url_verdicts(df, rules).collect()
    got = {urls[r.page_id]: r for r in rows}
    assert len(rows) == len(urls)
    assert got["http://spam.com/d/p1"].rule is None and got["http://spam.com/d/p1"].verdict == "block"
    assert got["http://www.spam.com/d/p1"].verdict == "block" and got["http://good.com/d/p1"].verdict == "allow"
    assert got["http://spam.com/a/p1"].template == got["http://spam.com/b/p1"].template == got["http://spam.com/bb/p1"].template == "/*1/*"
    assert got["http://spam.com/c/p1"].template == "/c/*" and got["http://spam.com/d/p1"].template == "/*/*"
    assert got[urls[450]].template.count("/") == 4
