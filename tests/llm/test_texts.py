"""Tokens, pieces, secrets, quality, repeats and language-model scores against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from wayloom.llm import brown_lm, piece_codec, quality, queries, repeat_spans, secret_scan, token_counts

from .data import docs, empty, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r[1] or "" for r in rows()] + ["  two  spaces ", "   執筆", "▁x", "x" * 500, "          " * 5 + "z", "\x00a\n\n b", "😀é"]
    m = piece_codec.model(path)
    ids = m.encode(texts)
    assert [x.tolist() for x in ids] == lib.encode(texts)
    assert m.decode(ids) == [lib.decode(x.tolist()) for x in ids]
    got = piece_codec.encode_pieces(docs(spark, extra=True), path).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((r[0], tuple(lib.encode(r[1] or ""))) for r in rows())
    assert all(r.decoded == (r.text or "") for r in got if "▁" not in (r.text or ""))
    assert piece_codec.encode_pieces(empty(spark), path).count() == 0
    back = piece_codec.decode_pieces(piece_codec.encode_pieces(docs(spark), path).drop("decoded"), path).collect()
    assert all(r.decoded == (r.text or "") for r in back if "▁" not in (r.text or ""))


def test_unigram_words_by_brute_force():
    m = piece_codec.model(queries.tokenizer_file("piece_bpe_32k.model"))
    m.bpe = False
    try:
        rng = random.Random(2)
        for _ in range(20):
            w = "▁" + "".join(rng.choice("thenigr") for _ in range(7))
            best = {0: 0.0}
            for i in range(1, len(w) + 1):
                best[i] = max(best[j] + (m.score[m.id_of[w[j:i]]] if w[j:i] in m.id_of else -math.inf) for j in range(i))
            assert sum(m.score[x] for x in m.viterbi([w])[0]) == best[len(w)]
    finally:
        m.bpe = True


def test_pieces_of_new_words_are_found_together():
    """Words that no text had before, with odd characters too: the library's pieces, in few Python calls a word (37 before, when each was cut and each border replayed alone)."""
    import cProfile
    import pstats

    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    rng = random.Random(8)
    parts = ["the", "ing", "tion", "er", "naï", "ß", "日", "本", "😀", "\x00", "▁", "q", "7", ".", "'", "  "]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(2, 7))) for _ in range(20)) for _ in range(1000)]
    m = piece_codec.PieceModel(open(path, "rb").read())
    p = cProfile.Profile()
    got = p.runcall(m.encode, texts)
    assert [x.tolist() for x in got] == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    assert pstats.Stats(p).total_calls < 10 * len(m.words)


def test_token_counts_and_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    lib, cache = Tokenizer.from_file(path), str(tmp_path / "cache")
    want = sorted((r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    for _ in range(2):
        got = token_counts.token_counts(docs(spark, extra=True), path, cache, limit=100).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    n = spark.read.parquet(cache).count()
    assert n == spark.read.parquet(cache).select("digest").distinct().count() < len(rows())  # nothing is encoded twice
    assert token_counts.token_counts(empty(spark), path, cache).count() == 0


def test_special_strings_in_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    texts = ["a<|endoftext|>b", "a <|ENDOFTEXT|> b", "  \n\t x\u0301 \n", "don't  STOP"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path, str(tmp_path / "c")).collect()}
    assert [got[i] for i in range(4)] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_of_other_tokenizers(spark, tmp_path):
    """A tokenizer that sees white space gets texts as they are."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), ["a  b\n\n c", "a b c", " a  b", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, path, str(tmp_path / "cache")).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_unsupported_models():
    def field(n, value):
        def varint(x):
            out = b""
            while x > 127:
                out, x = out + bytes([x & 127 | 128]), x >> 7
            return out + bytes([x])

        return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value

    plain = field(3, field(3, 1) + field(4, 0)) + field(2, field(3, 2))
    piece_codec.check_supported(plain)
    for bad in (field(3, field(4, 1)), field(3, field(4, 0) + field(2, b"map")), field(3, field(4, 0)) + field(1, field(1, b"x") + field(3, 4))):
        with pytest.raises(ValueError):
            piece_codec.check_supported(bad)
    with open(queries.tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        piece_codec.check_supported(f.read())


def brute_spans(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?i:(p[a]ssword|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets(spark):
    got = secret_scan.secrets(docs(spark, extra=True)).collect()
    want = []
    for r in rows():
        s = brute_spans(r[1] or "")
        n = Counter(k for k, _, _ in s)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((r[0], n["assign"], n["access"], n["hex"], hashlib.sha256(line.encode()).hexdigest()))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert secret_scan.secrets(empty(spark)).count() == 0
    assert not brute_spans("secret: token: abcdef") and not secret_scan.spans_of("secret: token: abcdef")


def test_ownership_and_redaction(spark):
    shared, own = "AKIA" + "Q1W2E3R4T5Y6U7I8", "AKIA" + "Z9X8C7V6B5N4M3L2"
    data = [(i, f"key {shared} end", "en", f"o{i}/r", 1) for i in range(5)] + [(9, f"é {own} x", "en", "me/r", 1), (10, None, "en", None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    verdict = {r.doc_id: (r.n_live, r.n_example) for r in secret_scan.secrets(df).collect()}
    assert verdict[0] == (0, 1) and verdict[9] == (1, 0) and verdict[10] == (0, 0)
    out = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert len(out) == 7 and out[9].text == "é <SECRET> x" and out[9].n_chars == 12 and out[0].text == data[0][1] and out[10].text is None


def brute_verdicts(data):
    """(live, example, weak) of each row (doc_id, text, source) by a plain scan over all values."""
    import math

    held, values = {}, []
    for _, text, source in data:
        own = set()
        for k, a, z in brute_spans(text or ""):
            v = text[a:z] if k != "assign" else re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", text[a:z])[1]
            own.add((k, v))
            held.setdefault(v, set()).add(source or "")
        values.append([v for _, v in own])

    def verdict(v):
        repos = held[v]
        if len({r.split("/")[0] for r in repos}) > 2 or len(repos) > 8:
            return 1
        n = Counter(v)
        return 0 if -sum(k / len(v) * math.log2(k / len(v)) for k in n.values()) >= 2.5 else 2

    return verdict, held


def test_secret_verdicts_by_brute_force(spark):
    """Owners and repositories decide; null and repeated ids keep their rows apart."""
    rng = random.Random(12)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(12)] + ["AKIA" + "A" * 16]
    data = [(rng.choice([None, 1, 2, i]), f"{prose(rng, 5)} {keys[i % 13]} and {keys[i * i % 13] if i % 5 == 0 else ''}", f"own/{i % 13}" if i % 13 in (0, 2, 5, 6, 12) else rng.choice(["a/x", "a/y", "b", "c/z", "d", None])) for i in range(80)]
    data += [(300 + i, f"{'f00d' * 6} in many places", f"owner/{i}") for i in range(9)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    verdict, held = brute_verdicts(data)
    want = []
    for d, t, s in data:
        n = [verdict(t[a:z]) for _, a, z in brute_spans(t)]
        want.append((d or -1, n.count(0), n.count(1), n.count(2)))
    got = sorted((r.doc_id if r.doc_id else -1, r.n_live, r.n_example, r.n_weak) for r in secret_scan.secrets(df).collect())
    assert got == sorted(want) and len({w[1:] for w in want}) > 2
    live = {v for v in held if verdict(v) == 0}
    out = [r.text for r in secret_scan.redact(df).collect()]
    assert len(out) == len(data) and live and not any(v in t for v in live for t in out)
    assert Counter(out) == Counter(re.sub("|".join(sorted(live)), "<SECRET>", t) for _, t, _ in data)


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    g = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if g[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark):
    got = quality.apply_policy(quality.ledger(docs(spark, extra=True))).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((r[0], *brute_quality(r[1])) for r in rows())
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality.filter_documents(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == sum(r.kept for r in got)
    assert quality.ledger(empty(spark)).count() == 0
    loss = {r.rule: (r.rejected, r.alone) for r in quality.ablation(quality.ledger(docs(spark))).collect()}
    assert loss["few_words"][0] == sum(r.n_words < 50 for r in got)
    assert loss["few_words"][1] == sum(r.failures == 1 for r in got)


def brute_repeats(data):
    seen, out = set(), {}
    for d, t in sorted({(r[0], (r[1] or "").encode()) for r in data}):
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if (w := t[i : i + 100]) in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, x in zip(t, gone) if not x)
        out[d] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [2 << 20, 400, 0])
def test_repeats(spark, most, monkeypatch):
    monkeypatch.setattr(repeat_spans, "INDEX_BYTES", most)  # 0: all groups are too large for an index
    want = brute_repeats(rows())
    got = repeat_spans.remove_repeats(docs(spark, extra=True)).collect()
    assert len(got) == len(rows()) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    assert sum(r.n_removed for r in got) > 0


def test_repeats_small(spark):
    assert repeat_spans.remove_repeats(empty(spark)).count() == 0
    data = [(None, "ab" * 90), (1, "ab" * 60), (2, "x" * 99), (3, "x" * 99), (4, "y" * 250)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeat_spans.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {None: (178, 1), 1: (120, 1), 2: (0, 0), 3: (0, 0), 4: (249, 1)}


def test_repeats_ids(spark):
    """Different texts under one doc_id, or under none, stay apart; equal rows share a result."""
    a, b, c = "".join(map(chr, range(33, 113))) * 2, "q" * 150, "0123456789" * 30
    data = [(None, a), (None, b), (5, c), (5, a), (5, c), (7, "z" + b)]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeat_spans.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(2)).collect())
    assert got == [(False, 0, 150, 149), (False, 0, 160, 0), (True, 5, 160, 160), (True, 5, 300, 290), (True, 5, 300, 290), (True, 7, 151, 150)]


def test_repeats_crowd(spark):
    """Many versions of a passage, longer and shorter, in more than eight documents."""
    rng = random.Random(8)
    base = prose(rng, 60)
    data = [(i, prose(rng, rng.randint(0, 12)) + base[rng.randint(0, 90) : rng.randint(120, 300)] + prose(rng, rng.randint(0, 12))) for i in range(120)]
    data += [(200 + i, base[: 100 + i] + "!" + base[100 + i :]) for i in range(30)]
    want = brute_repeats(data)
    got = repeat_spans.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_repeats_long(spark):
    """A text of several slices, with passages that repeat across their borders."""
    rng = random.Random(4)
    block = bytes(rng.choice(b"abcdefghij") for _ in range(1 << 20)).decode()
    parts = [block[i:] + block[:i] for i in (0, 1 << 19)]
    long = parts[0] + "".join(map(str, range(800_000))) + parts[1] + block[1000:1300]
    data = [(1, block[5000:5400] + "x" + long[(4 << 20) - 150 : (4 << 20) + 150]), (2, long), (3, long[(4 << 20) - 300 : (4 << 20) + 300] + "y")]
    want = brute_repeats(data)
    got = repeat_spans.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def brute_matches(query, strings):
    out = []
    for i in range(len(query)):
        n = 0
        while n < 100 and i + n < len(query) and any(query[i : i + n + 1] in s for s in strings):
            n += 1
        out.append(n)
    return out


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcdefgh"])
def test_run_index_by_brute_force(letters):
    import numpy as np

    rng = random.Random(3)
    strings = [bytes(rng.choice(letters) for _ in range(rng.randint(100, 200))) for _ in range(8)]
    strings[5], strings[6], strings[7] = strings[0][20:] + strings[1][:40], strings[3][:150] + b"~", strings[4][3:] + strings[3][:30]
    slots = [0, 0, 1, 1, 1, 0, 1, 1]
    a = [np.frombuffer(s, np.uint8) for s in strings]
    found = repeat_spans.RunIndex(a[:5], slots[:5]).matches(a[5:], slots[5:])
    for q, slot, m in zip(strings[5:], slots[5:], found, strict=True):
        assert m.tolist() == brute_matches(q, [s for s, k in zip(strings[:5], slots[:5], strict=True) if k == slot])


def test_repeated_windows_by_brute_force():
    import numpy as np

    rng = random.Random(5)
    bases = [bytes(rng.choice(x) for _ in range(400)) for x in (b"abc", b"def", b"gh", b"ij", b"klmn")]  # groups hold no equal windows
    groups = [[b[(a := rng.randint(0, 200)) : a + rng.randint(100, 176)] for _ in range(n)] for b, n in zip(bases, (1, 2, 3, 7, 20), strict=True)]
    marks = repeat_spans.repeated_windows([[np.frombuffer(s, np.uint8) for s in g] for g in groups])
    for g, m in zip(groups, marks, strict=True):
        for j, s in enumerate(g):
            assert m[j].tolist() == [any(s[i : i + 100] in t for t in g[:j]) for i in range(len(s) - 99)]


def test_language_model(spark):
    got = brown_lm.lm_scores(docs(spark, extra=True), head=50, items=30, classes=8).collect()
    split = lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1
    tokens = {(r[0], r[1]): (r[1] or "").encode().lower().split() + [None] for r in rows()}
    c = Counter(t for r in rows() if not split(r) for t in tokens[r[0], r[1]])
    n, v = sum(c.values()), len(c)
    want = sorted((r[0], split(r), len(tokens[r[0], r[1]]), sum(c[t] > 0 for t in tokens[r[0], r[1]]), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[r[0], r[1]]), 6)) for r in rows())
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # classes help on unseen texts
    assert brown_lm.lm_scores(empty(spark)).count() == 0


def test_language_model_by_brute_force(spark):
    """The model's own classes, and probabilities by plain counting; the exchange by Spark jobs raises the mutual information."""
    df = docs(spark)
    encoded, counts, m = brown_lm.fit(df, head=120, items=20, classes=6)
    place = {w: k + 1 for k, w in enumerate(m.words)}
    cls = lambda w: m.label[place.get(w, len(m.words) + 1 + brown_lm.signature(w))]
    split = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    data = [(r[0], (r[1] or "").encode().lower().split()) for r in rows()]
    pairs, c = Counter(), Counter()
    for d, ws in data:
        if not split(d):
            path = [0, *map(cls, ws), 0]
            pairs.update(zip(path, path[1:], strict=False))
            c.update(ws)
    classes = range(6)
    into, outof, total = Counter(), Counter(), sum(pairs.values())
    for (a, b), n in pairs.items():
        into[b] += n
        outof[a] += n
    mass, kinds = Counter(), Counter()
    for w, n in c.items():
        mass[cls(w)] += n
        kinds[cls(w)] += 1
    share = {b: (into[b] + 0.5) / (total + 0.5 * 6) for b in classes}
    want = []
    for d, ws in data:
        path = [0, *map(cls, ws), 0]
        x = sum(math.log10((pairs[a, b] + 10 * share[b]) / (outof[a] + 10)) for a, b in zip(path, path[1:], strict=False))
        x += sum(math.log10((c[w] + 0.5) / (mass[cls(w)] + 0.5 * (kinds[cls(w)] + 1))) for w in ws)
        want.append((d or -1, round(x, 5)))
    got = brown_lm.score(encoded, counts, m).collect()
    assert sorted((r.doc_id or -1, round(r.score, 5)) for r in got) == sorted(want)
    start = brown_lm.fit(df, head=120, items=20, classes=6, rounds=0)[2]
    train = encoded.where("not held_out")
    assert brown_lm.log_sum(brown_lm.class_pairs(train, m.label, 6)) > brown_lm.log_sum(brown_lm.class_pairs(train, start.label, 6))
    assert len(set(m.label[1 : len(m.words) + 1])) > 2 and (m.label[1:] > 0).all()


def test_exchange_raises_mutual_information():
    import numpy as np

    rng = np.random.default_rng(4)
    own = np.concatenate([[0], rng.integers(1, 4, 40)])
    next_class = {0: [1, 2, 3], 1: [2], 2: [3], 3: [1]}
    pairs = np.zeros((41, 41))
    for i in range(41):
        for j in range(1, 41):
            if own[j] in next_class[own[i]]:
                pairs[i, j] = rng.integers(1, 9)

    def information(label):
        one = np.eye(4)[label]
        n = one.T @ pairs @ one
        f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return f(n) - f(n.sum(0)) - f(n.sum(1))

    start = np.zeros(41, int)
    start[1:] = np.arange(40) % 3 + 1
    found = brown_lm.exchange(pairs, 4, passes=8)
    assert information(found) > information(start) and information(found) >= information(own) - 1e-6


def test_language_model_without_training_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = brown_lm.lm_scores(spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 0, 0, 0.0)] * 3


def test_language_model_holds_few_texts_at_once(spark, monkeypatch):
    """Jobs over texts hand a bounded number of rows and bytes to a worker, whatever a task holds; the setting is as before afterwards."""
    key, seen, write, before = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, brown_lm.materialize, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(brown_lm, "materialize", lambda df, name: (seen.setdefault(name, int(spark.conf.get(key))), write(df, name))[1])
    encoded, counts, m = brown_lm.fit(docs(spark), head=120, items=20, classes=6)
    assert {"counts", "encoded", "labels"} <= set(seen) and max(seen.values()) <= 1000
    assert spark.conf.get(key) == before
    assert encoded.count() == len(rows())
