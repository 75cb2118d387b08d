"""The pipeline's stages against brute-force versions, each on its own input."""

import random
import re
from collections import Counter

from .data import docs, empty, prose, rows
from .test_pairs import brute_targets, near_brute
from .test_texts import brute_quality, brute_spans, brute_verdicts


def test_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    from wayloom.llm.queries import tokenizer_file

    stage = dict(corpus_pipeline.STAGES)
    df, data = docs(spark), rows()

    def good(t):
        n_words, chars, symbols, dup_lines, repeats = brute_quality(t)
        lines = sum(1 for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        return n_words >= 50 and 100 * repeats <= 50 * n_words and 2 * n_words <= chars <= 20 * n_words and 10 * symbols <= 3 * n_words and 10 * dup_lines <= 5 * lines

    kept = stage["quality_rules"](spark, df, str(tmp_path))
    assert kept.columns == df.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, (r for r in data if good(r[1]))))
    masked = stage["secret_scans"](spark, df, str(tmp_path))
    verdict, held = brute_verdicts([(r[0], r[1], r[3]) for r in data])
    live = sorted((v for v in held if verdict(v) == 0), key=len, reverse=True)
    assert masked.columns == df.columns and masked.count() == len(data) and not any(v in (r.text or "") for v in live for r in masked.collect())
    clean = [r for r in data if not brute_spans(r[1] or "")]
    assert not Counter(map(repr, clean)) - Counter(repr(tuple(r)) for r in masked.collect())
    mixed = [tuple(r) for r in stage["mixing"](spark, df, str(tmp_path)).collect()]
    size, served = Counter(), Counter()
    for r in data:
        size[r[3]] += len((r[1] or "").split())
    for r in mixed:
        served[r[3]] += len(r[1].split())
    longest = max(len((r[1] or "").split()) for r in data)
    assert all(abs(served[s] - t) <= longest for s, t in brute_targets(size).items())
    assert set(mixed) <= set(data) and max((Counter(mixed) - Counter(data) - Counter(data)).values(), default=0) == 0
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    pieces = sorted((repr((r.doc_id, r.source)), list(r.ids)) for r in stage["sentencepiece"](spark, df, str(tmp_path)).collect())
    assert pieces == sorted((repr((r[0], r[3])), lib.encode(r[1] or "")) for r in data)


def test_mixing_order(spark, tmp_path):
    """What is served comes in the order of virtual time: any part of it is mixed to the weights."""
    import corpus_pipeline

    rng = random.Random(2)
    data = [(i, prose(rng, 20), "en", "abc"[i % 3], 1) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = [r.source for r in corpus_pipeline.mixing_stage(spark, df, str(tmp_path)).collect()]
    target = brute_targets({s: 300 * 20 for s in "abc"})
    for k in (300, 600):
        part = Counter(out[:k])
        assert all(abs(part[s] / k - target[s] / sum(target.values())) < 0.03 for s in "abc")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    quality_kept = corpus_pipeline.quality_stage(spark, table, str(tmp_path))
    near = corpus_pipeline.near_dedup_stage(spark, quality_kept, str(tmp_path))
    assert near.columns == table.columns
    left = [(r.doc_id, r.text) for r in quality_kept.collect()]
    want = near_brute(left)
    assert sorted(r.doc_id for r in near.collect()) == sorted({d for d in want if want[d] == d})
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in near.collect()}
    assert all(len(r.ids) == r.n_pieces for r in out)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0, name


def test_pipeline_ids(spark, tmp_path):
    """Null and repeated ids: different texts stay, near copies go once, and a row is served as often as the mix says."""
    import corpus_pipeline

    rng = random.Random(3)
    texts = [prose(rng, 80) for _ in range(12)]
    data = [(None, t, "en", "a", len(t)) for t in texts[:4]] + [(7, t, "en", "b", len(t)) for t in texts[4:8]] + [(8 + i, t, "en", "c", len(t)) for i, t in enumerate(texts[8:])]
    data += [(7, texts[0] + " end", "en", "b", 1), (None, texts[9], "en", "a", 1)]  # near copies; rows with smaller ids stay
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = corpus_pipeline.near_dedup_stage(spark, df, str(tmp_path))
    want = data[1:4] + data[4:12] + [data[12]]
    assert near.columns == df.columns and sorted(map(repr, map(tuple, near.collect()))) == sorted(map(repr, want))
    given = [r for r in data if r[3] == "a"] * 40 + [r for r in data if r[3] != "a"]
    got = corpus_pipeline.mixing_stage(spark, spark.createDataFrame(given, df.schema), str(tmp_path)).collect()
    size, served = {}, {}
    for r in given:
        size[r[3]] = size.get(r[3], 0) + len(r[1].split())
    for r in got:
        served[r.source] = served.get(r.source, 0) + len(r.text.split())
    for s, target in brute_targets(size).items():
        assert abs(served[s] - target) <= 81, s
