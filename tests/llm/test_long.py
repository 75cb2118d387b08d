"""Texts of megabytes, whole, through the operators that read texts; page ids that are null or repeated."""

import random

from pyspark.sql import functions as F

from wayloom.llm import order_minhash, piece_codec, queries, quality, secret_scan, token_counts, url_filter

from .test_texts import brute_quality, brute_spans


def long_rows():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = [rng.choice(words) for _ in range(330_000)]
    text[170_000] = "password=abcdef9$"
    near = list(text)
    for k in rng.sample(range(len(text)), 5000):
        near[k] = rng.choice(words)
    near[-1] = "AKIA" + "Q7" * 10
    return [(1, " ".join(text)), (2, " ".join(near)), (3, "short one"), (4, " ".join(text[:1000]))]


def test_megabytes(spark, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    rows = long_rows()
    text = dict(rows)
    assert min(len(text[k].encode()) for k in (1, 2)) > 2_000_000
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    for r in piece_codec.encode_pieces(df.where("doc_id <> 2"), queries.tokenizer_file("piece_bpe_32k.model"), cache=1000, slice_bytes=1 << 20).collect():
        assert list(r.ids) == lib.encode(text[r.doc_id]) and r.decoded == text[r.doc_id]
    file = queries.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(file)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df.where("doc_id <> 2"), file, f"file://{tmp_path}/cache").collect()}
    for i in (1, 3, 4):
        n = len(tok.encode(text[i], add_special_tokens=False).ids)
        assert got[i] == (len(text[i].encode()), n, n > 2048)
    for r in secret_scan.secrets(df).collect():
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(text[r.doc_id]))
    for r in quality.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text[r.doc_id])
    assert {r.doc_id: r.class_id for r in order_minhash.near_classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_page_ids(spark):
    """Null and repeated page ids stay rows of their own and count in the templates."""
    urls = [(7, f"http://a.example.org/es/{k}") for k in range(9)] + [(7, "http://a.example.org/xx/1")] + [(None, "http://a.example.com/fr/1")] * 3 + [(None, None)]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("k", F.lit("clash")).repartition(3)
    got = [(r.page_id, r.host, r.rule, r.verdict) for r in url_filter.url_verdicts(df, queries.URL_RULES).collect()]
    assert len(got) == len(urls) and got.count((7, "a.example.org", "example.org/es/", "block")) == 9
    assert got.count((None, "a.example.com", "com/fr/", "allow")) == 3 and (None, "", None, "allow") in got
