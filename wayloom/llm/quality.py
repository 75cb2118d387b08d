"""Quality rules as a ledger of bitmasks, with DataFrame functions alone.

ledger() evaluates every rule once for each document and stores the measurements and one bit for each failed rule.
Policies are versioned masks over those bits: a document is kept if no enforced bit is set. ablation() tells by bitwise
aggregation how many documents each rule rejects, and how many it alone rejects, under a policy.

Words are runs of characters other than ASCII white space. Defined results: a null text has no words (so it fails the
least number of words); long texts are measured whole; ratios with no words count as 0; rows are judged each, whatever their
ids: repeated rows give repeated results, null and repeated ids stay; a measurement equal to a rule's limit passes; an
empty table gives an empty ledger; the documents' other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import GAP, words_of

SYMBOLS = "#*$%&|<>"
#: Rules in the order of their bits: name, and the failing condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
]
#: The policies: version and the rules it enforces. base holds the fixed rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(name for name, _ in RULES),
}


def mask(names) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in names)


def measure(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id and the measurements; with keep, the row itself too, as row. Each step's columns feed the next, so that no array is computed twice."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([F.struct(*docs.columns).alias("row")] if keep else []))
    row = ["row"] if keep else []
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0)
    bare = F.length(F.translate("text", SYMBOLS, ""))
    m = t.select("doc_id", *row, words_of(F.col("text")).alias("w"), lines.alias("l"), (F.length("text") - bare).cast("long").alias("n_symbols"))
    window = F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2)))
    m = m.select(
        "doc_id", *row, "n_symbols", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 3, F.slice(window, F.lit(1), F.size("w") - 2)).otherwise(F.array().cast("array<long>")).alias("h"),
    )
    # hashes that occur twice, from the sorted hashes
    m = m.withColumn("s", F.sort_array("h"))
    m = m.withColumn("d", F.array_distinct(F.filter("s", lambda x, i: (i > 0) & (x == F.get("s", i - 1)))))
    # the places of those windows: of the texts that have any; few hashes are looked up one by one, many by sorting places
    few = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains("d", F.get("h", i)))
    pair = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    m = m.withColumn("p", F.when(F.size("d") > 8, pair).otherwise(F.array().cast("array<struct<h:long,i:int>>")))
    same = lambda x, y: x["h"] == y["h"]
    many = F.sort_array(F.transform(F.filter("p", lambda x, i: F.coalesce(same(x, F.get("p", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("p", i + 1)), F.lit(False))), lambda x: x["i"]))
    m = m.withColumn("at", F.when(F.size("d") == 0, F.array().cast("array<int>")).when(F.size("d") > 8, many).otherwise(few))
    # each window covers three words, less what the next one covers too
    gaps = F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3))))
    return m.select("doc_id", *row, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def ledger(docs: DataFrame, keep: bool = False) -> DataFrame:
    """The measurements and failures bigint: bit i is set if rule i of RULES fails. To filter a ledger, write it first."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measure(docs, keep).withColumn("failures", failures)


def apply_policy(entries: DataFrame, version: str = "v1") -> DataFrame:
    """entries with policy, base_failed and kept."""
    base, enforced = (F.col("failures").bitwiseAND(F.lit(mask(POLICIES[v])).cast("long")) for v in ("base", version))
    return entries.withColumns({"policy": F.lit(version), "base_failed": base != 0, "kept": (base == 0) & (enforced == 0)})


def filter_documents(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The rows of docs that the policy keeps, in one pass without a shuffle. The row number keeps the optimizer from
    moving the filter below the steps of measure, which would compute each of them many times."""
    judged = apply_policy(ledger(docs, keep=True), version).select("row", "kept", F.monotonically_increasing_id().alias("number"))
    return judged.where(F.col("kept") & (F.col("number") >= 0)).select("row.*")


def ablation(entries: DataFrame, version: str = "v1") -> DataFrame:
    """rule, rejected (documents that fail it), alone (documents that only it rejects under the policy)."""
    enforced = mask(POLICIES[version]) | mask(POLICIES["base"])
    by_mask = entries.select(F.col("failures").bitwiseAND(F.lit(enforced).cast("long")).alias("f")).groupBy("f").count()  # one row for each mask
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if enforced >> i & 1]
    each = by_mask.select("f", "count", F.explode(F.array(*rules)).alias("r")).select("f", "count", "r.rule", "r.bit")
    return each.groupBy("rule").agg(F.sum(F.when(F.col("f").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("rejected"), F.sum(F.when(F.col("f") == F.col("bit"), F.col("count")).otherwise(0)).alias("alone"))
