"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Repeated three-word windows are found without leaving the row: each window's position, in as many bits as the text
needs, and the rest of a long filled with its hash are one number; numbers are sorted as primitives, and neighbours
with equal hashes are repeats if their words agree. Where they don't, two different windows share a hash, and the row is
worked out by the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import SPACE, split_words

#: Frequent short words of the corpus's languages.
STOP_WORDS = (
    "the of and to in is that it was for on are be at an or a by with he "
    "de la que el en y los las un una por con se del al "
    "der die und das ein eine mit von ist zu den auf für im nicht "
    "le les des et du est une dans pour qui sur au ce"
).split()
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 0.5

#: Name, lowest and highest value that a kept document has. Names are ratios that report() computes.
RULES = (
    ("mean_word_chars", 2.5, 12.0),
    ("symbol_ratio", 0.0, 0.1),
    ("dup_line_ratio", 0.0, 0.5),
    ("stop_word_ratio", 0.05, 1.0),
)


def _packed(hash_bits: int) -> Column:
    """Sorted numbers of the three-word windows: hash above, position below. Needs word hashes h and the low bits' mask low."""
    keep = F.lit(-1 << (64 - hash_bits)).cast("long")
    number = lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).bitwiseAND(keep).bitwiseAND(F.bitwise_not("low")).bitwiseOR(i.cast("long"))
    return F.when(F.size("h") < 3, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(F.sequence(F.lit(0), F.size("h") - 3), number)))


def _relations() -> Column:
    """For each number but the first: 0 if its hash differs from the one before, 1 if their windows' words agree, else 2."""
    place = lambda x, j: F.get("w", x.bitwiseAND(F.col("low")).cast("int") + j)

    def relation(x: Column, i: Column) -> Column:
        before = F.get("s", i - 1)
        agree = (place(x, 0) == place(before, 0)) & (place(x, 1) == place(before, 1)) & (place(x, 2) == place(before, 2))
        return F.when((i == 0) | (x.bitwiseXOR(before).bitwiseAND(F.bitwise_not("low")) != 0), 0).when(agree, 1).otherwise(2)

    return F.transform("s", relation)


def _repeated_places() -> Column:
    """Positions of windows that are found twice or more."""
    fast = F.transform("s", lambda x, i: F.when((F.get("r", i) == 1) | (F.get("r", i + 1) == 1), x.bitwiseAND(F.col("low")).cast("int")))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c"), i.alias("i")))
    alike = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    # sorted by words; needed only where windows share a hash by chance
    by_words = lambda v: F.transform(v, lambda x, i: F.when(F.coalesce(alike(x, F.get(v, i - 1)), F.lit(False)) | F.coalesce(alike(x, F.get(v, i + 1)), F.lit(False)), x["i"]))
    exact = F.flatten(F.transform(F.array(F.array_sort(windows)), by_words))
    return F.filter(F.when(F.array_contains("r", 2), exact).otherwise(fast), lambda p: p.isNotNull())


def measures(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id and the counts of each document; only doc_id and text are read, null texts have no words.

    hash_bits bounds the bits of a window's hash, which changes no result; of texts with many words, positions take some.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    covered = F.size(F.array_distinct(F.flatten(F.array("p", F.transform("p", lambda x: x + 1), F.transform("p", lambda x: x + 2)))))
    return (
        docs.select("doc_id", text.alias("text"), split_words(text, SPACE).alias("w"), lines.alias("l"))
        .select(
            "doc_id",
            "w",
            F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
            F.size("w").alias("n_words"),
            F.length(F.array_join("w", "")).alias("word_chars"),
            F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
            (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
            F.size("l").alias("n_lines"),
            F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS))).alias("n_stop_words"),
            # ones in as many low bits as the number of words has
            (F.pow(F.lit(2.0), F.length(F.bin(F.size("w").cast("long")))).cast("long") - 1).alias("low"),
        )
        .select("*", _packed(hash_bits).alias("s"))
        .select("*", _relations().alias("r"))
        .select("*", _repeated_places().alias("p"))
        # one row in, one row out: a filter of what follows isn't worked out by these expressions once more
        .select("doc_id", F.inline(F.array(F.struct(*[F.col(x).cast("long").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stop_words")], covered.cast("long").alias("n_repeat_words")))))
    )


def compile_rules(rules=RULES) -> Column:
    """One condition that all rules hold; a ratio without a value (no words, no lines) breaks no rule."""
    out = F.lit(True)
    for name, least, most in rules:
        out = out & F.coalesce(F.col(name).between(least, most), F.lit(True))
    return out


def report(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed, the ratios, kept; one row for each row of docs.

    base_failed: under 50 words, or over half of the words in repeated windows. kept: base_failed is false and every
    rule holds. n_stop_words counts the words that are stop words, as they are written; its ratio is to all words.
    Stop words are of four languages, so texts in others need rules of their own. Rows are judged each on its own,
    repeated ones alike; texts of any length are read whole; an empty table gives no rows. Other columns than doc_id and
    text are not read, whatever their names.
    """
    n = F.col("n_words")
    ratio = lambda a, b: F.when(b > 0, a / b)
    return (
        measures(docs)
        .withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * n))
        .withColumn("mean_word_chars", ratio(F.col("word_chars"), n))
        .withColumn("symbol_ratio", ratio(F.col("n_symbols"), F.col("word_chars")))
        .withColumn("dup_line_ratio", ratio(F.col("n_dup_lines"), F.col("n_lines")))
        .withColumn("stop_word_ratio", ratio(F.col("n_stop_words"), n))
        .withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    )
