"""Secret scans: candidates, features, and a random forest that removes false positives.

Candidates are long runs of key-like characters. Their features are length, shares and transitions of character
classes, coverage by a dictionary of the corpus's own letter sequences, marks of the path, and neighbouring words. The
forest learns from labelled findings: a table of judged values where one is given, else findings planted in texts made
for it (labelled_findings), whose labels say what was planted and not what the features are. Everything runs in
built-in functions and the ML library of the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import SPACE, joined, split_words, written

MIN_LENGTH = 16
#: Labelled findings that the forest learns from at most, chosen by hash; texts with planted findings, and words of the corpus in them.
TRAIN_ROWS, PLANTED, WORDS = 20_000, 6_000, 300
#: Letters of a dictionary entry, of which there are at most 26**4.
GRAM = 4

#: Published prefixes of issued keys, words that name secrets, marks of paths with made-up values.
ISSUED = r"^(AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abp]-|sk_live_)"
NAMES = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth)"
MADE_UP = r"(?i)(test|example|sample|mock|fixture|spec|doc)"
CANDIDATE = r"[A-Za-z0-9_+/~-]{16,}={0,2}"

#: Alphabets of keys; kinds of findings (label, prefix, alphabet or joint of words, least and most characters or words, suffix, contexts that fit).
HEX, DIGITS = "0123456789abcdef", "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz"
KINDS = (
    (1, "AKIA", LETTERS[:26] + "234567", 16, 16, "", "any"),
    (1, "ghp_", LETTERS + DIGITS, 36, 36, "", "any"),
    (1, "sk_live_", LETTERS + DIGITS, 24, 32, "", "any"),
    (1, "", HEX, 32, 48, "", "named"),
    (1, "", HEX.upper(), 32, 48, "", "named"),
    (1, "", LETTERS + DIGITS, 20, 48, "", "named"),
    (1, "", LETTERS + DIGITS + "+/", 40, 43, "=", "named"),
    (1, "", LETTERS + DIGITS, 32, 48, "", "plain"),
    (1, "", LETTERS + DIGITS + "+/", 40, 43, "=", "plain"),
    (0, "", HEX, 64, 64, "", "named"),
    (0, "", HEX.upper(), 64, 64, "", "named"),
    (0, "", DIGITS, 16, 19, "", "named"),
    (0, "", HEX, 40, 40, "", "plain"),
    (0, "", HEX, 32, 64, "", "plain"),
    (0, "", DIGITS, 16, 19, "", "plain"),
    (0, "iVBORw0KGgo", LETTERS + DIGITS + "+/", 60, 120, "", "plain"),
    (0, "", LETTERS + DIGITS, 20, 48, "", "made up"),
    (0, "", "-_~", 16, 40, "", "plain"),
    (0, "", "words", 3, 7, "", "any"),
    (0, "", "Words", 3, 7, "", "any"),
    (0, "", "WORDS", 3, 7, "", "any"),
    (0, "", "words-", 4, 7, "", "any"),
    (0, "", "words_", 4, 7, "", "any"),
    (0, "", "words/", 4, 7, "", "any"),
)
NAMED = ('api_key = "{}"', "token: {}", "password={}", "export SECRET_KEY={}", "Authorization: Bearer {}", "secret = '{}'", '"access_token": "{}",', "auth_token = {}")
PLAIN = ("commit {}", "sha256 {}", "see {} for", "id {}", "etag {}", "md5: {}", "{}", "revision = {}", "png;base64,{}")
PATHS, MADE_UP_PATHS = ("src/app.py", "config/live.env", "deploy/values.yaml", "src0", "web"), ("tests/fixtures/a.json", "docs/example.md", "samples/b.txt")

CLASSES = (("lower", "a-z"), ("upper", "A-Z"), ("digit", "0-9"))
FEATURES = (
    ["length", "distinct_share", "longest_repeat", "vowel_turns", "coverage", "issued", "named", "assigned", "quoted", "made_up_path", "hex"]
    + [f"share_{a}" for a, _ in CLASSES]
    + [f"from_{a}_to_{b}" for a, _ in CLASSES for b, _ in CLASSES]
)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, word_no, run_no, value, before, after, path) of each candidate of each row; null texts have none."""
    words = docs.select("doc_id", F.col(path).cast("string").alias("path"), split_words(F.col("text"), SPACE).alias("w"))
    get = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    long = F.filter(
        F.transform("w", lambda x, i: F.when(F.length(x) >= MIN_LENGTH, F.struct(i.alias("i"), x.alias("x")))),
        lambda s: s.isNotNull(),
    )
    placed = words.select("doc_id", "path", "w", F.explode(long).alias("s"))
    near = placed.where(F.col("s.x").rlike(CANDIDATE)).select("doc_id", "path", F.col("s.i").alias("word_no"), F.col("s.x").alias("x"), get(F.col("s.i") - 2).alias("b2"), get(F.col("s.i") - 1).alias("b1"), get(F.col("s.i") + 1).alias("after"))
    runs = near.select("*", F.posexplode(F.regexp_extract_all("x", F.lit(f"({CANDIDATE})"), F.lit(1))).alias("run_no", "value"))
    before = F.concat_ws(" ", "b2", "b1", F.expr("substring_index(x, value, 1)"))
    return runs.select("doc_id", F.col("word_no").cast("long"), F.col("run_no").cast("long"), "value", before.alias("before"), "after", "path")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): distinct texts that have the word (a to z, from GRAM letters on) outside of candidates. Longer runs than MIN_LENGTH - 1 letters are candidates themselves."""
    words = F.split(F.lower(F.regexp_replace("text", CANDIDATE, " ")), r"[^a-z]+")
    proper = F.array_distinct(F.filter(words, lambda w: F.length(w) >= GRAM))
    texts = docs.where("text is not null").select(F.md5("text").alias("id"), proper.alias("words")).groupBy("id").agg(F.first("words").alias("words"))
    return texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def dictionary(docs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(gram): sequences of GRAM letters that words have more often than random letters would: a share of 1 / 26**GRAM of all, at least.

    A word counts once for each distinct text that has it, and what stands in candidates doesn't count. Random letters
    never reach that share, however large the corpus, and copies of texts change nothing.
    """
    counts = word_counts(docs) if counts is None else counts
    grams = counts.select("n", F.explode(F.expr(f"transform(sequence(1, length(word) - {GRAM - 1}), i -> substring(word, i, {GRAM}))")).alias("gram"))
    n = written(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = n.agg(F.sum("n")).first()[0] or 0
    return n.where(F.col("n") * 26**GRAM >= total).select("gram")


def labelled_findings(spark: SparkSession, words: list[str], n: int = PLANTED, seed: int = 7) -> DataFrame:
    """(doc_id, text, source, label): n texts with one planted finding each, of KINDS in turn, among the words given.

    All choices come from hashes of a row's number and the seed. Keys are drawn letter by letter; findings of words are
    joined from the words. A finding's kind is its number modulo that of KINDS. Neither a name of a secret before it nor its shape alone tells a
    label: there are keys without a name, and digests, numbers and words under one. Contexts of the kind "named" assign to a name of a secret, "plain" don't, "any" are either,
    and what is "made up" is a key that is named, but stands in a path of tests or examples.
    """
    words = words or ["some", "other", "word"]
    pick = lambda what, size: F.pmod(F.xxhash64(F.lit(f"{what} {seed}"), "doc_id"), size if isinstance(size, Column) else F.lit(size)).cast("int")
    of = lambda what, values: F.get(F.array(*[F.lit(x) for x in values]), pick(what, len(values)))
    kind = F.get(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("label", "prefix", "alphabet", "least", "most", "suffix", "context"), k, strict=True)]) for k in KINDS]), F.pmod(F.col("doc_id"), F.lit(len(KINDS))).cast("int"))
    rows = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("kind", kind).select("doc_id", "kind.*").withColumn("size", F.col("least") + pick("size", F.col("most") - F.col("least") + 1))
    each = lambda make: F.transform(F.sequence(F.lit(1), F.col("size")), make)
    drawn = lambda i: F.xxhash64(F.lit(f"value {seed}"), "doc_id", i)
    letters = F.array_join(each(lambda i: F.substring(F.col("alphabet"), (F.pmod(drawn(i), F.length("alphabet")) + 1).cast("int"), F.lit(1))), "")
    some = each(lambda i: F.get(F.array(*[F.lit(x) for x in words]), F.pmod(drawn(i), F.lit(len(words))).cast("int")))
    joined_words = F.call_function("array_join", some, F.substring("alphabet", 6, 1))
    cased = F.when(F.col("alphabet").startswith("W"), F.initcap(joined_words)).otherwise(joined_words)
    cased = F.when(F.col("alphabet").startswith("WO"), F.upper(joined_words)).otherwise(cased)
    value = F.concat("prefix", F.when(F.lower("alphabet").startswith("words"), cased).otherwise(letters), "suffix")
    named = F.col("context").isin("named", "made up") | ((F.col("context") == "any") & (pick("named", 2) == 0))
    context = F.when(named, of("context", NAMED)).otherwise(of("context", PLAIN))
    around = lambda what: F.concat_ws(" ", of(what, words), of(what + " too", words))
    text = F.concat_ws(" ", around("before"), F.replace(context, F.lit("{}"), value), around("after"))
    # other findings of words may stand in such paths as well
    made_up = (F.col("context") == "made up") | ((F.col("label") == 0) & (pick("path", 4) == 0))
    path = F.when(made_up, of("which", MADE_UP_PATHS)).otherwise(of("which", PATHS))
    return rows.select("doc_id", text.alias("text"), path.alias("source"), F.col("label").cast("double").alias("label"))


def _features() -> dict[str, Column]:
    v, n = F.col("value"), F.length("value").cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    flag = lambda c: c.cast("double")
    return (
        {
            "length": n,
            "distinct_share": F.size(F.array_distinct(F.split("value", ""))) / n,
            "longest_repeat": count(r"(.)\1\1"),
            "vowel_turns": count(r"(?i)[aeiou](?=[b-df-hj-np-tv-z])") / n,
            "issued": flag(v.rlike(ISSUED)),
            "named": flag(F.col("before").rlike(NAMES)),
            "assigned": flag(F.col("before").rlike(r"[=:]\s*[\"'`(]*$")),
            "quoted": flag(F.col("before").rlike(r"[\"'`]$")),
            "made_up_path": flag(F.coalesce(F.col("path"), F.lit("")).rlike(MADE_UP)),
            "hex": flag(v.rlike(r"^[0-9a-f]+$|^[0-9A-F]+$")),
        }
        | {f"share_{a}": count(f"[{x}]") / n for a, x in CLASSES}
        | {f"from_{a}_to_{b}": count(f"[{x}](?=[{y}])") / n for a, x in CLASSES for b, y in CLASSES}
    )


def featured(found: DataFrame, entries: DataFrame) -> DataFrame:
    """The findings, a table, with FEATURES. entries, at most 26**GRAM rows, is broadcast; coverage is worked out once for each value, and a value that many findings have is met by parts."""
    values = found.groupBy("value").agg(F.count("*").alias("n"))
    grams = values.select("value", "n", F.explode(F.expr(f"transform(sequence(1, length(value) - {GRAM - 1}), i -> lower(substring(value, i, {GRAM})))")).alias("gram"))
    known = F.broadcast(entries.withColumn("known", F.lit(1.0)))
    cover = written(grams.join(known, "gram", "left").groupBy("value").agg(F.first("n").alias("n"), F.avg(F.coalesce("known", F.lit(0.0))).alias("coverage")), "coverage")
    return joined(found, cover, ["value"], "n", found.count(), "doc_id").withColumns(_features())


def _fit(teach: DataFrame, seed: int):
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return assembler, RandomForestClassifier(numTrees=30, maxDepth=8, seed=seed, featureSubsetStrategy="sqrt").fit(assembler.transform(teach))


def planted_findings(docs: DataFrame, entries: DataFrame, counts: DataFrame, seed: int = 7) -> DataFrame:
    """Findings with features and label, planted among WORDS words that most texts of docs have."""
    spark = docs.sparkSession
    words = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    made = written(labelled_findings(spark, words, seed=seed), "planted")
    found = written(candidates(made), "planted_findings")
    return featured(found, entries).join(F.broadcast(made.select("doc_id", "label")), "doc_id")


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", train_rows: int = TRAIN_ROWS, seed: int = 7) -> DataFrame:
    """The findings of docs with features, score and is_secret (score of at least 0.5).

    labelled: (value, label) of judged findings of docs, label 1.0 or 0.0; without it the forest learns from
    planted_findings(). It learns from train_rows of them at most. Without labels of both kinds nothing can be learned:
    labelled findings keep their label as score, others get 0.5. Null texts and runs under MIN_LENGTH characters give no
    findings; texts and runs of any length are read whole. Repeated rows give repeated findings, equal ones get equal
    scores; an empty table gives none. Of other columns only path is read, and a null path has no marks.
    """
    counts = written(word_counts(docs), "words")
    entries = written(dictionary(docs, counts), "dictionary")
    found = written(featured(written(candidates(docs, path), "candidates"), entries), "findings")
    if labelled is None:
        known, judged = found, planted_findings(docs, entries, counts, seed)
    else:
        known = judged = found.join(labelled.groupBy("value").agg(F.max(F.col("label").cast("double")).alias("label")), "value", "left")
    judged = written(judged.where("label is not null").select("doc_id", "word_no", "run_no", "label", *FEATURES), "judged")
    sizes = {r.label: r.n for r in judged.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        scored = known.withColumn("score", F.coalesce("label", F.lit(0.5)) if labelled is not None else F.lit(0.5))
    else:
        half = train_rows / 2
        share = reduce(lambda c, k: F.when(F.col("label") == k, min(1.0, half / sizes[k])).otherwise(c), sizes, F.lit(0.0))
        assembler, forest = _fit(judged.where(F.pmod(F.xxhash64("doc_id", "word_no", "run_no", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)).select("label", *FEATURES), seed)
        scored = forest.transform(assembler.transform(known)).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("score") >= 0.5)


def _planted(docs: DataFrame, seed: int) -> DataFrame:
    counts = written(word_counts(docs), "words")
    return written(planted_findings(docs, written(dictionary(docs, counts), "dictionary"), counts, seed), "judged")


def _told(teach: DataFrame, judged: DataFrame, seed: int) -> DataFrame:
    """judged with prediction, by a forest that learned from teach, and by_rule: an issued prefix, or a name of a secret outside of made-up paths."""
    assembler, forest = _fit(teach.select("label", *FEATURES), seed)
    rule = (F.col("issued") == 1) | ((F.col("named") == 1) & (F.col("made_up_path") == 0))
    return forest.transform(assembler.transform(judged)).withColumn("by_rule", rule.cast("double"))


def held_out_counts(docs: DataFrame, seed: int = 7) -> dict[str, int]:
    """Planted findings of every fifth text, judged by a forest that learned from the others: tp, fp, fn, tn, and how many the plain rule tells right (rule)."""
    judged = _planted(docs, seed)
    apart = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5)) == 0
    told = _told(judged.where(~apart), judged.where(apart), seed).groupBy("label", "prediction", "by_rule").count().collect()
    name = {(1.0, 1.0): "tp", (0.0, 1.0): "fp", (1.0, 0.0): "fn", (0.0, 0.0): "tn"}
    out = dict.fromkeys([*name.values(), "rule"], 0)
    for r in told:
        out[name[r.label, r.prediction]] += r["count"]
        out["rule"] += r["count"] if r.label == r.by_rule else 0
    return out


def left_out_kinds(docs: DataFrame, kinds: list[int] | None = None, seed: int = 7) -> dict[int, tuple[int, int, int]]:
    """For each of KINDS, by place: findings, and how many of them are told right by a forest that saw no finding of the kind, and by the plain rule."""
    judged, out = _planted(docs, seed), {}
    for k in range(len(KINDS)) if kinds is None else kinds:
        own = F.pmod(F.col("doc_id"), F.lit(len(KINDS))) == k
        right = lambda c: F.count_if(F.col("label") == F.col(c))
        out[k] = tuple(_told(judged.where(~own), judged.where(own), seed).agg(F.count("*"), right("prediction"), right("by_rule")).first())
    return out


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, word_no, run_no, value_sha256, n_chars, score, is_secret of every finding; values themselves are not shown."""
    return scan(docs, **options).select("doc_id", "word_no", "run_no", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("n_chars"), "score", "is_secret")
