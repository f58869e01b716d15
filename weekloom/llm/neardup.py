"""Near duplicates: MinHash bands, odd sketches, exact confirmation, components.

Each text's set of shingles gives BANDS x ROWS MinHash samples. Bands of samples are the buckets in which candidates
meet; all samples folded by parity into a bitmap are the odd sketch, and the set bits of two sketches' XOR estimate the
similarity of candidates closely enough to leave out those far below the threshold. What remains is confirmed on the
full sets.

Texts with equal sets are one class, and only its representative goes on. In a bucket, all members are first compared
with one centre, the member that meets most others in all its buckets; links make components, and a new centre is
taken among those outside the first component as long as many pairs lie between their components. What is left are
pairs between different components. Where a bucket has few of them for each member, members outside its largest
component, of which there are few then, are compared with all others. Where it has many, as in a group whose outer members are just too far from all others, sets are seen as differences to the bucket's
centre, and only pairs with enough rare differences in common are compared (see _about_centres); that is exact. Pairs
within a component are never needed, so that a group of copies costs as many pairs as it has members and no link
between groups is lost. A pair at the threshold meets in no bucket with probability
(1 - 0.8**6)**48 < 1e-6.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import HOT, joined, kept, written
from weekloom.llm.components import components
from weekloom.llm.hashing import chunks, mix, shingle_sets, text_chunks

BANDS, ROWS, SKETCH_WORDS = 48, 6, 16
#: Estimated similarity below the threshold at which a sketch still lets candidates through: 4.8 standard deviations.
SLACK = 0.15
#: Pairs between components for each member of a bucket up to which they are compared one by one.
DIRECT = 8

_RNG = np.random.default_rng(4)
_MUL = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
#: Classes that share a bucket (three numbers each) up to which these are broadcast.
MAX_BROADCAST = 1_000_000
#: One class in so many tells which buckets are large.
EVERY = 64
#: Documents that go (two numbers each) up to which these are broadcast, so that texts aren't moved to be left out.
MAX_GONE = 500_000
#: Parts among which the members of one centre are dealt out.
PARTS = 256
SIGNATURE_SCHEMA = "doc_id long, t long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    own = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), 512):
        np.minimum(best, (own[at : at + 512, None] * _MUL + _ADD).min(0), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    bits = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_bits(similarity: float) -> int:
    """Expected set bits of the XOR of two sketches at this similarity."""
    bits = 64 * SKETCH_WORDS
    return math.floor(bits / 2 * (1 - (1 - 2 / bits) ** (2 * BANDS * ROWS * (1 - similarity))))


def _signature_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None, None)
        step = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            for a, b, texts in text_chunks(batch):
                n, h1, h2, bands, sketches = [], [], [], [], []
                for own in shingle_sets(texts, width):
                    n.append(len(own))
                    h1.append(own.sum(dtype=np.uint64) if len(own) else np.uint64(0))
                    h2.append(np.bitwise_xor.reduce(mix(own)) if len(own) else np.uint64(0))
                    if len(own):
                        samples = min_hashes(own)
                        keys = step.copy()
                        for row in samples.reshape(BANDS, ROWS).T:
                            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
                        bands.append(keys.view(np.int64))
                        sketches.append(odd_sketch(samples))
                    else:
                        bands.append(np.empty(0, np.int64))
                        sketches.append(np.empty(0, np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x))) for x in (bands, sketches)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b].cast(pa.int64()), batch.column("t")[a:b], pa.array(n, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), *lists],
                    ["doc_id", "t", "n_shingles", "h1", "h2", "bands", "sketch"],
                )

    return run


def _confirm_batches(width: int, percent: int, rows: int = 250):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                sides = [[x or b"" for x in batch.column(c).cast(pa.binary()).to_pylist()] for c in ("text_a", "text_b")]
                distinct, sets = list(dict.fromkeys(sides[0] + sides[1])), {}
                for lo, hi in chunks(distinct):
                    sets |= zip(distinct[lo:hi], shingle_sets(distinct[lo:hi], width), strict=True)
                linked = []
                for x, y in zip(*sides, strict=True):
                    x, y = sets[x], sets[y]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sizes with which sets can reach the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _difference_batches(width: int):
    """Rows come with each centre's own row before its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.uint64)
        for batch in batches:
            for lo, hi, texts in text_chunks(batch):
                member = batch.column("member")[lo:hi]
                n, sizes, differences = [], [], []
                for is_member, shingles in zip(member.to_pylist(), shingle_sets(texts, width), strict=True):
                    if not is_member:
                        held = shingles
                        continue
                    n.append(len(shingles))
                    sizes.append(len(held))
                    differences.append(np.setxor1d(shingles, held, assume_unique=True).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, differences)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *differences])))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi].filter(member) for c in ("centre", "rep", "component")), pa.array(n, pa.int64()), pa.array(sizes, pa.int64()), lists], ["centre", "rep", "component", "n", "n_c", "differs"])

    return run


def _about_centres(texts_of: Callable[[DataFrame], DataFrame], around: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components around one centre that can be linked; around has (centre, rep, component).

    A link of sets x and y means (100 + P) * |x ^ y| <= (100 - P) * (|x| + |y|), ^ being symmetric difference and P percent.
    With dx = x ^ centre, |x ^ y| = |dx| + |dy| - 2 * |dx & dy|, so a link asks for a number of common differences to the
    centre. As at most one of x and y is linked with the centre, that number is at least 1, and about half of each set's
    differences but where x is not linked with the centre and y is: whatever is linked with the centre is given as a pair
    with it, and then of one component with the others that are. So the rarest differences, all but as many as must
    be common (less one), hold a common one, and pairs meet there. Where they meet first, what follows in both must
    still give the number. Nothing that can be linked is left out, and nothing is capped.
    """
    up, down = 100 + percent, 100 - percent
    texts = texts_of(around.select(F.explode(F.array("centre", "rep")).alias("rep")).distinct())
    dealt = around.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(PARTS)))
    heads = dealt.select("centre", "part").distinct().join(texts.withColumnRenamed("rep", "centre"), "centre").select("centre", F.col("centre").alias("rep"), F.lit(0).cast("long").alias("component"), "part", F.lit(False).alias("member"), "text")
    members = dealt.join(texts, "rep").select("centre", "rep", "component", "part", F.lit(True).alias("member"), "text")
    both = heads.unionByName(members).repartition("centre", "part").sortWithinPartitions("centre", "part", "member")
    schema = "centre long, rep long, component long, n long, n_c long, differs array<long>"
    sets = both.mapInArrow(_difference_batches(width), schema)
    sets = written(sets.withColumn("d", F.size("differs").cast("long")).where("d > 0"), "differences")
    # hot differences, of which there are fewer than HOT, are looked up in each set, so that their rows meet nowhere; the others are counted by window
    total = sets.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
    counts = sets.select("centre", F.explode("differs").alias("differs")).groupBy("centre", "differs").agg(F.count("*").alias("df"))
    hot = counts.where((F.col("df") > 1) & (F.col("df") * HOT > total)).groupBy("centre").agg(F.sort_array(F.collect_list(F.struct("df", "differs"))).alias("hot"))
    hot = F.broadcast(written(hot.select("centre", F.col("hot.differs").alias("hot")), "hot"))
    none = F.array().cast("array<long>")
    told = sets.join(hot, "centre", "left").withColumn("hot", F.coalesce("hot", none))
    single = told.select("centre", "rep", F.explode(F.array_except("differs", "hot")).alias("differs"))
    light = single.withColumn("df", F.count("*").over(Window.partitionBy("centre", "differs"))).where("df > 1")
    ranked = light.groupBy("centre", "rep").agg(F.sort_array(F.collect_list(F.struct("df", "differs"))).alias("light"))
    in_order = F.sort_array(F.transform(F.array_intersect("hot", "differs"), lambda x: F.struct(F.array_position(F.col("hot"), x).alias("at"), x.alias("differs"))))
    common = F.concat(F.coalesce("light.differs", none), F.transform(in_order, lambda x: x["differs"]))
    ceil_half = lambda x: F.greatest(F.lit(1), F.ceil(x / (2 * up)))
    own = told.join(ranked, ["centre", "rep"], "left").withColumn("common", common).drop("differs", "hot", "light").where(F.size("common") > 0).withColumn("linked", up * F.col("d") <= down * (F.col("n") + F.col("n_c")))
    half = ceil_half(up * F.col("d") + down * (F.col("n_c") - F.col("n")))
    few = ceil_half(up * F.col("d") + 2 * percent - down * (F.col("n") + F.col("n_c")))
    own = own.select("*", (F.col("d") - half + 1).alias("short"), (F.col("d") - F.when(F.col("linked"), half).otherwise(F.least(half, few)) + 1).alias("long"), (F.col("d") - F.size("common")).alias("alone"))
    # differences of one set alone are the rarest and come first; they take places but meet nothing
    placed = own.select("centre", "rep", "component", "n", "d", "linked", "short", "long", "alone", F.posexplode("common")).withColumn("place", F.col("pos") + F.col("alone") + 1).where("place <= long")
    placed = written(placed.select("centre", "rep", "component", "n", "d", "linked", "place", (F.col("place") <= F.col("short")).alias("short"), F.col("col").alias("differs")), "placed")
    x, y = (placed.select("centre", "differs", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "n", "d", "linked", "place", "short")]) for s in "ab")
    needed = up * (F.col("d_a") + F.col("d_b")) - down * (F.col("n_a") + F.col("n_b"))
    still = 2 * up * (1 + F.least(F.col("d_a") - F.col("place_a"), F.col("d_b") - F.col("place_b")))
    once = F.col("linked_b") | (F.col("short_a") & (F.col("rep_a") < F.col("rep_b")))
    meet = x.where("not linked_a").join(y.where("short_b"), ["centre", "differs"]).where((F.col("component_a") != F.col("component_b")) & once & (still >= needed))
    met = meet.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    return met.unionByName(sets.where(up * F.col("d") <= down * (F.col("n") + F.col("n_c"))).select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")))


def _in_company(placed: DataFrame, classes: int) -> DataFrame:
    """(rep, n, key, size) of the rows whose bucket has size > 1 members, moved once.

    Buckets that look large among one class in EVERY are counted by map-side sums, so that their rows stay where they are; there are
    at most some 100,000 of these. The others' rows are counted by window. Which way a bucket goes makes no difference.
    """
    some = placed.where(F.pmod(F.xxhash64("rep"), F.lit(EVERY)) == 0).groupBy("key").agg(F.count("*").alias("c"))
    large = F.broadcast(written(some.where(F.col("c") >= max(2, classes // (2000 * EVERY))).select("key", F.lit(True).alias("large")), "large"))
    told = placed.join(large, "key", "left")
    sizes = F.broadcast(written(told.where("large").groupBy("key").agg(F.count("*").alias("size")), "sizes"))
    by_sum = told.where("large").join(sizes, "key").select("rep", "n", "key", "size")
    by_window = told.where("large is null").select("rep", "n", "key", F.count("*").over(Window.partitionBy("key")).alias("size"))
    return by_sum.unionByName(by_window).where("size > 1")


def links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(signatures, class components): (doc_id, t, n_shingles, h1, h2) of each row, and (h1, h2, component) of each class.

    Only doc_id and text are read; t is a hash of the text. A class is the texts of one set, and has a number of its
    own, as one doc_id may have several texts; component is the smallest doc_id of the classes that can be reached.
    Rows without a doc_id get signatures and take no part in links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    sig = written(docs.mapInArrow(_signature_batches(width), SIGNATURE_SCHEMA), "signatures")
    real = sig.where("n_shingles > 0 and doc_id is not null")
    # numbers that Spark makes up are fixed once they are written
    firsts = real.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    classes = written(firsts.select("h1", "h2", "first.doc_id", "first.t", F.monotonically_increasing_id().alias("rep")), "classes")
    key = ["h1", "h2", "doc_id", "t"]
    nodes = written(real.join(classes, key).groupBy(*key).agg(*[F.first(x).alias(y) for x, y in (("rep", "rep"), ("n_shingles", "n"), ("bands", "bands"), ("sketch", "sketch"))]).drop(*key), "nodes")
    placed = nodes.select("rep", "n", F.explode("bands").alias("key"))
    met = written(_in_company(placed, nodes.count()), "met")
    # rows meet what is said of their bucket by parts, where a bucket holds very many
    in_buckets = met.count()
    by_key = lambda rows, sums, count, spread="rep": joined(rows, sums, ["key"], count, in_buckets, spread)
    # the text that the others vary meets more of them than they meet one another: it is the best centre
    weight = met.groupBy("rep").agg(F.sum("size").alias("weight"))
    members = written(met.join(weight, "rep").select("key", "rep", "n", "weight"), "members")
    centres = written(members.groupBy("key").agg(F.max_by("rep", "weight").alias("centre"), F.count("*").alias("members")), "centres")

    limit = most_bits(percent / 100 - SLACK)
    sketches = nodes.select("rep", "n", "sketch")
    far = sum((F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(SKETCH_WORDS)), F.lit(0))

    # of all texts, those that share a bucket are taken once, and where they are few no others are moved; all that follows reads these
    own = written(classes.join(weight.select("rep"), "rep").select("rep", "doc_id", "t"), "sharing")
    own = F.broadcast(own) if own.count() <= MAX_BROADCAST else own
    held = written(docs.join(own, ["doc_id", "t"]).groupBy("doc_id", "t").agg(F.first("rep").alias("rep"), F.first("text").alias("text")).select("rep", "text"), "held")

    def texts_of(reps: DataFrame) -> DataFrame:
        """(rep, text) of the classes with these numbers, a table."""
        return written(held.join(reps, "rep", "left_semi"), "texts")

    def compared(pairs: DataFrame, few: bool = True) -> DataFrame:
        """The pairs (a, b) that are linked. Of few pairs, the texts that take part are picked first."""
        near = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
        near = written(near.where(_alike(F.col("n_a"), F.col("n_b"), percent) & (far <= limit)).select("a", "b").distinct(), "near")
        texts = texts_of(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()) if few else held
        side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"))
        return written(near.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirm_batches(width, percent), "a long, b long"), "links")

    pair = [F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")]
    tried = written(by_key(members, centres, "members").where("rep <> centre").select(*pair).distinct(), "tried")
    found = compared(tried, few=False)
    open_pairs = None
    while True:
        comps = components(found)
        state = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        per = state.groupBy("key", "component").agg(F.count("*").alias("c"), F.max("weight").alias("weight"))
        square = F.col("c") * F.col("c")
        mixed = per.groupBy("key").agg(
            F.max_by("component", "weight").alias("first"), F.max_by("c", "weight").alias("c"), F.max_by("component", "c").alias("largest"), F.count("*").alias("parts"), F.sum("c").alias("all"), F.sum(square).alias("own")
        ).where("parts > 1")
        others = F.col("all") - F.col("c")
        mixed = written(mixed.select("key", "first", "largest", F.col("all").alias("members"), ((F.col("all") * F.col("all") - F.col("own")) / 2 > DIRECT * F.col("all")).alias("large"), ((others * others - F.col("own") + square) / 2).alias("pairs")), "parted")
        state = written(by_key(state, mixed.withColumn("in_all", F.col("members")), "members").select("key", "rep", "n", "weight", "component", "first", "largest", "large", "pairs", "in_all"), "mixed")
        large = state.where("large and component <> first")
        rows, between = large.groupBy("key").agg(F.count("*").alias("rows"), F.first("pairs").alias("pairs")).agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        if between <= DIRECT * rows or (open_pairs is not None and between > 0.7 * open_pairs):
            break
        open_pairs = between
        second = written(large.groupBy("key").agg(F.max_by("rep", "weight").alias("centre"), F.max_by("component", "weight").alias("of"), F.count("*").alias("members")), "second")
        star = by_key(large, second, "members").where("component <> of").select(*pair).distinct()
        star = written(star.join(tried, ["a", "b"], "left_anti"), "star")
        tried = tried.unionByName(star)
        new = compared(star)
        if new.isEmpty():
            break  # components, and with them all that would be made of them again, are the same
        found = found.unionByName(new)
    # few pairs between components of a bucket: at most some 16 members are outside its largest one, or 32 are in it at all
    x, y = (z.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "component")], *own) for s, z, own in (("a", state.where("not large and component <> largest"), ["largest", "in_all"]), ("b", state.where("not large"), [])))
    once = (F.col("component_b") == F.col("largest")) | (F.col("rep_a") < F.col("rep_b"))
    rest = by_key(y, written(x, "outside"), "in_all", "rep_b").where((F.col("component_a") != F.col("component_b")) & once & _alike(F.col("n_a"), F.col("n_b"), percent))
    rest = rest.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    # buckets whose centres are linked with one heavier text share that one, so that sets are compared with few centres
    linked = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = linked.join(centres.select(F.col("centre").alias("a")).distinct(), "a", "left_semi").unionByName(centres.select(F.col("centre").alias("a"), F.col("centre").alias("b")).distinct())
    lead = written(linked.join(weight.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("centre")).agg(F.max(F.struct("weight", "b"))["b"].alias("lead")), "leads")
    around = by_key(state.where("large").select("key", "rep", "component"), centres, "members").select("centre", "rep", "component").distinct()
    around = written(around.join(lead, "centre").where("rep <> lead").select(F.col("lead").alias("centre"), "rep", "component").distinct(), "around")
    if not around.isEmpty():
        rest = rest.unionByName(_about_centres(texts_of, around, width, percent))
    more = compared(rest.distinct().join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        comps = components(found.unionByName(more))
    parted = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "doc_id", "component")
    low = written(parted.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("low")), "lowest")
    reached = parted.join(low, "component", "left").select("h1", "h2", F.coalesce("low", "doc_id").alias("component"))
    return sig.select("doc_id", "t", "n_shingles", "h1", "h2"), reached


def _marked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    sig, reached = links(docs, width, percent)
    own = sig.withColumn("linked", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    return own.join(reached.withColumn("linked", F.lit(True)), ["h1", "h2", "linked"], "left").select(
        "doc_id", "t", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept")
    )


def report(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    A null, empty or blank text has an empty set: it is its own component and kept. Rows of one doc_id with equal texts
    get equal results; with other texts, each row gets the component of its own text. Rows without a doc_id have no
    component and are kept. Texts of any length are read whole. An empty table gives no rows. Other columns than doc_id
    and text are not read, whatever their names.
    """
    return _marked(docs, width, percent).drop("t")


def dedup(docs: DataFrame, width: int = 5, percent: int = 80, max_broadcast: int = MAX_GONE) -> DataFrame:
    """docs, all columns, with one document of each component: the one with the smallest doc_id.

    Rows go by doc_id and text, so that of two texts under one doc_id the one that is no copy stays. Equal rows of one
    doc_id are one document and stay or go together. Rows without a doc_id, text or words stay.
    """
    gone = written(_marked(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.col("t").alias("__gone_text")).distinct(), "copies")
    gone = F.broadcast(gone) if gone.count() <= max_broadcast else gone.hint("merge")
    same = (docs["doc_id"].cast("long") == gone["__gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__gone_text"])
    return docs.join(gone, same, "left_anti")
