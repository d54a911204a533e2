"""SimHash fingerprints of whole texts, and search by Hamming radius.

Terms are pairs of neighbouring words (the last word stands alone), weighted by their letters up to a limit, so that pairs of
short, frequent words count less. A term's 64-bit hash votes with its weight on every bit. The 64 votes are summed as 32 sums of two
32-bit lanes, in one hash aggregation, without an array or a function call per bit.

Defined results: null text is the empty text; a text without words has fingerprint 0; a tied vote gives 0. Rows equal in
doc_id and text have equal results, one row each. Rows that share a doc_id are one place in the order of documents; the one
whose text hash is smallest is that place's text. A null doc_id comes first. With one place, it follows itself.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialise, only

WORDS = r"[\x20\x09-\x0D]+"
#: Largest weight of a term; lanes then hold texts of 2**32 / 16 terms.
LONGEST = 16
LANES = 0x0000000100000001
#: Stands for a null doc_id in keys.
NO_ID = -(1 << 63)


def _vote(fp_source: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Fingerprint per row group of `keys` over the column `text`."""
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    terms = (fp_source.select(*keys, F.col(text).alias("t"))
             .select(*keys, words.alias("w"))
             .select(*keys, F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("b"))
             .select(*keys, F.explode_outer(F.arrays_zip("a", "b")).alias("p"))
             .select(*keys, F.xxhash64("p.a", "p.b").alias("h"),
                     F.when(F.col("p.a").isNotNull(), F.least(F.length("p.a") + F.coalesce(F.length("p.b"), F.lit(0)), F.lit(LONGEST)))
                     .otherwise(0).cast("long").alias("weight")))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES)) * F.col("weight")).alias(f"s{i}") for i in range(32)]
    votes = terms.groupBy(*keys).agg(F.sum("weight").alias("weight"), *sums)

    def bit(i: int) -> Column:
        lane = F.col(f"s{i % 32}")
        lane = F.shiftrightunsigned(lane, 32) if i >= 32 else lane.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(lane * 2 > F.col("weight"), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    fp = bit(0)
    for i in range(1, 64):
        fp = fp.bitwiseOR(bit(i))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def followers(ids: DataFrame) -> DataFrame:
    """k, next_k for the distinct values of k in ascending order; the first follows the last. Values are dealt by range;
    only each range's first value is looked at across ranges."""
    dealt = materialise(ids.repartitionByRange("k").withColumn("part", F.spark_partition_id()), "next-ids")
    firsts = dealt.groupBy("part").agg(F.min("k").alias("first"))
    over = Window.orderBy("part")
    heads = firsts.select("part", F.coalesce(F.lead("first").over(over), F.min("first").over(Window.partitionBy(F.lit(1)))).alias("head"))
    inside = dealt.withColumn("next_k", F.lead("k").over(Window.partitionBy("part").orderBy("k")))
    return (inside.join(heads, "part").select(*ids.columns, F.coalesce("next_k", "head").alias("next_k")))


def fingerprints_of_edits(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Fingerprints of each text, of the text whose last quarter gives way to the head of the next
    document, and of the next document: doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp."""
    d = only(docs, k=F.coalesce("doc_id", F.lit(NO_ID)), has_id=F.col("doc_id").isNotNull(), text=F.coalesce("text", F.lit("")))
    d = d.withColumn("th", F.xxhash64("text"))
    rows = materialise(d.withColumn("n", F.length("text").cast("long")).groupBy("k", "th", "n").agg(F.count("*").alias("copies")), "fp-rows")
    places = rows.groupBy("k").agg(F.min("th").alias("rep"), F.max(F.floor(F.col("n") / 4)).alias("need"))
    order = materialise(followers(places), "fp-order")
    texts = d.select("k", "th", "text")
    reps = order.select(F.col("k").alias("to_k"), F.col("next_k").alias("k"), "need")
    rep_of = order.select("k", "rep")
    # k is a key of order and next_k one of the same size, so the built sides hold one row per document of a partition.
    # The row that stands for its place is told inside the aggregate: as a filter it would become a join key, and texts would be
    # shuffled once more under other keys.
    head = (texts.join(reps.join(rep_of, "k").hint("shuffle_hash"), "k")
            .groupBy("to_k").agg(F.min(F.when(F.col("th") == F.col("rep"), F.expr("substring(text, 1, cast(need as int))"))).alias("head")))
    n, cut = F.length("text").cast("long"), F.floor(F.length("text") / 4)
    both = (texts.join(head.select(F.col("to_k").alias("k"), "head").hint("shuffle_hash"), "k")
            .withColumn("n", n)
            .withColumn("edited", F.concat(F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 4) as int))"),
                                           F.expr("substring(head, 1, cast(floor(length(text) / 4) as int))"))))
    sides = both.select("k", "th", "n", F.sha2("edited", 256).alias("sha"),
                        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")),
                                          F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("s"))
    voted = _vote(sides.select("k", "th", "n", "sha", "s.side", F.col("s.t").alias("t")), ["k", "th", "n", "sha", "side"], "t")
    fps = materialise(voted.groupBy("k", "th", "n", "sha").agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"),
                                                               F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp")), "fp-votes")
    next_fp = fps.join(rep_of, "k").filter(F.col("th") == F.col("rep")).select(F.col("k").alias("next_k"), F.col("fp").alias("next_fp"))
    return (fps.join(order.select("k", "next_k"), "k").join(next_fp, "next_k").join(rows.select("k", "th", "copies"), ["k", "th"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.nullif("k", F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
                    "fp", "edited_fp", "next_fp"))


def _block_keys(fps: DataFrame, radius: int) -> DataFrame:
    """One row per table: the bits of two of radius + 2 blocks. Up to `radius` differing bits leave two blocks alike, so
    fingerprints within the radius meet in at least one table."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in (masks[i] | masks[j] for i, j in combinations(range(n), 2))]
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for t, m in enumerate(signed)])
    return fps.withColumn("key", F.explode(keys)).select("*", "key.table", "key.bits").drop("key")


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """fps, queries: a column fp. Every (query_fp, fp, distance) with distance at most `radius`, over distinct values."""
    data = _block_keys(fps.select("fp").distinct(), radius)
    asked = _block_keys(queries.select("fp").distinct(), radius).select(F.col("fp").alias("query_fp"), "table", "bits")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("query_fp")))
    return asked.join(data, ["table", "bits"]).filter(far <= radius).select("query_fp", "fp", far.alias("distance")).distinct()
