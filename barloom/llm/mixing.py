"""Mixing sources to target weights.

Words of a source, document after document, form one long stream that is cut into blocks of a fixed length. Output
shards draw how many blocks of each source they hold (a multinomial draw), a slot's running number within its source
goes through a pseudorandom permutation of the source's block numbers, and blocks are joined by number. A source that is
taken more than once goes through a permutation of its own in each pass, so no block is taken more often than the limit.

Defined results: null or empty text has no words and is never taken; the null source is a source, last in order; rows
that are equal in every column are mixed one by one; a null doc_id is an ordinary value; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialise, only

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space behind it, so that joined pieces keep their lines.
WORD_AND_GAP = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Resolution of the draw: source probabilities are stepped by 1 / DRAW.
DRAW = 1 << 16
ROUNDS = 12


@dataclass
class Mixture:
    """sources: sid, source, source_size, weight, target, n_blocks, quota. layout: a row per document with its place in
    its source's stream. slots: shard, sid, copy (which pass), block."""

    sources: DataFrame
    layout: DataFrame
    slots: DataFrame
    block_words: int

    def pieces(self) -> DataFrame:
        """Word range [lo, hi) of each document in each block it touches; without words, one row whose block is null."""
        b, o, n = F.lit(self.block_words), F.col("offset"), F.col("size")
        touched = F.when(n > 0, F.sequence(F.floor(o / b), F.floor((o + n - 1) / b)))
        out = self.layout.withColumn("block", F.explode_outer(touched))
        lo = F.greatest(F.col("block") * b, o) - o
        hi = F.least((F.col("block") + 1) * b, o + n) - o
        return out.withColumns({"lo": lo, "hi": hi})


def permuted(slots: DataFrame, seed: int, rounds: int = ROUNDS) -> DataFrame:
    """Replace `index` in [0, n_blocks) by its image under a permutation keyed by (sid, copy).

    Swap-or-not rounds: an index and its mirror image about a keyed point trade places where a keyed bit of the larger
    one says so. Each round is its own inverse, hence a permutation of any domain size without rejected values.
    """
    def one(x: Column, i: Column) -> Column:
        key = [F.col("sid"), F.col("copy"), F.lit(seed), i]
        mirror = F.pmod(F.xxhash64(*key) - x, F.col("n_blocks"))
        bit = F.xxhash64(*key, F.greatest(x, mirror)).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, mirror).otherwise(x)

    return slots.withColumn("index", F.reduce(F.sequence(F.lit(1), F.lit(rounds)), F.col("index").cast("long"), one))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], limit: int, block_words: int) -> DataFrame:
    """Targets min(limit * size, level * weight) whose sum is all words. The level comes from running sums over sources
    in the order in which they reach their limit: what a limited source can't take is shared by the rest.

    sizes: source, source_size. The number of sources is small; one task orders them."""
    every = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("sid", rank.cast("long")).withColumn("weight", w)
    full = every.orderBy(F.col("source_size") / F.col("weight"), "sid")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumns({
        "words": F.sum("source_size").over(every),
        "used": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * limit,
        "open": F.sum("weight").over(rest)})
    s = s.withColumn("level", (F.col("words") - F.col("used")) / F.col("open"))
    # Levels rise while the next source is over its limit and fall after it: the largest is the one that all can meet.
    s = s.withColumn("level", F.max("level").over(every))
    target = F.least((F.col("source_size") * limit).cast("double"), F.col("level") * F.col("weight"))
    blocks = F.ceil(F.col("source_size") / block_words)
    return (s.withColumn("target", F.coalesce(target, F.lit(0.0))).withColumn("n_blocks", blocks)
            .withColumn("quota", F.coalesce(F.least(F.col("n_blocks") * limit,
                                                    F.round(F.col("target") / F.col("source_size") * F.col("n_blocks")).cast("long")), F.lit(0)))
            .select("sid", "source", "source_size", "weight", "target", "n_blocks", "quota"))


def mix(docs: DataFrame, seed: int = 17, block_words: int = 64, shard_slots: int = 4096, limit: int = 3,
        weights: tuple[int, ...] = (1, 2, 3), bucket_rows: int = 5000) -> Mixture:
    """docs: doc_id, text, source. shard_slots: blocks of an output shard. bucket_rows: documents whose words are summed
    in one group when offsets are made; groups are chosen by hash over all sources, so a large source is split."""
    sized = materialise(only(docs, doc_id="doc_id", source="source",
                             size=F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
                             h=F.xxhash64("doc_id", "text")), "mix-sizes")
    sources = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit, block_words),
                          "mix-sources")
    n = sized.agg(F.greatest(F.lit(64), F.ceil(F.count("*") / bucket_rows)).alias("n"))
    n_buckets = _scalar(n)
    named = (sized.join(sources.select(F.col("source").alias("s"), "sid"), F.col("source").eqNullSafe(F.col("s")))
             .drop("s").withColumn("bucket", F.pmod(F.col("h"), n_buckets)))
    sums = named.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    base = sums.select("sid", "bucket", (F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words")).alias("base"))
    # Placed by bucket alone: every group has documents of all sources and about the same number of rows.
    inner = Window.partitionBy("bucket", "sid").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    layout = (named.repartition(F.col("bucket")).withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
              .join(base, ["sid", "bucket"]).withColumn("offset", F.col("base") + F.col("within"))
              .select("doc_id", "source", "size", "h", "sid", "offset"))
    return Mixture(sources, layout, _slots(sources, seed, shard_slots), block_words)


def _scalar(one: DataFrame) -> Column:
    return one.scalar()


def _slots(sources: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """Slots of all shards: the draw of each shard, settled to the sources' quotas in a closing shard."""
    # Rows multiply behind these exchanges, so their number of partitions is stated; and sizes guessed from the few
    # sources must not lead to a broadcast of slots, so joins with slots are merges.
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cum = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.floor(F.sum("quota").over(cum) * F.lit(DRAW) / F.greatest(F.sum("quota").over(Window.partitionBy(F.lit(1))), F.lit(1)))
    faces = (sources.select("sid", edge.alias("to"))
             .withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("sid")), F.lit(0)))
             .filter(F.col("to") > F.col("from"))
             .select("sid", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("face")))  # DRAW rows, whatever the input
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("total"))
    # One row per shard first; its draws are made where the shard's row is.
    shards = total.filter("total > 0").select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / shard_slots))).alias("shard"))
    size = F.least(F.lit(shard_slots).cast("long"), F.col("total") - F.col("shard") * shard_slots)
    throws = (shards.repartition(tasks, "shard")
              .select("shard", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("slot"))
              .select("shard", F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(DRAW)).alias("face"))
              .groupBy("shard", "face").count())
    counts = throws.join(F.broadcast(faces), "face").groupBy("sid", "shard").agg(F.sum("count").alias("n"))
    run = Window.partitionBy("sid").orderBy("shard")
    drawn = counts.select("sid", "shard", "n", (F.sum("n").over(run) - F.col("n")).alias("start"))
    held = sources.filter("quota > 0").select("sid", "n_blocks", "quota")
    kept = (drawn.join(held, "sid").filter("start < quota")
            .select("sid", "shard", "n_blocks", "start", F.least(F.col("start") + F.col("n"), F.col("quota")).alias("end")))
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    closing = (held.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota")
               .select("sid", F.lit(-1).cast("long").alias("shard"), "n_blocks", F.col("got").alias("start"), F.col("quota").alias("end")))
    ranks = (kept.unionByName(closing).repartition(tasks, "sid", "shard")
             .withColumn("rank", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
             .select("shard", "sid", "n_blocks", F.floor(F.col("rank") / F.col("n_blocks")).alias("copy"),
                     (F.col("rank") % F.col("n_blocks")).alias("index")))
    return permuted(ranks, seed).select("shard", "sid", "copy", F.col("index").alias("block"))


def words_taken(m: Mixture) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken."""
    times = m.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    words = F.coalesce((F.col("hi") - F.col("lo")) * F.col("times"), F.lit(0))
    # An empty document shares its offset with the next one: h tells them apart, and a count keeps equal empty rows.
    per = (m.pieces().join(times.hint("merge"), ["sid", "block"], "left")
           .groupBy("sid", "offset", "size", "h").agg(F.first("doc_id").alias("doc_id"), F.sum(words).alias("taken"),
                                                      F.sum(F.when(F.col("size") == 0, 1).otherwise(0)).alias("copies")))
    return (per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("copies"), F.lit(1)))))
            .join(m.sources.select("sid", "source", "source_size", "target"), "sid")
            .select("doc_id", "source", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, m: Mixture) -> DataFrame:
    """Documents of the mix, in the columns of `docs`: a row for each document and pass that takes some of its words,
    with the taken words as text and n_chars counted anew. Rows equal in doc_id and text share their other columns."""
    ranges = (m.pieces().join(m.slots.hint("merge"), ["sid", "block"])
              .groupBy(F.col("h").alias("__h"), "sid", "offset", "copy").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("__ranges"))
              .select("__h", "__ranges"))
    texts = docs.withColumn("__h", F.xxhash64("doc_id", "text")).dropDuplicates(["__h"])
    words = F.regexp_extract_all("text", F.lit(WORD_AND_GAP), F.lit(0))
    cut = F.transform("__ranges", lambda r: F.array_join(F.slice(F.col("__words"), (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), ""))
    out = texts.join(ranges, "__h").withColumn("__words", words).withColumn("text", F.array_join(cut, ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
