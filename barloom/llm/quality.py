"""Quality rules with adaptive thresholds: measures of every text are held against limits that each language and source sets itself.

1. Every text gets whole-number measures (`measures`), in Arrow batches, where it lies.
2. Each (lang, source) gets a quantile sketch of each rate: counts of rows by logarithmic bucket. A bucket keeps a value's leading six bits,
   so a quantile is off by at most 1/32 of its value, and a sketch has at most 2,000 rows. Sketches merge by adding counts, in
   any order, with the same result; Spark adds them before the shuffle, so a hot source is a few hundred rows of each task.
3. Limits come from the quartiles: the upper one is q3 + max(slack, spread * (q3 - q1)), the lower one mirrors it. Groups of fewer than
   `least_rows` rows take the limits of their language, and small languages those of all rows: the same sketches, merged.
4. Limits are joined to the rows' measures, never to their texts. Rows are dealt by (group, salt), so a source with a third of all rows
   meets its limits in `salts` places.

Rows that fail the fixed base rules (fewer than 20 words, more than 30 % of the words in repeated 8-word windows) feed no sketch and are dropped.

Defined results: a null text has no words; a text without words fails the base rules. Null languages and sources are groups of their own. Rows
equal in all columns are judged alike, each for itself; doc_id is only carried. An empty table gives no rows. If every row fails the base
rules there are no limits, and none is needed. Results hold own columns only, so extra columns can't clash; `filtered` returns the input's columns,
whatever their names. Long texts are measured whole: memory is the words of one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scale import with_scalars
from barloom.llm.common import materialise, only

SYMBOLS = b"#*$%&|<>"
FOLLOWING = bytes(range(0x80, 0xC0))
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
#: Rates by name: (measure, base, scale, slack of the limit, whether low values are held against a limit too).
RATES = {"word_length": ("word_chars", "n_words", 100, 150, True), "symbols": ("n_symbols", "n_words", 1000, 100, False),
         "dup_lines": ("n_dup_lines", "n_lines", 1000, 350, False),
         "capitals": ("n_capitals", "word_chars", 1000, 100, False)}
SPREAD = 3
LEAST_ROWS = 100
SALTS = 16


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` (a power of two) words that come up twice or more, the first place included. Windows get ranks
    by doubling: equal windows of 2k words are equal pairs of windows of k words."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    rank = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    k = 1
    while k < width:
        pair = rank[:-k] * (int(rank.max()) + 1) + rank[k:]
        rank = np.unique(pair, return_inverse=True)[1]
        k *= 2
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[width:] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """FIELDS of a text in UTF-8. Python's split of bytes parts at exactly the six ASCII white-space signs."""
    text = text or b""
    words = text.split()
    body = b"".join(words)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (len(words), len(body.translate(None, FOLLOWING)), len(body) - len(body.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(body) - len(body.translate(None, CAPITALS)))


def measures(text: str = "text") -> Column:
    """A struct of FIELDS."""
    kind = pa.struct([(f, pa.int64()) for f in FIELDS])

    @F.arrow_udf(", ".join(f"{f} long" for f in FIELDS))
    def run(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_py()) for t in texts]
        return pa.array([dict(zip(FIELDS, r)) for r in rows], kind)

    return run(F.col(f"`{text}`").cast("binary"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def rates() -> dict[str, Column]:
    return {k: F.call_function("div", F.col(num) * scale, F.greatest(F.col(den), F.lit(1).cast("long"))) for k, (num, den, scale, *_) in RATES.items()}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the measures, the rates and base_failed of every row."""
    m = only(docs, doc_id="doc_id", lang="lang", source="source", m=measures())
    m = m.select("doc_id", "lang", "source", *[F.col(f"m.{f}").alias(f) for f in FIELDS])
    return m.withColumns(rates()).withColumn("base_failed", base_failed())


def _bucket(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return shift * 32 + F.call_function("shiftright", v, shift)


def _value(b: Column) -> Column:
    """Middle of a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - shift * 32).cast("long"), shift) + F.call_function("shiftright", F.call_function("shiftleft", F.lit(1).cast("long"), shift), F.lit(1))


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: one sketch per (lang, source, rate), of the rows of `measured` that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), _bucket(F.col(k)).alias("bucket")) for k in RATES]))
    return (rows.filter("not base_failed").select("lang", "source", each.alias("e")).groupBy("lang", "source", "e.rate", "e.bucket")
            .agg(F.count("*").alias("n")))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches added up, per the columns `by` (from lang and source)."""
    return parts.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def quartiles(parts: DataFrame, by: list[str]) -> DataFrame:
    """by, rate, rows, q1, q3. A window here holds one sketch: at most 2,000 rows."""
    one = W.partitionBy(*by, "rate")
    up = one.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = parts.withColumns({"upto": F.sum("n").over(up), "rows": F.sum("n").over(one)})
    at = lambda quarters: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * quarters, _value(F.col("bucket"))))
    return run.groupBy(*by, "rate").agg(F.max("rows").alias("rows"), at(1).alias("q1"), at(3).alias("q3"))


def limits(parts: DataFrame, spread: int = SPREAD, least_rows: int = LEAST_ROWS) -> DataFrame:
    """lang, source and, per rate, low_<rate> and high_<rate> (low is null where only high values count)."""
    def fences(q: DataFrame, by: list[str], name: str) -> DataFrame:
        out = [F.max("rows").alias(f"rows_{name}")]
        for k, (_, _, _, slack, two_sided) in RATES.items():
            here = F.col("rate") == k
            wide = F.greatest(F.lit(slack), (F.col("q3") - F.col("q1")) * spread)
            low = F.col("q1") - wide if two_sided else F.lit(None).cast("long")
            out.append(F.max(F.when(here, F.struct(low.alias("low"), (F.col("q3") + wide).alias("high")))).alias(f"{k}_{name}"))
        return q.groupBy(*by).agg(*out)

    by_lang, in_all = merged(parts, ["lang"]), merged(parts, [])
    own = fences(quartiles(parts, ["lang", "source"]), ["lang", "source"], "own")
    tongue = fences(quartiles(by_lang, ["lang"]), ["lang"], "lang").withColumnRenamed("lang", "lang_l")
    whole = fences(quartiles(in_all, []), [], "all").drop("rows_all")
    j = with_scalars(own.join(tongue, F.col("lang").eqNullSafe(F.col("lang_l"))), whole)
    pick = lambda k: (F.when(F.col("rows_own") >= least_rows, F.col(f"{k}_own")).when(F.col("rows_lang") >= least_rows, F.col(f"{k}_lang"))
                      .otherwise(F.col(f"{k}_all")))
    return j.select("lang", "source", *[pick(k)[side].alias(f"{side}_{k}") for k in RATES for side in ("low", "high")])


def _group_key() -> Column:
    """One non-null key of a (lang, source), nulls told from texts."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.concat(F.length(part("lang")).cast("string"), F.lit(":"), part("lang"), part("source"))


def _with_limits(rows: DataFrame, bounds: DataFrame, salts: int) -> DataFrame:
    """rows (with lang, source and the rates) and their verdict `within`."""
    right = bounds.select(_group_key().alias("group_r"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt_r"),
                          *[F.col(f"{s}_{k}") for k in RATES for s in ("low", "high")])
    left = rows.withColumns({"group_l": _group_key(), "salt_l": F.pmod(F.xxhash64(*RATES, *FIELDS), F.lit(salts)).cast("int")})
    j = left.join(right, (F.col("group_l") == F.col("group_r")) & (F.col("salt_l") == F.col("salt_r")), "left")
    ok = F.lit(True)
    for k in RATES:
        ok = ok & (F.col(k) >= F.coalesce(f"low_{k}", F.col(k))) & (F.col(k) <= F.coalesce(f"high_{k}", F.col(k)))
    return j.withColumn("within", ok)


def judged(docs: DataFrame, spread: int = SPREAD, least_rows: int = LEAST_ROWS, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, lang, source, the measures, base_failed and kept. Measures are stored once: texts are read once."""
    rows = materialise(measured(docs), "quality-rows")
    bounds = materialise(limits(materialise(sketches(rows), "quality-sketches"), spread, least_rows), "quality-limits")
    return (_with_limits(rows, bounds, salts)
            .select("doc_id", "lang", "source", *FIELDS, "base_failed", (~F.col("base_failed") & F.col("within")).alias("kept")))


def filtered(docs: DataFrame, bounds: DataFrame | None = None, spread: int = SPREAD, least_rows: int = LEAST_ROWS, salts: int = SALTS) -> DataFrame:
    """The rows of docs that pass, with docs' columns. Limits of other rows can be given; texts are measured a second time, never shuffled by content."""
    if bounds is None:
        bounds = materialise(limits(materialise(sketches(measured(docs)), "quality-sketches"), spread, least_rows), "quality-limits")
    rows = docs.select(F.struct("*").alias("whole_row"), F.col("`lang`").alias("lang"), F.col("`source`").alias("source"), measures().alias("m"))
    rows = rows.select("whole_row", "lang", "source", *[F.col(f"m.{f}").alias(f) for f in FIELDS]).withColumns(rates())
    return _with_limits(rows.filter(~base_failed()), bounds, salts).filter("within").select("whole_row.*")
