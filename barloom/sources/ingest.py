"""Reading and standardising landed files: pools, bars, snapshots, flows, profiles, headlines."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.scalars import name_key, norm_code, safe_div, strip_units, to_double
from barloom.functions.scale import newest_row, top_k
from barloom.operators.panel import by_symbol

# Header aliases.
CODE_NAMES = ["股票代码", "证券代码", "代码", "stockcode", "code", "symbol"]
NAME_NAMES = ["股票名称", "证券名称", "证券简称", "名称", "stockname", "name"]
BAR_ALIASES = {
    "symbol": CODE_NAMES, "name": NAME_NAMES, "trade_date": ["日期", "date", "trade_date"], "open": ["开盘价", "开盘", "今开", "open"],
    "high": ["最高价", "最高", "high"], "low": ["最低价", "最低", "low"], "close": ["收盘价", "收盘", "close"],
    "volume": ["成交量", "volume"], "amount": ["成交额", "amount"], "turnover": ["换手率", "turnoverratio", "turnover"],
    "pct_change": ["涨跌幅", "pct_change"], "change": ["涨跌额"], "amplitude": ["振幅"]}
SPOT_ALIASES = {
    "symbol": CODE_NAMES, "name": NAME_NAMES, "price": ["最新价", "当前价", "trade", "price"], "open": ["今开", "开盘", "open"],
    "high": ["最高", "high"], "low": ["最低", "low"], "previous": ["昨收", "settlement", "preclose"], "volume": ["成交量", "volume"],
    "amount": ["成交额", "amount"], "turnover": ["换手率", "turnover"], "quantity_ratio": ["量比"], "pct": ["涨跌幅", "changepercent"]}
SEPARATORS = ("\t", ",", ";", "|")


def header_key(name: str) -> str:
    """A header without what writers vary: case, blanks, hyphens, underscores."""
    return "".join(ch for ch in name.casefold() if not ch.isspace() and ch not in "-_")


def resolve_header(columns: list[str], aliases: list[str]) -> str | None:
    """The column with the lowest score: an exact alias scores its place in the list (of equal headers the last counts), a column that only contains one
    scores after all aliases (of such columns the first counts)."""
    place = {header_key(a): i for i, a in reversed(list(enumerate(aliases)))}
    scored = []
    for at, column in enumerate(columns):
        key = header_key(column)
        if key in place:
            scored.append((place[key], -at, column))
        elif any(part in key for part in place):
            scored.append((len(aliases), at, column))
    return min(scored)[2] if scored else None


def rename_by_alias(df: DataFrame, aliases: dict[str, list[str]], keep_extra: bool = False) -> DataFrame:
    """Select canonical columns by header aliases; absent ones become NULL."""
    found = {ours: resolve_header(df.columns, names) for ours, names in aliases.items()}
    cols = [F.col(f"`{src}`").alias(ours) if src else F.lit(None).cast("string").alias(ours) for ours, src in found.items()]
    extra = [F.col(f"`{c}`") for c in df.columns if c not in found.values() and c not in found] if keep_extra else []
    return df.select(*cols, *extra)


def encodings(raw: bytes) -> list[str]:
    """Encodings a file may have, most likely first: UTF-16 by its mark, or by a zero byte in at least three of the first four letters; UTF-8; GB18030."""
    odd, even = raw[1:8:2].count(0), raw[0:8:2].count(0)
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return ["utf-16"]
    wide = ["utf-16-le"] if len(raw) >= 8 and odd >= 3 else ["utf-16-be"] if len(raw) >= 8 and even >= 3 else []
    return [*wide, "utf-8-sig", "gb18030", *(["utf-16-le", "utf-16-be"] if not wide else [])]


def pool_rows(raw: bytes) -> list[tuple[str | None, str | None]]:
    """(code, name) texts of a delimited file. The first encoding that decodes all of it to a table with a code or name header counts; a stray last byte
    of UTF-16 is let go. Lines end with CR, LF or both; separators and line ends inside quotes belong to their field; the separator is the one
    that the header has most often."""
    for encoding in encodings(raw):
        try:
            text = raw[:len(raw) - len(raw) % 2 if encoding.startswith("utf-16") else None].decode(encoding)
        except UnicodeDecodeError:
            continue
        text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\n\ufeff")
        head = text.split("\n", 1)[0]
        for sep in sorted(SEPARATORS, key=head.count, reverse=True):
            rows = csv.reader(io.StringIO(text), delimiter=sep)
            columns = next(rows, [])
            code, name = resolve_header(columns, CODE_NAMES), resolve_header(columns, NAME_NAMES)
            if "\0" in head or not (code or name):
                continue
            at = [columns.index(c) if c else len(columns) for c in (code, name)]
            return [tuple(r[i] if i < len(r) and i < len(columns) else None for i in at) for r in rows if any(x.strip() for x in r)]
    raise ValueError(f"no code or name header in {raw[:80]!r}")


def read_pool_files(spark: SparkSession, paths: list[str], names: DataFrame | None = None) -> DataFrame:
    """Delimited symbol lists, each file in its own encoding, line ends, separator and header. Spark reads the files, from any store that it can read, and each is
    taken apart in the task that holds it; a file that is no such list is an error, never an empty result. A row without a code takes the code
    of its name, if `names` (symbol, name) has that name once. Rows without a valid code go; of a code's rows the first stays."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"]):
                try:
                    rows = pool_rows(content.as_py())
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from None
                columns = [[path] * len(rows), range(len(rows)), [r[0] for r in rows], [r[1] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "at", "code", "name"])

    files = spark.read.format("binaryFile").load(paths).filter("length > 0").select("path", "content")
    rows = files.mapInArrow(parse, "path string, at long, code string, name string")
    out = rows.select(norm_code("code").alias("symbol"), F.trim("name").alias("name"), F.struct("path", "at").alias("_at"))
    if names is not None:
        known = names.groupBy(name_key("name").alias("_n")).agg(F.min("symbol").alias("_s"), F.countDistinct("symbol").alias("_c")).filter("_c = 1")
        out = out.withColumn("_n", name_key("name")).join(known, "_n", "left").withColumn("symbol", F.coalesce(F.nullif("symbol", F.lit("")), "_s"))
    return out.filter(F.col("symbol").rlike("^[0-9]{6}$")).groupBy("symbol").agg(F.min_by("name", "_at").alias("name"))


def read_pool_text(lines: DataFrame, order: str | None = None) -> DataFrame:
    """One symbol per line (column value): the first token gives the code, the rest the name. Of a code's lines the first by `order` (a column; by default
    the order of reading) stays."""
    p = F.split(F.trim("value"), r"[,，\s]+", 2)
    at = F.col(order) if order else F.monotonically_increasing_id()
    z = lines.select(norm_code(p[0]).alias("symbol"), F.coalesce(F.trim(F.get(p, 1)), F.lit("")).alias("name"), at.alias("_at"))
    return z.filter("symbol <> ''").groupBy("symbol").agg(F.min_by("name", "_at").alias("name"))


def standardise_bars(df: DataFrame, source: str = "") -> DataFrame:
    """Canonical bars with percentage change, change and amplitude derived where absent."""
    x = rename_by_alias(df, BAR_ALIASES)
    num = ("open", "high", "low", "close", "volume", "amount", "turnover", "pct_change", "change", "amplitude")
    x = x.select(norm_code("symbol").alias("symbol"), "name", F.col("trade_date").try_cast("date").alias("trade_date"),
                 *[to_double(c).alias(c) for c in num]).filter("trade_date IS NOT NULL")
    prev = F.lag("close").over(by_symbol())
    x = x.withColumn("_p", prev)
    return x.withColumns({
        "pct_change": F.coalesce("pct_change", (safe_div("close", "_p") - 1) * 100),
        "change": F.coalesce("change", F.col("close") - F.col("_p")),
        "amplitude": F.coalesce("amplitude", safe_div(F.col("high") - F.col("low"), "_p") * 100),
        "source": F.lit(source)}).drop("_p")


def prefer_source(bars: DataFrame, order: list[str], need: int) -> DataFrame:
    """Per symbol the first source in priority order with at least min(10, need) usable rows."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    n = bars.filter(F.col("close").isNotNull()).groupBy("symbol", "source").agg(F.count(F.lit(1)).alias("_n"))
    ok = n.filter(F.col("_n") >= min(10, need)).withColumn("_r", rank).filter("_r > 0")
    best = ok.groupBy("symbol").agg(F.min_by("source", "_r").alias("source"))
    return bars.join(best, ["symbol", "source"], "left_semi")


def attach_raw_prices(adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """Unadjusted prices beside adjusted ones, and the adjustment factor."""
    r = raw.select("symbol", "trade_date", *[F.col(c).alias(f"raw_{c}") for c in ("open", "high", "low", "close")])
    return adjusted.join(r, ["symbol", "trade_date"], "left").withColumn("adj_factor", safe_div("close", "raw_close"))


def raw_match_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy("symbol").agg(F.count("raw_close").alias("matched_days"), F.count(F.lit(1)).alias("days"))


def volume_ratio_5d(bars: DataFrame, keep: int = 120) -> DataFrame:
    """Volume over the mean of the five volumes before it (all five required); the last `keep` bars per symbol."""
    w = by_symbol()
    five = w.rowsBetween(-5, -1)
    x = bars.withColumn("volume_ratio_5d", F.when(F.count("volume").over(five) == 5, safe_div("volume", F.avg("volume").over(five))))
    return last_n_bars(x, keep)


def last_n_bars(bars: DataFrame, n: int, version: str | None = None) -> DataFrame:
    """Newest row per date (by `version`, combined map-side), then the last n dates per symbol."""
    one = newest_row(bars, ["symbol", "trade_date"], [F.col(version)]) if version else bars
    back = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("trade_date").desc()))
    return one.withColumn("_b", back).filter(F.col("_b") <= n).drop("_b")


def spot_for_pool(spot: DataFrame, pool: DataFrame, captured_at: str) -> DataFrame:
    """Standard snapshot columns of pool members, stamped with the capture time."""
    x = rename_by_alias(spot, SPOT_ALIASES)
    x = x.select(norm_code("symbol").alias("symbol"), "name", *[to_double(c).alias(c) for c in SPOT_ALIASES if c not in ("symbol", "name")])
    ts = F.lit(captured_at).cast("timestamp")
    return x.join(pool.select("symbol"), "symbol", "left_semi").withColumns({"captured_at": ts, "trade_date": F.to_date(ts)})


def minute_for_day(minute: DataFrame, pool: DataFrame, day: str, source: str = "") -> tuple[DataFrame, DataFrame]:
    """(bars on the day for pool members, row-count QA for every pool member)."""
    m = minute.filter(F.to_date("ts") == F.lit(day).cast("date")).drop("name").join(pool.select("symbol", "name"), "symbol")
    n = m.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    qa = pool.select("symbol", "name").join(n, "symbol", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return m.withColumn("source", F.lit(source)), qa.withColumn("status", F.when(F.col("rows") > 0, "成功").otherwise("失败"))


def index_bars(df: DataFrame, names: dict[str, str], days: int) -> tuple[DataFrame, DataFrame]:
    """(last `days` bars per index with its name, QA rows per index). names: code -> display name (a fixed few)."""
    lab = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    x = last_n_bars(df.filter(F.col("symbol").isin(*names)), days).withColumn("name", lab[F.col("symbol")])
    return x, x.groupBy("symbol", "name").agg(F.count(F.lit(1)).alias("rows"), F.max("trade_date").alias("last_date"))


def kv_stats(df: DataFrame, keys: list[str], by=("trade_date",)) -> DataFrame:
    """item/value rows to one column per required key, as rounded counts, and `missing`: the required keys without a value."""
    x = df.withColumn("_v", F.round(strip_units("value")).cast("long"))
    out = x.groupBy(*by).pivot("item", keys).agg(F.max("_v"))
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(f"`{k}`").isNull(), F.lit(k)) for k in keys])))


def fund_flow_last10(flow: DataFrame, rank10: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last ten daily flow rows per candidate; else the ten-day aggregate row, marked as such."""
    f = flow.join(pool.select("symbol"), "symbol", "left_semi")
    f = last_n_bars(f, 10).withColumn("aggregated", F.lit(False))
    r = rank10.join(pool.select("symbol"), "symbol", "left_semi").join(f.select("symbol"), "symbol", "left_anti")
    z = f.unionByName(r.withColumn("aggregated", F.lit(True)), allowMissingColumns=True)
    n = z.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.max("aggregated").alias("_a"))
    qa = pool.select("symbol").distinct().join(n, "symbol", "left")
    status = F.when(F.col("rows").isNull(), "失败").when(F.col("_a"), "警告").otherwise("成功")
    return z, qa.select("symbol", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def profiles_long(info: DataFrame, business: DataFrame, pool: DataFrame) -> DataFrame:
    """(symbol, item, value) rows; the fallback table serves symbols without rows."""
    p = pool.select("symbol")
    a = info.join(p, "symbol", "left_semi").withColumn("source", F.lit("info"))
    b = business.join(p, "symbol", "left_semi").join(info.select("symbol"), "symbol", "left_anti").withColumn("source", F.lit("business"))
    return a.unionByName(b)


def strip_tags(c) -> Column:
    return F.regexp_replace(c, "</?em>", "")


def latest_headlines(news: DataFrame, fallback: DataFrame, pool: DataFrame, k: int = 6) -> DataFrame:
    """Newest k titles per symbol, emphasis tags removed; the fallback serves symbols without news."""
    p = pool.select("symbol")
    a = news.join(p, "symbol", "left_semi")
    b = fallback.join(p, "symbol", "left_semi").join(news.select("symbol"), "symbol", "left_anti")
    z = a.unionByName(b, allowMissingColumns=True).withColumn("title", strip_tags("title"))
    return top_k(z, ["symbol"], [F.col("ts").desc(), F.col("title")], k, ["title", "ts"], "place")


def fetch_qa(audit: DataFrame) -> DataFrame:
    return audit.agg(F.count_if(F.col("status") == "成功").alias("success"),
                     F.count_if((F.col("status") == "成功") & F.lower("cache_mode").rlike("cache|increment")).alias("cached"),
                     F.count(F.lit(1)).alias("total"))


def coverage_gate(audit: DataFrame, share: float = 0.8, floor: int = 1000) -> DataFrame:
    """One row: successes, required, passed. `assert_coverage` turns it into a job failure."""
    a = audit.agg(F.count_if(F.col("status") == "成功").alias("success"), F.count(F.lit(1)).alias("listed"))
    need = F.greatest(F.lit(floor), F.ceil(F.col("listed") * share)).cast("long")
    return a.withColumn("required", need).withColumn("passed", F.col("success") >= F.col("required"))


def assert_coverage(audit: DataFrame, share: float = 0.8, floor: int = 1000) -> None:
    row = coverage_gate(audit, share, floor).first()
    if not row["passed"]:
        raise RuntimeError(f"coverage {row['success']} of {row['listed']} is below {row['required']}")
