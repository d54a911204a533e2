"""Symbol identity, pools and the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.digest import ordered_digests
from barloom.functions.scalars import col, first_match, flag, is_st, name_key, norm_code
from barloom.functions.scale import newest_row, with_scalars

# Index names, states, reasons and change labels.
INDEX_NAMES = ("上证指数", "深证成指", "创业板指", "科创50", "北证50", "上证综指", "深证成份指数", "创业板指数", "科创50指数", "北证50指数")
ACTIVE, COOLING, GONE, STAGE1, STAGE2 = "活跃", "冷却观察", "已淘汰", "一级活跃", "进入120日结构研究池"
ST_REASON = "硬规则：ST/*ST/SST/S*ST股票不得进入或保留在当前观察池"
DROP_REASON = "维护v0.1：较久未再次提交，且120日/40日趋势证据同步转弱；若后续重新强势并再次提交可自动恢复"
NEW, AGAIN, BACK, ST_OUT, INDEX_OUT = "新增", "已有/再次提交", "重新激活", "ST股票硬排除", "隔离为指数/非个股"
REGISTRY = ("symbol", "name", "first_submit", "last_submit", "submit_count", "status", "eliminated_on", "eliminated_reason")


def is_index(code, name) -> Column:
    c, n = col(code), F.replace(F.trim(F.coalesce(col(name), F.lit(""))), F.lit(" "), F.lit(""))
    return c.startswith("399") | (c == "899050") | n.isin(*INDEX_NAMES) | n.contains("指数")


def split_stocks_indices(pool: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> tuple[DataFrame, DataFrame]:
    """(stocks, indices), each one row per code, or per `keys`. `position` keeps the first row where present."""
    order = [F.col("position")] if "position" in pool.columns else [F.col("name")]
    x = pool.withColumn("symbol", norm_code("symbol")).withColumn("name", F.trim(F.coalesce("name", F.lit(""))))
    x = x.withColumn("_i", is_index("symbol", "name"))
    idx = newest_row(x.filter("_i").drop("_i"), [*keys], order, newest=False)
    st = newest_row(x.filter(~F.col("_i") & F.col("symbol").rlike("^[0-9]{6}$")).drop("_i"), [*keys], order, newest=False)
    return st, idx


def resolve_names(names: DataFrame, *tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved). tables: symbol, name in order of authority; a key must mean exactly one code."""
    u = None
    for i, t in enumerate(tables):
        z = t.select(norm_code("symbol").alias("symbol"), F.trim("name").alias("name"), F.lit(i).alias("_src"))
        u = z if u is None else u.unionByName(z)
    u = u.withColumn("_k", name_key("name")).filter((F.col("_k") != "") & F.col("symbol").rlike("^[0-9]{6}$"))
    # min = max says "one code" without collecting the codes of a key.
    one = u.groupBy("_k").agg(F.min("symbol").alias("symbol"), F.max("symbol").alias("_m")).filter("symbol = _m").drop("_m")
    official = u.groupBy("symbol").agg(F.min_by("name", F.struct("_src", "name")).alias("official_name"))
    q = names.withColumn("_k", name_key("name"))
    hit = q.join(one, "_k").join(official, "symbol", "left").drop("_k")
    return hit, q.join(one, "_k", "left_anti").drop("_k")


def refresh_names(df: DataFrame, master: DataFrame) -> DataFrame:
    m = master.select("symbol", F.col("name").alias("_m"))
    return df.join(m, "symbol", "left").withColumn("name", F.coalesce(F.nullif(F.trim("_m"), F.lit("")), "name")).drop("_m")


def merge_registry(registry: DataFrame, daily: DataFrame, asof: str, keys: tuple[str, ...] = ("symbol",)) -> tuple[DataFrame, DataFrame]:
    """(registry, changes): upsert of the day's submission as one full outer join. `keys` tell entries apart: the code, and what else it takes
    where a code stands for several entries."""
    day = F.lit(asof).cast("date")
    stocks, idx = split_stocks_indices(daily, keys)
    d = stocks.select(*keys, F.col("name").alias("_n"), F.lit(True).alias("_new"))
    j = registry.withColumn("_old", F.lit(True)).join(d, [*keys], "full_outer")
    new, old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    st_new, st_old = new & is_st("_n"), old & is_st("name")
    drop = st_new | (st_old & ~new)
    up = new & ~st_new
    keep = old | up          # a submitted ST symbol that is unknown does not enter
    better = F.coalesce(F.nullif(F.col("_n"), F.lit("")), F.col("name"), F.lit(""))
    out = j.filter(keep).select(
        "symbol", F.when(new, better).otherwise(F.col("name")).alias("name"),
        F.when(up & ~old, day).otherwise(F.col("first_submit")).alias("first_submit"),
        F.when(up, day).otherwise(F.col("last_submit")).alias("last_submit"),
        F.when(up, F.coalesce("submit_count", F.lit(0)) + 1).otherwise(F.col("submit_count")).cast("int").alias("submit_count"),
        F.when(drop, GONE).when(up, ACTIVE).otherwise(F.col("status")).alias("status"),
        F.when(drop, day).when(up, F.lit(None)).otherwise(F.col("eliminated_on")).alias("eliminated_on"),
        F.when(drop, ST_REASON).when(up, F.lit("")).otherwise(F.col("eliminated_reason")).alias("eliminated_reason"))
    # A stored ST name has been put out before the submission is looked at.
    was_gone = (F.col("status") == GONE) | st_old
    ch = j.filter(new).select("symbol", F.col("_n").alias("name"), first_match(
        [(st_new, ST_OUT), (old & flag(was_gone), BACK), (old, AGAIN)], NEW).alias("change"))
    return out, ch.unionByName(idx.select("symbol", "name", F.lit(INDEX_OUT).alias("change")))


def maintain_registry(registry: DataFrame, feats: DataFrame, asof: str, inactive: int = 45, strict_quirk: bool = True) -> tuple[DataFrame, DataFrame]:
    """(registry, audit): age and weak trends drop, cool or keep a symbol.

    With strict_quirk the "not yet eliminated" guard covers the 60-day branch only, so a stale weak symbol that
    was already eliminated gets a new elimination date.
    """
    day = F.lit(asof).cast("date")
    need = ["ret10", "ret20", "ret40", "ret120", "ma20_dist", "ma30_slope5"]
    x = registry.join(feats.select("symbol", *need), "symbol", "left")
    c = F.col
    age = F.datediff(day, c("last_submit"))
    weak = flag((c("ret40") < 0) & (c("ma20_dist") < 0) & (c("ma30_slope5") <= 0))
    very = flag((c("ret120") < 0) & (c("ret40") < 0) & (c("ma30_slope5") < 0))
    short = flag((c("ret20") < 0) & (c("ret10") < 0) & (c("ma20_dist") < 0))
    alive = F.coalesce(c("status"), F.lit("")) != GONE
    old_drop = flag(age >= inactive) & (weak | very)
    if not strict_quirk:
        old_drop = old_drop & alive
    drop = old_drop | (flag(age >= 60) & short & alive)
    st = is_st("name")
    x = x.withColumns({"_drop": drop, "_alive": alive, "_age": age, "_st": st})
    out = c("_drop") | c("_st")
    x = x.withColumns({
        "status": F.when(out, GONE).when(flag(c("_age") >= 15) & c("_alive"), COOLING).when(flag(c("_age") < 15) & c("_alive"), ACTIVE)
        .otherwise(c("status")),
        "eliminated_on": F.when(out, day).otherwise(c("eliminated_on")),
        "eliminated_reason": F.when(c("_st"), ST_REASON).when(c("_drop"), DROP_REASON).otherwise(c("eliminated_reason"))})
    audit = x.select("symbol", "name", "status", "last_submit", "ret20", "ret40", "ret120", "ma20_dist", "ma30_slope5",
                     "eliminated_on", "eliminated_reason")
    return x.select(*REGISTRY), audit


def mark_stage(registry: DataFrame, p1: DataFrame, p2: DataFrame) -> DataFrame:
    a = p1.select("symbol").distinct().withColumn("_1", F.lit(True))
    b = p2.select("symbol").distinct().withColumn("_2", F.lit(True))
    x = registry.join(a, "symbol", "left").join(b, "symbol", "left")
    alive = F.coalesce("status", F.lit("")) != GONE
    return x.withColumn("status", F.when(alive & F.col("_2").isNotNull(), STAGE2).when(alive & F.col("_1").isNotNull(), STAGE1)
                        .otherwise(F.col("status"))).drop("_1", "_2")


def batch_identity(pool: DataFrame, day: str) -> DataFrame:
    """yyyymmdd_ + 16 hex of SHA-256 over the sorted distinct codes, one a line."""
    codes = pool.select(norm_code("symbol").alias("code")).distinct()
    digest = ordered_digests(codes, [], F.col("code"), F.col("code"), "\n").select("digest").scalar()
    return codes.agg(F.count("code").alias("n")).select(
        F.concat(F.lit(day.replace("-", "")), F.lit("_"), F.substring(F.coalesce(digest, F.sha2(F.lit(""), 256)), 1, 16)).alias("batch_id"), "n")


def reconcile_snapshot(upload: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshot with all columns and a match flag, missing master symbols, report). Bad and duplicate codes are rejected."""
    x = upload.withColumn("symbol", norm_code("symbol"))
    m = master.select("symbol").distinct().withColumn("_m", F.lit(True))
    dup = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    z = x.join(dup, "symbol").filter(F.col("symbol").rlike("^[0-9]{6}$") & (F.col("_n") == 1)).drop("_n")
    z = z.join(m, "symbol", "left").withColumn("matched", F.col("_m").isNotNull()).drop("_m")
    missing = master.select("symbol").distinct().join(x.select("symbol"), "symbol", "left_anti")
    bad = x.filter(~F.col("symbol").rlike("^[0-9]{6}$")).agg(F.count(F.lit(1)).alias("invalid"))
    rep = z.agg(F.count(F.lit(1)).alias("rows"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))
    for one in (bad, dup.filter("_n > 1 AND symbol <> ''").agg(F.count(F.lit(1)).alias("duplicate_codes")),
                missing.agg(F.count(F.lit(1)).alias("missing"))):
        rep = with_scalars(rep, one)
    return z, missing, rep


def union_pools(a: DataFrame, b: DataFrame) -> DataFrame:
    u = a.select("symbol", "name", F.lit(0).alias("_s")).unionByName(b.select("symbol", "name", F.lit(1).alias("_s")))
    return u.groupBy("symbol").agg(F.min_by("name", F.struct("_s", "name")).alias("name"))


def bootstrap_registry(pool: DataFrame, today: str) -> DataFrame:
    stocks, _ = split_stocks_indices(pool)
    day = F.lit(today).cast("date")
    return stocks.select("symbol", "name", day.alias("first_submit"), day.alias("last_submit"), F.lit(1).alias("submit_count"),
                         F.lit(ACTIVE).alias("status"), F.lit(None).cast("date").alias("eliminated_on"), F.lit("").alias("eliminated_reason"))


def shard(df: DataFrame, i: int, n: int, on: str = "symbol", how: str = "code") -> DataFrame:
    """Disjoint and complete slices by code number or by a checksum of a name."""
    k = F.pmod(F.col(on).cast("int"), F.lit(n)) if how == "code" else F.pmod(F.crc32(F.col(on).cast("binary")), F.lit(n))
    return df.filter(k == i)


def master_code_list(master: DataFrame) -> DataFrame:
    return master.select(norm_code("symbol").alias("symbol")).filter(F.col("symbol").rlike("^[0-9]{6}$")).distinct()


def symbol_universe(df: DataFrame, order: str | None = None) -> DataFrame:
    """Aliased code and name columns, invalid codes dropped; of a code's rows the first by `order` (a column; by default the order of reading)."""
    from barloom.sources.ingest import CODE_NAMES, NAME_NAMES, rename_by_alias
    at = F.col(order) if order else F.monotonically_increasing_id()
    z = rename_by_alias(df.withColumn("_at", at), {"symbol": CODE_NAMES, "name": NAME_NAMES, "_at": ["_at"]})
    z = z.select(norm_code("symbol").alias("symbol"), F.trim("name").alias("name"), "_at").filter(F.col("symbol").rlike("^[0-9]{6}$"))
    return z.groupBy("symbol").agg(F.min_by("name", "_at").alias("name"))
