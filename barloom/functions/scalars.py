"""Column expressions shared by every operator. Nothing here runs Python per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond) -> Column:
    """Boolean that treats unknown as false."""
    return F.coalesce(cond, F.lit(False))


def as_int(cond) -> Column:
    return flag(cond).cast("int")


def to_double(c) -> Column:
    """Lenient number parse: bad text and NaN become NULL."""
    d = col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def safe_div(a, b) -> Column:
    return col(a) / F.nullif(col(b), F.lit(0.0))


def clip(c, lo: float, hi: float) -> Column:
    """Clamp that keeps NULL (greatest/least would skip it)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def first_match(rules: Iterable[tuple[Column, object]], default) -> Column:
    out = None
    for cond, label in rules:
        value = label if isinstance(label, Column) else F.lit(label)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    rest = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(rest)


def norm_code(c) -> Column:
    """Six-digit text code: drop a trailing .0, keep digits, last six, left-pad; '' when no digit."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), r"^([0-9]+)\.0$", "$1")
    digits = F.regexp_replace(text, "[^0-9]", "")
    padded = F.lpad(F.substring(digits, -6, 6), 6, "0")
    return F.coalesce(F.when(digits != "", padded), F.lit(""))


_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def to_halfwidth(c) -> Column:
    """Compatibility fold of the full-width ASCII block."""
    return F.translate(col(c), _WIDE, _NARROW)


def name_key(c) -> Column:
    """Lookup key of a display name: half-width, no white space, upper case."""
    return F.upper(F.regexp_replace(to_halfwidth(F.coalesce(col(c).cast("string"), F.lit(""))), r"\s+", ""))


def is_st(name) -> Column:
    clean = F.upper(F.regexp_replace(F.coalesce(col(name).cast("string"), F.lit("")), r"\s+", ""))
    return clean.rlike(r"^(S\*?ST|\*?ST)")


def exchange_prefix(code) -> Column:
    """Code with its market prefix; unknown leading digits stay bare."""
    c = col(code)
    return F.concat(first_match([(c.rlike("^[569]"), "sh"), (c.rlike("^[0-3]"), "sz"), (c.rlike("^[48]"), "bj")], ""), c)


# Daily price-limit percentage and board label by code prefix.
LIMIT_ST = (5.0, "ST/*ST 5%")
LIMIT_GROWTH = (20.0, "创业板20%")
LIMIT_STAR = (20.0, "科创板20%")
LIMIT_NORTH = (30.0, "北交所30%")
LIMIT_MAIN = (10.0, "沪深主板10%")


def limit_pct(code, name=None) -> Column:
    return _limit(code, name, 0)


def limit_board(code, name=None) -> Column:
    return _limit(code, name, 1)


def _limit(code, name, i: int) -> Column:
    c = col(code)
    rules = []
    if name is not None:
        rules.append((flag(F.upper(F.replace(col(name), F.lit(" "), F.lit(""))).contains("ST")), LIMIT_ST[i]))
    rules += [(c.rlike("^30[01]"), LIMIT_GROWTH[i]), (c.rlike("^68[89]"), LIMIT_STAR[i]),
              (c.rlike("^(4|8|920)"), LIMIT_NORTH[i])]
    return first_match(rules, LIMIT_MAIN[i])


def limit_flags(code, name, pct) -> Column:
    """Approximate up/down limit flags from a percentage change only."""
    lim, p = limit_pct(code, name), col(pct)
    near = F.greatest(F.lit(0.1), lim - 0.2)
    return F.struct(flag(p.between(near, lim + 0.8)).alias("up"),
                    flag((-p).between(near, lim + 0.8)).alias("down"),
                    limit_board(code, name).alias("board"))


#: Zone whose wall clock the rules' hours and days are read from.
BUSINESS_TZ = "Asia/Shanghai"


def business_clock(ts, tz: str = BUSINESS_TZ) -> Column:
    """Wall-clock time of an instant in the business zone. A time without a zone is taken in the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(tz), col(ts).cast("timestamp_ntz"))


def epoch_to_ts(c) -> Column:
    """Seconds or milliseconds since the epoch."""
    x = col(c).cast("double")
    return F.timestamp_seconds(F.when(x > 1e10, x / 1000).otherwise(x))


def strip_units(c) -> Column:
    """Numbers written with thousands separators, percent signs or Chinese magnitude suffixes."""
    return to_double(F.regexp_replace(F.trim(col(c).cast("string")), "[,，%亿万\\s]", ""))


def json_object_text(c) -> Column:
    """The JSON object in a written answer: the text itself, without a code fence, or what stands between its first and last brace; null if neither is an
    object."""
    blanks = F.lit(" \t\n\x0b\f\r")
    t = F.btrim(F.coalesce(col(c), F.lit("")), blanks)
    bare = F.btrim(F.btrim(t, F.lit("`")), blanks)
    bare = F.when(F.lower(F.substring(bare, 1, 4)) == "json", F.btrim(F.substring(bare, F.lit(5), F.length(bare)), blanks)).otherwise(bare)
    t = F.when(F.startswith(t, F.lit("```")), bare).otherwise(t)
    first, last = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    inner = F.when((first > 0) & (last > first), F.substring(t, first, last - first + 1))

    def whole(x: Column) -> Column:
        """x if all of it is one object. The parser stops behind a value, so the value is put between two keys that both have to be found."""
        around = F.json_object_keys(F.concat(F.lit('{"x":'), x, F.lit(',"end":1}')))
        return F.when(F.json_object_keys(x).isNotNull() & (around == F.array(F.lit("x"), F.lit("end"))), x)
    return F.coalesce(whole(t), whole(inner))
