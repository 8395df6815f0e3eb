"""Small column helpers shared by all operators.

All helpers return ``Column`` expressions built from Spark built-ins so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode-aware "word character" class that Java (Spark) and RE2 (DuckDB)
# agree on (plain ``\w`` differs between the engines for non-ASCII letters).
WORD_RE = r"[\p{L}\p{N}_]+"

# Python's str.isspace() set, written so Java regex (Spark) and RE2 (DuckDB)
# both read it identically (plain \s differs between Python, Java and RE2).
PY_WS_CHARS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
PY_WS = f"[{PY_WS_CHARS}]"
PY_NON_WS = f"[^{PY_WS_CHARS}]"
# the same set as plain characters, for functions that take no pattern
WS_LIST = "".join(chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                   0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b, default: float = 0.0) -> Column:
    """a / b, or ``default`` when b is 0 or null (the reference returns 0)."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(default))


def r6(x) -> Column:
    """Round to 6 places and fold -0.0 into 0.0 (stable value hashes)."""
    return F.round(_c(x).cast("double"), 6) + F.lit(0.0)


def strip_ws(x) -> Column:
    """Python ``str.strip()``: cut Unicode whitespace at both ends."""
    return F.btrim(_c(x), F.lit(WS_LIST))


def words(x) -> Column:
    """Python ``str.split()``: whitespace-separated tokens, no empties (one
    pass maps all whitespace to blanks, a plain split follows)."""
    return F.array_remove(F.split(F.translate(_c(x), WS_LIST, " " * len(WS_LIST)), " "), "")


def substr_count(x, needle: str) -> Column:
    """Non-overlapping count of ``needle`` in ``x`` (Python ``str.count``)."""
    s = _c(x)
    gone = F.octet_length(s) - F.octet_length(F.replace(s, F.lit(needle), F.lit("")))
    return (gone / F.lit(len(needle.encode()))).cast("long")


def hash_key(id_col, seed: int = 42) -> Column:
    """Deterministic pseudo-random order key in [0, 2^31) of an id of any type:
    the leading 31 bits of ``md5('seed:id')`` (Python's RNG cannot be
    reproduced; md5 is the same in Spark and in SQL oracles)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(_c(id_col).cast("string"), F.lit("")))
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), 1)


def hash_key_sql(id_expr: str, seed: int = 42) -> str:
    """``hash_key`` in DuckDB SQL."""
    return f"(('0x' || substr(md5('{seed}:' || cast({id_expr} as varchar)), 1, 8))::BIGINT // 2)"


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``max_rows`` rows (counted,
    reading no more than that and one); a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
