"""Column functions for text cells: what is null, a number or a date, tokens of names and normalised needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: Cells that mean no value, in lower case.
NULLS = ("", "na", "null", "n/a")


#: Characters with a capital, their capitals, and those that full case mapping makes longer, such as ß.
_CAPITALS = {c: u for c in map(chr, range(0x80, 0x1F000)) if (u := c.upper() if len(c.upper()) == 1 else c.title() if len(c.title()) == 1 else c) != c} | {"ß": "ẞ"}
_LONGER = "".join(c for c in map(chr, range(0x80, 0x1F000)) if len(c.upper()) > 1)


def upper_each(text: str) -> str:
    """SQL for ``text`` in capitals, character by character as DuckDB does it: ß becomes ẞ, not SS, and ﬁ stays."""
    small, large = "".join(_CAPITALS), "".join(_CAPITALS.values())
    return f"CASE WHEN {text} RLIKE '[{_LONGER}]' THEN translate({text}, 'abcdefghijklmnopqrstuvwxyz{small}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{large}') ELSE upper({text}) END"


def is_blank(cell: Column) -> Column:
    """A cell without a value; a NULL counts."""
    return F.coalesce(F.lower(F.trim(cell)).isin(*NULLS), F.lit(True))


def is_skipped(cell: Column) -> Column:
    """A cell that an aggregation passes over: NULL, blank, NA or null; ``n/a`` is no number, though, and counts as invalid."""
    return F.coalesce(F.lower(F.trim(cell)).isin(*[n for n in NULLS if n != "n/a"]), F.lit(True))


#: Decimal digits of a limb; a sum of limbs holds 9 * 10**12 rows. Exponents beyond the limit are no numbers.
LIMB, MOST_EXPONENT = 6, 1_000_000
LIMBS = "array<struct<k:int,digits:bigint>>"


def with_number(rows: DataFrame, cell: Column, value: str, limbs: str) -> DataFrame:
    """``rows`` with ``value`` DOUBLE and ``limbs``, the exact number: the sum of digits * 10**(6 k); both NULL for a cell that
    is no finite number.

    Thousands commas are removed. NaN, infinities, type letters and what a double cannot reach are no numbers. Limbs of equal
    ``k`` add up as whole numbers, so sums are exact for any digits and exponents, in any order.
    """
    plain = F.lower(F.replace(F.trim(cell), F.lit(","), F.lit("")))
    tail = lambda text, mark: F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, -1))
    own = rows.withColumn("_plain", F.when(plain.rlike(NUMBER), plain)).withColumn("_head", F.ltrim(F.substring_index("_plain", "e", 1), F.lit("+-")))
    own = own.withColumn("_part", F.coalesce(tail(F.col("_head"), "."), F.lit(""))).withColumn("_e", F.coalesce(tail(F.col("_plain"), "e"), F.lit("0")).try_cast("int"))
    number = F.col("_plain").try_cast("double")
    good = F.col("_plain").isNotNull() & F.coalesce(F.abs("_e") <= MOST_EXPONENT, F.lit(False)) & (F.abs(number) < float("inf"))
    own = own.withColumn(value, F.when(good, number)).withColumn("_digits", F.ltrim(F.concat(F.substring_index("_head", ".", 1), F.col("_part")), F.lit("0"))).withColumn("_last", F.col("_e") - F.length("_part"))
    own = own.withColumn("_full", F.concat("_digits", F.repeat(F.lit("0"), F.pmod("_last", F.lit(LIMB)).cast("int")))).withColumn("_n", F.expr(f"(length(_full) + {LIMB - 1}) div {LIMB}").cast("int"))
    own = own.withColumn("_full", F.lpad("_full", F.col("_n") * LIMB, F.lit("0")))
    cut = f"""filter(transform(sequence(1, _n), j -> named_struct(
        'k', cast(floor(_last / {LIMB}.0D) as int) + _n - j,
        'digits', if(startswith(_plain, '-'), -1L, 1L) * cast(substr(_full, {LIMB} * (j - 1) + 1, {LIMB}) as bigint))), x -> x.digits <> 0)"""
    # Most cells are a limb before the point and one behind it: the same limbs, without a function over an array.
    limb = lambda k, text: f"named_struct('k', {k}, 'digits', if(startswith(_plain, '-'), -1L, 1L) * cast(coalesce(nullif({text}, ''), '0') as bigint))"
    short = F.expr(f"_e = 0 and length(_part) <= {LIMB} and length(substring_index(_head, '.', 1)) <= {LIMB}")
    plain_limbs = F.expr(f"array({limb(0, "substring_index(_head, '.', 1)")}, {limb(-1, f"rpad(_part, {LIMB}, '0')")})")
    found = F.when(short, plain_limbs).when(F.col("_digits") == "", F.expr(f"cast(array() as {LIMBS})")).otherwise(F.expr(cut))
    return own.withColumn(limbs, F.when(F.col(value).isNotNull(), found)).drop("_plain", "_head", "_part", "_e", "_digits", "_last", "_full", "_n")


def is_date(cell: Column) -> Column:
    """One of yyyy-MM-dd, yyyy-MM, RFC 3339 and yyyy/MM/dd, with a day that exists."""
    found = [F.when(cell.rlike(shape), F.try_to_timestamp(cell, F.lit(layout))).isNotNull() for shape, layout in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{4}-\d{2}$", "yyyy-MM"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"))]
    stamp = F.when(cell.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.]\d+)?(Z|[+-]\d{2}:\d{2})$"), cell.try_cast("timestamp")).isNotNull()
    return F.coalesce(found[0] | found[1] | found[2] | stamp, F.lit(False))


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits of two characters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda t: F.char_length(t) >= 2)))


def need_key(text: Column) -> Column:
    """A need in lower case with single blanks, for matching."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
