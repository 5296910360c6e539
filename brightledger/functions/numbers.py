"""Disclosed numbers: three readers with rules of their own, units, precision, display."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import bound
from .text import compact_quote

DECIMAL = "decimal(28,8)"
#: Type of converted amounts: 8 places of the source and 8 more of a smaller unit.
CONVERTED = "decimal(38,17)"
#: Money unit -> amount in yuan. Fixed values.
UNIT_SCALES = {"元": 1, "千元": 1_000, "万元": 10_000, "百万元": 1_000_000, "亿元": 100_000_000, "十亿元": 1_000_000_000}
#: Units that are never scaled.
OTHER_UNITS = ["%", "倍", "天", "次", "元/股", "股", "text"]
GROUPED = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"


def unit_scale(unit: Column) -> Column:
    """Yuan in one of the unit; null for one that isn't money."""
    return F.try_element_at(F.create_map(*[F.lit(x) for name, scale in UNIT_SCALES.items() for x in (name, scale)]), unit).cast("decimal(10,0)")


def loose_number(text: Column, let: Callable[[Column, Callable[[Column], Column]], Column] = lambda value, use: use(value)) -> Column:
    """Separators anywhere, parentheses or a minus for negative, an exponent of up to three digits; null if unreadable.

    ``let=bound`` works each step out once, for lambdas and filters, in which Spark repeats what is used twice.
    """

    def read(mapped: Column) -> Column:
        wrapped = mapped.startswith("(") & mapped.endswith(")")
        bare = F.regexp_replace(F.when(wrapped, F.regexp_replace(mapped, r"^\(|\)$", "")).otherwise(mapped), r"[\s,]", "")
        return let(bare, lambda b: let(F.regexp_replace(b, "^-", ""), lambda digits: signed(b, digits, wrapped)))

    def signed(bare: Column, digits: Column, wrapped: Column) -> Column:
        value = F.when(digits.rlike(r"^[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]{1,3})?$"), digits).try_cast(DECIMAL)
        return let(value, lambda v: F.when(wrapped | bare.startswith("-"), -v).otherwise(v).cast(DECIMAL))

    return let(F.translate(F.trim(text), "，（）", ",()"), read)


def quoted_number(mapped: Column) -> Column:
    """``strict_number`` of a text that ``compact_quote`` has been through."""
    wrapped = mapped.startswith("(") & mapped.endswith(")")
    bare = F.when(wrapped, F.regexp_replace(mapped, r"^\(|\)$", "")).otherwise(mapped)
    value = F.when(bare.rlike(f"^[+-]?{GROUPED}$"), F.replace(bare, F.lit(","), F.lit(""))).try_cast(DECIMAL)
    return F.when(wrapped, -value).otherwise(value).cast(DECIMAL)


def strict_number(text: Column) -> Column:
    """Separators in exact groups of three only, no exponent; blank and unreadable cells are null."""
    return bound(compact_quote(text), quoted_number)


def note_number(text: Column, scale: Column | int = 1) -> Column:
    """A note's amount times its scale: percent signs dropped, cut-off or broken groups are null."""
    numeric = F.translate(F.regexp_replace(text, r"\s+", ""), "，%", ",")
    broken = text.rlike(r"[,，]\s*$") | (numeric.contains(",") & ~numeric.rlike(r"^-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$"))
    scaled = loose_number(F.replace(text, F.lit("%"), F.lit(""))) * (scale if isinstance(scale, Column) else F.lit(scale)).cast("decimal(10,0)")
    return F.when(~broken, scaled).cast(DECIMAL)


def decimal_places(text: Column) -> Column:
    """Places after the point of a strictly readable number; null otherwise."""
    bare = F.regexp_replace(compact_quote(text), "[(),]", "")
    return F.when(strict_number(text).isNotNull(), F.length(F.regexp_extract(bare, r"\.([0-9]*)$", 1)))


def source_increment(text: Column) -> Column:
    """The smallest step that the disclosed precision can tell: 10 to the minus places."""
    return bound(decimal_places(text), lambda places: F.coalesce(*[F.when(places == n, F.lit(f"1e-{n}").cast("decimal(18,8)")) for n in range(9)]))


def convert_unit(value: Column, source: Column, target: Column) -> Column:
    """A money amount in another money unit, an exact decimal; amounts of other units as they are."""
    powers = {name: len(str(scale)) - 1 for name, scale in UNIT_SCALES.items()}
    power = lambda unit: F.try_element_at(F.create_map(*[F.lit(x) for pair in powers.items() for x in pair]), unit)
    shift, given = power(source) - power(target), value.cast("decimal(27,8)")
    moved = given
    for n in range(1, max(powers.values()) + 1):  # literals of their own precision keep each product exact
        up, down = F.lit(Decimal(10**n)), F.lit(Decimal(1).scaleb(-n))
        moved = F.when(shift == n, (given * up).cast(CONVERTED)).when(shift == -n, (given * down).cast(CONVERTED)).otherwise(moved.cast(CONVERTED))
    return moved.cast(CONVERTED)


def half_up(value: Column, places: int) -> Column:
    """Thousands separators and fixed places, rounded half up before formatting (which would round half to even)."""
    return F.regexp_replace(F.format_number(F.round(value, places), places), "^-(0(?:\\.0+)?)$", "$1")


def auto_unit(value: Column) -> Column:
    """The unit that shows an amount in yuan best."""
    digits = F.length(F.abs(value).cast("decimal(38,0)").cast("string"))
    return F.when(digits > 8, "亿元").when(digits > 4, "万元").otherwise("元")


def canonical_decimal(text: Column) -> Column:
    """Decimal text without superfluous zeros or a negative zero."""
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(short, r"^(-?)0+(?=[0-9])", "$1")
    return F.when(short.isin("-0", ""), "0").otherwise(short)


def guarded_ratio(numerator: Column, denominator: Column) -> tuple[Column, Column]:
    """(value, reason): null with a reason where the denominator is zero or negative."""
    reason = F.when(denominator == 0, "分母为零").when(denominator < 0, "分母为负，不适用常规比率解释")
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")), reason


def exponent_increment(text: Column) -> Column:
    """The step of a loosely readable number's last digit, as plain decimal text: 0.01 of 1.50, 100 of 1.5e3."""
    bare = F.regexp_replace(F.translate(F.trim(text), "，（）", ",()"), r"^-|[\s,()]", "")
    exponent = F.coalesce(F.regexp_extract(bare, "[eE]([+-]?[0-9]{1,3})$", 1).try_cast("int"), F.lit(0))
    places = F.length(F.regexp_extract(bare, r"\.([0-9]*)", 1)) - exponent
    step = F.when(places > 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), places - 1), F.lit("1"))).otherwise(F.concat(F.lit("1"), F.repeat(F.lit("0"), -places)))
    return F.when(loose_number(text).isNotNull(), step)


def quantized(value: Column, places: int = 6) -> Column:
    """An exact decimal rounded half up, as exported indicators are."""
    return F.round(value.cast("decimal(38,18)"), places).cast(f"decimal(38,{places})")


def percent_display(value: Column, reason: Column) -> Column:
    """A ratio as a percentage of two places (half to even), or a dash with the reason why there is none."""
    shown = F.concat(F.bround(value.cast("decimal(38,18)") * 100, 2).cast("decimal(38,2)").cast("string"), F.lit("%"))
    return F.coalesce(shown, F.concat(F.lit("—（"), F.coalesce(reason, F.lit("")), F.lit("）")))


def same_number(left: Column, right: Column) -> Column:
    """Whether two texts are the same decimal number; false where one is missing or no number."""
    number = lambda x: F.trim(x.cast("string")).try_cast("decimal(38,12)")
    return F.coalesce(number(left) == number(right), F.lit(False))
