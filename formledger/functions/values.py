"""Column functions on single values: numbers, readings, keys, audit columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formledger.functions import fields as f

#: What counts as a number; "nan" and "inf" do not.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Characters that a reader takes for digits, and the digits they stand for.
LOOKALIKES = "Oo〇ＯDlI|｜丨qgZzSsbBTㄱ$&０１２３４５６７８９．"
MEANT = "00000111119922556877880123456789."
# Fixed value: what counts as white space, the ideographic and the no-break space included.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_DIGITS = "０１２３４５６７８９"


def quoted(name: str) -> str:
    return f"`{name}`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    return F.btrim(blank(text), F.lit(SPACE))


def without_space(text: Column) -> Column:
    return F.translate(blank(text), SPACE, "")


def to_number(text: Column) -> Column:
    """A5: the double a trimmed text spells, in ASCII or full-width digits, else null. Commas are not taken out."""
    trimmed = F.translate(stripped(text), WIDE_DIGITS, "0123456789")
    return F.when(F.rlike(trimmed, F.lit(NUMBER)), trimmed.try_cast("double"))


def parse_number(text: Column) -> Column:
    """V1: as to_number(), with thousands commas taken out first."""
    return to_number(F.replace(blank(text), F.lit(",")))


def half_even(number: Column, digits: int = 1) -> Column:
    """Number to so many decimals, ties to even; scaled first, so that a sum that misses a tie by its last bit still counts as one."""
    scale = F.lit(float(10**digits))
    rounded = F.rint(number * scale) / scale
    return F.when(F.abs(rounded) < float("inf"), rounded).otherwise(number)


def is_numeric_field(name: Column) -> Column:
    """O5"""
    return F.rlike(name, F.lit(f"(_{f.LIMIT}|_{f.SCORE}|_{f.BONUS})$")) | (name == f.TOTAL)


def clean_number(text: Column) -> Column:
    """Look-alikes become digits, all else but digits and points goes; a text without any digit stays as it is."""
    kept = F.regexp_replace(F.translate(text, LOOKALIKES, MEANT), "[^0-9.]", "")
    kept = F.regexp_replace(kept, r"^\.+|\.+$", "")
    return F.when(F.rlike(kept, F.lit("[0-9]")), kept).otherwise(text)


def plausible_score(name: Column, value: Column) -> Column:
    """A number of at most 10, or 100 for the total."""
    return F.coalesce(to_number(value) <= F.when(name == f.TOTAL, 100).otherwise(10), F.lit(False))


def choose_reading(name: Column, first: Column, second: Column) -> Column:
    """Of two readings of a number, cleaned: the plausible one with digits, the first if in doubt."""
    digits = lambda v: F.rlike(blank(v), F.lit("[0-9]"))
    good = lambda v: digits(v) & plausible_score(name, v)
    return F.when(good(first), first).when(digits(second) & (plausible_score(name, second) | ~digits(first)), second).otherwise(first)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/:*?"<>|]', "")


def supplier_record_key(tax_id: Column, company: Column) -> Column:
    """V7: id_company as they are if both are given; else whichever there is, without characters that paths forbid."""
    i, c = stripped(tax_id), stripped(company)
    one = F.when(i != "", i).when(c != "", c).otherwise(F.lit(f.UNNAMED))
    return F.when((i != "") & (c != ""), F.concat_ws("_", i, c)).otherwise(safe_name(one))


def eval_record_key(name: Column) -> Column:
    """V8"""
    safe = safe_name(stripped(name))
    return F.when(safe == "", F.lit(f.UNNAMED)).otherwise(safe)


def canonical_doc_type(name: Column) -> Column:
    """I1"""
    aliases = F.create_map(*[F.lit(x) for pair in f.DOC_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, name), name)


def checkbox_value(checked: Column) -> Column:
    """O9"""
    return F.when(F.coalesce(checked, F.lit(False)), F.lit("是")).otherwise(F.lit("否"))
