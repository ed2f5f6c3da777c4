r"""Several values packed in one field, split into one row per value with its position.

Each row is read by its own convention:

* a JSON list of strings is parsed as such;
* spans in double quotes that fill a whole value, and characters behind a backslash, are protected: they are
  replaced by indexed placeholders, the rest is split, and the spans are put back by array lookup;
* marks that separate wherever they stand unprotected: ``|`` (single, double or full width), ``;`` (also full width),
  a broken bar, a bullet, line ends, tabs and a slash between blanks;
* a comma separates only in rows without any of those marks outside protected spans.

All of it is built-in array and string expressions, inside one stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.exprs import let

#: Marks that always separate, as a Java regular expression. A slash separates between blanks only.
STRONG = r"[|\x{FF5C}\x{00A6};\x{FF1B}\x{2022}\t\n\r\x{2028}\x{2029}]| / "
WEAK = r"[,\x{FF0C}\x{3001}]"
#: Placeholders use two private-use characters, which are escaped first where the text itself has them.
OPEN, ESC = "\ue000", "\ue001"

_BEFORE = rf"(?<=^|[|\x{{FF5C}}\x{{00A6}};\x{{FF1B}}\x{{2022}}\t\n\r\x{{2028}}\x{{2029}},\x{{FF0C}}\x{{3001}}]|\s/\s)"
_AFTER = r"(?=\s*(?:[|\x{FF5C}\x{00A6};\x{FF1B}\x{2022}\t\n\r\x{2028}\x{2029},\x{FF0C}\x{3001}]|\s/\s|$))"
#: A quoted span that fills a value, or a character behind a backslash.
PROTECTED = rf'{_BEFORE}[ \x{{00A0}}]*"(?:[^"\\]|""|\\.)*"{_AFTER}|\\[|;,/"\\\x{{00A6}}\x{{2022}}]'


def _trim(col: Column) -> Column:
    return F.regexp_replace(col, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


def _unprotect(span: Column) -> Column:
    """The text that a protected span stands for."""
    bare = _trim(span)
    quoted = bare.startswith('"') & (F.length(bare) >= 2)
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    return F.when(quoted, F.regexp_replace(F.replace(inner, F.lit('""'), F.lit('"')), r'\\([|;,/"\\])', "$1")).otherwise(F.substring(bare, F.lit(2), F.length(bare)))


def _number(parts: Column) -> Column:
    """Joins the parts around protected spans with numbered placeholders: part i follows placeholder i - 1."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(OPEN), p))), "")


def _cut(held: Column) -> Column:
    return F.when(F.regexp_like(held, F.lit(STRONG)), F.split(held, STRONG)).otherwise(F.split(held, WEAK))


def _restore(piece: Column, spans: Column) -> Column:
    bits = F.split(_trim(piece), OPEN)  # text, index, text, index, ... text
    whole = F.array_join(F.transform(bits, lambda b, i: F.when(i % 2 == 1, _unprotect(F.get(spans, F.coalesce(b.try_cast("int"), F.lit(-1))))).otherwise(b)), "")
    return _trim(F.replace(F.replace(whole, F.lit(ESC + "a"), F.lit(OPEN)), F.lit(ESC + "b"), F.lit(ESC)))


def _split_plain(field: Column) -> Column:
    def split(coded: Column) -> Column:
        spans = F.regexp_extract_all(coded, F.lit(PROTECTED), F.lit(0))
        pieces = let(_number(F.split(F.regexp_replace(coded, PROTECTED, OPEN), OPEN)), _cut)
        return let(spans, lambda s: F.transform(pieces, lambda piece: _restore(piece, s)))

    return let(F.replace(F.replace(field, F.lit(ESC), F.lit(ESC + "b")), F.lit(OPEN), F.lit(ESC + "a")), split)


def _read(text: Column) -> Column:
    listed = F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>"))
    # What parses as a JSON list without nulls is one; anything else in brackets is plain text.
    return let(listed, lambda v: F.when(v.isNotNull() & ~F.exists(v, lambda x: x.isNull()), F.transform(v, _trim)).otherwise(_split_plain(text)))


def unpack(field: Column) -> Column:
    """Array of the non-empty values of a packed field in their order; empty for null and blank fields."""
    values = let(_trim(field), _read)
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v != "")


def explode_packed(df: DataFrame, key: str, field: str, pos_name: str = "alias_pos", value_name: str = "alias_value") -> DataFrame:
    """One row per value: ``key``, position from 1 (bigint) and value.

    Null, blank and all-empty fields give no row; repeated values and repeated rows stay; empty values take no position.
    Only the key and the field are read, so clashing extra columns do no harm. Very long fields are split whole.
    """
    return (
        df.select(df[key].alias("__key"), F.posexplode(unpack(df[field])).alias("__pos", "__value"))
        .select(F.col("__key").alias(key), (F.col("__pos") + 1).cast("bigint").alias(pos_name), F.col("__value").alias(value_name))
    )
