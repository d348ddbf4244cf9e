"""Character references of HTML, decoded in one scan."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that most references have.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;")
#: Names with their semicolon, common and short ones first, as a name is looked for in this order; and those that may lack it, the longest first.
_FULL = {k[:-1]: v for k, v in sorted(html5.items(), key=lambda kv: (kv[0] not in _COMMON, len(kv[0]), kv[0])) if k.endswith(";")}
_BARE = {k: html5[k] for k in sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))}
_BARE_NAME = "&(?:" + "|".join(_BARE) + ")"
REFERENCE = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]{1,31};|" + _BARE_NAME
#: References that have their semicolon.
CLOSED = r"&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[A-Za-z][A-Za-z0-9]{1,31};"
#: Separates the values of a map literal; it stands for no reference.
_MARK = ""


def _map(names: dict[str, str]) -> Column:
    return F.map_from_arrays(F.split(F.lit(" ".join(names)), " "), F.split(F.lit(_MARK.join(names.values())), _MARK))


def _c1(n: int) -> str:
    """What browsers show for a number of the C1 range: its character in Windows-1252, if it has one."""
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


def _character(n: Column) -> Column:
    """The character of a number; null above the last one, and an empty text for what is no character."""
    # With a mark of byte order in front, one that is meant as a character isn't taken for it.
    plain = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")
    c1 = F.element_at(F.array(*(F.lit(_c1(i)) for i in range(0x80, 0xA0))), (n - 0x7F).cast("int"))
    return (
        F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "�")
        .when(n.between(0x80, 0x9F), c1)
        .when(n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE), "")
        .otherwise(plain)
    )


def _number(ref: Column) -> Column:
    """The number of ``&#..;``; more digits than a character needs stand for one that is too large."""
    hexadecimal = F.regexp_extract(ref, r"^&#[xX]0*([0-9a-fA-F]*)", 1)
    decimal = F.regexp_extract(ref, r"^&#0*([0-9]*)", 1)
    of_hex = F.conv(F.concat(F.lit("0"), F.substring(hexadecimal, 1, 9)), 16, 10).cast("long")
    of_decimal = F.concat(F.lit("0"), F.substring(decimal, 1, 9)).cast("long")
    return F.when(F.rlike(ref, F.lit("^&#[xX]")), of_hex).otherwise(of_decimal)


def _decoded(ref: Column, instead: dict[str, str], closed: bool) -> Column:
    full = F.try_element_at(_map(_FULL | instead), F.regexp_extract(ref, "^&(.*);$", 1))
    if closed:
        return F.when(F.startswith(ref, F.lit("&#")), _character(_number(ref))).otherwise(F.coalesce(full, ref))
    bare = F.regexp_extract(ref, "^" + _BARE_NAME, 0)
    prefix = F.concat(F.try_element_at(_map(_BARE | instead), F.substr(bare, F.lit(2))), F.substr(ref, F.length(bare) + 1))
    named = F.coalesce(full, F.when(bare != "", prefix), ref)
    return F.when(F.startswith(ref, F.lit("&#")), _character(_number(ref))).otherwise(named)


def unescape(text: Column, instead: dict[str, str] | None = None, closed: bool = False) -> Column:
    """``text`` with each reference replaced by what it stands for, as browsers do; nothing is decoded twice.

    Numbers may be decimal or hexadecimal, and semicolons may lack where browsers
    allow it; of a name that isn't known the longest beginning that is counts.
    ``instead`` has names that stand for something else. With ``closed`` only references
    with their semicolon count, so a text that was cut within one, or an address with
    ``&copy=1``, stays as it is.
    """
    pattern = CLOSED if closed else REFERENCE

    def one(t: Column) -> Column:
        refs = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        plain = F.concat(F.transform(refs, lambda ref: _decoded(ref, instead or {}, closed)), F.array(F.lit("")))
        whole = F.array_join(F.zip_with(F.split(t, pattern, -1), plain, lambda a, b: F.concat(a, b)), "")
        return F.when(F.contains(t, F.lit("&")), whole).otherwise(t)

    # As an element of an array the text is computed once, whatever it is made of.
    return F.transform(F.array(text), one)[0]
