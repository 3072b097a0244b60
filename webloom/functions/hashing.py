"""Stable text keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webloom.functions.text import let


def _letters(byte: Column) -> Column:
    """Two letters for a byte: 0 counts as 255, and bytes from 128 on move down by one (so 127 and 128 meet)."""
    k = F.when(byte == 0, 255).when(byte > 127, byte - 1).otherwise(byte)
    return F.concat(F.chr(97 + k % 26), F.chr(97 + 2 * F.floor(k / 26)))


def url_hash(text: Column) -> Column:
    """40 lower-case letters: the SHA-1 of the UTF-8, two letters a byte."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i)
    digest = F.sha1(text.cast("binary"))
    return F.when(
        text.isNotNull(),
        let(digest, lambda d: F.array_join(F.transform(pairs, lambda i: let(F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("int"), _letters)), "")),
    )


def key_encode(text: Column) -> Column:
    """Letters of ASCII, digits and ``-`` stay; any other character becomes ``_`` and its code in hexadecimal."""
    one = lambda c: F.when(c.rlike("^[a-zA-Z0-9-]$"), c).otherwise(F.concat(F.lit("_"), F.lower(F.hex(F.ascii(c)))))
    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


def key_decode(text: Column) -> Column:
    """The inverse of ``key_encode`` for characters whose code has two hexadecimal digits."""
    parts = lambda p: F.transform(p, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.chr(F.conv(F.substring(x, 1, 2), 16, 10).cast("int")), F.substring(x, 3, 1 << 30))))
    return F.array_join(let(F.split(text, "_"), parts), "")
