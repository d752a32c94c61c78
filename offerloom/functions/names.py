"""Names: normal forms, grams, tokens, similarity, slugs, titles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, which the engine lacks."""
    return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def normal_spaced(name: Column) -> Column:
    """Decomposed, lower case; all but letters and numbers, marks too, become single spaces."""
    return F.trim(F.regexp_replace(F.lower(nfkd(name)), r"[^\p{L}\p{N}]+", " "))


def normal_plain(name: Column) -> Column:
    """Decomposed without marks, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(nfkd(name), r"\p{M}+", "")), r"\s+", " "))


def trigrams(norm: Column) -> Column:
    """The distinct trigrams of a text padded by two spaces left and one right; none of an empty text."""
    p = F.concat(F.lit("  "), norm, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda i: F.substring(p, i, F.lit(3)))
    return F.when(F.length(norm) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """2 * shared / (a + b) of two gram sets; 1 for two empty sets, 0 for one."""
    both, total = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def char_grams(norm: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams with their size as prefix, of a text with other characters than a-z0-9 as spaces; those of digits and spaces alone go."""
    p = F.concat(F.lit(" "), F.regexp_replace(F.lower(norm), "[^a-z0-9]", " "), F.lit(" "))

    def of(n: int) -> Column:
        return F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def marked(n: int) -> Column:
        return F.transform(F.filter(of(n), lambda g: ~g.rlike("^[0-9 ]*$")), lambda g: F.concat(F.lit(f"c{n}:"), g))

    return F.concat(*map(marked, range(least, most + 1)))


#: Words that say nothing of a product's type, quantities with units, and codes.
STOP_WORDS = (
    "con per dal dei della delle degli una uno the and di da in su del la il lo le un a e o x mm ml gr pz conf pack size plus set kit tipo fig modello colore "
    "col unita pezzi superiore inferiore media fine extra maxi mini blu rosso verde nero bianco giallo rosa trasparente"
).split()
QUANTITY = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:pz|ml|gr|g|mm|cm|kg|lt|l|unita|pezzi)\b"
CODES = r"^(?:\d+|x\d+|\d+x\d+|iso|fg|hp|ra|ca|eu|tcr|nfc|slb)$"


def tokens(norm: Column) -> Column:
    """Words of a name that may tell its type, repeats kept."""
    found = F.regexp_extract_all(F.regexp_replace(F.lower(norm), QUANTITY, " "), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS) & ~w.rlike(CODES))


def slug(text: Column, most: int = 80, default: str = "doc") -> Column:
    """Marks dropped, a-z0-9 joined by single dashes, cut at ``most``, never empty."""
    bare = F.lower(F.regexp_replace(nfkd(F.coalesce(text, F.lit(""))), r"\p{M}+", ""))
    plain = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(plain, 1, most), "-+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit(default))


def display_name(name: Column) -> Column:
    """Trimmed; a name all in capitals becomes a sentence; an empty one a placeholder."""
    x = F.trim(name)
    loud = (F.upper(x) == x) & x.rlike(r"\p{L}") & ~x.rlike(r"\p{Ll}")
    rest = F.lower(F.substring(x, 2, 1 << 30))
    return F.when(F.length(x) == 0, "Prodotto").when(loud, F.concat(F.upper(F.substring(x, 1, 1)), rest)).otherwise(x)


def packed_trigram(gram: Column) -> Column:
    """Three characters in 32 bits. Lossy: the first two keep what 32 bits leave of them, the third its low ten bits; beyond U+FFFF all are one."""

    def code(i: int) -> Column:
        c = F.ascii(F.substring(gram, i, 1)).cast("long")
        return F.when(c > 0xFFFF, 0xFFFD).otherwise(c)

    return F.shiftleft(code(1), 21).bitwiseOR(F.shiftleft(code(2), 10)).bitwiseOR(code(3).bitwiseAND(F.lit(0x3FF))).bitwiseAND(F.lit(0xFFFFFFFF))
