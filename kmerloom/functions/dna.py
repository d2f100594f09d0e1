"""DNA expressions: reverse complement, canonical k-mers, windows, file-safe names. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# K-mer size, window width, window slide.
KMER_SIZE = 5
WINDOW = 125
SLIDE = 10

BASES = "ACGT"
SPARK_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def revcomp(s: Column) -> Column:
    """Reverse complement; anything but ACGT becomes N."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGT]", "N"), "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    """The lesser of a string and its reverse complement."""
    return F.least(s, revcomp(s))


def kmers(s: Column, k: int = KMER_SIZE) -> Column:
    """All substrings of length k in order, found in one pass by look-ahead; empty for shorter strings."""
    return F.regexp_extract_all(s, F.lit(rf"(?=([\s\S]{{{k}}}))"), F.lit(1))


def known_kmers(s: Column, k: int = KMER_SIZE) -> Column:
    """Canonical k-mers of pure ACGT; k-mers with other symbols are skipped."""
    found = F.regexp_extract_all(s, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))
    return F.transform(found, lambda x: F.least(x, F.reverse(F.translate(x, "ACGT", "TGCA"))))


def kmer_code(s: Column) -> Column:
    """Big-endian base-4 number of an ACGT string (A0 C1 G2 T3)."""
    return F.conv(F.translate(s, BASES, "0123"), 4, 10).cast("int")


def window_starts(length: Column, rule: str = "cpu", width: int = WINDOW, slide: int = SLIDE) -> Column:
    """0-based window starts.

    ``cpu``: x = 0, slide, ... while x + width < length (a last full window that ends at the end is left out).
    ``gpu``: (length - width) / slide + 1 windows; none for shorter sequences.
    """
    if rule not in ("cpu", "gpu"):
        raise ValueError(f"unknown window rule {rule!r}")
    last = length - width - (1 if rule == "cpu" else 0)
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(slide))).otherwise(F.array().cast("array<int>"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often a lambda refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(df: DataFrame, seq_col: str = "sequence", rule: str = "cpu", width: int = WINDOW, slide: int = SLIDE) -> DataFrame:
    """One row per window: all columns, window_start (0-based), window.

    Windows are cut before they become rows, by byte offsets where the sequence is ASCII, so no row carries the whole sequence.
    """
    starts = window_starts(F.length(seq_col), rule, width, slide)

    def cut(whole: Column) -> Column:
        return bound(whole, lambda s: F.transform(starts, lambda x: F.struct(x.alias("window_start"), F.substring(s, x + 1, F.lit(width)).cast("string").alias("window"))))

    ascii_only = F.length(seq_col) == F.octet_length(seq_col)
    found = F.when(ascii_only, cut(F.col(seq_col).cast("binary"))).otherwise(cut(F.col(seq_col)))
    return df.select("*", F.inline(found))


def nmers(spark: SparkSession, n: int) -> DataFrame:
    """All 4**n strings over ACGT in order: (code bigint, nmer string)."""
    digits = F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda i: F.substring(F.lit(BASES), (F.expr("shiftrightunsigned(id, 0)").bitwiseAND(F.lit((1 << (2 * n)) - 1)) / F.pow(F.lit(4), i)).cast("bigint").bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)))
    return spark.range(4**n).select(F.col("id").alias("code"), F.array_join(digits, "").alias("nmer"))


def normalize_category(s: Column) -> Column:
    """Spaces become underscores."""
    return F.translate(s, " ", "_")


def safe_name(s: Column) -> Column:
    """Spaces and slashes become underscores; parentheses go."""
    return F.translate(s, " /()", "__")


def text_to_dna(text: Column, length: int) -> Column:
    """ASCII letters of the first ``length`` code points as bases, anything else as '.', for tables without DNA."""
    head = F.upper(F.regexp_replace(F.substring(text, 1, length), "[^A-Za-z]", "."))
    return F.translate(head, SPARK_LETTERS, (BASES * 7)[:26])


#: Bases of a packed word.
PACKED = 16


def pack(s: Column) -> Column:
    """Struct n, words (array<bigint>), unknown (array<int>): 16 bases a word, two bits each (A0 C1 G2 T3), the first base highest; ``unknown`` has a bit for each base that is none.

    A last word is filled up with A. Null packs as the empty sequence.
    """
    pieces = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(rf"[\s\S]{{1,{PACKED}}}"), F.lit(0))
    digits = F.transform(pieces, lambda x: F.rpad(F.translate(F.regexp_replace(x, "[^ACGT]", "A"), BASES, "0123"), PACKED, "0"))
    marks = F.transform(pieces, lambda x: F.rpad(F.translate(F.regexp_replace(x, "[^ACGT]", "1"), BASES, "0000"), PACKED, "0"))
    words = F.transform(digits, lambda x: F.conv(x, 4, 10).cast("bigint"))
    unknown = F.transform(marks, lambda x: F.conv(x, 2, 10).cast("int"))
    return F.struct(F.coalesce(F.length(s), F.lit(0)).alias("n"), words.alias("words"), unknown.alias("unknown"))


def unpack(packed: Column, other: str = "N") -> Column:
    """The sequence of a packed one; ``other`` stands for unknown bases."""

    def piece(word: Column, unknown: Column) -> Column:
        plain = F.translate(F.lpad(F.conv(word.cast("string"), 10, 4), PACKED, "0"), "0123", BASES)
        marks = F.lpad(F.conv(unknown.cast("string"), 10, 2), PACKED, "0")
        mixed = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(PACKED)), lambda i: F.when(F.substring(marks, i, F.lit(1)) == "1", other).otherwise(F.substring(plain, i, F.lit(1)))), "")
        return F.when(unknown == 0, plain).otherwise(mixed)

    return bound(packed, lambda p: F.substring(F.array_join(F.zip_with(p["words"], p["unknown"], piece), ""), F.lit(1), p["n"]))


def packed_kmers(packed: Column, k: int = KMER_SIZE) -> Column:
    """The base-4 number of the k-mer (k <= 16) at each place, -1 where a base is unknown: shifts over two neighbouring words."""
    if not 1 <= k <= PACKED:
        raise ValueError("a k-mer has 1 to 16 bases")

    def every(p: Column) -> Column:
        def at(i: Column) -> Column:
            w, off = F.shiftright(i, 4), i.bitwiseAND(F.lit(PACKED - 1))
            high, low = F.get(p["words"], w), F.coalesce(F.get(p["words"], w + 1), F.lit(0).cast("bigint"))
            # the two words from the base on stand at the top of 64 bits
            both = F.call_function("shiftleft", F.shiftleft(high, 32).bitwiseOR(low), 2 * off)
            marks = F.shiftleft(F.get(p["unknown"], w), PACKED).bitwiseOR(F.coalesce(F.get(p["unknown"], w + 1), F.lit(0)))
            bad = F.shiftrightunsigned(F.call_function("shiftleft", marks, off), 32 - k)
            return F.when(bad == 0, F.shiftrightunsigned(both, 64 - 2 * k)).otherwise(F.lit(-1).cast("bigint"))

        last = p["n"] - k
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))

    return bound(packed, every)
