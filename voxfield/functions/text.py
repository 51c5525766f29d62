"""Column functions on text. Regular expressions stay within what Java's engine and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that Windows reserves for devices.
RESERVED = ["con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]]


def slugify(s: Column, reserved: list[str] = RESERVED) -> Column:
    """Lower case, runs of other than a-z0-9 to one underscore, none at the ends; `untitled` if nothing is left; reserved names (those of devices) get `_topic`."""
    bare = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(F.coalesce(bare, F.lit("")) == "", "untitled").when(bare.isin(reserved), F.concat(bare, F.lit("_topic"))).otherwise(bare)


def author_hash(author: Column, salt: str) -> Column:
    """sha256 of salt:author; an empty or null author stays empty."""
    return F.when(F.coalesce(author, F.lit("")) == "", "").otherwise(F.sha2(F.concat(F.lit(salt + ":"), author).cast("binary"), 256))


def short_id(prefix: str, key: Column) -> Column:
    """prefix_ and the first 12 hex digits of the key's sha256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 12))


def truncate(s: Column, n: int) -> Column:
    """At most n characters; what is longer is cut to n-1, right-trimmed, and ends in an ellipsis."""
    return F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n - 1)), F.lit("…"))).otherwise(s)


def snippet(s: Column, n: int) -> Column:
    """The first n characters with line ends as spaces."""
    return F.translate(F.substring(s, 1, n), "\n", " ")


def post_text(title: Column, body: Column) -> Column:
    """Title, blank line, body; without a title the body alone."""
    return F.concat_ws("\n\n", F.nullif(title, F.lit("")), body)


def digits_to_int(s: Column) -> Column:
    """The number made of all digits of s, null without any."""
    return F.regexp_replace(s, "[^0-9]", "").try_cast("long")


def count_suffix(s: Column) -> Column:
    """1.7M, 73K, 2B or 1,234 as a whole number; null where there is none."""
    number = F.regexp_extract(F.regexp_replace(s, ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(s, r"[0-9.,]+\s*([KkMmBb])", 1))
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.floor(number * factor + 1e-6).cast("long")


def rating(s: Column) -> Column:
    """The number before `/5`, or a bare number from 1 to 5."""
    ratio = F.regexp_extract(s, r"([0-9](?:\.[0-9]+)?)\s*/\s*5", 1).try_cast("double")
    bare = F.regexp_extract(s, r"^\s*([1-5](?:\.[0-9]+)?)\s*$", 1).try_cast("double")
    return F.coalesce(ratio, bare)


def contains_any(s: Column, words: list[str]) -> Column:
    """Does the lower-cased text hold any of the words, anywhere."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(s), w))


def hits(s: Column, words: list[str]) -> Column:
    """How many of the words the lower-cased text holds."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(s), w)))


def bar(n: Column, most: Column, width: int = 40) -> Column:
    """A bar of at least one block, `width` at the maximum."""
    return F.repeat(F.lit("█"), F.greatest(F.lit(1), F.floor(n * width / most)).cast("int"))


def token_set(s: Column) -> Column:
    """Distinct runs of a-z0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), 0))


def compound_variants(s: Column) -> Column:
    """Variants of a compound topic: its words lower-cased and as they are (if several), digits set apart, underscores and hyphens as spaces.

    Characters are classified one by one. A word begins where a letter follows another class, a capital follows a small letter, or a
    capital precedes a small one; capitals that run into an underscore or a letter beyond ASCII are no word."""
    chars = F.filter(F.split(F.regexp_replace(s, "[A-Z]+(?=[_\\x{80}-\\x{10FFFF}])", "_"), ""), lambda c: c != "")
    small = lambda c: F.coalesce(c.between("a", "z"), F.lit(False))
    big = lambda c: F.coalesce(c.between("A", "Z"), F.lit(False))
    digit = lambda c: F.coalesce(c.between("0", "9"), F.lit(False))

    def letter(c: Column, i: Column) -> Column:
        before, after = F.get(chars, i - 1), F.get(chars, i + 1)
        begins = big(c) & (small(before) | small(after))
        return F.when(~(small(c) | big(c)), " ").when(begins, F.concat(F.lit(" "), c)).otherwise(c)

    words = F.filter(F.split(F.array_join(F.transform(chars, letter), ""), " +"), lambda w: w != "")
    several, spaced = F.size(words) > 1, F.array_join(words, " ")
    own = F.filter(F.split(s, ""), lambda c: c != "")
    apart = F.array_join(F.transform(own, lambda c, i: F.when((i > 0) & (digit(c) != digit(F.get(own, i - 1))), F.concat(F.lit(" "), c)).otherwise(c)), "")
    flat = F.translate(s, "_-", "  ")
    return F.array_compact(F.array(F.when(several, F.lower(spaced)), F.when(several, spaced), F.when(apart != s, apart), F.when(flat != s, flat)))


def hue(key: Column) -> Column:
    """A hue of 0 to 359 from the key's sha256."""
    return (F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("long") % 360).cast("long")
