"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r4(x: Column) -> Column:
    """Half-up rounding to four places, the same in every engine."""
    return F.floor(x * 10000 + 0.5) / 10000


def strip(x: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(x, F.lit(" \t\n\r\f\x0b"))


def normalize_text(x: Column | str) -> Column:
    """Lower case; separators, possessives and punctuation to single blanks."""
    out = F.regexp_replace(F.lower(col(x)), r"[-_./\\]+", " ")
    out = F.regexp_replace(out, r"'s\b", "")
    out = F.regexp_replace(out, r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(out, " +", " "))


def normalize_label(x: Column | str) -> Column:
    """``normalize_text`` without a leading article."""
    return F.regexp_replace(normalize_text(x), r"^(the|an|a) ", "")


def context_label(x: Column | str) -> Column:
    """The first non-blank line without its speaker, 200 characters at most."""
    lines = F.filter(F.transform(F.split(col(x), "\n"), lambda s: strip(s)), lambda s: s != "")
    first = F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^(User|Assistant|Human|AI):\s*", "")
    return F.coalesce(F.substring(first, 1, 200), F.lit("Unnamed context"))


def embedding_text(label: Column | str, content: Column | str) -> Column:
    label, content = col(label), col(content)
    return F.when((F.coalesce(content, F.lit("")) != "") & (content != label), F.concat(label, F.lit(". "), content)).otherwise(label)


def truncate_label(x: Column | str) -> Column:
    """200 characters at most, cut at a word with dots where one ends after the 100th character."""
    x = col(x)
    cut = F.substring(x, 1, 197)
    words = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    return F.when(F.length(x) <= 200, x).otherwise(F.concat(F.when(F.length(words) > 100, words).otherwise(cut), F.lit("...")))


def slug(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "-"), "^-|-$", "")


def safe_filename(x: Column | str) -> Column:
    out = F.trim(F.regexp_replace(F.regexp_replace(col(x), r"[^A-Za-z0-9_ -]", ""), r" +", " "))
    return F.when(out == "", "entity").otherwise(out)


def normalize_answer(x: Column | str) -> Column:
    out = F.lower(F.regexp_replace(col(x), ",", ""))
    out = F.regexp_replace(out, r"[!-/:-@\[-`{-~]", "")
    out = F.regexp_replace(out, r"\b(a|an|the|and)\b", " ")
    return F.trim(F.regexp_replace(out, r"[ \n\t]+", " "))


def basename(x: Column | str) -> Column:
    return F.element_at(F.split(F.regexp_replace(col(x), r"[\\/]+$", ""), r"[\\/]+"), -1)


def plain_letters(x: Column | str) -> Column:
    """Lower case with foreign letters as ``_`` and foreign signs as blanks, so that ASCII word boundaries fall where letters end."""
    out = F.regexp_replace(F.lower(col(x)), r"[^\x00-\x7F\p{L}\p{N}\p{M}]", " ")
    return F.regexp_replace(out, r"[^\x00-\x7F]", "_")


def topic_words(x: Column | str) -> Column:
    """Words of at least two letters as topics see them, in order."""
    return F.regexp_extract_all(plain_letters(x), F.lit(r"\b([a-z][a-z'-]+)\b"), F.lit(1))


def relative_age(then: Column, now: Column) -> Column:
    """How long ago, in words."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    unit = lambda n, word: F.concat(F.floor(s / n).cast("string"), F.lit(f" {word}"), F.when(F.floor(s / n) == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(s < 60, "just now").when(s < 3600, unit(60, "minute")).when(s < 86400, unit(3600, "hour")).when(s < 604800, unit(86400, "day")).when(s < 2592000, unit(604800, "week")).when(s < 31536000, unit(2592000, "month")).otherwise(unit(31536000, "year"))


def sentences(x: Column | str) -> Column:
    return F.filter(F.split(col(x), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


# What an answer that refuses says (fixed values).
REFUSALS = ["no information available", "not mentioned"]


def is_refusal(x: Column | str) -> Column:
    """Whether an answer says that it has none."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return F.contains(low, F.lit(REFUSALS[0])) | F.contains(low, F.lit(REFUSALS[1]))


def linkable(x: Column | str) -> Column:
    """Whether a label can be the target of a double-bracket link."""
    return F.coalesce((F.trim(col(x)) != "") & ~col(x).rlike(r"[\n\r\[\]|#]"), F.lit(False))
