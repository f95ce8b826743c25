"""String expressions: normalising, splitting id lists, label parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java's Unicode white space leaves out the four ASCII separators that text tools elsewhere drop.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def norm_key(c: Column) -> Column:
    """Lower case without any white space; the key for finding repeated questions."""
    return F.regexp_replace(F.lower(c), SPACE, "")


def collapse(c: Column, most: int | None = None) -> Column:
    """White space runs as one space; cut to so many characters."""
    one = F.trim(F.regexp_replace(c, SPACE, " "))
    return F.substring(one, 1, most) if most else one


def split_ids(c: Column, unique: bool = False, marks: str = "[;,]") -> Column:
    """Ids parted by any of the marks (a character class), without blanks, in order; unique drops repeats."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), marks), strip), lambda x: x != "")
    return F.array_distinct(parts) if unique else parts


def split_intents(c: Column, none_word: str = "무관") -> Column:
    """Intents parted by +, as a sorted set; blank or the none word is the empty set."""
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\+"), strip), lambda x: x != "")))
    return F.when(strip(F.coalesce(c, F.lit(""))).isin("", none_word), F.array().cast("array<string>")).otherwise(parts)


def parse_double(c: Column) -> Column:
    """A number or null, never NaN or an infinity."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def short_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def seeded_order(seed: str, *parts: Column) -> Column:
    """A sort key that shuffles deterministically: the SHA-1 of seed and parts joined by ':'."""
    return F.sha1(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]))


def token_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, term, weight: each lower-case word's share of its text's words, rounded to 9 decimals."""
    words = docs.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")
    counts = words.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(id_col).agg(F.sum("n").alias("total"))
    return counts.join(totals, id_col).select(id_col, "term", F.round(F.col("n") / F.col("total"), 9).alias("weight"))


def weight_maps(tokens: DataFrame, id_col: str) -> DataFrame:
    """id_col, weights: a text's sparse lexical vector as a map."""
    return tokens.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))
