"""Synthetic rows: copies of distractors, and siblings of entities with a changed word or house number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import hash_share


def densify(records: DataFrame, owned: DataFrame, key: str, rate: float, seed: int = 0) -> DataFrame:
    """records with origin 'raw', and copies (origin 'copy') of a share rate - 1 of those that nobody owns."""
    free = records.join(owned.select(key).distinct(), key, "left_anti").filter(hash_share(F.col(key), seed=seed) < rate - 1)
    return records.withColumn("origin", F.lit("raw")).unionByName(free.withColumn("origin", F.lit("copy")))


def insert_word(name: Column, word: Column, legal: list[str]) -> Column:
    """The word before the name's legal ending, or at its end; in capitals where the name is."""
    cased = F.when(name == F.upper(name), F.upper(word)).when(name == F.lower(name), F.lower(word)).otherwise(word)
    tail = r"(?i)^(.*?)((?:[ ,.]+(?:" + "|".join(legal) + r")\.?)*)$"
    return F.concat(F.regexp_extract(name, tail, 1), F.lit(" "), cased, F.regexp_extract(name, tail, 2))


def shift_house(address: Column, house: Column, offset: Column) -> Column:
    """The first number equal to house (zeros aside) moved by offset, its zero padding kept; unchanged if there is none."""
    pattern = F.concat(F.lit("(?<![0-9])0*"), house, F.lit("(?![0-9])"))
    found = F.regexp_substr(address, pattern)
    moved = F.greatest(house.try_cast("bigint") + offset, F.lit(1)).cast("string")
    padded = F.when(F.length(moved) < F.length(found), F.lpad(moved, F.length(found), F.lit("0"))).otherwise(moved)
    at = F.regexp_instr(address, pattern)
    return F.when(found.isNull() | (house == ""), address).otherwise(
        F.concat(F.substring(address, F.lit(1), at - 1), padded, F.substring(address, at + F.length(found), F.length(address)))
    )


def siblings(entities: DataFrame, key: str, words: list[str], offsets: list[int], legal: list[str], seed: int = 0, copy: float = 0.85, no_word: float = 0.3) -> DataFrame:
    """Look-alikes of entities (key, name, addr, house): a word put in, or the house moved, or the address kept.

    Choices are hashes of the key, so they fall alike in every run.
    """
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(seed + salt), key), F.lit(len(values))) + 1).cast("int"))
    plain = hash_share(F.col(key), seed=seed + 1) < no_word
    same = hash_share(F.col(key), seed=seed + 2) < copy
    name = F.when(plain, F.col("name")).otherwise(insert_word(F.col("name"), pick(words, 3), legal))
    addr = F.when(same & ~plain, F.col("addr")).otherwise(shift_house(F.col("addr"), F.col("house"), pick(offsets, 4)))
    return entities.withColumns({"name": name, "addr": addr}).withColumn("origin", F.lit("sibling"))
