"""Texts inside texts, by an index of substrings instead of comparing all pairs.

A text can only hold a needle if it holds each of the needle's grams. So each needle
is looked up by the one of its grams that the fewest texts hold, and only those
texts are compared with it. All joins are equalities; both sides go in distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_key
#: Longest gram: longer ones tell more needles apart, as any needle up to this length is its own gram.
GRAM = 8


def _grams(frame: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """frame with a row for each substring of these lengths, as ``__gram``, a hash; all matches by it are compared afterwards."""
    placed = frame.where(F.length(text) >= min(sizes)).select("*", F.explode(F.sequence(F.lit(1), F.length(text) - (min(sizes) - 1))).alias("__at"))
    sized = placed.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("__size")) if len(sizes) > 1 else placed.withColumn("__size", F.lit(sizes[0]))
    whole = sized.where(F.col("__at") + F.col("__size") - 1 <= F.length(text))
    return whole.withColumn("__gram", F.xxhash64(F.substring(F.col(text), F.col("__at"), F.col("__size")))).drop("__at", "__size")


def _sorted(side: DataFrame) -> DataFrame:
    """A side to join by sorting: Spark guesses the size of texts taken apart by that of their table, so it would broadcast them."""
    return side.hint("merge")


def held(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs (text, needle) of different values of which the text holds the needle; an empty needle is in none, nulls neither."""
    inside = texts.select(F.col(text).alias("__text")).where(F.col("__text") != "").distinct()
    wanted = needles.select(F.col(needle).alias("__needle")).where(F.col("__needle") != "").distinct()
    # at most GRAM numbers: texts are taken apart by the lengths in use only
    sizes = sorted(r[0] for r in wanted.select(F.least(F.length("__needle"), F.lit(GRAM))).distinct().collect()) or [GRAM]
    sized = _grams(inside, "__text", sizes)
    long = _grams(wanted, "__needle", [GRAM])
    asked = long.unionByName(wanted.where(F.length("__needle") < GRAM).withColumn("__gram", F.xxhash64("__needle")))
    # the grams of needles only, so that the texts' other grams aren't shuffled again
    counts = sized.select("__gram").join(_sorted(asked.select("__gram").distinct()), "__gram", "left_semi").groupBy("__gram").agg(F.count("*").alias("__n"))
    rarest = asked.join(_sorted(counts), "__gram", "left").groupBy("__needle").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("gram"))).alias("__r"))
    found = sized.join(_sorted(rarest.where("__r.n > 0").select("__needle", F.col("__r.gram").alias("__gram"))), "__gram").where(F.contains(F.col("__text"), F.col("__needle")))
    return found.select(F.col("__text").alias("__in_text"), F.col("__needle").alias("__in_needle")).distinct()


def containing(left: DataFrame, text: str, master: DataFrame, name: str) -> DataFrame:
    """left joined with the master rows whose name holds the text, or is held by it."""
    one = held(left, text, master, name).select(F.col("__in_text").alias("__a"), F.col("__in_needle").alias("__b"))
    two = held(master, name, left, text).select(F.col("__in_needle").alias("__a"), F.col("__in_text").alias("__b"))
    pairs = one.unionByName(two).distinct()
    return left.join(pairs, F.col(text) == F.col("__a")).drop("__a").join(master, F.col("__b") == F.col(name)).drop("__b")


def held_by(left: DataFrame, text: str, master: DataFrame, name: str) -> DataFrame:
    """left joined with the master rows whose name holds the text."""
    pairs = held(master, name, left, text)
    return left.join(pairs, F.col(text) == F.col("__in_needle")).drop("__in_needle").join(master, F.col("__in_text") == F.col(name)).drop("__in_text")


def holding(left: DataFrame, text: str, master: DataFrame, name: str) -> DataFrame:
    """left joined with the master rows whose name stands in the text."""
    pairs = held(left, text, master, name)
    return left.join(pairs, F.col(text) == F.col("__in_text")).drop("__in_text").join(master, F.col("__in_needle") == F.col(name)).drop("__in_needle")


def word_pairs(texts: DataFrame, text: str, master: DataFrame, name: str) -> DataFrame:
    """Pairs (text, name) of different values of which the name is a run of whole words of the text; both in words with single spaces.

    A name is looked up by the one of its words that the fewest names have, and
    then compared; a text meets only the names of its own words.
    """
    names = master.select(F.col(name).alias("__name")).where(F.col("__name") != "").distinct()
    words = names.select("__name", F.explode(F.array_distinct(F.split("__name", " "))).alias("__word"))
    counts = words.groupBy("__word").agg(F.count("*").alias("__n"))
    rarest = words.join(_sorted(counts), "__word").groupBy("__name").agg(F.min_by("__word", F.struct("__n", "__word")).alias("__word"))
    asked = texts.select(F.col(text).alias("__text")).where(F.col("__text") != "").distinct()
    found = asked.select("__text", F.explode(F.array_distinct(F.split("__text", " "))).alias("__word")).join(_sorted(rarest), "__word")
    space = F.lit(" ")
    whole = F.contains(F.concat(space, "__text", space), F.concat(space, "__name", space))
    return found.where(whole).select("__text", "__name")


def with_words(left: DataFrame, text: str, master: DataFrame, name: str) -> DataFrame:
    """left joined with the master rows whose name is a run of whole words of the text, by ``word_pairs``."""
    pairs = word_pairs(left, text, master, name)
    return left.join(pairs, F.col(text) == F.col("__text")).drop("__text").join(master, F.col("__name") == F.col(name)).drop("__name")


# The lookups below answer each different text once and give the answers to all rows that ask
# it; masters are first reduced to one row a code or name, so that neither many rows of one text
# nor many of one name multiply each other.


def _first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, *order, answer) of the first row of each key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, "answer")).alias("__m")).select(key, "__m.*")


def _stage(rows: DataFrame, stage: int, *order: str) -> DataFrame:
    """(__text, stage, answer): the first answer of each text."""
    return rows.groupBy("__text").agg(F.min(F.struct(*order, "answer")).alias("__m")).select("__text", F.lit(stage).alias("stage"), "__m.answer")


def _only(pairs: DataFrame, text: str, name: str, names: DataFrame, stage: int) -> DataFrame:
    """(__text, stage, answer) of the pairs' texts whose names have just one answer."""
    span = names.groupBy("__name").agg(F.min("answer").alias("__lo"), F.max("answer").alias("__hi"))
    met = pairs.select(F.col(text).alias("__text"), F.col(name).alias("__name")).join(_sorted(span), "__name")
    return met.groupBy("__text").agg(F.min("__lo").alias("answer"), F.max("__hi").alias("__hi")).where("answer = __hi").select("__text", F.lit(stage).alias("stage"), "answer")


def _first_stage(asked: DataFrame, text: Column, *stages: DataFrame) -> DataFrame:
    """asked with stage and answer of the first stage that has one for its text."""
    every = stages[0]
    for stage in stages[1:]:
        every = every.unionByName(stage)
    best = every.groupBy("__text").agg(F.min(F.struct("stage", "answer")).alias("b")).select("__text", "b.stage", "b.answer")
    return asked.withColumn("__text", text).join(_sorted(best), "__text", "left").select(*asked.columns, "stage", "answer")


def foreign_ports(asked: DataFrame, key: str, text: str, ports: DataFrame) -> DataFrame:
    """asked with stage and answer: 1 a name or alias by key, 2 the port of the longest name of which one is whole words of the text, 3 the first that a name, alias or code in the text names.

    ports: answer, pos (their order), code, name, aliases. Stages 1 and 2 are the
    loose lookup, stage 3 is the plain one, by small letters and not by words. A
    port's length in stage 2 is that of its longest name, whichever matched.
    """
    own = asked.select(F.col(text).alias("__text")).where("__text IS NOT NULL").distinct().select("__text", plain_key(F.col("__text")).alias("__key"), F.lower(F.trim("__text")).alias("__low"))
    named = ports.select("answer", "pos", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("__as"))
    keyed = named.select("answer", "pos", plain_key(F.col("__as")).alias("__name")).where(F.col("__name") != "")
    longest = keyed.groupBy("answer").agg((-F.max(F.length("__name"))).alias("__short"))
    exact = own.join(_sorted(_first(keyed, "__name", "pos")), F.col("__key") == F.col("__name"))
    by_words = word_pairs(own, "__key", keyed, "__name").withColumnRenamed("__text", "__key").join(_sorted(_first(keyed.join(_sorted(longest), "answer"), "__name", "__short", "pos")), "__name")
    words = own.join(by_words.groupBy("__key").agg(F.min(F.struct("__short", "pos", "answer")).alias("__m")).select("__key", "__m.*").hint("merge"), "__key")
    low = named.select("answer", "pos", F.lower("__as").alias("__name"))
    by_part = held(own, "__low", low, "__name").select(F.col("__in_text").alias("__low"), F.col("__in_needle").alias("__name")).join(_sorted(_first(low, "__name", "pos")), "__name").select("__low", "pos", "answer")
    by_code = ports.select(F.lower("code").alias("__low"), "pos", "answer")
    plain = own.join(_sorted(_first(by_part.unionByName(by_code), "__low", "pos")), "__low")
    return _first_stage(asked, F.col(text), _stage(exact, 1, "pos"), _stage(words, 2, "__short", "pos"), _stage(plain, 3, "pos"))


def custom_houses(asked: DataFrame, key: str, text: str, houses: DataFrame) -> DataFrame:
    """asked with stage and answer: 1 by site or exchange code, 2 by name, 3 by a part of a name that only one has.

    houses: answer, pos, code, edi, name.
    """
    up = F.upper(F.trim(F.col(text)))
    own = asked.select(up.alias("__text")).where(F.col("__text") != "").distinct()
    codes = houses.select("answer", "pos", F.explode(F.array_compact(F.array("code", "edi"))).alias("__text"))
    names = houses.select("answer", "pos", F.upper("name").alias("__name"))
    by = lambda rows, column: own.join(_sorted(_first(rows.withColumnRenamed(column, "__text"), "__text", "pos")), "__text")
    return _first_stage(asked, up, _stage(by(codes, "__text"), 1, "pos"), _stage(by(names, "__name"), 2, "pos"), _only(held(names, "__name", own, "__text"), "__in_needle", "__in_text", names, 3))


def airlines(asked: DataFrame, key: str, text: str, carriers: DataFrame) -> DataFrame:
    """asked with stage and answer: 1 by the three digits an air waybill begins with, 2 by code of two, 3 of three letters, 4 by name, 5 by a name that alone holds the text or is held by it.

    carriers: answer, pos, prefix, iata, icao, name.
    """
    up = F.upper(F.trim(F.col(text)))
    own = asked.select(up.alias("__text")).where(F.col("__text") != "").distinct()
    digits = F.regexp_extract("__text", r"^([0-9]{3})(?![0-9A-Z_])", 1)
    names = carriers.select("answer", "pos", F.upper("name").alias("__name"))
    stage = lambda n, there, value, rows, column: _stage(own.where(there).withColumn("__value", value).join(_sorted(_first(rows.withColumnRenamed(column, "__value"), "__value", "pos")), "__value"), n, "pos")
    whole = F.col("__text")
    # step 4 has the names that are equal, so step 5 takes only texts longer than some name, or shorter than some
    least, most = names.agg(F.min(F.length("__name")), F.max(F.length("__name"))).first()
    inside, around = held(own.where(F.length("__text") > F.lit(least)), "__text", names, "__name"), held(names, "__name", own.where(F.length("__text") < F.lit(most)), "__text")
    either = inside.toDF("__a", "__b").unionByName(around.select(F.col("__in_needle").alias("__a"), F.col("__in_text").alias("__b")))
    return _first_stage(
        asked,
        up,
        stage(1, digits != "", digits, carriers, "prefix"),
        stage(2, whole.rlike("^[0-9A-Z]{2}$"), whole, carriers, "iata"),
        stage(3, whole.rlike("^[A-Z]{3}$"), whole, carriers, "icao"),
        stage(4, F.lit(True), whole, names, "__name"),
        _only(either, "__a", "__b", names, 5),
    )
