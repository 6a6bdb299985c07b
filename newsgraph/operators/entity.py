"""Entity gate: does a text name a person, an organisation or a place?

The recogniser is a gazetteer: word n-grams of the text are joined to a table of
known names. Callers that have a trained model pass it as a column function
(for example a ``pandas_udf`` that loads the model once per worker); the truth
table stays the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.functions.dates import exact_timestamp

WORD_PATTERN = r"[\w'-]+"
#: The most bits of the first-word index.
MOST_BITS = 1 << 22


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_runs(words: Column, longest: int = 3, may_begin: Callable[[Column], Column] | None = None) -> Column:
    """All runs of 1 to ``longest`` of the words, joined by one blank; with
    ``may_begin`` only those whose first word passes it. ``words`` should be a
    column of the row: an expression would be worked out for every word."""
    count = F.size(words)
    every = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    starts = every if may_begin is None else F.filter(every, lambda i: may_begin(F.get(words, i - 1)))
    lengths = F.sequence(F.lit(1), F.lit(longest))
    return F.flatten(F.transform(lengths, lambda n: F.transform(
        F.filter(starts, lambda i: i + n <= count + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))


def ngrams(text: Column, longest: int = 3) -> Column:
    return word_runs(words_in(text), longest)


def _places(word: Column, bits: int) -> list[Column]:
    """Two places of a word in an index of so many bits."""
    return [F.pmod(h, F.lit(bits)) for h in (F.xxhash64(word), F.xxhash64(F.lit(1), word))]


def first_word_index(gazetteer: DataFrame) -> Callable[[Column], Column]:
    """A test whether a word can be the first of a name, by a bit array.

    The array is a literal of the plan: 16 bits per first word, ``MOST_BITS`` at
    most whatever the size of the gazetteer. A larger one lets more words
    pass, and the join with the names decides about those.
    """
    first = gazetteer.select(F.regexp_extract("entity", WORD_PATTERN, 0).alias("word")).distinct()
    bits = min(MOST_BITS, max(1 << 10, 1 << (16 * first.count()).bit_length()))
    rows = first.select(F.explode(F.array(*_places(F.col("word"), bits))).alias("bit")).groupBy(
        F.floor(F.col("bit") / 64).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).collect()
    words = [0] * (bits // 64)
    for row in rows:
        words[row["at"]] = row["bits"]
    index = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def has(place: Column) -> Column:
        word = F.get(index, F.floor(place / 64).cast("int"))
        return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    def may_begin(word: Column) -> Column:
        one, two = _places(word, bits)
        return has(one) & has(two)

    return may_begin


def naming(
    df: DataFrame, key: str, text: str, gazetteer: DataFrame, longest: int = 3
) -> DataFrame:
    """Distinct keys of the texts in which at least one n-gram is in the gazetteer.

    Word runs that cannot be names, by their first word, are dropped where the
    texts are read; only the others reach the join.
    """
    names = gazetteer.select(F.col("entity").alias("_gram")).distinct()
    grams = F.array_distinct(word_runs(F.col("_words"), longest, first_word_index(gazetteer)))
    return (
        df.select(key, words_in(F.col(text)).alias("_words"))
        .select(key, F.explode(grams).alias("_gram"))
        .join(names, "_gram", "left_semi")
        .select(key)
        .distinct()
    )


def with_gate(
    df: DataFrame,
    text: str,
    gazetteer: DataFrame | None = None,
    model: Callable[[Column], Column] | None = None,
    longest: int = 3,
    out: str = "is_topic",
    key: str | None = None,
) -> DataFrame:
    """Add ``out``: true when the text holds no entity and is no timestamp.

    Short texts repeat, so every distinct text is judged once. For long texts
    pass the unique ``key`` of the rows: the rows are judged where they are and
    only keys are shuffled. A null text gives a null flag.
    """
    by = key or text
    judged = df.select(*dict.fromkeys([by, text])).where(F.col(text).isNotNull())
    if key is None:
        judged = judged.distinct()
    if model is not None:
        named = judged.where(model(F.col(text))).select(by)
    else:
        named = naming(judged, by, text, gazetteer, longest)
    plain = F.when(F.col(text).isNotNull(), exact_timestamp(F.col(text)).isNull())
    return (
        df.withColumn(out, plain)
        .join(named.withColumn("_named", F.lit(True)), by, "left")
        .withColumn(out, F.col(out) & F.col("_named").isNull())
        .drop("_named")
    )


def last_entity_word(df: DataFrame, key: str, words: str, gazetteer: DataFrame) -> DataFrame:
    """(key, word): the last word of the word list that the gazetteer knows.

    A single word is its own only n-gram and never a timestamp, so the gate is
    one semi join on the word.
    """
    names = gazetteer.select(F.col("entity").alias("word")).distinct()
    return (
        df.select(key, F.posexplode(words).alias("pos", "word"))
        .join(names, "word", "left_semi")
        .groupBy(key)
        .agg(F.max_by("word", "pos").alias("word"))
    )
