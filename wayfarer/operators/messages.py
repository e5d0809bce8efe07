"""Understanding of user messages as column expressions and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.operators import similarity
from wayfarer.operators.places import search_many
from wayfarer.session import written


def detect_intent(message: Column, intents: list[tuple[str, list[str]]], default: str) -> Column:
    """The first group with a keyword that the message contains."""
    low = F.lower(F.coalesce(message, F.lit("")))
    cases = [F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), F.lit(name)) for name, words in intents]
    return F.coalesce(*cases, F.lit(default))


def search_term(message: Column, prefixes: list[str]) -> Column:
    """The message without the first of the prefixes that it begins with."""
    return F.trim(F.regexp_replace(message, "(?i)^(" + "|".join(prefixes) + ")", ""))


def find_names(messages: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """The longest of ``names`` (``name, district``) that stands in the message as whole words, and its district.

    Names without a district are blocked. Runs of words of the messages meet the names in an equi join, so the list of
    names may be long; a message's words come in runs as long as the longest name.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")), " ")
    known = names.where("district IS NOT NULL").withColumn("_run", F.array_join(words(F.col("name")), " ")).where("_run <> ''")
    longest = known.agg(F.coalesce(F.max(F.size(words(F.col("name")))), F.lit(1))).first()[0]
    run = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    said = messages.select(*keys, words(F.coalesce("message", F.lit(""))).alias("_w"))
    said = said.select(*keys, F.explode(F.array_distinct(F.concat(*[run(F.col("_w"), n) for n in range(1, longest + 1)]))).alias("_run"))
    rank = F.struct(F.length("name").alias("l"), F.col("name"))
    best = said.join(known, "_run").groupBy(*keys).agg(F.max_by(F.struct("name", "district"), rank).alias("_b"))
    return messages.select(*keys).join(best.select(*keys, "_b.name", "_b.district"), keys, "left")


# How a message asks for what is around.
NEAR_ME = r"\b(?:near|around|close to|nearby)\s+(?:me|here|my location|us)\b|\bnearby\b\s*(?:$|[^\w\s])"


def wants_near_me(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike(NEAR_ME), F.lit(False))


# Words that say nothing of what is asked for, and marks around words.
STOP_WORDS = "the a an in near nearby place places tourist tourism visit visiting show me give some best good for to of is are what where which can i want tell about please".split()
MARKS = r".,!?;:()\[\]{}"


def message_words(message: Column, stop: list[str]) -> Column:
    """The words of a message in order, without the marks around them: three letters at least, no stop words."""
    bare = F.transform(F.split(F.trim(F.lower(message)), r"\s+"), lambda w: F.regexp_replace(w, f"^[{MARKS}]+|[{MARKS}]+$", ""))
    stops = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    return F.filter(bare, lambda w: (F.length(w) >= 3) & ~F.array_contains(stops, w))


def message_search(messages: DataFrame, places: DataFrame, keys: list[str], stop: list[str], n: int) -> DataFrame:
    """``keys, place_id, nth, how``: the first ``n`` places of each message.

    A message that places hold as a whole finds those (``how`` is "message"). Else each of its words finds its first ``n``, and
    places count in the order of the words ("words"). ``places`` is a base view. What many say, and words that many
    messages share, are looked up once.
    """
    said = messages.select(F.trim("message").alias("said")).where("said <> ''").distinct()
    whole = written(search_many(places, said.select(F.col("said").alias("search_id"), F.col("said").alias("text")), n), "messages-whole")
    left = said.join(whole.select(F.col("search_id").alias("said")).distinct(), "said", "left_anti")
    words = written(left.select("said", F.posexplode(message_words(F.col("said"), stop)).alias("pos", "word")), "messages-words")
    once = words.select(F.col("word").alias("search_id"), F.col("word").alias("text")).distinct()
    found = search_many(places, once, n).select(F.col("search_id").alias("word"), "place_id", F.col("nth").alias("w"))
    hits = words.join(found, "word").groupBy("said", "place_id").agg(F.min(F.struct("pos", "w")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("said").orderBy("at", "place_id"))
    by_words = hits.withColumn("nth", nth).where(F.col("nth") <= n).select("said", "place_id", "nth", F.lit("words").alias("how"))
    best = by_words.unionByName(whole.select(F.col("search_id").alias("said"), "place_id", "nth", F.lit("message").alias("how")))
    return messages.select(*keys, F.trim("message").alias("said")).join(best, "said").select(*keys, "place_id", "nth", "how")


def place_information(mentions: DataFrame, places: DataFrame) -> DataFrame:
    """``mention_id, place_id, how`` of mentions (``mention_id, text``): the place they mean.

    Digits mean the place of that id ("id") if there is one; anything else, and digits without a place, mean the first place
    that a search finds ("search"). Blank mentions and those that find nothing have no row.
    """
    asked = mentions.select("mention_id", F.trim("text").alias("text")).where("text <> ''")
    number = F.when(F.col("text").rlike("^[0-9]{1,18}$"), F.col("text").cast("long"))
    by_id = written(asked.select("mention_id", number.alias("place_id")).join(places.select("place_id"), "place_id").select("mention_id", "place_id", F.lit("id").alias("how")), "mentions-id")
    rest = asked.join(by_id.select("mention_id"), "mention_id", "left_anti")
    texts = rest.select(F.col("text").alias("search_id"), "text").distinct()
    first = search_many(places, texts, 1).select(F.col("search_id").alias("text"), "place_id")
    return by_id.unionByName(rest.join(first, "text").select("mention_id", "place_id", F.lit("search").alias("how")))


def grounded(messages: DataFrame, places: DataFrame, districts: DataFrame, category: Column, keys: list[str], n: int = 8) -> DataFrame:
    """``keys, place_id, nth, how``: what the places answer to a message that names a district, a kind or a place.

    The district is the longest of ``districts`` (``name, district``) in the message, the kind what ``category`` says of it, and
    the named place that of the longest name that the message holds, found through an index of letters; of equal names the
    most popular. A named place is the answer ("named") unless district and kind are both told; else the ``n`` most popular
    places of the district and kind are ("listed"), of the district alone where it has none of the kind. Messages that
    name nothing have no row. What many ask for is looked up once.
    """
    said = written(messages.select(*keys, "message", category.alias("category")), "grounded-said")
    with_district = find_names(said.select(*keys, "message"), districts, keys).select(*keys, "district")
    low = said.select(*keys, F.lower("message").alias("_m"))
    known = places.select("place_id", F.lower("place_name").alias("_n"), "popularity_score")
    hits = similarity.holding(known, low, [], "_n", "_m")
    longest = hits.groupBy("_m").agg(F.max(F.struct(F.length("_n").alias("l"), "_n")).alias("h")).select("_m", "h._n")
    best = known.groupBy("_n").agg(F.min_by("place_id", F.struct((-F.coalesce("popularity_score", F.lit(0.0))).alias("p"), "place_id")).alias("named"))
    named = low.join(longest, "_m").join(best, "_n").select(*keys, "named")
    asked = written(said.join(with_district, keys, "left").join(named, keys, "left").select(*keys, "district", "category", "named"), "grounded-asked")
    both = F.col("district").isNotNull() & F.col("category").isNotNull()
    direct = asked.where(F.col("named").isNotNull() & ~both).select(*keys, F.col("named").alias("place_id"), F.lit(1).alias("nth"), F.lit("named").alias("how"))

    rest = asked.where((F.col("named").isNull() | both) & (F.col("district").isNotNull() | F.col("category").isNotNull()))
    wanted = rest.select("district", "category").distinct()
    there = places.select(F.col("district").alias("_d"), F.col("category_name").alias("_c"), "place_id", "place_name", "popularity_score")
    kinds = there.select(F.col("_d").alias("district"), F.col("_c").alias("category")).distinct().withColumn("_has", F.lit(True))
    wanted = wanted.join(kinds, ["district", "category"], "left").withColumn("_kind", F.when(F.col("district").isNull() | F.col("_has"), F.col("category"))).drop("_has")
    local = wanted.where("district IS NOT NULL").join(there, F.col("district") == F.col("_d")).where("_kind IS NULL OR _kind = _c")
    everywhere = wanted.where("district IS NULL").join(there, F.col("category") == F.col("_c"))
    nth = F.row_number().over(Window.partitionBy("district", "category").orderBy(F.desc("popularity_score"), "place_name", "place_id"))
    top = local.unionByName(everywhere).withColumn("nth", nth).where(F.col("nth") <= n).select(F.col("district").alias("_d"), F.col("category").alias("_k"), "place_id", "nth")
    listed = rest.join(top, F.col("district").eqNullSafe(F.col("_d")) & F.col("category").eqNullSafe(F.col("_k"))).select(*keys, "place_id", "nth", F.lit("listed").alias("how"))
    return direct.unionByName(listed)
