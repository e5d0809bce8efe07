"""The read layer over places: base view, filters, orders, windows and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.functions.geo import haversine_km
from wayfarer.functions.score import clip, weighted_rating_sql
from wayfarer.functions.text import name_key, truncate
from wayfarer.operators import similarity
from wayfarer.operators.ratios import similar
from wayfarer.session import written


def rating_summary(ratings: DataFrame) -> DataFrame:
    """Mean rating, number of votes and weighted rating of each place; aggregated before any join."""
    summed = ratings.groupBy("place_id").agg(F.avg("rating").alias("rating"), F.sum(F.coalesce("rating_count", F.lit(0))).cast("long").alias("rating_count"))
    return summed.withColumn("weighted_rating", weighted_rating_sql(F.col("rating"), F.col("rating_count")))


def first_image(images: DataFrame) -> DataFrame:
    """The primary image of each place, else its first by address."""
    key = F.struct((~F.col("is_primary")).alias("p"), F.col("image_url"))
    return images.groupBy("place_id").agg(F.min_by("image_url", key).alias("image_url"))


def place_select(places: DataFrame, ratings: DataFrame, images: DataFrame) -> DataFrame:
    """Places with their rating summary and first image; places without either stay."""
    zero = F.lit(0.0)
    joined = places.join(rating_summary(ratings), "place_id", "left").join(first_image(images), "place_id", "left")
    return joined.withColumns({"rating": F.coalesce("rating", zero), "rating_count": F.coalesce("rating_count", F.lit(0).cast("long")), "weighted_rating": F.coalesce("weighted_rating", zero)})


#: The columns of the base view, in order.
BASE_VIEW = (
    "place_id place_name district city_town city state category_id category_name subcategory description latitude longitude location_precision address opening_time closing_time opening_days "
    "avg_visit_duration entry_fee best_season popularity_score tourism_relevance verified source_id created_at updated_at rating rating_count weighted_rating image_url"
).split()


def with_category(places: DataFrame, categories: DataFrame) -> DataFrame:
    """Places with the name of their category, null if there is no such category."""
    return places.drop("category_name").join(categories.select("category_id", "category_name"), "category_id", "left")


def base_view(places: DataFrame, categories: DataFrame, ratings: DataFrame, images: DataFrame) -> DataFrame:
    """Every column of a place, with its category, city, rating summary and first image; places without any of them stay."""
    named = with_category(places, categories).withColumn("city", F.col("city_town"))
    return place_select(named, ratings, images).select(*BASE_VIEW)


def by_text(df: DataFrame, column: str, value: str) -> DataFrame:
    """Places whose district, city or state is this, case aside, most prominent first; nothing for a blank value."""
    return df.where(equals_folded(column, value) if value.strip() else F.lit(False)).orderBy(*by_prominence())


#: What a search looks through.
SEARCHED = ["place_name", "city_town", "district", "state", "subcategory", "description", "address", "category_name"]


def search_view(df: DataFrame, text: str | None, category_id: int | None = None, n: int = 50) -> DataFrame:
    """``df`` (a base view) where any of eight columns holds the text, case aside; ``tier`` is 1 for the name itself, 2 where the
    name begins with it, 3 where the city holds it, else 4. Without a text all places count, without tiers."""
    low = F.lit((text or "").strip().lower())
    name = F.lower("place_name")
    tier = F.when(name == low, 1).when(F.startswith(name, low), 2).when(F.contains(F.lower(F.coalesce("city_town", F.lit(""))), low), 3).otherwise(4)
    asked = bool((text or "").strip())
    found = df.where(any_contains(SEARCHED, text.strip())) if asked else df
    if category_id is not None:
        found = found.where(F.col("category_id") == category_id)
    return found.withColumn("tier", (tier if asked else F.lit(4)).cast("int")).orderBy("tier", *by_prominence()).limit(n)


def search_many(df: DataFrame, asked: DataFrame, n: int = 50) -> DataFrame:
    """``search_id, place_id, tier, nth`` for many searches (``search_id, text``) at once, each as :func:`search_view` gives it.

    Texts are found through an index of their rarest three letters over the eight columns, so no search reads all places.
    Blank texts find nothing here.
    """
    said = asked.select("search_id", F.lower(F.trim("text")).alias("_q")).where("_q <> ''")
    columns = F.array(*[F.lower(F.col(c)) for c in SEARCHED])
    texts = df.select("place_id", F.explode(F.array_distinct(F.filter(columns, lambda x: x.isNotNull()))).alias("_t"))
    hits = similarity.holding(said, texts, [], "_q", "_t").join(texts, "_t").select("_q", "place_id").distinct()
    shown = df.select("place_id", "popularity_score", "weighted_rating", "place_name", F.lower("place_name").alias("_name"), F.lower(F.coalesce("city_town", F.lit(""))).alias("_city"))
    tier = F.when(F.col("_name") == F.col("_q"), 1).when(F.startswith("_name", F.col("_q")), 2).when(F.contains("_city", F.col("_q")), 3).otherwise(4).cast("int")
    ranked = hits.join(shown, "place_id").withColumn("tier", tier)
    nth = F.row_number().over(Window.partitionBy("_q").orderBy("tier", *by_prominence()))
    best = ranked.withColumn("nth", nth).where(F.col("nth") <= n).select("_q", "place_id", "tier", "nth")
    return said.join(best, "_q").select("search_id", "place_id", "tier", "nth")


def by_prominence() -> list[Column]:
    """Popularity, then weighted rating, then name."""
    return [F.desc_nulls_last("popularity_score"), F.desc_nulls_last("weighted_rating"), F.asc("place_name"), F.asc("place_id")]


def prominent(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*by_prominence()).limit(n)


def top_rated(df: DataFrame, n: int) -> DataFrame:
    order = [F.desc("weighted_rating"), F.desc("rating"), F.desc("rating_count"), F.desc("popularity_score"), F.asc("place_id")]
    return df.where("rating_count > 0").orderBy(*order).limit(n)


def listing(df: DataFrame, name: str, key: str, order: list[Column], n: int) -> DataFrame:
    """``listing, id, nth``: the first ``n`` rows in an order; only those are numbered, in one task."""
    first = df.orderBy(*order).limit(n)
    return first.select(F.lit(name).alias("listing"), F.col(key).alias("id"), F.row_number().over(Window.orderBy(*order)).alias("nth"))


def equals_folded(column: str, value: str) -> Column:
    return F.lower(column) == value.lower()


def any_contains(columns: list[str], text: str) -> Column:
    """A case-insensitive substring of any of the columns."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns))


def search_places(df: DataFrame, text: str, category: str | None, n: int) -> DataFrame:
    """Substring search; exact names come first, then prefixes, then matching districts, then the rest."""
    low = F.lit(text.lower())
    name, district = F.lower("place_name"), F.lower("district")
    tier = F.when(name == low, 0).when(F.startswith(name, low), 1).when(F.contains(district, low), 2).otherwise(3)
    found = df.where(any_contains(["place_name", "district", "category_name", "description"], text))
    if category is not None:
        found = found.where(F.col("category_name") == category)
    return found.withColumn("tier", tier.cast("int")).orderBy("tier", *by_prominence()).limit(n)


def find_places(df: DataFrame, n: int = 8, district: str | None = None, category: str | None = None, name_like: str | None = None) -> DataFrame:
    """Optional case-sensitive conditions, most popular first."""
    if district is not None:
        df = df.where(F.col("district") == district)
    if category is not None:
        df = df.where(F.col("category_name") == category)
    if name_like is not None:
        df = df.where(F.col("place_name").like(f"%{name_like}%"))
    return df.orderBy(F.desc("popularity_score"), "place_name", "place_id").limit(n)


def wants_any(column: str, terms: list[str]) -> Column:
    """Some term is a substring of the column, case aside."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t))


def district_or_all(df: DataFrame, district: str) -> DataFrame:
    """Rows of the district; all rows where it has none."""
    hits = df.where(equals_folded("district", district))
    none = hits.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select("_n")
    # A one-row table decides; the branch that isn't wanted is empty.
    return hits.unionByName(df.join(F.broadcast(none), how="cross").drop("_n"))


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, as_name: str = "place_rank") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(as_name, rank.cast("int")).where(F.col(as_name) <= n)


def category_summary(df: DataFrame) -> DataFrame:
    """Per category: number of places, the most prominent one and the first with a photo."""
    rank = F.struct((-F.col("popularity_score")).alias("p"), (-F.col("weighted_rating")).alias("w"), "place_name", "place_id")
    photo = F.col("image_url").rlike("^https?://")
    return df.groupBy("category_name").agg(
        F.count(F.lit(1)).alias("n_places"), F.min_by("place_id", rank).alias("top_place"), F.min_by("place_id", F.when(photo, rank)).alias("photo_place")
    )


def prominence(places: DataFrame, place_sources: DataFrame, images: DataFrame) -> DataFrame:
    """Stored prominence: relevance, distinct sources, image, coordinates, external id (if there is such a column) and a
    long description."""
    sources = place_sources.groupBy("place_id").agg(F.countDistinct("source_id").alias("n_sources"))
    pictured = images.select("place_id").distinct().withColumn("pictured", F.lit(1))
    if "external_id" not in places.columns:
        places = places.withColumn("external_id", F.lit(None).cast("string"))
    joined = places.join(sources, "place_id", "left").join(pictured, "place_id", "left")
    zero = F.lit(0)
    score = (
        35 * clip(F.coalesce("tourism_relevance", F.lit(0.0)), 0, 1)
        + 25 * F.least(F.coalesce("n_sources", zero), F.lit(4)) / 4.0
        + 15 * F.coalesce("pictured", zero)
        + 10 * (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).cast("int")
        + 5 * (F.coalesce(F.trim("external_id"), F.lit("")) != "").cast("int")
        + 10 * (F.coalesce(F.length("description"), zero) >= 80).cast("int")
    )
    return joined.select("place_id", F.round(score, 1).alias("prominence"))


def festivals_for_places(places: DataFrame, festivals: DataFrame, k: int = 10) -> DataFrame:
    """``place_id, festival_id, relevance, nth``: the first ``k`` festivals of each place, in order.

    A festival matters to a place that it is held at (relevance 0), by its district (1) or because it has none (2). They
    are ordered by relevance, month (that of the start where it isn't told, missing ones last), start and name. Each of
    the three sides is cut to its first ``k`` before it meets places in an equi join, the statewide one as a single row.
    """
    month = F.coalesce(F.col("month"), F.month("start_date"), F.lit(13)).alias("m")
    order = F.struct(month, F.col("start_date").isNull().alias("x"), F.coalesce("start_date", F.lit("1970-01-01").cast("date")).alias("s"), "festival_name", "festival_id")
    rows = festivals.withColumn("o", order)

    def firsts(df: DataFrame, keys: list[str]) -> DataFrame:
        ranked = df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where(F.col("r") <= k)
        return ranked.groupBy(*keys).agg(F.collect_list("o").alias("list"))

    own = firsts(rows.where("associated_place_id IS NOT NULL"), ["associated_place_id"]).select(F.col("associated_place_id").alias("place_id"), F.col("list").alias("l0"))
    local = firsts(rows.where("district IS NOT NULL"), ["district"]).withColumnRenamed("list", "l1")
    top = rows.where("district IS NULL").orderBy("o").limit(k).agg(F.collect_list("o").alias("l2"))
    met = places.join(own, "place_id", "left").join(local, "district", "left").join(F.broadcast(top), how="cross")  # one row
    none = F.array().cast(met.schema["l2"].dataType)
    each = F.concat(*[_with_relevance(F.coalesce(F.col(f"l{n}"), none), n) for n in range(3)])
    once = met.select("place_id", F.explode(each).alias("f")).groupBy("place_id", "f.o.festival_id").agg(F.min("f").alias("f"))
    nth = F.row_number().over(Window.partitionBy("place_id").orderBy("f"))
    return once.withColumn("nth", nth).where(F.col("nth") <= k).select("place_id", "festival_id", F.col("f.relevance").alias("relevance"), "nth")


def _with_relevance(festivals: Column, n: int) -> Column:
    return F.transform(festivals, lambda o: F.struct(F.lit(n).alias("relevance"), o.alias("o")))


def next_occurrences(festivals: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest row of each name, rows without a date last."""
    order = [F.coalesce(F.col("start_date").cast("string"), F.lit("9999")), F.col("festival_id")]
    return top_per(festivals, keys, order, 1, "nth").drop("nth")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


#: Shorter descriptions are replaced by an article's, if that is longer; articles farther off are about something else.
ARTICLE_CHARS, ARTICLE_KM = 80, 2.0
#: Ratio of names from which an article without a near position is about the place.
ARTICLE_RATIO = 0.6


def enrich_from_articles(places: DataFrame, articles: DataFrame, images: DataFrame, cut: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What articles add to places: descriptions, images and sources.

    ``places`` has ``place_id, place_name, description, latitude, longitude`` and ``articles`` ``place_id, title, extract, latitude,
    longitude, image_url, article_url``, those that a place's ids lead to. An article is about the place if it lies within
    ``ARTICLE_KM``, or if the keys of title and name hold one another or are alike. The first table is ``place_id, description``
    of places with too short a description whose article has a long one, cut at a word; the second ``place_id, image_url``
    for places without any image; the third ``place_id, article_url`` of every accepted article.
    """
    said = articles.select("place_id", "title", "extract", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), "image_url", "article_url")
    met = places.join(said, "place_id").withColumns({"_t": name_key(F.col("title")), "_n": name_key(F.col("place_name"))})
    near = F.coalesce(haversine_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon")) <= ARTICLE_KM, F.lit(False))
    told = (F.col("_t") != "") & (F.col("_n") != "")
    held = told & (F.contains("_t", F.col("_n")) | F.contains("_n", F.col("_t")))
    sure = met.withColumn("_sure", near | held)
    alike = sure.where(~F.col("_sure")).where(told).where(similar(F.col("_t"), F.col("_n"), ARTICLE_RATIO))
    accepted = written(sure.where("_sure").unionByName(alike), "articles")
    long = F.length(F.coalesce("extract", F.lit(""))) >= ARTICLE_CHARS
    texts = accepted.where((F.length(F.coalesce("description", F.lit(""))) < ARTICLE_CHARS) & long).groupBy("place_id").agg(F.min_by("extract", "article_url").alias("extract"))
    shown = accepted.where(F.coalesce("image_url", F.lit("")) != "").join(images.select("place_id").distinct(), "place_id", "left_anti")
    return texts.select("place_id", truncate(F.col("extract"), cut).alias("description")), shown.groupBy("place_id").agg(F.min_by("image_url", "article_url").alias("image_url")), accepted.select("place_id", "article_url").distinct()
