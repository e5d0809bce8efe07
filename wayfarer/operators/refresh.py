"""The write side of a refresh: records go into the stored tables by a cascade of keys, and duplicates are absorbed.

Tables are snapshots. Each function takes the tables before and returns those after; what a place's rows say field by field
is settled by one aggregation per table, whatever the number of records of a place.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.functions.text import name_key
from wayfarer.operators import places as P
from wayfarer.operators import resolve as E
from wayfarer.operators import spelling as Y
from wayfarer.operators import upsert as U
from wayfarer.operators.components import connected_components
from wayfarer.operators.numbering import numbered_after
from wayfarer.session import written

# Fields that a record may lack, and fields that an absorbed place lends to its keeper.
OPTIONAL = ["city_town", "subcategory", "description", "latitude", "longitude", "address", "external_id", "map_id", "source_url"]
LENT = ["city_town", "subcategory", "address", "external_id", "map_id", "source_url"]


@dataclass
class Upserted:
    """``places`` after the upsert, with ``change`` (insert, update, keep); ``ids`` has ``new_id, place_id, how``."""

    places: DataFrame
    ids: DataFrame


def upsert_places(stored: DataFrame, new: DataFrame, related: DataFrame, default_state: str | None = None) -> Upserted:
    """Records update the place that they match, or become places.

    ``stored`` has ``place_id, place_name, district, category_name, tourism_relevance, location_precision`` and the columns of
    ``OPTIONAL``; ``new`` has ``new_id`` and the same but for ``place_id`` and ``location_precision``. Matching goes by external
    id, map id, district and name key, then name key in a related district. Records that match nothing and agree in one of
    the first three become one place. Of several records of a place the later one by ``new_id`` counts, null fields leave what is
    known, relevance never falls, and a new position drops the remark that the old one was only near. A place found in a
    related district stays there.
    """
    ids = written(E.match_stored(stored, new, related), "upsert-matched")
    known = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c)
    key = name_key(F.col("place_name"))
    left = written(new.join(ids, "new_id", "left_anti").select("new_id", "district", F.when(key != "", key).alias("name_key"), known("external_id"), known("map_id")), "upsert-left")
    links = [E.star_edges(left, keys, "new_id") for keys in (["external_id"], ["map_id"], ["district", "name_key"])]
    roots = connected_components(reduce(DataFrame.unionByName, links))
    groups = written(left.select("new_id").join(roots, F.col("new_id") == F.col("node"), "left").select("new_id", F.coalesce("root", "new_id").alias("first")), "upsert-groups")
    start = stored.agg(F.max("place_id")).first()[0] or 0
    added = numbered_after(groups.select("first").distinct(), ["first"], start, "place_id")
    ids = written(ids.unionByName(groups.join(added, "first").select("new_id", "place_id", F.lit("insert").alias("how"))), "upsert-ids")

    rows = new.join(ids, "new_id").withColumn("district", F.when(F.col("how") != "related", F.col("district")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("new_id"))).alias(c)
    fields = ["place_name", "district", "category_name", *OPTIONAL]
    told = rows.groupBy("place_id").agg(*[last(c) for c in fields], F.max(F.coalesce("tourism_relevance", F.lit(0.0))).alias("tourism_relevance"))
    joined = stored.withColumn("_s", F.lit(True)).alias("o").join(told.alias("n"), "place_id", "full_outer").withColumns({"_old": F.col("_s").isNotNull(), "_new": F.col("n.tourism_relevance").isNotNull()})
    relevance = F.when(F.col("_new"), F.greatest(F.coalesce("o.tourism_relevance", F.lit(0.0)), F.col("n.tourism_relevance"))).otherwise(F.col("o.tourism_relevance"))
    settled = {c: F.coalesce(f"n.{c}", f"o.{c}") for c in fields} | {"tourism_relevance": relevance, "location_precision": F.when(F.col("n.latitude").isNull(), F.col("o.location_precision"))}
    if "state" in stored.columns:
        settled["state"] = F.when(F.col("_old"), F.col("o.state")).otherwise(F.lit(default_state))
    change = F.when(~F.col("_old"), "insert").when(F.col("_new"), "update").otherwise("keep")
    columns = [settled[c].alias(c) if c in settled else F.col(c) if c == "place_id" else F.col(f"o.{c}").alias(c) for c in stored.columns]
    return Upserted(joined.select(*columns, change.alias("change")), ids)


def upsert_sources(stored: DataFrame, new: DataFrame, key: str = "source_name") -> DataFrame:
    """Sources by name (or categories, or holidays by their key): new values, but a licence or note isn't lost; ids go on."""
    fresh = new.groupBy(key).agg(*[F.max(c).alias(c) for c in new.columns if c != key])
    both = stored.alias("o").join(fresh.alias("n"), key, "full_outer")
    known = [c for c in stored.columns if c not in (key, "source_id")]
    values = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in known]
    rows = both.select(key, "o.source_id", *values)
    start = stored.agg(F.max("source_id")).first()[0] or 0
    there, added = rows.where("source_id IS NOT NULL"), numbered_after(rows.where("source_id IS NULL").drop("source_id"), [key], start, "source_id")
    return there.unionByName(added).select(*stored.columns)


def upsert_keyed(stored: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace stored ones of their key; in the columns of ``keep`` a null leaves what is stored. One row a key."""
    values = [c for c in stored.columns if c not in keys]
    fresh = new.groupBy(*keys).agg(F.max(F.struct(*values)).alias("n"))
    met = stored.select(*keys, F.struct(*values).alias("o")).join(fresh, keys, "full_outer")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return met.select(*keys, *[pick(c).alias(c) for c in values]).select(*stored.columns)


def upsert_place_sources(stored: DataFrame, new: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """``place_id, source_id, source_url, last_seen``: each source that a record lists is seen ``now``; nameless ones aren't kept.

    ``new`` has ``new_id`` and ``sources``, an array of ``struct<source_id, source_url>``.
    """
    seen = new.select("new_id", F.explode("sources").alias("s")).where("s.source_id IS NOT NULL").join(ids, "new_id")
    rows = seen.select("place_id", "s.source_id", F.coalesce("s.source_url", F.lit("")).alias("source_url"), now.alias("last_seen"))
    return stored.unionByName(rows).groupBy("place_id", "source_id", "source_url").agg(F.max("last_seen").alias("last_seen"))


def upsert_images(stored: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """``place_id, image_url, image_source, image_license, image_author, is_primary`` after the images of records are added.

    ``new`` has ``new_id`` and ``images``, an array of structs of the four texts. An image that is stored gets its new source,
    and licence and author if told. A place without a primary image takes the first image of its first record that brings
    a new one; stored choices stay.
    """
    facts = ["image_source", "image_license", "image_author"]
    told = new.select("new_id", F.posexplode("images").alias("nth", "i")).where("i.image_url IS NOT NULL").join(ids, "new_id")
    last = F.struct("new_id", "nth")
    fresh = told.groupBy("place_id", F.col("i.image_url").alias("image_url")).agg(
        F.max_by("i.image_source", last).alias("image_source"), *[F.max_by(f"i.{c}", F.when(F.col(f"i.{c}").isNotNull(), last)).alias(c) for c in facts[1:]], F.min(F.when(F.col("nth") == 0, F.col("new_id"))).alias("lead")
    )
    met = stored.withColumn("_old", F.lit(True)).alias("o").join(fresh.withColumn("_new", F.lit(True)).alias("n"), ["place_id", "image_url"], "full_outer")
    source = F.when(F.col("_new"), F.col("n.image_source")).otherwise(F.col("o.image_source")).alias("image_source")
    rows = met.select("place_id", "image_url", source, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in facts[1:]], F.coalesce("o.is_primary", F.lit(False)).alias("was"), F.when(F.col("_old").isNull(), F.col("n.lead")).alias("lead"))
    per = Window.partitionBy("place_id")
    chosen = F.row_number().over(per.orderBy(F.asc_nulls_last("lead"), "image_url")) == 1
    rows = rows.withColumns({"_has": F.bool_or("was").over(per), "_first": chosen & F.col("lead").isNotNull()})
    return rows.select("place_id", "image_url", *facts, F.when(F.col("_has"), F.col("was")).otherwise(F.col("_first")).alias("is_primary"))


def described_images(images: DataFrame, meta: DataFrame, hosted: Column) -> DataFrame:
    """Images with the author and licence that their host tells; hosted images that it doesn't know go, others stay as they are."""
    told = meta.select("image_url", F.col("image_author").alias("_author"), F.col("image_license").alias("_license"))
    met = images.withColumn("_hosted", F.coalesce(hosted, F.lit(False))).join(told.withColumn("_known", F.lit(True)), "image_url", "left")
    kept = met.where(~F.col("_hosted") | F.col("_known").isNotNull())
    return kept.withColumns({"image_author": F.coalesce("_author", "image_author"), "image_license": F.coalesce("_license", "image_license")}).select(*images.columns)


@dataclass
class Tables:
    """The stored tables. ``children`` have a ``place_id`` and move with it, ``features`` go with an absorbed place, and ``events``
    link to a place by ``associated_place_id``."""

    places: DataFrame
    sources: DataFrame
    images: DataFrame
    children: dict[str, DataFrame] = field(default_factory=dict)
    features: DataFrame | None = None
    events: DataFrame | None = None


def _moved(df: DataFrame, mapping: DataFrame, column: str = "place_id") -> DataFrame:
    """``df`` with ``_root`` (the keeper of an absorbed place, else the place) and ``_order`` (the keeper's rows first)."""
    to = mapping.select(F.col("place_id").alias("_from"), F.col("keeper").alias("_keeper"))
    met = df.join(to, F.col(column) == F.col("_from"), "left")
    return met.withColumns({"_root": F.coalesce("_keeper", column), "_order": F.struct(F.col("_keeper").isNotNull().alias("absorbed"), F.col(column).alias("id"))}).drop("_from", "_keeper")


def absorb(tables: Tables, mapping: DataFrame) -> Tables:
    """``tables`` after the places of ``mapping`` (``place_id, keeper``) went into their keepers.

    A keeper takes from them, in order of their ids, what it lacks of the fields of ``LENT``, the longest description (its own
    if none is longer), the greatest relevance, and their names and merged names at the end of its own merged names. Sources
    and images that agree are one; a moved image is primary only if no place before it has brought one. Other children and
    events change their place, features of absorbed places go.
    """
    rows = _moved(tables.places, mapping)
    there = lambda c: F.col(c).isNotNull()
    own = lambda c: F.min_by(c, "_order").alias(c)
    first = lambda c: F.min_by(c, F.when(there(c), F.col("_order"))).alias(c)
    names = F.concat_ws("|", F.when(F.col("_order.absorbed"), F.col("place_name")), F.when(F.col("merged_names") != "", F.col("merged_names")))
    listed = F.array_sort(F.collect_list(F.when(names != "", F.struct("_order", names.alias("n")))))
    longest = F.min_by("description", F.struct((-F.length(F.coalesce("description", F.lit("")))).alias("l"), "_order"))
    alone = F.count(F.lit(1)) == 1
    taken = {c: first(c) for c in LENT} | {
        "merged_names": F.nullif(F.array_join(F.transform(listed, lambda x: x["n"]), "|"), F.lit("")).alias("merged_names"),
        "description": longest.alias("description"),
        "tourism_relevance": F.when(alone, F.max("tourism_relevance")).otherwise(F.max(F.coalesce("tourism_relevance", F.lit(0.0)))).alias("tourism_relevance"),
    }
    columns = [c for c in tables.places.columns if c != "place_id"]
    places = rows.groupBy("_root").agg(*[taken.get(c, own(c)) for c in columns]).withColumnRenamed("_root", "place_id")

    def once(df: DataFrame, keys: list[str]) -> DataFrame:
        """The row of each key that the earliest place has."""
        moved = _moved(df, mapping)
        rest = [c for c in df.columns if c != "place_id" and c not in keys]
        return moved.groupBy(F.col("_root").alias("place_id"), *keys).agg(F.min("_order").alias("_order"), *[own(c) for c in rest])

    sources = once(tables.sources, ["source_id", "source_url"])
    images = once(tables.images, ["image_url"])
    lead = F.min(F.when(F.col("is_primary"), F.col("_order"))).over(Window.partitionBy("place_id"))
    images = images.withColumn("is_primary", F.col("is_primary") & (F.col("_order") == lead))
    pointed = lambda df, column: _moved(df, mapping, column).withColumn(column, F.col("_root")).select(*df.columns)
    return Tables(
        places.select(*tables.places.columns), sources.select(*tables.sources.columns), images.select(*tables.images.columns), {n: pointed(df, "place_id") for n, df in tables.children.items()},
        None if tables.features is None else tables.features.join(mapping.select("place_id"), "place_id", "left_anti"), None if tables.events is None else pointed(tables.events, "associated_place_id"),
    )


def remove(tables: Tables, ids: DataFrame) -> Tables:
    """``tables`` without the places of ``ids`` and all their children; events stay and lose their link."""
    gone = ids.select("place_id").where("place_id IS NOT NULL").distinct()
    without = lambda df: df.join(gone, "place_id", "left_anti")
    events = tables.events
    if events is not None:
        marked = events.join(gone.select(F.col("place_id").alias("_gone")), F.col("associated_place_id") == F.col("_gone"), "left")
        events = marked.withColumn("associated_place_id", F.when(F.col("_gone").isNull(), F.col("associated_place_id"))).select(*events.columns)
    return Tables(without(tables.places), without(tables.sources), without(tables.images), {n: without(df) for n, df in tables.children.items()}, None if tables.features is None else without(tables.features), events)


def _observed(df: DataFrame, name: str, report: dict[str, int], **counts: Column) -> DataFrame:
    """``df`` written once, with the counts taken as it is written."""
    seen = Observation(name)
    out = written(df.observe(seen, F.count(F.lit(1)).alias("_all"), *[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()]), name)
    report.update({n: seen.get[n] for n in counts})
    return out


def refresh(tables: Tables, records: DataFrame, related: DataFrame, meta: DataFrame, hosted: Column, junk: Column, now: Column, festivals: DataFrame | None = None) -> tuple[Tables, dict[str, int]]:
    """The stored tables after a run of the sources, and a report of what happened.

    ``records`` have ``rid`` and what merging and survivorship read; ``meta`` describes hosted images, ``hosted`` says of an
    address whether it is one, ``junk`` of a place whether its name says nothing. Records are merged, described, matched and
    upserted with their sources and images; junk goes; duplicates across districts and by spelling are absorbed; prominence is
    worked out anew; ``festivals`` replace those of their sources. Counts are observed while tables are written, without passes
    of their own.
    """
    report: dict[str, int] = {}
    yes = F.lit(True)
    rows = _observed(records, "refresh-records", report, records_seen=yes)
    merged = E.survivors(rows, E.merge_all(rows), ["place_name", "district", "external_id", "map_id", "source_url"]).withColumnRenamed("root", "new_id")
    merged = _observed(merged, "refresh-merged", report, records_merged=yes)
    lacking = {c: F.lit(None).cast("string") for c in OPTIONAL if c not in merged.columns}
    up = upsert_places(tables.places, merged.withColumns(lacking), related)
    places = _observed(up.places, "refresh-places", report, places_inserted=F.col("change") == "insert", places_updated=F.col("change") == "update")

    shown = merged.select("new_id", F.posexplode("images").alias("nth", "image_url")).withColumns({c: F.lit(None).cast("string") for c in ("image_source", "image_license", "image_author")})
    shown = described_images(shown, meta, hosted)
    shown = _observed(shown, "refresh-images", report, images_resolved=F.col("image_author").isNotNull() | F.col("image_license").isNotNull())
    image = F.struct("image_url", "image_source", "image_license", "image_author").alias("i")
    images = shown.groupBy("new_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", image))), lambda x: x["i"]).alias("images"))
    sources = merged.select("new_id", F.transform("sources", lambda s: F.struct(s.cast("long").alias("source_id"), F.lit("").alias("source_url"))).alias("sources"))
    now_tables = Tables(places.drop("change"), written(upsert_place_sources(tables.sources, sources, up.ids, now), "refresh-sources"), written(upsert_images(tables.images, images, up.ids), "refresh-pictures"), tables.children, tables.features, tables.events)

    lost = _observed(now_tables.places.where(junk).select("place_id"), "refresh-junk", report, junk_removed=yes)
    now_tables = remove(now_tables, lost)
    across = E.cross_district_duplicates(now_tables.places.withColumn("popularity_score", F.coalesce("popularity_score", F.lit(0.0))), related)
    across = _observed(_ended(across), "refresh-across", report, across_districts=yes)
    now_tables = absorb(now_tables, across)
    count = now_tables.sources.groupBy("place_id").agg(F.count(F.lit(1)).alias("source_count"))
    entries = now_tables.places.select("place_id", "place_name", "district", "latitude", "longitude", "location_precision", "merged_names", "popularity_score").join(count, "place_id", "left")
    _, spelt = Y.merge_rounds(written(entries.withColumn("source_count", F.coalesce("source_count", F.lit(0))), "refresh-entries"))
    spelt = _observed(_ended(spelt), "refresh-spelt", report, by_spelling=yes)
    now_tables = absorb(now_tables, spelt)
    kept = written(now_tables.places, "refresh-kept")
    known, pictures = written(now_tables.sources, "refresh-known"), written(now_tables.images, "refresh-shown")
    score = P.prominence(kept, known, pictures)
    placed = kept.drop("popularity_score").join(score.withColumnRenamed("prominence", "popularity_score"), "place_id").select(*kept.columns)
    final = _observed(placed, "refresh-final", report, places_total=yes, places_with_position=F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    report["districts"] = final.agg(F.countDistinct("district")).first()[0]
    events = now_tables.events
    if events is not None and festivals is not None:
        events = U.replace_slice(events, festivals, "source_id")
    return Tables(final, known, pictures, now_tables.children, now_tables.features, events), report


def _ended(mapping: DataFrame) -> DataFrame:
    """``mapping`` (``place_id, keeper``) in which no keeper is itself absorbed; a keeper that is passes its places on."""
    while True:
        to = mapping.select(F.col("place_id").alias("keeper"), F.col("keeper").alias("_next"))
        met = written(mapping.join(to, "keeper", "left").select("place_id", F.coalesce("_next", "keeper").alias("keeper"), F.col("_next").isNotNull().alias("_moved")), "keepers")
        mapping = met.select("place_id", "keeper")
        if met.where("_moved").isEmpty():
            return mapping
