"""Jobs over a table of raw pages (``page_id, url, html``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfarer.functions.text import page_text, squeeze
from wayfarer.operators.resolve import resolve_district


def texts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", page_text(F.col("html")).alias("text"))


def titles(pages: DataFrame) -> DataFrame:
    """Title parts (name, district, suffix, split at ``|``) and the described content."""
    title = squeeze(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    parts = F.split(title, r"\s*\|\s*")
    meta = F.nullif(F.regexp_extract("html", r"(?is)<meta\s+name=[\"']description[\"']\s+content=[\"'](.*?)[\"']", 1), F.lit(""))
    return pages.select("page_id", F.try_element_at(parts, F.lit(1)).alias("title_name"), F.try_element_at(parts, F.lit(2)).alias("title_district"), F.try_element_at(parts, F.lit(3)).alias("title_suffix"), meta.alias("description"))


def _without_dots(path: Column) -> Column:
    """A path with ``.`` and ``..`` taken out."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.concat(held, F.array(x))))
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(kept, "/"), F.when(open_end, "/").otherwise(""))


def absolute_link(url: Column, href: Column) -> Column:
    """The address that ``href`` means on the page ``url``: other hosts, roots, folders above, queries alone."""
    scheme, root = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", 0), F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    here = F.regexp_extract(F.substring(url, F.length(root) + 1, F.length(url)), r"^[^?#]*", 0)
    folder = F.when(here == "", "/").otherwise(F.regexp_extract(here, "^.*/", 0))
    target, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"[?#].*$", 0)
    path = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, target))
    plain = F.concat(root, _without_dots(path), rest)
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(target == "", F.concat(root, here, rest)).otherwise(plain)


def links(pages: DataFrame, stop: list[str]) -> DataFrame:
    """Absolute links of each page in order of first use, without stop slugs."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"'#]+)[\"']"), F.lit(1))
    at = pages.select("page_id", "url", F.posexplode(found).alias("pos", "href"))
    at = at.withColumn("link", absolute_link(F.col("url"), F.col("href")))
    slug = F.lower(F.regexp_extract("link", r"([^/]*)/?$", 1))
    return at.where(~slug.isin(stop)).groupBy("page_id", "link").agg(F.min("pos").cast("long").alias("first_pos"))


def heading_sections(pages: DataFrame) -> DataFrame:
    """Headings with the paragraph that follows them at once."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<(?:h[1-6]|p)\b[^>]*>.*?(?=<(?:h[1-6]|p)\b|</article|$)"), F.lit(0))
    at = pages.select("page_id", F.posexplode(blocks).alias("pos", "block"))
    at = at.withColumn("is_heading", F.lower("block").rlike("^<h[1-6]")).withColumn("text", page_text(F.col("block")))
    w = Window.partitionBy("page_id").orderBy("pos")
    following = at.withColumn("paragraph", F.when(~F.lead("is_heading").over(w), F.lead("text").over(w)))
    return following.where("is_heading").select("page_id", F.col("pos").cast("long").alias("pos"), F.col("text").alias("heading"), "paragraph")


def table_rows(pages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of tables as named columns; ``columns`` maps a name to a fragment of its header cell."""
    tables = F.regexp_extract_all("html", F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))
    t = pages.select("page_id", F.posexplode(tables).alias("table_no", "t"))
    r = t.select("page_id", "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))).alias("row_no", "r"))
    c = r.select("page_id", "table_no", "row_no", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[hd]\b[^>]*>.*?</t[hd]>"), F.lit(0))).alias("cell_no", "c"))
    c = c.withColumn("text", page_text(F.col("c")))
    header = c.where("row_no = 0").select("page_id", "table_no", "cell_no", F.lower("text").alias("header"))
    body = c.where("row_no > 0").join(header, ["page_id", "table_no", "cell_no"])
    cells = [F.max(F.when(F.contains(F.col("header"), F.lit(part)), F.col("text"))).alias(name) for name, part in columns.items()]
    return body.groupBy("page_id", "table_no", "row_no").agg(*cells)


def summaries(pages: DataFrame, boilerplate: str, limit: int = 500) -> DataFrame:
    """Long paragraphs, until they have ``limit`` characters together."""
    paragraphs = F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>(.*?)(?=<p\b|</p>|</article|$)"), F.lit(1))
    at = pages.select("page_id", F.posexplode(paragraphs).alias("pos", "p")).withColumn("text", page_text(F.col("p")))
    at = at.where((F.length("text") > 40) & ~F.lower("text").rlike(boilerplate))
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("so_far", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("so_far") <= limit)
    joined = at.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("summary"))
    return joined


def pattern_matches(pages: DataFrame, pattern: str) -> DataFrame:
    """All (name, place) pairs of a two-group pattern in the page text."""
    text = texts(pages)
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("place"))
    return text.select("page_id", F.posexplode(pairs).alias("pos", "m")).select("page_id", F.col("pos").cast("long").alias("pos"), "m.name", "m.place")


def reset_banners(listing: DataFrame) -> DataFrame:
    """Category of each address by the listings that hold it (``listing, category, url``).

    An address on more than half of all listings is a banner and loses its categories; otherwise the smallest
    listing decides.
    """
    sizes = listing.groupBy("listing").agg(F.countDistinct("url").alias("size"))
    total = sizes.agg(F.count(F.lit(1)).alias("n_listings"))
    votes = listing.join(sizes, "listing").groupBy("url").agg(F.countDistinct("listing").alias("n"), F.min_by("category", F.struct("size", "listing")).alias("category"))
    return votes.join(total, how="cross").select("url", F.when(2 * F.col("n") <= F.col("n_listings"), F.col("category")).alias("category"))


def page_status(pages: DataFrame) -> DataFrame:
    """Status of what a page describes: 0.2 where its text speaks against a visit, else 1."""
    against = F.lower(page_text(F.col("html"))).rlike("closed|closure|dry|unsafe")
    return pages.select("page_id", F.when(against, 0.2).otherwise(1.0).alias("suitability"))


def section_cards(pages: DataFrame) -> DataFrame:
    """List items with the heading they stand under and the link they hold."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<(?:h[1-6]|li)\b[^>]*>.*?</(?:h[1-6]|li)>"), F.lit(0))
    at = pages.select("page_id", F.posexplode(blocks).alias("pos", "block")).withColumn("text", page_text(F.col("block")))
    heading = F.when(F.lower("block").rlike("^<h"), F.col("text"))
    at = at.withColumn("section", F.last(heading, ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pos")))
    href = F.nullif(F.regexp_extract("block", r"(?i)<a\s[^>]*href=[\"']([^\"']+)[\"']", 1), F.lit(""))
    return at.where(F.lower("block").rlike("^<li")).select("page_id", F.col("pos").cast("long").alias("pos"), "section", F.col("text").alias("card"), href.alias("href"))


def split_lists(rows: DataFrame, column: str) -> DataFrame:
    """A row for each entry of a list in words ("A, B and C & D"); a row without any entry stays, with null."""
    parts = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"\s+and\s+|,|&"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn(column, F.explode_outer(F.array_distinct(parts)))


# What stands in brackets behind a name without being a town.
NO_TOWN = r"(?i)falls|perennial|sanctuary"


def located_cards(cards: DataFrame, aliases: DataFrame, hosts: DataFrame) -> DataFrame:
    """``page_id, pos, name, district, town, how``: where the place of a card lies.

    The district is what the card's last brackets name ("brackets"), else that of the linked host ("host", from ``hosts`` with
    ``host, district``), else what the section's heading names ("section"). Brackets of at most two words that name no
    district are the town, unless they describe a sight. ``aliases`` has ``alias, district``.
    """
    inner = F.trim(F.regexp_extract("card", r"\(([^)]+)\)\s*$", 1))
    rows = cards.withColumn("inner", F.nullif(inner, F.lit(""))).withColumn("name", F.trim(F.regexp_replace("card", r"\s*\([^)]+\)\s*$", "")))
    rows = rows.withColumn("host", F.lower(F.try_parse_url("href", F.lit("HOST"))))
    rows = resolve_district(rows, "inner", aliases).withColumnRenamed("resolved", "by_brackets")
    rows = resolve_district(rows, "section", aliases).withColumnRenamed("resolved", "by_section")
    rows = rows.join(hosts.select(F.lower("host").alias("host"), F.col("district").alias("by_host")).dropDuplicates(["host"]), "host", "left")
    town = F.when(F.col("by_brackets").isNull() & (F.size(F.split("inner", r"\s+")) <= 2) & ~F.col("inner").rlike(NO_TOWN), F.col("inner"))
    how = F.when(F.col("by_brackets").isNotNull(), "brackets").when(F.col("by_host").isNotNull(), "host").when(F.col("by_section").isNotNull(), "section")
    return rows.select("page_id", "pos", "name", F.coalesce("by_brackets", "by_host", "by_section").alias("district"), town.alias("town"), how.alias("how"))
