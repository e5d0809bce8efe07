"""Queries of names, pages and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.operators import messages as M, pages as G, places as P
from wayfarer.plans.read_layer import HOLDS_SQL, PROMINENCE, TIER_SQL, base_view, view_sql
from wayfarer.plans.registry import query
from wayfarer.sources.tables import view, with_views

KEY_SQL = "trim(regexp_replace(regexp_replace(' ' || trim(regexp_replace(lower(place_name), '[^a-z0-9]+', ' ', 'g')) || ' ', ' (sri|shri|shree|the|thiru|arulmigu|a) ', ' ', 'g'), ' +', ' ', 'g'))"
PHON_SQL = KEY_SQL
for _a, _b in X.SPELLINGS:
    PHON_SQL = f"replace({PHON_SQL}, '{_a}', '{_b}')"


def page_text_sql(c: str) -> str:
    """The visible text of a page in SQL."""
    out = f"regexp_replace({c}, '<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'gis')"
    out = f"regexp_replace(regexp_replace({out}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
    for name, value in X.ENTITIES:
        out = f"replace({out}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '[\\s\u00a0]+', ' ', 'g'))"


def pieces_sql(starts: str, ends: str) -> str:
    """``page_id, pos, piece`` of pages: what follows a tag of ``starts`` up to the next one or one of ``ends``, in SQL."""
    cut = f"string_split(regexp_replace(html, '((?:<(?:{starts})\\b|{ends}))', chr(1) || '\\1', 'gi'), chr(1))"
    kept = f"list_filter({cut}, lambda x: regexp_matches(x, '^<(?:{starts})\\b[^>]*>', 'i'))"
    return f"SELECT page_id, unnest(l) AS piece, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, {kept} AS l FROM pages)"


@query("sf2_name_key", with_views(f"SELECT source_id, record_key, {KEY_SQL} AS name_key FROM source_records", "source_records"))
def sf2(spark, sf_dir):
    return view(spark, sf_dir, "source_records").select("source_id", "record_key", X.name_key(F.col("place_name")).alias("name_key"))


@query("sf3_phonetic_key", with_views(f"SELECT source_id, record_key, array_to_string(list_transform(list_filter(list_zip(string_split({PHON_SQL}, ''), range(1, 200)), lambda x: x[2] = 1 OR (x[1] IS NOT NULL AND x[1] <> string_split({PHON_SQL}, '')[CAST(x[2] - 1 AS BIGINT)])), lambda x: x[1]), '') AS phonetic_key FROM source_records", "source_records"))
def sf3(spark, sf_dir):
    return view(spark, sf_dir, "source_records").select("source_id", "record_key", X.phonetic_key(X.name_key(F.col("place_name"))).alias("phonetic_key"))


@query("sf10_clean_place_name", with_views("SELECT source_id, record_key, CASE WHEN upper(place_name) = place_name THEN array_to_string(list_transform(string_split(place_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE place_name END AS clean_name FROM source_records", "source_records"))
def sf10(spark, sf_dir):
    return view(spark, sf_dir, "source_records").select("source_id", "record_key", X.clean_place_name(F.col("place_name")).alias("clean_name"))


RULES = [("Metal", r"\b(bolt|gear|ring)\b"), ("Kitchen", r"\b(plate|bowl)\b"), ("Heavy", r"\banvil\b")]


@query("sf11_classify", with_views("SELECT place_id, CASE WHEN regexp_matches(lower(place_name), '\\b(bolt|gear|ring)\\b') THEN 'Metal' WHEN regexp_matches(lower(place_name), '\\b(plate|bowl)\\b') THEN 'Kitchen' WHEN regexp_matches(lower(place_name), '\\banvil\\b') THEN 'Heavy' ELSE 'Other' END AS category FROM places", "places"))
def sf11(spark, sf_dir):
    return view(spark, sf_dir, "places").select("place_id", X.classify(F.col("place_name"), RULES, "Other").alias("category"))


@query("sf13_truncate", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(regexp_replace(substr(text, 1, 200), '\\s\\S*$', ''), '[,;:]+$', '') || '…' END AS short_text FROM documents")
def sf13(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", X.truncate(F.col("text"), 200).alias("short_text"))


@query("sf14_split_location", with_views("SELECT place_id, place_name AS name, district AS location FROM places", "places"))
def sf14(spark, sf_dir):
    parts = X.split_name_location(F.concat_ws(", ", "place_name", "district"))
    return view(spark, sf_dir, "places").select("place_id", parts.alias("p")).select("place_id", "p.*")


@query("sf15_month_number", with_views("SELECT festival_id, CAST(month AS INTEGER) AS month_no FROM festivals", "festivals"))
def sf15(spark, sf_dir):
    named = F.concat(F.lit("in "), F.date_format(F.make_date(F.lit(2000), F.col("month").cast("int"), F.lit(1)), "MMMM"), F.lit(" or so"))
    return view(spark, sf_dir, "festivals").select("festival_id", X.month_number(named).alias("month_no"))


@query("sf16_normalize_text", "SELECT conv_id, turn, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS text FROM conversations")
def sf16(spark, sf_dir):
    return view(spark, sf_dir, "conversations").select("conv_id", "turn", X.squeeze(F.col("text")).alias("text"))


@query("sf20_clock", with_views("SELECT trip_id, stop_no, printf('%02d:%02d', (540 + stop_no * 35) // 60, (540 + stop_no * 35) % 60) AS clock, CAST(540 + stop_no * 35 AS INTEGER) AS minutes FROM trip_stops", "trip_stops"))
def sf20(spark, sf_dir):
    clock = X.clock_of(540 + F.col("stop_no") * 35)
    return view(spark, sf_dir, "trip_stops").select("trip_id", "stop_no", clock.alias("clock"), X.minutes_of(clock).alias("minutes"))


@query("f9_junk_names", "SELECT doc_id, length(t) < 3 OR length(t) > 120 OR NOT regexp_matches(t, '[a-z]') OR regexp_matches(t, 'privacy|disclaimer|copyright|skip to|feedback|website policies|last updated|visitor|help desk|©|toll free|opens in a new window|share on|subscribe to|newsletter') OR regexp_matches(t, '^(https?://|www\\.|stay at |stay in )') OR regexp_matches(t, '^[^a-z&]*((" + "|".join(X.HEADING_WORDS) + ")[^a-z&]+)*(" + "|".join(X.HEADING_WORDS) + ")?[^a-z&]*$') AS is_junk FROM (SELECT doc_id, trim(lower(split_part(text, chr(10), 1))) AS t FROM documents)")
def f9(spark, sf_dir):
    first_line = F.split_part("text", F.lit("\n"), F.lit(1))
    return view(spark, sf_dir, "documents").select("doc_id", X.junk_name(first_line).alias("is_junk"))


@query("f8_valid_rows", with_views("SELECT place_id, district FROM places WHERE district IN (SELECT n_name FROM nation WHERE n_regionkey < 3) AND NOT regexp_matches(lower(concat_ws(' ', place_name, category_name, description)), '\\bschool\\b|\\bcollege\\b')", "places"))
def f8(spark, sf_dir):
    known = view(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("district"))
    kept = view(spark, sf_dir, "places").join(known, "district", "left_semi")
    return kept.where(~F.lower(F.concat_ws(" ", "place_name", "category_name", "description")).rlike(X.EDUCATION)).select("place_id", "district")


@query("pg1_page_text", f"SELECT page_id, {page_text_sql('html')} AS text FROM pages")
def pg1(spark, sf_dir):
    return G.texts(view(spark, sf_dir, "pages"))


@query("pg2_page_title", "WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, nullif(trim(split_part(t, '|', 1)), '') AS name, nullif(trim(split_part(t, '|', 2)), '') AS district, nullif(trim(split_part(t, '|', 3)), '') AS suffix FROM t")
def pg2(spark, sf_dir):
    part = lambda c: F.nullif(F.col(f"title_{c}"), F.lit("")).alias(c)
    return G.titles(view(spark, sf_dir, "pages")).select("page_id", part("name"), part("district"), part("suffix"))


@query("pg3_page_links", """WITH hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href=["'']([^"''#]+)["'']', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href=["'']([^"''#]+)["'']', 1), 1) - 1 AS pos FROM pages),
abs AS (SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href ELSE coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/(?:[^?#]*/)?'), ''), regexp_extract(url, '^[a-z]+://[^/?#]+') || '/') || href END AS link FROM hrefs)
SELECT page_id, link, CAST(min(pos) AS BIGINT) AS first_pos FROM abs WHERE lower(regexp_extract(link, '([^/]*)/?$', 1)) NOT IN ('home', 'the') GROUP BY page_id, link""")
def pg3(spark, sf_dir):
    return G.links(view(spark, sf_dir, "pages"), ["home", "the"])


@query("pg4_heading_sections", f"""SELECT page_id, pos, heading, paragraph FROM (
SELECT page_id, pos, is_heading, text AS heading, CASE WHEN NOT lead(is_heading) OVER w THEN lead(text) OVER w END AS paragraph FROM (
SELECT page_id, pos, regexp_matches(piece, '^<h[1-6]', 'i') AS is_heading, {page_text_sql('piece')} AS text FROM ({pieces_sql('h[1-6]|p', '</article')})) WINDOW w AS (PARTITION BY page_id ORDER BY pos)) WHERE is_heading""")
def pg4(spark, sf_dir):
    return G.heading_sections(view(spark, sf_dir, "pages"))


@query("pg5_table_rows", with_views("SELECT p_partkey AS page_id, CAST(0 AS INTEGER) AS table_no, CAST(1 AS INTEGER) AS row_no, place_name AS name, district AS place FROM part JOIN places ON place_id = p_partkey UNION ALL SELECT place_id, 0, 2, upper(place_name), NULL FROM places WHERE place_id % 3 = 0", "places"))
def pg5(spark, sf_dir):
    """Pages with a table of one or two rows, the second without its last cell."""
    cell = lambda tag, c: F.concat(F.lit(f"<{tag} class='x'>"), c, F.lit(f"</{tag}>"))
    row = lambda *cells: F.concat(F.lit("<tr>"), *cells, F.lit("</tr>\n"))
    head = row(cell("th", F.lit("Name of <b>place</b>")), cell("th", F.lit("District")))
    first = row(cell("td", F.concat(F.lit("<a href='/x'>"), F.col("place_name"), F.lit("</a>"))), cell("td", F.col("district")))
    second = F.when(F.col("place_id") % 3 == 0, row(cell("td", F.upper("place_name")))).otherwise("")
    html = F.concat(F.lit("<html><body><p>before</p><table border='1'>"), head, first, second, F.lit("</table></body></html>"))
    return G.table_rows(view(spark, sf_dir, "places").select(F.col("place_id").alias("page_id"), html.alias("html")), {"name": "name", "place": "district"})


@query("pg6_banner_reset", """WITH links AS (SELECT DISTINCT page_id % 20 AS listing, unnest(regexp_extract_all(html, '<a\\s[^>]*href=["'']([^"''#]+)["'']', 1)) AS url FROM pages),
sizes AS (SELECT listing, count(DISTINCT url) AS size FROM links GROUP BY listing)
SELECT url, CASE WHEN 2 * count(DISTINCT listing) <= (SELECT count(*) FROM sizes) THEN arg_min('c' || (listing % 4), struct_pack(size, listing)) END AS category FROM links JOIN sizes USING (listing) GROUP BY url""")
def pg6(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"'#]+)[\"']"), F.lit(1))
    listing = F.col("page_id") % 20
    links = view(spark, sf_dir, "pages").select(listing.alias("listing"), F.concat(F.lit("c"), (listing % 4).cast("string")).alias("category"), F.explode(found).alias("url")).distinct()
    return G.reset_banners(links)


@query("pg7_page_status", f"SELECT page_id, CASE WHEN regexp_matches(lower({page_text_sql('html')}), 'closed|closure|dry|unsafe') THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS suitability FROM pages")
def pg7(spark, sf_dir):
    return G.page_status(view(spark, sf_dir, "pages"))


@query("pg8_page_summary", f"""WITH p AS (SELECT page_id, pos, {page_text_sql("regexp_replace(piece, '^<p[^>]*>', '', 'i')")} AS text FROM ({pieces_sql('p', '</p>|</article')})),
long AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM p WHERE length(text) > 40 AND NOT regexp_matches(lower(text), 'how to reach|nearest airport'))
SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS summary FROM long WHERE so_far <= 500 GROUP BY page_id""")
def pg8(spark, sf_dir):
    return G.summaries(view(spark, sf_dir, "pages"), "how to reach|nearest airport")


PAIR = r"(\p{Lu}\p{L}+) (\p{Ll}{4,})\."


@query("pg9_pattern_matches", f"""SELECT page_id, unnest(a) AS name, unnest(b) AS place, generate_subscripts(a, 1) - 1 AS pos FROM (
SELECT page_id, regexp_extract_all(t, '{PAIR}', 1) AS a, regexp_extract_all(t, '{PAIR}', 2) AS b FROM (SELECT page_id, {page_text_sql('html')} AS t FROM pages))""")
def pg9(spark, sf_dir):
    return G.pattern_matches(view(spark, sf_dir, "pages"), PAIR)


@query("pg10_section_cards", f"""WITH b AS (SELECT page_id, unnest(l) AS block, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '<(?:h[1-6]|li)\\b[^>]*>.*?</(?:h[1-6]|li)>', 0, 'is') AS l FROM pages)),
t AS (SELECT page_id, pos, regexp_matches(block, '^<li', 'i') AS is_card, {page_text_sql('block')} AS text FROM b)
SELECT page_id, pos, section, text AS card FROM (SELECT *, last_value(CASE WHEN NOT is_card THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS section FROM t) WHERE is_card""")
def pg10(spark, sf_dir):
    return G.section_cards(view(spark, sf_dir, "pages")).drop("href")


@query("pg5_split_districts", with_views("""SELECT place_id AS page_id, CAST(nth AS INTEGER) AS row_no, place_name AS name, d AS place FROM (SELECT place_id, place_name, 1 AS nth, unnest(CASE WHEN r.related IS NULL THEN [p.district] WHEN place_id % 3 = 0 THEN list_distinct([p.district, r.related, 'NATION_0']) ELSE [p.district, r.related] END) AS d
FROM places p LEFT JOIN (SELECT district, min(related) AS related FROM related_districts GROUP BY district) r USING (district)) UNION ALL SELECT place_id, 2, upper(place_name), NULL FROM places WHERE place_id % 3 = 0""", "places", "related_districts"))
def pg5_split(spark, sf_dir):
    """Tables whose last column lists districts in words; the second row of some has none."""
    other = view(spark, sf_dir, "related_districts").groupBy("district").agg(F.min("related").alias("other"))
    df = view(spark, sf_dir, "places").join(other, "district", "left")
    row = lambda *cells: F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))
    named = F.when(F.col("place_id") % 3 == 0, F.concat(F.concat_ws(" and ", "district", "other"), F.lit(", NATION_0"))).otherwise(F.concat_ws(" &amp; ", "district", "other"))
    second = F.when(F.col("place_id") % 3 == 0, row(F.upper("place_name"), F.lit(" "))).otherwise("")
    html = F.concat(F.lit("<table><tr><th>Wetland name</th><th>District(s)</th></tr>"), row("place_name", named), second, F.lit("</table>"))
    rows = G.table_rows(df.select(F.col("place_id").alias("page_id"), html.alias("html")), {"name": "name", "place": "district"})
    return G.split_lists(rows, "place").select("page_id", "row_no", "name", "place")


@query("pg10_card_places", with_views("""SELECT place_id AS page_id, place_name AS name, CASE WHEN place_id % 4 = 0 THEN district WHEN place_id % 5 < 2 THEN 'NATION_' || CAST(place_id % 5 AS VARCHAR) WHEN place_id % 3 <> 0 THEN district END AS district,
CASE WHEN place_id % 4 = 1 THEN 'Lower Town' END AS town, CASE WHEN place_id % 4 = 0 THEN 'brackets' WHEN place_id % 5 < 2 THEN 'host' WHEN place_id % 3 <> 0 THEN 'section' END AS how FROM places""", "places"))
def pg10_places(spark, sf_dir):
    """Cards with a district, a town, a sight or nothing in brackets, under a heading that names a district or none."""
    df, k = view(spark, sf_dir, "places"), F.col("place_id")
    behind = F.when(k % 4 == 0, F.concat(F.lit(" ("), F.upper("district"), F.lit(" Dt.)"))).when(k % 4 == 1, " (Lower Town)").when(k % 4 == 2, " (Perennial falls)").otherwise("")
    host = F.when(k % 5 < 2, F.concat(F.lit("https://D"), k % 5, F.lit(".example/x"))).otherwise("/card")
    heading = F.when(k % 3 != 0, F.concat("district", F.lit(" district"))).otherwise("Far away")
    html = F.concat(F.lit("<h2>"), heading, F.lit("</h2><ul><li class='c'><a href='"), host, F.lit("'>"), "place_name", behind, F.lit("</a></li></ul>"))
    aliases = view(spark, sf_dir, "nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("district"))
    hosts = view(spark, sf_dir, "nation").where("n_nationkey < 2").select(F.concat(F.lit("d"), "n_nationkey", F.lit(".example")).alias("host"), F.col("n_name").alias("district"))
    return G.located_cards(G.section_cards(df.select(k.alias("page_id"), html.alias("html"))), aliases, hosts).drop("pos")


INTENTS = [("ask", ["que", "der "]), ("tell", ["the ", "of "]), ("plan", ["en"])]


@query("m1_detect_intent", with_views("SELECT conv_id, turn, CASE WHEN contains(lower(message), 'que') OR contains(lower(message), 'der ') THEN 'ask' WHEN contains(lower(message), 'the ') OR contains(lower(message), 'of ') THEN 'tell' WHEN contains(lower(message), 'en') THEN 'plan' ELSE 'search' END AS intent FROM messages", "messages"))
def m1(spark, sf_dir):
    return view(spark, sf_dir, "messages").select("conv_id", "turn", M.detect_intent(F.col("message"), INTENTS, "search").alias("intent"))


@query("m2_search_term", with_views("SELECT conv_id, turn, trim(regexp_replace(message, '^(the|der|la|en)', '', 'i')) AS term FROM messages", "messages"))
def m2(spark, sf_dir):
    return view(spark, sf_dir, "messages").select("conv_id", "turn", M.search_term(F.col("message"), ["the", "der", "la", "en"]).alias("term"))


NAMES = ["the", "la", "der", "que", "of", "de la"]


@query("m3_find_name", with_views("SELECT conv_id, turn, arg_max(name, struct_pack(n := length(name), name)) AS name, arg_max('D ' || name, struct_pack(n := length(name), name)) AS district FROM messages LEFT JOIN (VALUES " + ", ".join(f"('{n}')" for n in NAMES if n != "que") + ") w(name) ON contains(' ' || regexp_replace(lower(message), '[^\\p{L}\\p{N}_]+', ' ', 'g') || ' ', ' ' || name || ' ') GROUP BY conv_id, turn", "messages"))
def m3(spark, sf_dir):
    names = spark.createDataFrame([(n, None if n == "que" else f"D {n}") for n in NAMES], "name string, district string")
    return M.find_names(view(spark, sf_dir, "messages"), names, ["conv_id", "turn"])


@query("m4_find_category", with_views("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(message), '(^|\\W)que') THEN 'Q' WHEN regexp_matches(lower(message), 'tion') THEN 'T' END AS category, regexp_matches(lower(CASE conv_id % 3 WHEN 0 THEN message || ' near me' WHEN 1 THEN message || ' nearby' ELSE message END), '" + M.NEAR_ME + "') AS near_me FROM messages", "messages"))
def m4(spark, sf_dir):
    ending = F.when(F.col("conv_id") % 3 == 0, " near me").when(F.col("conv_id") % 3 == 1, " nearby").otherwise("")
    return view(spark, sf_dir, "messages").select("conv_id", "turn", X.classify(F.lower("message"), [("Q", r"(^|\W)que"), ("T", "tion")], None).alias("category"), M.wants_near_me(F.concat("message", ending)).alias("near_me"))


@query("m5_keywords", with_views("SELECT conv_id, turn, list_sort(list(word)) AS words FROM (SELECT DISTINCT conv_id, turn, regexp_replace(w, '^[^a-zA-Z0-9_]+|[^a-zA-Z0-9_]+$', '', 'g') AS word FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(message), '\\s+')) AS w FROM messages)) WHERE length(word) >= 3 AND word NOT IN ('the', 'and') GROUP BY conv_id, turn", "messages"))
def m5(spark, sf_dir):
    words = F.array_sort(X.keywords(F.col("message"), ["the", "and"]))
    return view(spark, sf_dir, "messages").select("conv_id", "turn", words.alias("words")).where(F.size("words") > 0)


_STOPS_SQL = ", ".join(f"'{w}'" for w in M.STOP_WORDS)
_MARKS_SQL = ".,!?;:()[]{}"
MESSAGE_SQL = f""",
texts AS (SELECT place_id, lower(t) AS t FROM (SELECT place_id, unnest([{", ".join(P.SEARCHED)}]) AS t FROM full_view) WHERE t IS NOT NULL),
said AS (SELECT DISTINCT trim(message) AS said FROM messages WHERE trim(message) <> ''),
heard AS (SELECT said, pos, trim(w, '{_MARKS_SQL}') AS word FROM (SELECT said, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT said, regexp_split_to_array(trim(lower(said)), '\\s+') AS ws FROM said))),
words AS (SELECT * FROM heard WHERE length(word) >= 3 AND word NOT IN ({_STOPS_SQL})),
asked AS (SELECT lower(said) AS q FROM said UNION SELECT word FROM words),
hits AS (SELECT DISTINCT q, place_id FROM (SELECT q, d.t FROM asked, (SELECT DISTINCT t FROM texts) d WHERE contains(d.t, q)) JOIN texts USING (t)),
met AS (SELECT q, place_id, row_number() OVER (PARTITION BY q ORDER BY {TIER_SQL}, {PROMINENCE}) AS nth FROM hits JOIN full_view USING (place_id)),
whole AS (SELECT said, place_id, nth, 'message' AS how FROM said JOIN met ON q = lower(said) WHERE nth <= 5),
parts AS (SELECT said, place_id, min(struct_pack(pos, nth)) AS at_ FROM words JOIN met ON q = word WHERE nth <= 5 AND said NOT IN (SELECT said FROM whole) GROUP BY said, place_id),
best AS (SELECT * FROM whole UNION ALL SELECT * FROM (SELECT said, place_id, row_number() OVER (PARTITION BY said ORDER BY at_, place_id) AS nth, 'words' AS how FROM parts) WHERE nth <= 5)
SELECT conv_id, turn, place_id, CAST(nth AS INTEGER) AS nth, how FROM messages JOIN best ON said = trim(message)"""


@query("m6_message_search", view_sql(MESSAGE_SQL, "messages"))
def m6(spark, sf_dir):
    """The messages of all conversations: places that hold the whole message, else those of its words."""
    return M.message_search(view(spark, sf_dir, "messages"), base_view(spark, sf_dir), ["conv_id", "turn"], M.STOP_WORDS, 5)


MENTIONS_SQL = "SELECT p_partkey AS mention_id, CASE p_partkey % 5 WHEN 0 THEN concat(' ', CAST(p_partkey AS VARCHAR), ' ') WHEN 1 THEN concat('9', CAST(p_partkey AS VARCHAR), '999') WHEN 2 THEN upper(concat(p_name, ' ', p_brand)) WHEN 3 THEN concat(CAST(p_partkey AS VARCHAR), ' main') ELSE ' ' END AS text FROM part"


@query("m10_place_information", view_sql(f""", mentions AS (SELECT mention_id, trim(text) AS text FROM ({MENTIONS_SQL}) WHERE trim(text) <> ''),
by_id AS (SELECT mention_id, place_id, 'id' AS how FROM mentions JOIN full_view ON place_id = TRY_CAST(text AS BIGINT) WHERE regexp_full_match(text, '[0-9]+')),
asked AS (SELECT DISTINCT lower(text) AS q FROM mentions WHERE mention_id NOT IN (SELECT mention_id FROM by_id)),
met AS (SELECT q, place_id, row_number() OVER (PARTITION BY q ORDER BY {TIER_SQL}, {PROMINENCE}) AS nth FROM asked, full_view WHERE {HOLDS_SQL})
SELECT * FROM by_id UNION ALL SELECT mention_id, place_id, 'search' FROM mentions JOIN met ON q = lower(text) WHERE nth = 1 AND mention_id NOT IN (SELECT mention_id FROM by_id)"""))
def m10_information(spark, sf_dir):
    """Mentions of places by id, by digits that are no id, by name and by address; some are blank."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(k % 5 == 1, F.concat(F.lit("9"), k, F.lit("999"))).when(k % 5 == 2, F.upper(F.concat_ws(" ", "p_name", "p_brand"))).when(k % 5 == 3, F.concat(k, F.lit(" main"))).otherwise(" ")
    return M.place_information(view(spark, sf_dir, "part").select(k.alias("mention_id"), text.alias("text")), base_view(spark, sf_dir))


UPCOMING = "1995-03-01"


@query("m8_festival_digest", with_views(f"""SELECT district, festival_name, CAST(nth AS INTEGER) AS nth FROM (SELECT district, festival_name, row_number() OVER (PARTITION BY district ORDER BY d, festival_id) AS nth FROM (
SELECT coalesce(district, 'statewide') AS district, festival_name, coalesce(CAST(start_date AS VARCHAR), '9999') AS d, festival_id, row_number() OVER (PARTITION BY district, lower(festival_name) ORDER BY coalesce(CAST(start_date AS VARCHAR), '9999'), festival_id) AS k
FROM festivals WHERE district IS NOT NULL OR start_date >= DATE '{UPCOMING}') WHERE k = 1) WHERE nth <= CASE WHEN district = 'statewide' THEN 6 ELSE 8 END""", "festivals"))
def m8(spark, sf_dir):
    """Eight festivals of each district, once each, and the next six of the state."""
    coming = view(spark, sf_dir, "festivals").where(F.col("district").isNotNull() | (F.col("start_date") >= F.lit(UPCOMING).cast("date")))
    named = coming.withColumn("district", F.coalesce("district", F.lit("statewide"))).withColumn("name", F.lower("festival_name"))
    once = P.next_occurrences(named, ["district", "name"])
    order = [F.coalesce(F.col("start_date").cast("string"), F.lit("9999")), F.col("festival_id")]
    top = P.top_per(once, ["district"], order, 8, "nth").where("nth <= 6 OR district <> 'statewide'")
    return top.select("district", "festival_name", "nth")


@query("m10_place_with_festivals", with_views("""SELECT place_id, list(festival_id ORDER BY nth) AS festivals FROM (SELECT p.place_id, f.festival_id, row_number() OVER (PARTITION BY p.place_id ORDER BY f.district IS NULL, f.m, f.start_date NULLS LAST, f.festival_name, f.festival_id) AS nth
FROM places p JOIN (SELECT *, coalesce(month, month(start_date), 13) AS m FROM festivals) f ON f.district = p.district OR f.district IS NULL) WHERE nth <= 5 GROUP BY place_id""", "places", "festivals"))
def m10(spark, sf_dir):
    """Each place with its first five festivals, in order."""
    festivals = view(spark, sf_dir, "festivals").withColumn("associated_place_id", F.lit(None).cast("long"))
    rows = P.festivals_for_places(view(spark, sf_dir, "places").select("place_id", "district"), festivals, 5)
    listed = F.array_sort(F.collect_list(F.struct("nth", "festival_id")))  # five at most
    return rows.groupBy("place_id").agg(F.transform(listed, lambda f: f["festival_id"]).alias("festivals"))
