"""Queries over the catalogue, its search, and the tables built from logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from slatewise.functions import scalars as S
from slatewise.operators import catalogue as C
from slatewise.plans.registry import query
from slatewise.session import scratch_dir, table
from slatewise.sources import binding as B


def _parts(spark, d):
    items = B.items(spark, d)
    genres = C.explode_genres(items)
    tags = items.select("item_id", F.explode(F.split("title", " ")).alias("tag"))
    return items, genres, B.item_actors(spark, d), tags


def _wide(spark, d):
    stats = B.interactions(spark, d).groupBy("item_id").agg(F.avg("rating").alias("vote_average"), F.count("*").alias("vote_count"))
    return C.wide_catalogue(*_parts(spark, d)).join(stats, "item_id", "left").select("item_id", "title", "director", "popularity", "release_date", "genres", "actors", "tags", F.coalesce("vote_average", F.lit(0.0)).alias("vote_average"), F.coalesce("vote_count", F.lit(0)).alias("vote_count"))


WIDE = """WITH a AS (SELECT item_id, string_agg(DISTINCT actor, '|' ORDER BY actor) AS actors FROM item_actors GROUP BY 1),
 g AS (SELECT item_id, string_agg(DISTINCT genre, '|' ORDER BY genre) AS genres FROM genre_rows GROUP BY 1),
 t AS (SELECT item_id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM (SELECT item_id, unnest(string_split(title, ' ')) AS tag FROM items ) GROUP BY 1),
 v AS (SELECT item_id, avg(rating) AS vote_average, count(*) AS vote_count FROM interactions GROUP BY 1),
 wide AS (SELECT i.item_id, i.title, i.director, i.popularity, i.release_date, coalesce(g.genres, '') AS genres, coalesce(a.actors, '') AS actors, coalesce(t.tags, '') AS tags, coalesce(v.vote_average, 0.0) AS vote_average, coalesce(v.vote_count, 0) AS vote_count
   FROM items i LEFT JOIN g ON g.item_id = i.item_id LEFT JOIN a ON a.item_id = i.item_id LEFT JOIN t ON t.item_id = i.item_id LEFT JOIN v ON v.item_id = i.item_id)
"""


@query(WIDE + "SELECT * FROM wide")
def wide_catalogue(spark, d):
    return _wide(spark, d)


@query(WIDE + "SELECT * FROM wide WHERE item_id IN (1, 5, 9, 17, 33)")
def catalogue_by_ids(spark, d):
    return C.catalogue_by_ids(_wide(spark, d), [1, 5, 9, 17, 33, 5])


@query("WITH g AS (SELECT item_id, string_agg(DISTINCT genre, '|' ORDER BY genre) AS l FROM genre_rows GROUP BY 1) SELECT i.item_id, title, coalesce(l, '') AS genre_list, popularity, release_date FROM items i LEFT JOIN g ON g.item_id = i.item_id")
def catalogue_summary(spark, d):
    items = B.items(spark, d)
    return C.catalogue_summary(items, C.explode_genres(items))


@query(WIDE + "SELECT * FROM wide WHERE contains(lower(title), 'red') OR contains(lower(director), 'red') OR contains(lower(genres), 'red') OR contains(lower(actors), 'red') OR contains(lower(tags), 'red') ORDER BY popularity DESC, item_id LIMIT 20")
def search_text(spark, d):
    return C.shown(_wide(spark, d), C.search_ids(*_parts(spark, d), text="RED", limit=20))


_NEEDLES = ["RED", "Supplier#00000000", "small r", "o", "no such name"]


@query("WITH n AS (SELECT unnest(['red', 'supplier#00000000', 'small r', 'o', 'no such name']) AS needle), h AS (SELECT item_id, lower(title) AS name FROM items UNION ALL SELECT item_id, lower(director) FROM items UNION ALL SELECT item_id, lower(genre) FROM genre_rows UNION ALL SELECT item_id, lower(actor) FROM item_actors UNION ALL SELECT item_id, lower(unnest(string_split(title, ' '))) FROM items ), f AS (SELECT DISTINCT needle, item_id FROM n JOIN h ON contains(name, needle)), r AS (SELECT needle, f.item_id, row_number() OVER (PARTITION BY needle ORDER BY popularity DESC, f.item_id) AS rank FROM f JOIN items i ON i.item_id = f.item_id) SELECT * FROM r WHERE rank <= 20")
def search_by_index(spark, d):
    """An index of the catalogue's names is written, then asked for long, short and unknown texts."""
    path = f"{scratch_dir(spark)}/search-{uuid.uuid4().hex}"
    C.write_search_index(*_parts(spark, d), path)
    out = None
    for needle in _NEEDLES:
        rank = F.row_number().over(Window.orderBy(F.desc("popularity"), "item_id")).cast("long")  # 20 rows
        rows = C.search_index(spark, path, needle).select(F.lit(needle.lower()).alias("needle"), "item_id", rank.alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(WIDE + "SELECT * FROM wide WHERE len(list_filter(string_split(genres, '|'), lambda g: contains(lower(g), 'eco'))) > 0 AND substr(release_date, 1, 4) >= '1990' AND substr(release_date, 1, 4) <= '1999' AND release_date <> '' AND release_date <= '1998-06-01' ORDER BY popularity DESC, item_id LIMIT 25")
def search_genre_year_status(spark, d):
    return C.shown(_wide(spark, d), C.search_ids(*_parts(spark, d), genre="eco", year="1990-1999", status="released", today="1998-06-01", limit=25))


@query(WIDE + "SELECT * FROM wide WHERE contains(lower(actors), 'supplier') AND len(list_filter(string_split(genres, '|'), lambda g: contains(lower(g), 'red'))) > 0 AND len(list_filter(string_split(genres, '|'), lambda g: contains(lower(g), 'wid'))) > 0 AND vote_average >= 2.0 ORDER BY popularity DESC, item_id LIMIT 30")
def filter_catalogue(spark, d):
    return C.filter_catalogue(_wide(spark, d), actors=["supplier"], genres=["red", "wid"], min_rating=2.0)


@query("SELECT * FROM items WHERE len(list_filter(string_split(genres, '|'), lambda g: contains(lower(g), 'bolt'))) > 0 ORDER BY popularity DESC, item_id LIMIT 20 OFFSET 20")
def by_genre(spark, d):
    return C.by_genre(B.items(spark, d), "Bolt", page=2, limit=20)


@query("SELECT * FROM items ORDER BY popularity DESC, item_id LIMIT 20 OFFSET 20")
def trending_page(spark, d):
    return C.page_of(B.items(spark, d), page=2)


@query("SELECT * FROM items ORDER BY release_date DESC NULLS LAST, item_id LIMIT 20")
def latest_page(spark, d):
    return C.page_of(B.items(spark, d), order="release_date")


@query("WITH r AS (SELECT * FROM items WHERE popularity < 950.0 OR (popularity = 950.0 AND item_id < 100) ORDER BY popularity DESC, item_id DESC LIMIT 21), k AS (SELECT *, row_number() OVER (ORDER BY popularity DESC, item_id DESC) AS rn, count(*) OVER () AS n FROM r) SELECT * EXCLUDE (rn, n), CASE WHEN rn = 20 AND n > 20 THEN base64(encode(CAST(popularity AS VARCHAR) || '|' || CAST(item_id AS VARCHAR))) END AS next_cursor FROM k WHERE rn <= 20")
def trending_after(spark, d):
    return C.page_after(B.items(spark, d), 950.0, 100)


@query("SELECT count(*) AS n FROM items ")
def catalogue_count(spark, d):
    return B.items(spark, d).agg(F.count("*").alias("n"))


@query("SELECT director, count(*) AS n, max(popularity) AS best FROM items GROUP BY 1")
def items_by_director(spark, d):
    return B.items(spark, d).groupBy("director").agg(F.count("*").alias("n"), F.max("popularity").alias("best"))


@query("WITH v AS (SELECT item_id, avg(rating) AS m, count(*) AS n FROM interactions GROUP BY 1) SELECT i.item_id, title, m, n FROM items i JOIN v ON v.item_id = i.item_id WHERE substr(release_date, 1, 4) = '1995' AND n >= 2 ORDER BY m DESC, i.item_id LIMIT 10")
def top_rated_in_year(spark, d):
    v = B.interactions(spark, d).groupBy("item_id").agg(F.avg("rating").alias("m"), F.count("*").alias("n"))
    rows = B.items(spark, d).join(v, "item_id").filter((F.substring("release_date", 1, 4) == "1995") & (F.col("n") >= 2))
    return rows.select("item_id", "title", "m", "n").orderBy(F.desc("m"), "item_id").limit(10)


@query("""WITH y AS (SELECT item_id, title, release_date, coalesce(TRY_CAST(substr(release_date, 1, 4) AS INTEGER), TRY_CAST(nullif(regexp_extract(title, '\\((\\d{4})\\)', 1), '') AS INTEGER), 2010) AS y FROM items)
SELECT item_id, y AS release_year, CAST(coalesce(nullif(substr(release_date, 1, 4), ''), '2010') AS BIGINT) AS sql_year, CAST(month(TRY_CAST(release_date AS DATE)) AS INTEGER) AS release_month, CAST(floor(y / 10) * 10 AS INTEGER) AS decade, round(exp(-ln(2) / 15 * greatest(0, 2024 - y)), 9) AS decay FROM y""")
def release_features(spark, d):
    y = S.release_year(F.col("release_date"), F.col("title"))
    return B.items(spark, d).select("item_id", y.alias("release_year"), S.sql_release_year(F.col("release_date")).alias("sql_year"), S.release_month(F.col("release_date")).alias("release_month"), S.release_decade(y).alias("decade"), F.round(S.recency_decay(y, ref_year=2024), 9).alias("decay"))


@query("SELECT item_id, CASE WHEN substr(release_date, 1, 4) < '2000' AND release_date <> '' THEN 'classic' WHEN substr(release_date, 1, 4) BETWEEN '2000' AND '2009' THEN '2000s' WHEN substr(release_date, 1, 4) BETWEEN '2010' AND '2019' THEN '2010s' ELSE 'other' END AS bucket, release_date > '2000-01-01' AS upcoming FROM items WHERE release_date IS NOT NULL")
def year_buckets(spark, d):
    date = F.col("release_date")
    chain = F.when(S.year_bucket(date, "classic"), "classic").when(S.year_bucket(date, "2000s"), "2000s").when(S.year_bucket(date, "2010s"), "2010s").otherwise("other")
    return B.items(spark, d).filter("release_date is not null").select("item_id", chain.alias("bucket"), S.status(date, "upcoming", "2000-01-01").alias("upcoming"))


@query("""WITH a AS (SELECT item_id, list(actor ORDER BY cast_order) AS l FROM item_actors GROUP BY 1)
SELECT i.item_id, trim(concat_ws(' ', replace(genres, '|', ' '), replace(director, ' ', ''), array_to_string(list_transform(coalesce(l, [])[1:5], lambda x: replace(x, ' ', '')), ' '), title)) AS soup, title || '. Genres: ' || replace(genres, '|', ', ') || '. ' || director AS item_text FROM items i LEFT JOIN a ON a.item_id = i.item_id""")
def metadata_soup(spark, d):
    cast = F.transform(F.array_sort(F.collect_list(F.struct("cast_order", "actor"))), lambda s: s["actor"])
    a = B.item_actors(spark, d).groupBy("item_id").agg(cast.alias("cast"))
    g = F.split("genres", r"\|")
    return B.items(spark, d).join(a, "item_id", "left").select("item_id", S.soup(g, F.col("director"), F.col("cast"), F.split("title", " ")).alias("soup"), S.item_text(F.col("title"), g, F.col("director")).alias("item_text"))


@query("SELECT row_number() OVER (ORDER BY n) AS id, n AS name FROM (SELECT DISTINCT trim(genre) AS n FROM genre_rows ) WHERE n <> ''")
def genre_dimension(spark, d):
    return C.build_dimension(C.explode_genres(B.items(spark, d)), "genre")


@query("""WITH dim AS (SELECT n AS name, row_number() OVER (ORDER BY n) AS id FROM (SELECT DISTINCT director AS n FROM items ))
SELECT item_id, title, genres, popularity, coalesce(release_date, '') AS release_date, dim.id AS director_id FROM items LEFT JOIN dim ON dim.name = director""")
def star_items(spark, d):
    items = B.items(spark, d)
    return C.build_items(items, C.build_dimension(items, "director"))


@query("""WITH p AS (SELECT item_id, unnest(string_split(genres, '|')) AS name, generate_subscripts(string_split(genres, '|'), 1) - 1 AS pos FROM items ),
f AS (SELECT item_id, name, min(pos) AS pos FROM p GROUP BY 1, 2), dim AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT name FROM p))
SELECT f.item_id, dim.id, f.pos AS cast_order FROM f JOIN dim ON dim.name = f.name""")
def star_junction(spark, d):
    items = B.items(spark, d)
    return C.build_junction(items, C.build_dimension(C.explode_genres(items), "genre"), "genres", ordered=True)


@query("""WITH g AS (SELECT item_id, string_agg(DISTINCT genre, '|' ORDER BY genre) AS g FROM genre_rows GROUP BY 1), a AS (SELECT item_id, string_agg(actor, '|' ORDER BY cast_order) AS c FROM item_actors GROUP BY 1)
SELECT i.item_id, title, coalesce(g, '(no genres listed)') AS genres, coalesce(director, '<unknown>') AS director, coalesce(release_date, '') AS release_date, coalesce(c, '') AS "cast" FROM items i LEFT JOIN g ON g.item_id = i.item_id LEFT JOIN a ON a.item_id = i.item_id""")
def flatten_catalogue(spark, d):
    items = B.items(spark, d)
    return C.flatten_catalogue(items, C.explode_genres(items), B.item_actors(spark, d))


@query("""SELECT user_id, item_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, event_id DESC) AS rn FROM log ) WHERE rn = 1""")
def current_events(spark, d):
    return C.latest_wins(B.events(spark, d), tie=("event_id",)).select("user_id", "item_id", "event_type", "ts")


@query("SELECT user_id, item_id, max(ts) AS ts FROM toggles GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def watchlist_state(spark, d):
    return C.toggle_state(B.toggles(spark, d))


@query("WITH t AS (SELECT user_id, item_id, max(ts) AS ts FROM toggles GROUP BY 1, 2 HAVING count(*) % 2 = 1) SELECT t.user_id, t.item_id, title, t.ts FROM t JOIN items i ON i.item_id = t.item_id")
def watchlist_items(spark, d):
    return C.toggle_state(B.toggles(spark, d)).join(B.items(spark, d), "item_id").select("user_id", "item_id", "title", "ts").orderBy("user_id", F.desc("ts"), "item_id")


@query("""WITH p AS (SELECT user_id, string_agg(genre, '|' ORDER BY genre) AS genres, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids FROM (SELECT DISTINCT i.user_id, g.genre, i.item_id FROM interactions i JOIN genre_rows g ON g.item_id = i.item_id WHERE rating >= 4.5) GROUP BY 1)
SELECT user_id, len(string_split(genres, '|')) AS n_genres, len(string_split(item_ids, ',')) AS n_items FROM p""")
def user_preferences(spark, d):
    rows = B.interactions(spark, d).filter("rating >= 4.5").join(C.explode_genres(B.items(spark, d)), "item_id").select("user_id", "genre", "item_id").distinct()
    texts = rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("genre")), "|").alias("genres"), F.array_join(F.collect_list("item_id").cast("array<string>"), ",").alias("item_ids"), F.lit(0).alias("ts"))
    return C.preferences(texts).select("user_id", F.size("genres").cast("long").alias("n_genres"), F.size("item_ids").cast("long").alias("n_items"))


@query("""WITH t AS (SELECT * FROM comments WHERE parent_id IS NULL ORDER BY comment_id DESC LIMIT 20 OFFSET 20)
SELECT t.comment_id, (SELECT count(*) FROM comments c WHERE c.parent_id = t.comment_id) AS replies, coalesce((SELECT min(c.comment_id) FROM comments c WHERE c.parent_id = t.comment_id), -1) AS first_reply FROM t""")
def thread_page(spark, d):
    rows = C.thread_view(B.comments(spark, d), page=2)
    return rows.select("comment_id", F.coalesce(F.size("reply_ids"), F.lit(0)).cast("long").alias("replies"), F.coalesce(F.try_element_at("reply_ids", F.lit(1)), F.lit(-1)).alias("first_reply"))


@query("""WITH l AS (SELECT DISTINCT user_id AS liker, item_id * 1000 AS comment_id FROM log WHERE event_type = 'click'), n AS (SELECT comment_id, count(*) AS k, max(CASE WHEN liker = 7 THEN 1 ELSE 0 END) AS mine FROM l GROUP BY 1)
SELECT c.comment_id, c.role AS author, coalesce(k, 0) AS like_count, coalesce(mine = 1, false) AS liked_by_viewer FROM comments c LEFT JOIN n ON n.comment_id = c.comment_id""")
def comment_likes(spark, d):
    likes = B.events(spark, d).filter("event_type = 'click'").select("user_id", (F.col("item_id") * 1000).alias("comment_id")).distinct()
    comments = B.comments(spark, d).withColumnRenamed("role", "user_id")
    authors = comments.select("user_id").distinct().withColumn("author", F.col("user_id"))
    return C.comments_with_likes(comments, authors, likes, viewer=7).select("comment_id", "author", "like_count", "liked_by_viewer")


def _slates(spark, d):
    w = _wide(spark, d)
    return w.select((F.col("item_id") % 50).alias("slate_id"), "item_id", "genres", "vote_average", F.substring("release_date", 1, 4).try_cast("int").alias("year"), (F.floor(F.col("item_id") / 50) + 1).cast("int").alias("rank"), "popularity")


@query(WIDE + """, s AS (SELECT item_id % 50 AS slate_id, item_id, string_split(genres, '|') AS g, vote_average, TRY_CAST(substr(release_date, 1, 4) AS INTEGER) AS y, item_id // 50 + 1 AS r FROM wide),
 f AS (SELECT *, list_contains(g, 'bolt') AS hit FROM s WHERE NOT list_contains(g, 'red')), fa AS (SELECT *, bool_or(hit) OVER (PARTITION BY slate_id) AS anyhit FROM f),
 k AS (SELECT *, row_number() OVER (PARTITION BY slate_id ORDER BY r, item_id) AS rank FROM fa WHERE (hit OR NOT anyhit) AND vote_average >= 2.0 AND y > 1990)
SELECT slate_id, item_id, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def refine_slates(spark, d):
    return C.refine_slate(_slates(spark, d), exclude=["red"], want="bolt", min_rating=2.0, newer_than=1990, limit=5).select("slate_id", "item_id", "rank")


@query(WIDE + """, s AS (SELECT item_id % 50 AS slate_id, item_id, string_split(genres, '|') AS g, vote_average, popularity, count(*) OVER (PARTITION BY item_id % 50) AS n FROM wide),
 lk AS (SELECT DISTINCT item_id FROM interactions WHERE rating >= 5.0), f AS (SELECT *, 0.5 * len(list_intersect(g, ['red', 'bolt'])) + 0.05 * vote_average + 0.001 * popularity AS score FROM s WHERE item_id NOT IN (SELECT item_id FROM lk) OR n <= 10),
 k AS (SELECT *, row_number() OVER (PARTITION BY slate_id ORDER BY score DESC, item_id) AS rank FROM f)
SELECT slate_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def reflect_slates(spark, d):
    liked = B.interactions(spark, d).filter("rating >= 5.0").select((F.col("item_id") % 50).alias("slate_id"), "item_id")
    return C.reflect_rerank(_slates(spark, d), liked, genres=["red", "bolt"]).withColumn("score", F.round("score", 6))


@query(WIDE + "SELECT item_id % 50 AS slate_id, item_id, CAST((item_id // 50) // 5 AS BIGINT) AS page FROM wide")
def slate_pages(spark, d):
    return C.next_batch(_slates(spark, d)).select("slate_id", "item_id", "page")


@query("""WITH o AS (SELECT user_id, item_id, min(ts * 100000 + event_id % 100000) AS t FROM log GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, item_id) AS rn FROM o)
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rn) AS ids FROM r WHERE rn <= 50 GROUP BY 1""")
def unique_in_order(spark, d):
    order = F.array_sort(F.collect_list(F.struct((F.col("ts") * 100000 + F.col("event_id") % 100000).alias("t"), "item_id")))
    rows = B.events(spark, d).groupBy("user_id").agg(F.transform(order, lambda s: s["item_id"]).alias("ids"))
    return C.unique_in_order(rows, "ids").select("user_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT item_id, popularity, coalesce(TRY_CAST(substr(release_date, 1, 4) AS DOUBLE), 0.0) AS release_date, 0.0 AS missing FROM (SELECT item_id, popularity, substr(release_date, 1, 4) AS release_date FROM items )")
def ensure_columns(spark, d):
    rows = B.items(spark, d).select("item_id", "popularity", F.substring("release_date", 1, 4).alias("release_date"))
    return C.ensure_columns(rows, ["popularity", "release_date", "missing"])


@query("WITH p AS (SELECT * FROM items ORDER BY popularity DESC, item_id LIMIT 60) SELECT item_id, len(list_intersect(string_split(genres, '|'), ['red', 'gear'])) > 0 AS matched, popularity FROM p ORDER BY matched DESC, popularity DESC, item_id LIMIT 20")
def cold_start(spark, d):
    return C.cold_start(B.items(spark, d), ["red", "gear"]).select("item_id", "matched", "popularity")


@query("SELECT item_id, title, genres, popularity, director, release_date, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY director ORDER BY popularity DESC, item_id) AS INTEGER) AS rank FROM items ) WHERE rank <= 10")
def slate_response(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("director").orderBy(F.desc("popularity"), "item_id"))
    return B.items(spark, d).withColumn("rank", rank).filter("rank <= 10").select("item_id", "title", "genres", "popularity", "director", "release_date", "rank")


@query("""SELECT item_id, CAST(hash_b AS BIGINT) AS cursor_ok FROM (SELECT item_id, item_id AS hash_b FROM items )""")
def keyset_cursor(spark, d):
    coded = B.items(spark, d).select("item_id", S.keyset_encode(F.col("popularity"), F.col("item_id")).alias("cursor"))
    value, back = S.keyset_decode(F.col("cursor"))
    return coded.select(F.col("item_id"), value, back.alias("cursor_ok")).select("item_id", "cursor_ok")


@query("""SELECT page_id, len(list_filter(list_transform(string_split_regex(CASE WHEN starts_with(trim(html), '[') THEN regexp_replace(trim(html), '[\\[\\]]', '', 'g') ELSE html END, '[,|;]'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM pages""")
def parse_lists(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(S.parse_list(F.col("html"))).cast("long").alias("n"))


@query("SELECT item_id, CASE WHEN item_id % 5 = 4 THEN '' ELSE array_to_string(list_filter(string_split(genres, '|'), lambda x: x <> ''), ';') END AS names FROM items ")
def parse_list_forms(spark, d):
    """The same lists as JSON, with single quotes, in bare brackets and parted by bars; one in five a null word."""
    parts = F.filter(F.split("genres", r"\|"), lambda x: x != "")
    form = F.col("item_id") % 5
    quoted = F.concat(F.lit("['"), F.array_join(parts, "', '"), F.lit("']"))
    text = F.when(form == 0, F.to_json(parts)).when(form == 1, quoted).when(form == 2, F.concat(F.lit("["), F.array_join(parts, "; "), F.lit("]"))).when(form == 3, F.col("genres")).otherwise("NaN")
    return B.items(spark, d).select("item_id", F.array_join(S.parse_list(text), ";").alias("names"))


@query("SELECT item_id, string_agg(actor, '|' ORDER BY cast_order) AS names FROM item_actors GROUP BY 1")
def extract_names(spark, d):
    """Casts written as JSON objects or, for every other item, as JSON strings."""
    cast = B.item_actors(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("cast_order", F.col("actor").alias("name")))).alias("cast"))
    text = F.when(F.col("item_id") % 2 == 0, F.to_json("cast")).otherwise(F.to_json(F.transform("cast", lambda x: x["name"])))
    return cast.select("item_id", F.array_join(S.extract_names(text), "|").alias("names"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN TRY_CAST(substr(release_date, 1, 4) AS INTEGER) END AS year FROM items ")
def title_year(spark, d):
    """Titles that end in the year, have it inside, or lack it."""
    year = F.coalesce(F.substring("release_date", 1, 4), F.lit("none"))
    title = F.when(F.col("item_id") % 3 == 0, F.concat("title", F.lit(" ("), year, F.lit(") "))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("("), year, F.lit(") "), "title")).otherwise(F.col("title"))
    return B.items(spark, d).select("item_id", S.title_year(title).alias("year"))
