"""Queries on unspaced scripts, administrative trees and short forms, running sums over whole tables, identity classes and bucketed sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigilis.functions import text
from vigilis.operators import abbreviations, dedup, lookup, prefix, scripts, textjobs, tree
from vigilis.plans import query
from vigilis.sources import adapters as a
from vigilis.streaming import buckets, jobs

#: Parts of generated texts; they follow one another without a space.
PIECES = ["ผู้ป่วยโรคไข้เลือดออกเพิ่มขึ้น", "พบอหิวาต์", "ພົບໄຂ້ຍຸງລາຍຢູ່", "ជំងឺគ្រុនឈាម", "登革热病例", "dengue", " Wabah Kolera, ", "登革"]
NAMES = [("ไข้เลือดออก", "C1"), ("โรคไข้เลือดออก", "C2"), ("อหิวาต์", "C3"), ("ໄຂ້ຍຸງລາຍ", "C4"), ("គ្រុនឈាម", "C5"), ("登革热", "C6"), ("登革", "C7"), ("Kolera", "C8"), ("dengue", "C9")]
#: Combining marks of those scripts, and the key of a text without accents, in SQL.
MARKS = r"[\x{0E38}-\x{0E3A}\x{0E48}-\x{0E4B}\x{0EB8}-\x{0EBA}\x{0EC8}-\x{0ECB}\x{17D2}\x{17DD}]"
KEY_SQL = rf"trim(regexp_replace(regexp_replace(lower(%s), '{MARKS}', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
PIECES_SQL = "[" + ", ".join(f"'{p}'" for p in PIECES) + "]"


def generated_texts(spark, d):
    """A text of three parts for each customer."""
    k, n = F.col("c_custkey"), len(PIECES)
    part = lambda i: F.get(F.array(*map(F.lit, PIECES)), (F.floor(k / n**i) % n).cast("int"))
    return a.scan(spark, d, "customer", ["c_custkey"]).select(k.alias("doc_id"), F.concat(part(0), part(1), F.lit("x "), part(2)).alias("text"))


@query(f"""WITH t AS (SELECT c_custkey AS doc_id, {KEY_SQL % f"{PIECES_SQL}[c_custkey % 8 + 1] || {PIECES_SQL}[c_custkey // 8 % 8 + 1] || 'x ' || {PIECES_SQL}[c_custkey // 64 % 8 + 1]"} AS key FROM customer),
  l AS (SELECT {KEY_SQL % 'alias'} AS alias, concept FROM (VALUES {", ".join(f"('{x}', '{c}')" for x, c in NAMES if not x.isascii())}) v(alias, concept)),
  h AS (SELECT doc_id, i - 1 AS s, i - 1 + length(alias) AS e, concept FROM t, l, unnest(range(1, length(key) + 1)) r(i)
    WHERE substr(key, i, length(alias)) = alias AND NOT regexp_matches(' ' || substr(key, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[a-z0-9]$') AND NOT regexp_matches(substr(key, i + length(alias), 1), '^[a-z0-9]')),
  m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM h)
  SELECT doc_id, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", concept FROM m WHERE far IS NULL OR e > far""")
def tx3_unspaced_mentions(spark, d):
    """Thai, Lao, Khmer and Chinese aliases inside texts without spaces."""
    lex = spark.createDataFrame(NAMES, "alias string, concept string")
    return scripts.unspaced_mentions(generated_texts(spark, d), lex).select("doc_id", "start", "end", "concept")


@query(f"""WITH t AS (SELECT c_custkey AS doc_id, string_split({KEY_SQL % f"{PIECES_SQL}[c_custkey % 8 + 1] || {PIECES_SQL}[c_custkey // 8 % 8 + 1] || 'x ' || {PIECES_SQL}[c_custkey // 64 % 8 + 1]"}, ' ') AS ws FROM customer), w AS (SELECT doc_id, unnest(ws) AS w FROM t)
  SELECT doc_id, CASE w WHEN 'kolera' THEN 'C8' ELSE 'C9' END AS concept, count(*) AS n FROM w WHERE w IN ('kolera', 'dengue') GROUP BY ALL""")
def tx3_latin_mentions(spark, d):
    """Latin aliases in the same texts, as whole words."""
    lex = spark.createDataFrame(NAMES, "alias string, concept string")
    found = textjobs.mentions(generated_texts(spark, d), lex)
    return found.where("concept in ('C8', 'C9')").groupBy("doc_id", "concept").agg(F.count("*").alias("n"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SEGMENT_SQL = "list_position([" + ", ".join(f"'{s}'" for s in SEGMENTS) + "], c_mktsegment)"
TREE_SQL = f"""nodes AS (SELECT CAST(r_regionkey AS BIGINT) AS place_id, NULL::BIGINT AS parent_id, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation
    UNION ALL SELECT DISTINCT 1000 + 10 * c_nationkey + {SEGMENT_SQL}, 100 + c_nationkey, 'District ' || c_nationkey || ' ' || c_mktsegment FROM customer UNION ALL SELECT 100000 + c_custkey, 1000 + 10 * c_nationkey + {SEGMENT_SQL}, c_name FROM customer),
  walk(place_id, parent_id, level, ids, names) AS (SELECT place_id, parent_id, 0, [place_id], [name] FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.place_id, n.parent_id, level + 1, list_append(ids, n.place_id), list_append(names, n.name) FROM nodes n JOIN walk w ON n.parent_id = w.place_id),
  below AS (SELECT id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM walk) GROUP BY 1),
  tree AS (SELECT place_id, level, names[1] AS country, names[2] AS admin1, names[3] AS admin2, ids, row_number() OVER (ORDER BY ids) - 1 AS first, n FROM walk JOIN below ON id = place_id)"""


def administrative_places(spark, d):
    """Regions, their nations, a district for each segment of a nation's customers, and the customers."""
    c = a.scan(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    district = 1000 + 10 * F.col("c_nationkey") + F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment"))
    row = lambda ident, parent, name: [ident.cast("long").alias("place_id"), parent.cast("long").alias("parent_id"), name.alias("name")]
    regions = a.scan(spark, d, "region").select(*row(F.col("r_regionkey"), F.lit(None), F.col("r_name")))
    nations = a.scan(spark, d, "nation").select(*row(100 + F.col("n_nationkey"), F.col("n_regionkey"), F.col("n_name")))
    districts = c.select(*row(district, 100 + F.col("c_nationkey"), F.concat_ws(" ", F.lit("District"), "c_nationkey", "c_mktsegment"))).distinct()
    return regions.unionByName(nations).unionByName(districts).unionByName(c.select(*row(100_000 + F.col("c_custkey"), district, F.col("c_name"))))


@query(f"WITH RECURSIVE {TREE_SQL} SELECT place_id, level, country, admin1, admin2, CAST(first AS BIGINT) AS first, CAST(first + n - 1 AS BIGINT) AS last FROM tree")
def tx14_admin_tree(spark, d):
    """Every place with its level, ancestors and interval."""
    return tree.admin_tree(administrative_places(spark, d)).drop("parent_id")


@query(f"WITH RECURSIVE {TREE_SQL} SELECT t.place_id, p.place_id AS other, list_contains(t.ids, p.place_id) AND t.level > p.level AS is_parent FROM tree t JOIN tree p ON p.place_id = CASE WHEN t.place_id % 2 = 0 THEN t.place_id % 5 ELSE 100 + t.place_id % 25 END")
def tx14_parent_test(spark, d):
    """Whether a region or nation, chosen by the place's id, is above the place: two intervals compared."""
    rows = tree.admin_tree(administrative_places(spark, d))
    other = F.when(F.col("place_id") % 2 == 0, F.col("place_id") % 5).otherwise(100 + F.col("place_id") % 25)
    child = rows.select(F.struct("level", "first", "place_id").alias("c"), other.alias("other"))
    parent = rows.where("level < 2").select(F.struct("level", "first", "last").alias("p"), F.col("place_id").alias("__p"))
    return child.join(parent, F.col("other") == F.col("__p")).select("c.place_id", "other", tree.is_parent("p", "c").alias("is_parent"))


@query(f"""WITH RECURSIVE {TREE_SQL}, asked AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN upper(n_name) WHEN n_nationkey % 3 = 1 THEN 'Nówhere' ELSE 'District ' || n_nationkey || ' BUILDING' END AS place, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE 'ÁSIA' END AS hint FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT k, level, country, admin1, admin2, place_id IS NULL OR country <> hint AS needs_review FROM asked LEFT JOIN (SELECT t.*, n.name FROM tree t JOIN nodes n ON t.place_id = n.place_id) t ON lower(strip_accents(place)) = lower(name)""")
def tx14_resolve_levels(spark, d):
    """Named places with their level and ancestors; a hint of another country is a reason for a review, never a parent."""
    places = administrative_places(spark, d)
    rows = tree.admin_tree(places).join(places.select(F.col("place_id").alias("__i"), "name"), F.col("place_id") == F.col("__i")).drop("__i")
    k = F.col("n_nationkey")
    place = F.when(k % 3 == 0, F.upper("n_name")).when(k % 3 == 1, "Nówhere").otherwise(F.concat(F.lit("District "), k, F.lit(" BUILDING")))
    n = a.scan(spark, d, "nation").join(F.broadcast(a.scan(spark, d, "region")), F.expr("n_regionkey = r_regionkey"))
    asked = n.select(k.alias("k"), place.alias("place"), F.when(k % 2 == 0, F.col("r_name")).otherwise("ÁSIA").alias("country"))
    return tree.place_levels(asked, rows, "place").select("k", "found.level", "found.country", "found.admin1", "found.admin2", "needs_review")


@query("SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank FROM documents")
def wn11_running_sums(spark, d):
    """Each document's place in the order of lengths, and the characters up to it: file offsets."""
    docs = a.scan(spark, d, "documents", ["doc_id", "n_chars"])
    summed = prefix.running_sum(docs, "n_chars", "doc_id", F.col("n_chars"), "upto", 16)
    return prefix.ranks(summed, "n_chars", "doc_id", "rank", 16).select("doc_id", "upto", F.col("rank").cast("long").alias("rank"))


LINKED_SQL = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey // 3 END AS k1, CASE WHEN o_orderkey % 12 < 11 THEN (o_orderkey + 1) // 3 END AS k2 FROM orders"


@query(f"""WITH RECURSIVE o AS ({LINKED_SQL}), e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM o x JOIN o y ON x.k1 = y.k1 UNION SELECT x.id, y.id FROM o x JOIN o y ON x.k2 = y.k2),
  reach(id, node) AS (SELECT id, id FROM o UNION SELECT reach.id, b FROM reach JOIN e ON reach.node = a), c AS (SELECT id, min(2 * node + CASE WHEN node % 7 < 3 THEN 0 ELSE 1 END) AS class_id FROM reach GROUP BY 1)
  SELECT CASE WHEN id % 7 < 3 THEN 'new' ELSE 'old' END AS side, id, CAST(class_id AS BIGINT) AS class_id, count(*) FILTER (WHERE id % 7 < 3) OVER (PARTITION BY class_id) AS n_new, count(*) FILTER (WHERE id % 7 >= 3) OVER (PARTITION BY class_id) AS n_old FROM c""")
def jn12_identity_classes(spark, d):
    """Rows of two tables that share either of two independent keys, directly or through others: one row for each, with its class."""
    k = F.col("o_orderkey")
    o = a.scan(spark, d, "orders", ["o_orderkey"]).select(k.alias("id"), F.when(k % 4 > 0, F.floor(k / 3)).alias("k1"), F.when(k % 12 < 11, F.floor((k + 1) / 3)).alias("k2"))
    return lookup.identity_classes(o.where("id % 7 < 3"), o.where("id % 7 >= 3"), ["k1", "k2"])


@query(f"""WITH RECURSIVE o AS ({LINKED_SQL}), e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM o x JOIN o y ON x.k1 = y.k1 UNION SELECT x.id, y.id FROM o x JOIN o y ON x.k2 = y.k2),
  reach(id, node) AS (SELECT id, id FROM o UNION SELECT reach.id, b FROM reach JOIN e ON reach.node = a) SELECT id, min(node) AS survivor FROM reach GROUP BY 1""")
def wn7_dedup_chains(spark, d):
    """Survivors where rows are linked through chains of two independent keys."""
    k = F.col("o_orderkey")
    o = a.scan(spark, d, "orders", ["o_orderkey"]).select(k.alias("id"), F.when(k % 4 > 0, F.floor(k / 3)).alias("k1"), F.when(k % 12 < 11, F.floor((k + 1) / 3)).alias("k2"))
    return dedup.dedup_identities(o, "id", ["k1", "k2"], [F.asc("id")]).select("id", "survivor")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, max(event_id % 3) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_id % 3 = last")
def ss8_bucketed_sink(spark, d):
    """Three batches of events into a bucketed table, each replacing the users that it has; the second is delivered twice."""
    dedup.set_checkpoint_dir(spark)
    table = buckets.BucketedTable(spark, f"{spark.sparkContext.getCheckpointDir()}/bucketed-{uuid.uuid4().hex}", "user_id", 16)
    e = a.scan(spark, d, "events", ["event_id", "user_id", "event_type"])
    for n in (0, 1, 1, 2):
        table.write(e.where(f"event_id % 3 = {n}"), n, lambda old, new: jobs.replace_by_report(old, new, "user_id"))
    return table.read().select("event_id", "user_id", "event_type")


@query("SELECT doc_id, sha256(strip_accents(lower(text))) AS folded FROM documents")
def fn16_fold_accents(spark, d):
    docs = a.scan(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.sha2(text.fold_accents(F.col("text")), 256).alias("folded"))


#: Nations as places: N0 to N6 stand for several of them, U0 to U24 for one.
SHORT_SQL = """places AS (SELECT n_nationkey AS i, n_name AS name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey),
  docs AS (SELECT c_custkey AS doc_id, c_custkey % 7 AS a, c_custkey % 4 AS mode, c_custkey % 25 AS b FROM customer),
  own AS (SELECT docs.*, p.name AS scope, p.country AS near FROM docs JOIN places p ON p.i = b),
  scored AS (SELECT doc_id, 'n' || a AS alias, i, CASE mode WHEN 1 THEN CASE WHEN i = b THEN 10 ELSE 0 END WHEN 2 THEN CASE WHEN country = near THEN 35 ELSE 0 END + CASE WHEN name = scope THEN 50 ELSE 0 END WHEN 3 THEN CASE WHEN country = near THEN 20 ELSE 0 END ELSE 0 END AS score FROM own JOIN places ON i % 7 = a),
  found AS (SELECT doc_id, alias, CASE WHEN max(score) > 0 THEN arg_max(i, (score, -i)) END AS place_id FROM scored GROUP BY 1, 2 UNION ALL SELECT doc_id, 'u' || b, b FROM docs WHERE doc_id % 3 = 0)"""


def short_forms(spark, d):
    n = a.scan(spark, d, "nation").join(F.broadcast(a.scan(spark, d, "region")), F.expr("n_regionkey = r_regionkey"))
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    aliases = F.array(F.concat(F.lit("N"), k % 7), F.concat(F.lit("U"), k))
    places = n.select(k.cast("long").alias("place_id"), F.col("n_name").alias("canonical"), F.col("r_name").alias("country"), F.col("r_name").alias("admin1"), F.lit(None).cast("string").alias("admin2"), F.lit(1).alias("level"), aliases.alias("aliases"), F.array(F.concat(F.lit("Cue"), k, F.lit("x"))).alias("cues"))
    own = a.scan(spark, d, "customer", ["c_custkey"]).join(F.broadcast(n.select(k, "n_name", "r_name")), c % 25 == k)
    said = F.when(c % 4 == 1, F.concat(F.lit(" cue"), k, F.lit("x"))).when(c % 4 == 2, F.concat(F.lit(" Dinkes "), "n_name")).otherwise("")
    text_ = F.concat(F.lit("Kasus di N"), c % 7, F.lit("."), said, F.when(c % 3 == 0, F.concat(F.lit(" dan U"), k)).otherwise(""))
    return own.select(c.alias("doc_id"), text_.alias("text"), F.when(c % 4 == 3, F.col("r_name")).alias("country_hint"), F.col("n_name").alias("own")), places


@query(f"WITH {SHORT_SQL} SELECT doc_id, alias, place_id FROM found")
def tx15_abbreviations(spark, d):
    """Short forms of nations in texts, told apart by cues, the text's own place and the country hinted at."""
    return abbreviations.resolve_abbreviations(*short_forms(spark, d))


@query(f"""WITH {SHORT_SQL}, named AS (SELECT f.doc_id, p.name AS place FROM found f LEFT JOIN places p ON p.i = f.place_id) SELECT o.doc_id, o.doc_id % 2 = 0 AND bool_or(place IS NULL OR place <> scope) AS geo_uncertain FROM own o JOIN named n ON o.doc_id = n.doc_id GROUP BY o.doc_id""")
def tx15_geo_uncertain(spark, d):
    """Whether a text with counts has a short form that isn't bound to its resolved place."""
    docs, places = short_forms(spark, d)
    found = abbreviations.resolve_abbreviations(docs, places)
    k = F.col("doc_id")
    # names of provinces are the nations' own here, so that a region alone binds nothing
    rows = docs.select(k, F.when(k % 2 == 0, 5).otherwise(0).alias("cases"), F.lit(None).cast("int").alias("deaths"), F.array(F.concat(F.lit("x; "), F.lower("own"))).alias("resolved"))
    return abbreviations.geo_uncertain(rows, found, places.withColumn("admin1", F.col("canonical")))
