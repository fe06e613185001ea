"""Registered queries of the merge engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..functions import similarity as S
from ..functions import standardize as st
from ..functions.embed import PrecomputedEmbedder, embed_distinct
from ..operators import bertscore, merge, profile
from ..operators.assign import assign, beam_rounds
from ..operators.classify import nearest_alias
from ..operators.match import match_categories, match_schemas, score_pairs
from ..operators.pairs import best_with_ties, first_best, grouped_join, placed
from .integrate import Config, integrate

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 5 = 1 THEN NULL ELSE p_name END AS cell FROM part""")
def null_clean(spark, sf):
    raw = F.when(F.col("p_partkey") % 5 == 0, "''").when(F.col("p_partkey") % 5 == 1, " ").otherwise(F.col("p_name"))
    return load(spark, sf, "part").select("p_partkey", st.null_clean(raw).alias("cell"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN substr(n_name, 2) ELSE n_name END AS cell FROM nation""")
def quote_strip(spark, sf):
    n, k = F.col("n_name"), F.col("n_nationkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("'"), n, F.lit("'"))).when(k == 1, F.concat(n, F.lit("'"))).otherwise(n)
    return load(spark, sf, "nation").select("n_nationkey", st.strip_quotes(raw).alias("cell"))


@query("""SELECT n_name, r_name, levenshtein(n_name, r_name)::INTEGER AS dist, round(1 - levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)), 6) AS score FROM nation, region""")
def levenshtein_pairs(spark, sf):
    pairs = load(spark, sf, "nation").join(F.broadcast(load(spark, sf, "region")), how="cross")  # 25 x 5 names
    a, b = F.col("n_name"), F.col("r_name")
    return pairs.select("n_name", "r_name", F.levenshtein(a, b).alias("dist"), F.round(S.levenshtein_similarity(a, b), 6).alias("score"))


@query("""
WITH a AS (SELECT dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS ordinal, c_mktsegment AS category FROM (SELECT DISTINCT c_mktsegment FROM customer)),
l AS (SELECT ordinal, 0 AS pos, category, category AS alias FROM a UNION ALL SELECT ordinal, 1, category, substr(category, 1, 4) FROM a),
h AS (SELECT DISTINCT header FROM (SELECT p_name AS header FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT event_type FROM events)),
d AS (SELECT header, category, ordinal, pos, levenshtein(lower(header), lower(alias)) AS dist FROM h, l),
r AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY dist, ordinal, pos) AS k FROM d)
SELECT header, CASE WHEN dist < 10 THEN category ELSE 'etc' END AS category, CASE WHEN dist < 10 THEN dist ELSE -1 END::INTEGER AS dist FROM r WHERE k = 1""")
def alias_categorize(spark, sf):
    """Names that occur in tables under the nearest of the market segments and their short forms."""
    names = [load(spark, sf, t).select(F.col(c).alias("header")) for t, c in (("part", "p_name"), ("part", "p_type"), ("orders", "o_orderpriority"), ("events", "event_type"))]
    headers = names[0].union(names[1]).union(names[2]).union(names[3]).distinct()
    segments = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("category")).distinct()
    ordinal = F.array_position(F.col("all"), F.col("category")) - 1
    known = segments.agg(F.array_sort(F.collect_list("category")).alias("all"))  # a few segments
    aliases = known.select("all", F.explode("all").alias("category")).select(ordinal.alias("ordinal"), "category", F.posexplode(F.array("category", F.substring("category", 1, 4))).alias("pos", "alias"))
    return nearest_alias(headers, aliases).na.fill(-1, ["dist"])


@query("""
SELECT c_name AS name, c_mktsegment AS status, c_custkey::VARCHAR AS id, 'NULL' AS place FROM customer
UNION ALL SELECT s_name, 'NULL', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM supplier""")
def stack_by_category(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"), F.col("c_custkey").alias("id"))
    b = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("place"))
    return merge.stack(a, b).na.fill("NULL")


@query("""SELECT p_partkey, upper(w[1][1]) || lower(w[1][2:]) AS first FROM (SELECT p_partkey, string_split(trim(p_name), ' ') AS w FROM part)""")
def name_first(spark, sf):
    return load(spark, sf, "part").select("p_partkey", st.first_name(F.col("p_name")).alias("first"))


@query("""
WITH r AS (SELECT p_partkey, lower(p_name) AS n, string_split(lower(p_name), ' ') AS w FROM part),
t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN w[2] || ' ' || w[1] ELSE n END AS n FROM r)
SELECT p_partkey, array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(n, ' ')], ' ') AS name FROM t""")
def name_standardize(spark, sf):
    w = F.split("p_name", " ")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.get(w, 0), F.lit(", "), F.get(w, 1), F.lit(" J."))).otherwise(F.concat(F.lit("  "), F.upper("p_name")))
    return load(spark, sf, "part").select("p_partkey", st.person_name(raw).alias("name"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%H:%M:00') WHEN 1 THEN strftime(ts, '%H:%M:00')
  WHEN 2 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%H:00:00') END AS clock FROM events""")
def time_standardize(spark, sf):
    ts, k = F.col("ts"), F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format(ts, "h:mm a")).when(k == 1, F.date_format(ts, "H:mm")).when(k == 2, F.date_format(ts, "H:mm:ss")).otherwise(F.lower(F.date_format(ts, "ha")))
    return load(spark, sf, "events").select("event_id", st.clock_time(raw).alias("clock"))


@query("""SELECT l_orderkey, l_linenumber, printf('%.1f', l_quantity * 9 / 5 + 32) AS temperature FROM lineitem""")
def temperature_standardize(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.concat(st.one_decimal(F.col("l_quantity") * 9 / 5 + 32), F.lit("F"))).otherwise(st.one_decimal(F.col("l_quantity"))).alias("raw"))
    plan = st.plan_temperature(rows.withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "raw", "at")
    return rows.select("l_orderkey", "l_linenumber", st.temperature(F.col("raw"), plan).alias("temperature"))


@query("""SELECT o_orderkey, '$' || floor(o_totalprice)::BIGINT::VARCHAR AS money FROM orders""")
def number_strip_commas(spark, sf):
    raw = F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice"), 0))
    return load(spark, sf, "orders").select("o_orderkey", st.number_text(raw).alias("money"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Invalid Date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def date_standardize(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    raw = F.when(k % 7 == 0, "NULL").when(k % 2 == 0, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "MMMM d, yyyy"))
    return load(spark, sf, "orders").select("o_orderkey", st.date_text(raw).alias("day"))


_PROFILED = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS attribute, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) / count(*) > 0.8
    THEN CASE WHEN bool_and(try_cast({c}::VARCHAR AS DOUBLE) IS NOT NULL) THEN 'numerical' ELSE 'unique' END ELSE 'categorical' END AS kind FROM customer""" for c in _PROFILED))  # fmt: skip
def attribute_profile(spark, sf):
    return profile.profile(load(spark, sf, "customer"), _PROFILED)


_SIGMA = "SELECT stddev_pop(x) AS sigma FROM (SELECT s_acctbal AS x FROM supplier UNION ALL SELECT c_acctbal FROM customer)"


@query(f"SELECT round(sigma, 6) AS sigma FROM ({_SIGMA})")
def pooled_stddev(spark, sf):
    return profile.pooled_stddev(load(spark, sf, "supplier"), "s_acctbal", load(spark, sf, "customer"), "c_acctbal").select(F.round("sigma", 6).alias("sigma"))


@query(f"""SELECT s_suppkey, c_custkey, round(1 / (abs(s_acctbal - c_acctbal) / sigma + 1), 6) AS score FROM supplier JOIN customer ON s_nationkey = c_nationkey, ({_SIGMA})""")
def numeric_similarity(spark, sf):
    s, c = load(spark, sf, "supplier"), load(spark, sf, "customer")
    sigma = profile.pooled_stddev(s, "s_acctbal", c, "c_acctbal")
    own = s.select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation")).join(F.broadcast(sigma), how="cross")  # sigma is one row
    pairs = grouped_join(own, c.select(F.struct("c_custkey", "c_acctbal").alias("c"), F.col("c_nationkey").alias("nation")), ["nation"], "s_suppkey", "c")
    return pairs.select("s_suppkey", "c.c_custkey", S.rounded(S.numeric_similarity(F.col("s_acctbal"), F.col("c.c_acctbal"), F.col("sigma")), 6).alias("score"))


@query("SELECT c_custkey AS left_id, s_suppkey AS right_id, 1.0::DOUBLE AS score FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def categorical_match_score(spark, sf):
    return score_pairs(load(spark, sf, "customer"), load(spark, sf, "supplier"), {"c_nationkey": "s_nationkey"}, "c_custkey", "s_suppkey", exact_categories=True)


def _nation_vectors(nations):
    """A vector for every name and every name spelled backwards: its own place, and a little of the next one's."""
    place = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.when(i == F.col("n_nationkey"), 1.0).when(i == (F.col("n_nationkey") + 1) % 25, 0.4).otherwise(0.0))
    named = nations.select(F.col("n_name").alias("text"), place.alias("vector"))
    return PrecomputedEmbedder(named.union(named.select(F.reverse("text"), "vector")))


@query("SELECT n_name AS value1, reverse(n_name) AS value2 FROM nation")
def category_value_match(spark, sf):
    """Neighbours are above the threshold too; the best one-to-one map is every name and itself spelled backwards."""
    n = load(spark, sf, "nation")
    return match_categories(n, "n_name", n.select(F.reverse("n_name").alias("back")), "back", _nation_vectors(n))


@query("SELECT s_suppkey AS left_id, c_custkey AS right_id, 1.0::DOUBLE AS score FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN customer ON c_nationkey = a.n_nationkey")
def mapped_category_scores(spark, sf):
    """Pairs by a categorical attribute whose values are spelled differently on both sides."""
    n = load(spark, sf, "nation")
    s = load(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("nation"))
    c = load(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.reverse("n_name").alias("back"))
    return score_pairs(s, c, {"nation": "back"}, "s_suppkey", "c_custkey", embedder=_nation_vectors(n))


_LEFT, _RIGHT = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_SIGNS = "#.-0123456789"


def _looks_sql(table: str, c: str) -> str:
    parts = ", ".join(f"sum(length(x) - length(replace(x, '{ch}', ''))) / count(*)" for ch in _SIGNS)
    return f"SELECT '{c}' AS name, [{parts}, avg(length(x)), sum(length(regexp_replace(x, '[^A-Za-z]', '', 'g'))) / count(*)] AS v FROM (SELECT {c}::VARCHAR AS x FROM {table})"


def _pick_sql(k: int) -> str:
    used = "".join(f" AND b{k}.name <> b{i}.name" for i in range(1, k))
    return f"JOIN s b{k} ON b{k}.a = '{_LEFT[k - 1]}'{used}"


@query(f"""
WITH l AS ({" UNION ALL ".join(_looks_sql("supplier", c) for c in _LEFT)}), r AS ({" UNION ALL ".join(_looks_sql("customer", c) for c in _RIGHT)}),
s AS (SELECT l.name AS a, r.name, list_cosine_similarity(l.v, r.v) AS sim FROM l, r),
best AS (SELECT b1.name AS m1, b2.name AS m2, b3.name AS m3, b4.name AS m4 FROM (SELECT 1) {" ".join(_pick_sql(k) for k in range(1, 5))} ORDER BY b1.sim + b2.sim + b3.sim + b4.sim DESC LIMIT 1)
SELECT unnest({_LEFT}) AS attribute, unnest([m1, m2, m3, m4]) AS matched FROM best""")
def schema_match(spark, sf):
    """Columns of supplier and customer by what their cells look like: signs and digits a cell, letters, length."""

    def looks(table: str, columns: list[str]) -> DataFrame:
        cells = load(spark, sf, table).select(F.explode(F.array(*(F.struct(F.lit(c).alias("text"), F.col(c).cast("string").alias("x")) for c in columns))).alias("e")).select("e.*")
        often = [F.sum(F.length("x") - F.length(F.replace(F.col("x"), F.lit(ch), F.lit("")))) / F.count("*") for ch in _SIGNS]
        return cells.groupBy("text").agg(F.array(*often, F.avg(F.length("x")), F.sum(F.length(F.regexp_replace("x", "[^A-Za-z]", ""))) / F.count("*")).alias("v"))

    seen = looks("supplier", _LEFT).unionByName(looks("customer", _RIGHT))
    unit = seen.select("text", F.transform("v", lambda x: x / F.sqrt(S.dot(F.col("v"), F.col("v")))).alias("vector"))
    found = match_schemas(_LEFT, _RIGHT, PrecomputedEmbedder(unit), 0.3)
    return spark.createDataFrame(list(found.items()), "attribute string, matched string")


_SCORES = f"""
WITH p AS (SELECT s_suppkey AS left_id, c_custkey AS right_id,
  (1 - levenshtein(s_name, c_name) / greatest(length(s_name), length(c_name)) + 1 / (abs(s_acctbal - c_acctbal) / sigma + 1)) / 2 AS score
  FROM supplier, customer, ({_SIGMA}))"""


_KINDS = {"s_name": "unique", "s_acctbal": "numerical"}  # with 900,000 balances less than 0.8 of them are distinct


def _supplier_customer_pairs(spark, sf, threshold=0.6):
    return score_pairs(load(spark, sf, "supplier"), load(spark, sf, "customer"), {"s_name": "c_name", "s_acctbal": "c_acctbal"}, "s_suppkey", "c_custkey", threshold, kinds=_KINDS)


@query(_SCORES + " SELECT left_id, right_id, round(score, 6) AS score FROM p WHERE score > 0.6")
def entity_pair_scores(spark, sf):
    return _supplier_customer_pairs(spark, sf).select("left_id", "right_id", S.rounded(F.col("score"), 6).alias("score"))


@query("""
WITH RECURSIVE e AS (SELECT r_regionkey::BIGINT AS i, n_nationkey::BIGINT AS j, ((r_regionkey * 7 + n_nationkey * 13) % 11 + 1) / 11.0::DOUBLE AS score FROM region, nation),
n AS (SELECT count(*) AS n FROM region), r AS (SELECT i, row_number() OVER (ORDER BY i) AS row FROM (SELECT DISTINCT i FROM e)),
u AS (SELECT row, j, score, row_number() OVER (PARTITION BY row ORDER BY score DESC, j) AS k FROM e JOIN r USING (i) WHERE score > 0.5),
walk(row, used, total) AS (
  SELECT 0::BIGINT, []::BIGINT[], 0.0::DOUBLE
  UNION ALL (
    SELECT walk.row + 1, list_append(used, j), total + score - 0.5 FROM walk JOIN u ON u.row = walk.row + 1 AND u.k <= (SELECT n FROM n) AND NOT list_contains(used, j)
    UNION ALL SELECT row + 1, used, total FROM walk WHERE row < (SELECT n FROM n)))
SELECT round(max(total), 6) AS gain FROM walk""")
def entity_assignment(spark, sf):
    """Of n rows none needs more than its n best columns, so the SQL walks these only."""
    return _assignment_gain(load(spark, sf, "region"), load(spark, sf, "nation"))


@query("""
WITH RECURSIVE e AS (SELECT r_regionkey::BIGINT AS i, n_nationkey::BIGINT AS j, ((r_regionkey * 3 + n_nationkey * 5) % 8 + 1) / 8.0::DOUBLE AS score FROM region, nation),
n AS (SELECT count(*) AS n FROM region), r AS (SELECT i, row_number() OVER (ORDER BY i DESC) AS row FROM (SELECT DISTINCT i FROM e)),
u AS (SELECT row, j, score, row_number() OVER (PARTITION BY row ORDER BY score DESC, j) AS k FROM e JOIN r USING (i) WHERE score > 0.5),
walk(row, path, total) AS (
  SELECT 0::BIGINT, []::BIGINT[], 0.0::DOUBLE
  UNION ALL (
    SELECT walk.row + 1, list_append(path, j), total + score - 0.5 FROM walk JOIN u ON u.row = walk.row + 1 AND u.k <= (SELECT n FROM n) AND NOT list_contains(path, j)
    UNION ALL SELECT row + 1, list_append(path, 1000000), total FROM walk WHERE row < (SELECT n FROM n))),
best AS (SELECT path FROM walk WHERE row = (SELECT n FROM n) ORDER BY total DESC, path LIMIT 1),
x AS (SELECT unnest(path) AS j, generate_subscripts(path, 1) AS row FROM best)
SELECT r.i AS left_id, x.j AS right_id, e.score FROM x JOIN r USING (row) JOIN e ON e.i = r.i AND e.j = x.j""")
def assignment_choice(spark, sf):
    """The choice itself, among many equally good ones: the first from the last row up, columns ascending."""
    r = load(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("left_id"))
    n = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("right_id"))
    score = ((F.col("left_id") * 3 + F.col("right_id") * 5) % 8 + 1) / F.lit(8.0)
    return assign(r.join(n, how="cross").withColumn("score", score), 0.5)


def _assignment_gain(regions, nations):
    r = regions.select(F.col("r_regionkey").cast("long").alias("left_id"))
    n = nations.select(F.col("n_nationkey").cast("long").alias("right_id"))
    score = ((F.col("left_id") * 7 + F.col("right_id") * 13) % 11 + 1) / F.lit(11.0)
    chosen = assign(r.join(n, how="cross").withColumn("score", score), 0.5)
    return chosen.agg(F.round(F.sum(F.col("score") - 0.5), 6).alias("gain"))


_BEAM = 1000
_EDGES = "SELECT r_regionkey::BIGINT AS i, n_nationkey::BIGINT AS j, ((r_regionkey * 7 + n_nationkey * 13) % 8 + 1) / 8.0::DOUBLE AS score FROM region, nation"


def _beam_step(k: int) -> str:
    """One round of the beam in SQL: rows of the k-th last region, after the cut with ties."""
    return f"""
k{k} AS (SELECT * FROM p{k - 1} QUALIFY rank() OVER (ORDER BY value DESC) <= {_BEAM}),
p{k} AS (
  SELECT value + score AS value, list_append(path, j) AS path FROM k{k} JOIN e ON e.row = {k} AND NOT list_contains(path, j)
  UNION ALL SELECT value + 0.375, list_append(path, 99) FROM k{k})"""


@query(f"""
WITH a AS ({_EDGES}), e AS (SELECT dense_rank() OVER (ORDER BY i DESC) AS row, i, j, score FROM a WHERE score > 0.375),
p0 AS (SELECT 0.0::DOUBLE AS value, []::BIGINT[] AS path),{",".join(_beam_step(k) for k in range(1, 6))},
b AS (SELECT path FROM p5 ORDER BY value DESC, path LIMIT 1),
x AS (SELECT unnest(path) AS j, generate_subscripts(path, 1) AS row FROM b)
SELECT e.i AS left_id, e.j AS right_id, e.score FROM x JOIN e USING (row, j)""")
def beam_assignment(spark, sf):
    """A beam of partial assignments over regions and nations, with thousands of live paths and cuts with ties."""
    r = load(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("left_id"))
    n = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("right_id"))
    score = ((F.col("left_id") * 7 + F.col("right_id") * 13) % 8 + 1) / F.lit(8.0)
    return beam_rounds(r.join(n, how="cross").withColumn("score", score), 0.375, _BEAM)


def _merge_inputs(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))
    m = s.where("s_suppkey % 2 = 0").join(c.where("c_custkey % 3 = 0"), F.col("s_suppkey") == F.col("c_custkey") / 3).select(F.col("s_suppkey").alias("left_id"), F.col("c_custkey").alias("right_id"))
    return s, c, m


_MAP = "WITH m AS (SELECT s_suppkey AS l, c_custkey AS r FROM supplier JOIN customer ON c_custkey % 3 = 0 AND s_suppkey % 2 = 0 AND s_suppkey = c_custkey / 3)"


@query(_MAP + """
SELECT s_name AS name, s_nationkey::VARCHAR AS nation, c_mktsegment AS segment FROM supplier LEFT JOIN m ON s_suppkey = l LEFT JOIN customer ON r = c_custkey
UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT r FROM m)""")
def left_preferred_merge(spark, sf):
    s, c, m = _merge_inputs(spark, sf)
    return merge.merge_tables(s, c, {"name": "title", "nation": None}, m, "s_suppkey", "c_custkey")


@query(_MAP + """
SELECT coalesce(s_suppkey, -1) AS s_suppkey, s_name AS name, coalesce(s_nationkey, -1) AS nation, coalesce(c_custkey, -1) AS c_custkey, c_name AS title, c_mktsegment AS segment
FROM (SELECT * FROM supplier LEFT JOIN m ON s_suppkey = l) FULL JOIN customer ON r = c_custkey""")
def match_audit(spark, sf):
    s, c, m = _merge_inputs(spark, sf)
    return merge.match_audit(s, c, m, "s_suppkey", "c_custkey").na.fill(-1, ["s_suppkey", "nation", "c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def unmatched_right(spark, sf):
    matches = load(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("left_id"), F.col("o_custkey").alias("right_id"))
    return merge.unmatched(load(spark, sf, "customer"), matches, "c_custkey").select("c_custkey", "c_name")


@query("""
WITH w AS (SELECT 'w' || vec_id AS word, (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS at, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.at AS i, b.at AS j, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM w a, w b""")
def word_similarity_matrix(spark, sf):
    e = load(spark, sf, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id")).alias("text"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id")
    words = placed(e.select("vec_id", "text"), "vec_id", "at").select(F.col("at").cast("int").alias("at"), "text")
    rows = embed_distinct(words, "text", "v", PrecomputedEmbedder(e.select("text", "vector")))
    cells = bertscore.similarity_cells(rows.select(F.col("at").alias("i"), F.col("v").alias("v1")), rows.select(F.col("at").alias("j"), F.col("v").alias("v2")))
    return cells.select("i", "j", S.rounded(F.col("score"), 6).alias("score"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _neighbours(spark, sf):
    e = load(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", S.cosine(F.col("embedding"), F.col("other")).alias("cos"))


@query(f"SELECT a.vec_id, round({_COS}, 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf):
    return _neighbours(spark, sf).select("vec_id", F.round("cos", 6).alias("cos"))


@query(f"SELECT a.vec_id, round(({_COS} - 0.66620487) / (1 - 0.66620487), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def rescaled_similarity(spark, sf):
    return _neighbours(spark, sf).select("vec_id", F.round(S.rescale(F.col("cos"), 0.66620487), 6).alias("score"))


def _tokens(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select((F.col("vec_id") % 50).alias("sent_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), (1 + F.col("vec_id") % 3).cast("double").alias("idf"))


def _sentence_pairs(spark, sf):
    return spark.range(25).select(F.col("id").alias("pair_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ref_id"), F.col("id").alias("cand_sent"), F.lit(None).cast("long").alias("ref_sent")).withColumn("ref_sent", (F.col("cand_sent") + 25 + F.col("ref_id")) % 50)


_PRF = """
WITH t AS (SELECT vec_id % 50 AS sent, vec_id AS pos, embedding::DOUBLE[] AS vec, 1 + vec_id % 3 AS w FROM embeddings),
pairs AS (SELECT p AS pair_id, k AS ref_id, (p + 25 + k) % 50 AS ref FROM range(25) a(p), range(2) b(k)),
cells AS (SELECT pair_id, ref_id, a.pos AS i, b.pos AS j, a.w AS w1, b.w AS w2, list_cosine_similarity(a.vec, b.vec) AS sim FROM pairs JOIN t a ON a.sent = pair_id JOIN t b ON b.sent = ref),
pr AS (SELECT pair_id, ref_id, sum(best * w1) / sum(w1) AS P FROM (SELECT pair_id, ref_id, i, any_value(w1) AS w1, max(sim) AS best FROM cells GROUP BY ALL) GROUP BY ALL),
re AS (SELECT pair_id, ref_id, sum(best * w2) / sum(w2) AS R FROM (SELECT pair_id, ref_id, j, any_value(w2) AS w2, max(sim) AS best FROM cells GROUP BY ALL) GROUP BY ALL),
prf AS (SELECT pair_id, ref_id, P, R, 2 * P * R / (P + R) AS F FROM pr JOIN re USING (pair_id, ref_id))"""


@query(_PRF + " SELECT pair_id, ref_id::INTEGER AS ref_id, round(P, 6) AS P, round(R, 6) AS R, round(F, 6) AS F FROM prf")
def greedy_prf(spark, sf):
    t = _tokens(spark, sf)
    out = bertscore.greedy_prf(_sentence_pairs(spark, sf), t, t)
    return out.select("pair_id", "ref_id", *(F.round(c, 6).alias(c) for c in "PRF"))


@query(_PRF + " SELECT pair_id, round(max(P), 6) AS P, round(max(R), 6) AS R, round(max(F), 6) AS F FROM prf GROUP BY pair_id")
def multi_ref_best(spark, sf):
    t = _tokens(spark, sf)
    best = bertscore.best_of_references(bertscore.greedy_prf(_sentence_pairs(spark, sf), t, t))
    return best.select("pair_id", *(F.round(c, 6).alias(c) for c in "PRF"))


@query("""
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)
SELECT label, d::INTEGER AS d, round(avg(v), 6) AS mean FROM x GROUP BY ALL""")
def word_embedding_mean(spark, sf):
    means = bertscore.word_embeddings(load(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec")), ["label"])
    return means.select("label", F.posexplode("vec").alias("d0", "mean")).select("label", (F.col("d0") + 1).alias("d"), F.round("mean", 6).alias("mean"))


@query("""
WITH t AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents)
SELECT token, round(ln((n + 1) / (count(*) + 1)), 6) AS idf FROM t, n GROUP BY token, n""")
def token_idf(spark, sf):
    t = load(spark, sf, "documents").select(F.col("doc_id").alias("sent_id"), F.explode(F.split("text", " ")).alias("token"))
    return bertscore.token_idf(t).select("token", F.round("idf", 6).alias("idf"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -3) DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE k = 1""")
def argmax_first_tie(spark, sf):
    return first_best(load(spark, sf, "orders").withColumn("thousands", F.round("o_totalprice", -3)), ["o_custkey"], "thousands", ["o_orderkey"])


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -5) DESC) AS k FROM orders) WHERE k <= 3""")
def beam_cut(spark, sf):
    return best_with_ties(load(spark, sf, "orders").withColumn("value", F.round("o_totalprice", -5)), ["o_custkey"], "value", 3).select("o_orderkey")


@query("""SELECT o_orderkey::VARCHAR AS o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS price, strftime(o_orderdate, '%B %-d, %Y') AS day FROM orders""")
def restored_formats(spark, sf):
    """Orders of two sources that write money and dates in their own ways: both in standard form, stacked, then shown in the first one's formats."""
    o = load(spark, sf, "orders")
    two = F.col("o_totalprice").cast("decimal(18,2)")
    first = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.concat(F.lit("$"), F.format_number(two, 2)).alias("price"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("day"))
    second = o.where("o_orderkey % 2 = 1").select("o_orderkey", two.cast("string").alias("price"), F.date_format("o_orderdate", "yyyy/M/d").alias("day"))
    kinds = {"price": "money", "day": "date"}
    known = formats.plan_formats(first, kinds)
    stacked = merge.stack(formats.standard_table(first, known), formats.standard_table(second, formats.plan_formats(second, kinds)))
    return formats.restore_table(stacked, known)


@query("""
WITH p AS (SELECT p_partkey, p_name AS cand, unnest([lower(p_type), reverse(p_name)]) AS ref FROM part),
u AS (SELECT DISTINCT cand, ref FROM p), s AS (SELECT cand AS text FROM u UNION SELECT ref FROM u),
t AS (SELECT text, unnest(k.l) AS token, generate_subscripts(k.l, 1) AS pos FROM (SELECT text, list_concat(['[CLS]'], string_split(text, ' '), ['[SEP]']) AS l FROM s) k),
v AS (SELECT text, pos, (token NOT IN ('[CLS]', '[SEP]'))::INT AS w, [(length(lower(token)) - length(replace(lower(token), chr(i::INTEGER), '')))::DOUBLE FOR i IN range(97, 123)] AS vec FROM t),
c AS (SELECT cand, ref, a.pos AS i, b.pos AS j, a.w AS w1, b.w AS w2, list_cosine_similarity(a.vec, b.vec) AS sim FROM u JOIN v a ON a.text = cand JOIN v b ON b.text = ref),
x AS (SELECT cand, ref, sum(best * w) / sum(w) AS P FROM (SELECT cand, ref, i, any_value(w1) AS w, max(sim) AS best FROM c GROUP BY ALL) GROUP BY ALL),
y AS (SELECT cand, ref, sum(best * w) / sum(w) AS R FROM (SELECT cand, ref, j, any_value(w2) AS w, max(sim) AS best FROM c GROUP BY ALL) GROUP BY ALL)
SELECT p_partkey AS pair_id, round(max(P), 6) AS P, round(max(R), 6) AS R, round(max(2 * P * R / (P + R)), 6) AS F FROM p JOIN x USING (cand, ref) JOIN y USING (cand, ref) GROUP BY p_partkey""")
def text_scores(spark, sf):
    """Names of parts against two references each, by the letters of their words."""
    part = load(spark, sf, "part")
    pairs = part.select(F.col("p_partkey").alias("pair_id"), F.col("p_name").alias("candidate"), F.array(F.lower("p_type"), F.reverse("p_name")).alias("references"))
    words = pairs.select(F.explode(F.concat(F.array("candidate"), "references")).alias("t")).select(F.explode(F.concat(F.split("t", " "), F.array(F.lit("[CLS]"), F.lit("[SEP]")))).alias("text")).distinct()
    letters = F.array(*((F.length("text") - F.length(F.replace(F.lower("text"), F.lit(ch), F.lit("")))).cast("double") for ch in "abcdefghijklmnopqrstuvwxyz"))
    out = bertscore.score(pairs, bertscore.ScorerConfig(PrecomputedEmbedder(words.select("text", letters.alias("vector")))))
    return out.select("pair_id", *(F.round(c, 6).alias(c) for c in "PRF"))


@query()
def integrate_flagship(spark, sf):
    config = Config(schema_map={"s_name": "c_name", "s_acctbal": "c_acctbal"}, kinds=_KINDS, standardize=False, clean=False)
    s = load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return integrate(s, c, config, "s_suppkey", "c_custkey").merged
