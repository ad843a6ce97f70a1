"""Queries over links, properties, recorded answers, clicks and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.functions import strings as st
from tessella.operators import codebooks, lookups, parts_model, sessions
from tessella.plans import views
from tessella.plans.game_queries import r6
from tessella.plans.views import cte
from tessella.session import table

C = F.col
# What kind of question a property makes, and of which part.
PROPERTIES = {"STANDARD": ("batch", "head"), "SMALL": ("multiple", "tail"), "MEDIUM": ("multiple", "wing"), "LARGE": ("batch", "head"), "ECONOMY": ("multiple", "back")}


def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "customer").select(C("c_custkey").alias("source"), F.when(C("c_custkey") % 7 == 0, None).when(C("c_custkey") % 5 == 0, F.concat(F.lit("NO "), C("c_mktsegment"))).otherwise(C("c_mktsegment")).alias("name"))
    entities = table(spark, d, "customer").groupBy(C("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("id"))
    return lookups.resolved(links, entities)


def j3(spark, d):
    return resolved_links(spark, d).withColumn("id", C("id").cast("string"))


def j3_lost(spark, d):
    return lookups.unresolved(resolved_links(spark, d)).groupBy("name").agg(F.count("*").alias("n"))


def j4(spark, d):
    attributes = table(spark, d, "part").groupBy(F.concat_ws("::", F.split_part("p_type", F.lit(" "), F.lit(1)), F.substring_index("p_type", " ", -2)).alias("name")).agg(F.min("p_partkey").alias("attribute"))
    properties = spark.createDataFrame([(k, *v) for k, v in PROPERTIES.items()], "property string, kind string, part string")
    return lookups.property_questions(attributes, properties)


def choices(spark: SparkSession) -> DataFrame:
    return spark.range(views.ATTRIBUTES).select(F.floor(C("id") / 4).cast("int").alias("question"), C("id").cast("int").alias("attribute"), (C("id") % 4).cast("int").alias("position"))


def b9(spark, d):
    out = lookups.chosen_answers(views.responses(spark, d), choices(spark))
    return out.withColumn("seconds", r6(C("seconds")))


def b9_batch(spark, d):
    told = lookups.batch_told(views.responses(spark, d), choices(spark))
    return told.select("example", "question", F.array_join(F.transform("told", lambda t: F.concat_ws(":", t["attribute"], t["answer"], t["certainty"])), ",").alias("told"))


def clicks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.groupBy(C("l_orderkey").alias("object"), C("l_linenumber").alias("part"), C("l_suppkey").alias("user")).agg(F.min(C("l_extendedprice") % 640).alias("x"), F.min((C("l_partkey") % 480).cast("double")).alias("y"))


def j13(spark, d):
    out = lookups.click_errors(clicks(spark, d), views.parts(spark, d))
    return out.select("object", "part", "user", *[r6(C(c)).alias(c) for c in ("dx", "dy", "distance")])


def f1(spark, d):
    first = lookups.first_user(clicks(spark, d).withColumnRenamed("object", "example"))
    return first.select("example", "part", "user")


def j15(spark, d):
    e = table(spark, d, "events").groupBy(C("user_id").alias("user"), (C("event_id") % 50).alias("image")).agg(F.min("event_id").alias("at"), F.max("value").alias("loss"))
    return lookups.user_losses(e.select("user", "image", "at"), e.where("image < 40").select("user", "image", "loss")).withColumnRenamed("user", "who")


def j16(spark, d):
    links = table(spark, d, "embeddings").groupBy(C("label").alias("source"), (C("vec_id") % 12).cast("int").alias("target")).agg(F.count("*").alias("value"))
    nodes = table(spark, d, "nation").select(C("n_nationkey").alias("id"), C("n_name").alias("name"), C("n_regionkey").alias("group")).where("id < 11")
    return lookups.linked_nodes(links, nodes)


def a24(spark, d):
    p = views.parts(spark, d).where("visible = 1")
    q = p.select(C("object").alias("o"), (C("part") - 1).alias("q"), C("x").alias("qx"), C("y").alias("qy"))
    offsets = p.join(q, (p["object"] == C("o")) & (p["part"] == C("q"))).select("part", (C("qx") - C("x")).alias("dx"), (C("qy") - C("y")).alias("dy"))
    out = lookups.offset_bounds(offsets, ["part"])
    return out.select("part", "n", *[r6(C(c)).alias(c) for c in ("mean_x", "mean_y", "most_x", "most_y")])


def a27(spark, d):
    return lookups.summary({"class": (table(spark, d, "embeddings"), "label"), "part": (views.parts(spark, d).where("visible = 1"), "part"), "kind": (views.log(spark, d), "kind")})


def b15(spark, d):
    p = views.parts(spark, d).where("visible = 1").select((C("object") % 10).alias("class"), C("object").alias("image"), "part", "x", "y")
    wanted = p.where("image <= 40").select(C("image").alias("session"), (C("image") * 3 % 10).alias("class"), "part", "x", "y")
    out = lookups.nearest_images(p.where("image > 40"), wanted)
    return out.select("session", "class", "image", r6(C("distance")).alias("distance"))


def s_case(spark, d):
    return table(spark, d, "customer").select("c_custkey", st.upper_case(F.concat(C("c_name"), F.lit(" é"))).alias("up"), st.lower_case(C("c_mktsegment")).alias("low"))


def s_full(spark, d):
    url = C("url")
    paths = F.when(C("page_id") % 3 == 0, F.concat(F.lit("/root/"), url)).when(C("page_id") % 3 == 1, F.concat(F.lit("c:/"), url)).otherwise(url)
    return table(spark, d, "pages").select("page_id", st.full_path(paths, F.lit("/home/x")).alias("path"))


def s_safe(spark, d):
    return table(spark, d, "pages").select("page_id", st.safe_name(C("url")).alias("name"), st.user_and_image(F.regexp_replace("url", "[/:.]", "_")).getField("user").alias("user"), st.user_and_image(F.regexp_replace("url", "[/:.]", "_")).getField("image").alias("image"))


def s_valid(spark, d):
    t = table(spark, d, "customer")
    return t.select("c_custkey", st.valid_species(C("c_name")).alias("name_ok"), st.valid_species(C("c_mktsegment")).alias("segment_ok"), st.valid_count(C("c_custkey").cast("string")).alias("key_ok"), st.valid_count(C("c_acctbal").cast("string")).alias("balance_ok"))


def s_enum(spark, d):
    t = table(spark, d, "part").select("p_partkey", (C("p_size") % 14).cast("int").alias("number"))
    name = names.name_of(C("number"), names.OPTIMISATION)
    written = F.when(C("p_partkey") % 11 == 0, "online_dual_update").otherwise(name)
    return t.select("p_partkey", name.alias("name"), names.number_of(written, names.OPTIMISATION, names.ALIASES).cast("string").alias("back"), names.name_of(C("number"), names.DETECTION_LOSS).alias("loss"))


def s_meta(spark, d):
    t = table(spark, d, "supplier")
    whole = names.with_meta(F.create_map(F.lit("Latin"), C("s_name"), F.lit("Order"), F.lit("x")), "Order", C("s_nationkey"))
    whole = names.with_meta(whole, "Family", F.when(C("s_suppkey") % 2 == 0, C("s_suppkey")))
    return t.select("s_suppkey", names.meta(whole, "Latin").alias("latin"), names.meta(whole, "Order").alias("order_"), names.meta(whole, "Family").alias("family"), names.meta(whole, "Genus").alias("genus"), F.size(whole).alias("n"))


def part_boxes(spark: SparkSession, d: str) -> DataFrame:
    return views.boxes(spark, d).select("object", "part", "x", "y", "w", "h", ((C("object") + C("part")) % 7 > 0).cast("int").alias("visible"))


def m26(spark, d):
    t = part_boxes(spark, d)
    p = t.withColumns({"x": C("x") + C("part") * 3, "y": C("y") - C("object") % 4, "visible": ((C("object") + C("part")) % 5 > 0).cast("int")})
    out = None
    for kind in names.DETECTION_LOSS:
        part = parts_model.part_losses(p, t, kind, 8.0, 3.0).select("object", F.lit(kind).alias("kind"), r6(C("loss")).alias("loss"))
        out = part if out is None else out.unionByName(part)
    return out


def m12_assign(spark, d):
    p = views.parts(spark, d)
    pivot = p.where("part = 1").select(C("object").alias("o"), C("x").alias("px"), C("y").alias("py"))
    offsets = p.join(pivot, C("object") == C("o")).select("object", "part", (C("x") - C("px")).alias("dx"), (C("y") - C("py")).alias("dy"), "visible")
    centres = offsets.where("object <= 6").select(C("object").alias("cluster"), "part", "dx", "dy", "visible")
    return codebooks.pose_clusters(offsets, centres, 5000.0).select("object", "cluster", r6(C("cost")).alias("cost"))


def k15(spark, d):
    return sessions.session_documents(views.log(spark, d))


def x13_open(spark, d):
    e = table(spark, d, "events").select(C("user_id").cast("string").alias("session_id"), "event_id")
    open_ = e.where("event_id < 200").groupBy("session_id").agg(F.min("event_id").alias("started"))
    return sessions.found_or_created(open_, e.where("event_id >= 200 and event_id < 400"), 400)


_BOXES = """, t AS (SELECT object, part, x, y, w, h, ((object + part) % 7 > 0)::INT AS v FROM boxes),
    m AS (SELECT object, part, x + part * 3 AS px, y - object % 4 AS py, x, y, w, h, ((object + part) % 5 > 0)::INT AS pv, v,
      greatest(least(px + w, x + w) - greatest(px, x), 0) * greatest(least(py + h, y + h) - greatest(py, y), 0) AS shared, sqrt((px - x) ** 2 + (py - y) ** 2) AS far FROM t),
    o AS (SELECT object, min(CASE WHEN pv = 1 THEN px END) AS a, min(CASE WHEN pv = 1 THEN py END) AS b, max(CASE WHEN pv = 1 THEN px + w END) AS c, max(CASE WHEN pv = 1 THEN py + h END) AS d,
      min(CASE WHEN v = 1 THEN x END) AS ta, min(CASE WHEN v = 1 THEN y END) AS tb, max(CASE WHEN v = 1 THEN x + w END) AS tc, max(CASE WHEN v = 1 THEN y + h END) AS td FROM m GROUP BY 1),
    i AS (SELECT *, greatest(least(c, tc) - greatest(a, ta), 0) * greatest(least(d, td) - greatest(b, tb), 0) AS s FROM o),
    u AS (SELECT object, CASE WHEN a IS NULL AND ta IS NULL THEN 1 WHEN a IS NULL OR ta IS NULL THEN 0 ELSE coalesce(s / nullif((c - a) * (d - b) + (tc - ta) * (td - tb) - s, 0), 0) END AS overlap FROM i) """
_LOSS = ", ".join(f"'{n}'" for n in names.DETECTION_LOSS)
_OPT = ", ".join(f"'{n}'" for n in names.OPTIMISATION)
_J3 = """WITH l AS (SELECT c_custkey AS source, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'NO ' || c_mktsegment ELSE c_mktsegment END AS name FROM customer),
    e AS (SELECT c_mktsegment AS name, min(c_custkey) AS id FROM customer GROUP BY 1),
    r AS (SELECT source, l.name, CASE WHEN l.name IS NOT NULL THEN coalesce(id, -1) END AS id FROM l LEFT JOIN e ON l.name = e.name) """
_CLICKS = "clicks AS (SELECT l_orderkey AS object, l_linenumber AS part, l_suppkey AS user, min(l_extendedprice % 640) AS x, min((l_partkey % 480)::DOUBLE) AS y FROM lineitem GROUP BY 1, 2, 3)"

QUERIES = {
    "j3_resolve_links": (j3, _J3 + "SELECT source, name, id::VARCHAR AS id FROM r"),
    "j3_lost_links": (j3_lost, _J3 + "SELECT name, count(*) AS n FROM r WHERE id = -1 GROUP BY 1"),
    "j4_property_questions": (j4, "WITH a AS (SELECT split_part(p_type, ' ', 1) AS question, array_to_string(split(p_type, ' ')[-2:], ' ') AS rest, min(p_partkey) AS attribute FROM part GROUP BY 1, 2), k(question, kind, part) AS (VALUES "
        + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in PROPERTIES.items()) + ") SELECT question, kind, part, attribute, (row_number() OVER (PARTITION BY question ORDER BY attribute) - 1)::INT AS position FROM a JOIN k USING (question)"),
    "b9_test_answers": (b9, cte("responses") + """, m AS (SELECT *, (attribute // 4)::INT AS question FROM responses),
        g AS (SELECT example, question, max(CASE WHEN answer = 1 THEN attribute END) AS said FROM m GROUP BY 1, 2)
        SELECT g.example, g.question, CASE WHEN said IS NULL THEN m.answer ELSE said END AS answer, CASE WHEN said IS NULL THEN 0 ELSE m.certainty END AS certainty, round(m.seconds, 6) AS seconds
        FROM g JOIN m ON m.example = g.example AND m.attribute = coalesce(said, g.question * 4)"""),
    "b9_batch_answers": (b9_batch, cte("responses") + " SELECT example, (attribute // 4)::INT AS question, string_agg(attribute || ':' || answer || ':' || certainty, ',' ORDER BY attribute) AS told FROM responses GROUP BY 1, 2"),
    "j13_click_errors": (j13, cte("parts") + f", {_CLICKS}" + """ SELECT c.object, c.part, c.user, CASE WHEN visible = 1 THEN round(c.x - p.x, 6) + 0 END AS dx, CASE WHEN visible = 1 THEN round(c.y - p.y, 6) + 0 END AS dy,
        CASE WHEN visible = 1 THEN round(sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2), 6) END AS distance FROM clicks c JOIN parts p USING (object, part)"""),
    "b9_first_user": (f1, f"WITH {_CLICKS} SELECT object AS example, part, user FROM clicks QUALIFY user = min(user) OVER (PARTITION BY object)"),
    "j15_user_losses": (j15, """WITH e AS (SELECT user_id AS who, event_id % 50 AS image, min(event_id) AS seen, max(value) AS loss FROM events GROUP BY 1, 2)
        SELECT who, (row_number() OVER (PARTITION BY who ORDER BY seen, image) - 1)::INT AS place, image, CASE WHEN image < 40 THEN loss END AS loss FROM e"""),
    "j16_linked_nodes": (j16, """WITH l AS (SELECT label AS source, (vec_id % 12)::INT AS target, count(*) AS value FROM embeddings GROUP BY 1, 2)
        SELECT source, target, value, a.n_name AS source_name, a.n_regionkey AS source_group, b.n_name AS target_name, b.n_regionkey AS target_group FROM l JOIN nation a ON a.n_nationkey = source JOIN nation b ON b.n_nationkey = target AND target < 11 AND source < 11"""),
    "a24_offset_bounds": (a24, cte("parts") + """, p AS (SELECT * FROM parts WHERE visible = 1), o AS (SELECT p.part, q.x - p.x AS dx, q.y - p.y AS dy FROM p JOIN p q ON q.object = p.object AND q.part = p.part + 1),
        m AS (SELECT part, count(*) AS n, avg(dx) AS mx, avg(dy) AS my FROM o GROUP BY 1)
        SELECT part, n, round(mx, 6) + 0 AS mean_x, round(my, 6) + 0 AS mean_y, round(max(abs(dx - mx)), 6) AS most_x, round(max(abs(dy - my)), 6) AS most_y FROM o JOIN m USING (part) GROUP BY part, n, mx, my"""),
    "a27_summary": (a27, cte("parts", "log") + """ SELECT 'class' AS kind, label::VARCHAR AS name, count(*) AS n FROM embeddings GROUP BY 2 UNION ALL SELECT 'part', part::VARCHAR, count(*) FROM parts WHERE visible = 1 GROUP BY 2
        UNION ALL SELECT 'kind', kind, count(*) FROM log GROUP BY 2"""),
    "b15_nearest_images": (b15, cte("parts") + """, p AS (SELECT object % 10 AS class, object AS image, part, x, y FROM parts WHERE visible = 1),
        w AS (SELECT image AS session, image * 3 % 10 AS class, part, x, y FROM p WHERE image <= 40)
        SELECT session, class, image, round(distance, 6) AS distance FROM (SELECT session, p.class, p.image, round(avg((p.x - w.x) ** 2 + (p.y - w.y) ** 2), 9) AS distance FROM w JOIN p ON p.class = w.class AND p.part = w.part AND p.image > 40 GROUP BY 1, 2, 3)
        QUALIFY row_number() OVER (PARTITION BY session, class ORDER BY distance, image) = 1"""),
    "m26_part_losses": (m26, cte("boxes") + _BOXES + """
        SELECT object, 'intersection_parts' AS kind, round(avg(CASE WHEN pv = 1 AND v = 1 THEN 1 - coalesce(shared / nullif(2 * w * h - shared, 0), 0) WHEN pv <> 1 AND v <> 1 THEN 0 ELSE 1 END), 6) + 0 AS loss FROM m GROUP BY 1
        UNION ALL SELECT object, 'num_click_std_dev', round(avg(CASE WHEN pv = 1 AND v = 1 THEN least(far / 8, 3) WHEN pv <> 1 AND v <> 1 THEN 0 ELSE 3 END), 6) + 0 FROM m GROUP BY 1
        UNION ALL SELECT object, 'num_parts_incorrect', round(avg(CASE WHEN pv = 1 AND v = 1 THEN (far > 8)::INT WHEN pv <> 1 AND v <> 1 THEN 0 ELSE 1 END), 6) + 0 FROM m GROUP BY 1
        UNION ALL SELECT object, 'intersection_object', round(1 - overlap, 6) + 0 FROM u UNION ALL SELECT object, 'detection', (overlap < 0.5)::INT FROM u"""),
    "m12_pose_assignment": (m12_assign, cte("parts") + """, o AS (SELECT p.object, p.part, p.x - q.x AS dx, p.y - q.y AS dy, p.visible AS v FROM parts p JOIN parts q ON q.object = p.object AND q.part = 1),
        c AS (SELECT o.object, k.object AS cluster, round(sum(CASE WHEN o.v = 1 AND k.v = 1 THEN (o.dx - k.dx) ** 2 + (o.dy - k.dy) ** 2 WHEN o.v <> k.v THEN 5000 ELSE 0 END), 6) AS cost FROM o JOIN o k ON k.part = o.part AND k.object <= 6 GROUP BY 1, 2)
        SELECT object, cluster, cost FROM c QUALIFY row_number() OVER (PARTITION BY object ORDER BY cost, cluster) = 1"""),
    "k15_session_documents": (k15, cte("log") + """, k AS (SELECT user_id, kind, string_agg('{' || CASE WHEN question IS NULL THEN '' ELSE '"id":"' || question || '",' END || '"time":"' || at_ms || '"}', ',' ORDER BY at_ms, event_id) AS rows FROM log GROUP BY 1, 2)
        SELECT user_id, '{' || string_agg('"' || kind || '":[' || rows || ']', ',' ORDER BY kind) || '}' AS document FROM k GROUP BY 1"""),
    "r22_find_or_create": (x13_open, """WITH o AS (SELECT user_id::VARCHAR AS session_id, min(event_id) AS started FROM events WHERE event_id < 200 GROUP BY 1)
        SELECT session_id, started FROM o UNION ALL SELECT DISTINCT user_id::VARCHAR, 400 FROM events WHERE event_id >= 200 AND event_id < 400 AND user_id::VARCHAR NOT IN (SELECT session_id FROM o)"""),
    "s_case": (s_case, "SELECT c_custkey, upper(c_name) || ' é' AS up, lower(c_mktsegment) AS low FROM customer"),
    "s_full_path": (s_full, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/root/' || url WHEN 1 THEN 'c:/' || url ELSE '/home/x/' || url END AS path FROM pages"),
    "s_safe_name": (s_safe, r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS name, split_part(regexp_replace(url, '[/:.]', '_', 'g'), '_', 1) AS user, split_part(regexp_replace(url, '[/:.]', '_', 'g'), '_', 2) AS image FROM pages"),
    "s_validation": (s_valid, r"SELECT c_custkey, regexp_matches(c_name, '^[a-zA-Z''\- ]+$') AS name_ok, regexp_matches(c_mktsegment, '^[a-zA-Z''\- ]+$') AS segment_ok, true AS key_ok, regexp_matches(c_acctbal::VARCHAR, '^[0-9]+$') AS balance_ok FROM customer"),
    "s_enum_names": (s_enum, f"""WITH t AS (SELECT p_partkey, coalesce(([{_OPT}])[p_size % 14 + 1], 'unknown') AS name, coalesce(([{_LOSS}])[p_size % 14 + 1], 'unknown') AS loss FROM part)
        SELECT p_partkey, name, CASE WHEN p_partkey % 11 = 0 THEN 4 ELSE nullif(list_position([{_OPT}], name), 0) - 1 END::INT::VARCHAR AS back, loss FROM t"""),
    "s_metadata": (s_meta, "SELECT s_suppkey, s_name AS latin, s_nationkey::VARCHAR AS order_, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR END AS family, NULL::VARCHAR AS genus, 3 AS n FROM supplier"),
}
