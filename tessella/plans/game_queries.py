"""Queries over the response model and the question game, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import probability as prob
from tessella.operators import evaluation, game, mixed_game
from tessella.operators import response_model as rm
from tessella.plans import views
from tessella.plans.views import cte
from tessella.session import table


def r6(x):
    """Six digits, and no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


MODEL = (
    cte("responses")
    + """,
counts AS (SELECT class, attribute, certainty, count(*) AS n, sum(answer)::BIGINT AS n1 FROM responses GROUP BY 1, 2, 3),
dense AS (
  SELECT c.class, a.attribute, k.certainty, coalesce(t.n, 0) AS n, coalesce(t.n1, 0) AS n1,
    ([32.0, 16.0, 8.0, 4.0])[k.certainty + 1]::DOUBLE AS beta,
    4.5::DOUBLE / (([32.0, 16.0, 8.0, 4.0])[k.certainty + 1]::DOUBLE + 0.5::DOUBLE) AS weight,
    (SELECT count(DISTINCT example) FROM responses) AS sets
  FROM (SELECT DISTINCT class FROM counts) c CROSS JOIN (SELECT DISTINCT attribute FROM counts) a
  CROSS JOIN (SELECT unnest(range(4))::INT AS certainty) k
  LEFT JOIN counts t ON t.class = c.class AND t.attribute = a.attribute AND t.certainty = k.certainty),
sums AS (
  SELECT *, sum(n1) OVER (PARTITION BY attribute, certainty) / sets AS glob1, sum(n - n1) OVER (PARTITION BY attribute, certainty) / sets AS glob0,
    sum(weight * n) OVER (PARTITION BY class, attribute) AS nac, sum(weight * n1) OVER (PARTITION BY class, attribute) AS wac,
    sum(weight * n) OVER (PARTITION BY attribute) AS na, sum(weight * n1) OVER (PARTITION BY attribute) AS wa
  FROM dense),
model AS (
  SELECT class, attribute, certainty, weight,
    (wac / (nac + 1e-7) * least(10, nac) + glob1 * least(beta, sets) + n1) / (least(10, nac) + least(beta, sets) + n + 1e-7) AS pos,
    ((1 - wac / (nac + 1e-7)) * least(10, nac) + glob0 * least(beta, sets) + n - n1) / (least(10, nac) + least(beta, sets) + n + 1e-7) AS neg,
    (wac / (nac + 1e-7) * nac + least(10, na) * wa / na) / (nac + least(10, na) + 1e-7) AS p
  FROM sums)
"""
)

PRIORS = """,
early AS (SELECT example AS session, m.class, CASE WHEN answer = 1 THEN p ELSE 1 - p END AS q, weight FROM responses r JOIN model m USING (attribute, certainty) WHERE attribute % 4 = 0),
early_terms AS (SELECT session, class, sum(CASE WHEN q > 0 THEN weight * ln(q) ELSE 0 END) AS logit, max((q <= 0)::INT) AS none FROM early GROUP BY 1, 2),
early_mass AS (SELECT *, CASE WHEN none = 0 THEN exp(logit - max(CASE WHEN none = 0 THEN logit END) OVER (PARTITION BY session)) ELSE 0 END AS m FROM early_terms),
priors AS (SELECT session, class, m / sum(m) OVER (PARTITION BY session) AS p FROM early_mass)
"""

FEW_PRIORS = """,
raw AS (SELECT s::INT AS session, class, (1 + (class * 7 + s * 3) % 5)::DOUBLE AS w FROM (SELECT DISTINCT class FROM model) CROSS JOIN (SELECT unnest(range(5)) AS s)),
priors AS (SELECT session, class, w / sum(w) OVER (PARTITION BY session) AS p FROM raw)
"""

JOINT = """,
joint AS (
  SELECT session, attribute, certainty, answer, class,
    priors.p * CASE WHEN q > 0 THEN exp(weight * ln(q)) ELSE 0 END AS u
  FROM priors JOIN (SELECT *, CASE WHEN answer = 1 THEN p ELSE 1 - p END AS q FROM model CROSS JOIN (SELECT unnest([0, 1]) AS answer)) m USING (class)),
answers AS (SELECT session, attribute, certainty, answer, sum(u) AS mass, sum(CASE WHEN u > 0 THEN u * ln(u) ELSE 0 END) AS ulnu FROM joint GROUP BY 1, 2, 3, 4),
expected AS (SELECT session, attribute, sum(CASE WHEN mass > 0 THEN mass * ln(mass) - ulnu ELSE 0 END) / sum(mass) AS expected_entropy FROM answers GROUP BY 1, 2)
"""

POSTERIOR = """,
told AS (SELECT example AS session, m.class, CASE WHEN answer = 1 THEN p ELSE 1 - p END AS q, weight FROM responses r JOIN model m USING (attribute, certainty)),
terms AS (SELECT session, class, sum(CASE WHEN q > 0 THEN weight * ln(q) ELSE 0 END) AS logit, max((q <= 0)::INT) AS none FROM told GROUP BY 1, 2),
mass AS (SELECT *, CASE WHEN none = 0 THEN exp(logit - max(CASE WHEN none = 0 THEN logit END) OVER (PARTITION BY session)) ELSE 0 END AS m FROM terms),
post AS (SELECT session, class, m / sum(m) OVER (PARTITION BY session) AS p FROM mass)
"""


def model_of(spark: SparkSession, d: str) -> DataFrame:
    return rm.response_model(views.responses(spark, d))


def priors_of(spark: SparkSession, d: str, model: DataFrame) -> DataFrame:
    """(session, class, p): every session after the answers to every fourth attribute."""
    answers = views.responses(spark, d).where("attribute % 4 = 0").select(F.col("example").alias("session"), "attribute", "answer", "certainty")
    return game.posterior(answers, model)


def few_priors(model: DataFrame) -> DataFrame:
    """(session, class, p) of five made-up sessions, for questions whose answers are drawn by the hundred."""
    raw = model.select("class").distinct().withColumn("session", F.explode(F.sequence(F.lit(0), F.lit(4))))
    raw = raw.withColumn("w", (1 + (F.col("class") * 7 + F.col("session") * 3) % 5).cast("double"))
    return raw.select("session", "class", prob.normalise(F.col("w"), "session").alias("p"))


def posterior_of(spark: SparkSession, d: str) -> DataFrame:
    answers = views.responses(spark, d).select(F.col("example").alias("session"), "attribute", "answer", "certainty")
    return game.posterior(answers, model_of(spark, d))


def a1(spark, d):
    m = model_of(spark, d)
    return m.select("class", "attribute", "certainty", *[r6(c).alias(c) for c in ("weight", "pos", "neg", "p")])


def a2(spark, d):
    return rm.upper_median(views.log(spark, d), "value", "kind")


def a2_attributes(spark, d):
    return rm.upper_median(views.responses(spark, d).withColumn("seconds", r6(F.col("seconds"))), "seconds", "attribute")


def b1(spark, d):
    m = model_of(spark, d).withColumn("answer", F.explode(F.array(F.lit(0), F.lit(1))))
    return m.select("class", "attribute", "certainty", "answer", r6(game.likelihood(F.col("p"), F.col("answer"), F.col("weight"))).alias("likelihood"))


def b2(spark, d):
    m = model_of(spark, d)
    joint = game.binary_answers(priors_of(spark, d, m), m)
    return joint.groupBy("session", "attribute", "certainty", "answer").agg(r6(F.sum("u")).alias("mass"))


def a8(spark, d):
    m = model_of(spark, d)
    e = game.expected_entropy(game.binary_answers(priors_of(spark, d, m), m), "session", "attribute")
    return e.select("session", "attribute", r6(F.col("expected_entropy")).alias("expected_entropy"))


def b3(spark, d):
    m = model_of(spark, d)
    choices = m.select("attribute").distinct().withColumn("question", F.floor(F.col("attribute") / 4).cast("int"))
    joint = game.choice_answers(priors_of(spark, d, m), m, choices)
    e = game.expected_entropy(joint, "session", "question")
    return e.select("session", "question", r6(F.col("expected_entropy")).alias("expected_entropy"))


def gains_of(spark, d, m):
    priors = priors_of(spark, d, m)
    e = game.expected_entropy(game.binary_answers(priors, m), "session", "attribute")
    return e.join(game.session_entropy(priors), "session").select("session", "attribute", (F.col("entropy") - F.col("expected_entropy")).alias("gain"))


def b7(spark, d):
    m = model_of(spark, d)
    gains = gains_of(spark, d, m)
    asked = gains.where(F.col("attribute") % 4 == 0).select("session", "attribute")
    return game.select_question(gains, asked).select("session", "attribute", r6(F.col("gain")).alias("gain"))


def b7_time(spark, d):
    gains = gains_of(spark, d, model_of(spark, d))
    seconds = gains.select("attribute").distinct().withColumn("seconds", (1 + F.col("attribute") % 7).cast("double"))
    return game.select_question(gains, seconds=seconds).select("session", "attribute", r6(F.col("gain")).alias("gain"))


def b8(spark, d):
    return posterior_of(spark, d).select("session", "class", r6(F.col("p")).alias("p"))


def b10(spark, d):
    vision = posterior_of(spark, d).withColumn("joint", F.col("p") * (1 + F.col("class")))
    return vision.select("session", "class", r6(prob.normalise(F.col("joint"), "session")).alias("p"))


def b11(spark, d):
    return game.ranked(posterior_of(spark, d)).where("rank <= 3").select("session", "rank", "class", r6(F.col("p")).alias("p"))


def b13(spark, d):
    post = posterior_of(spark, d)
    verdicts = post.select("session").distinct().where("session % 3 < 2").select("session", (F.col("session") % 10).cast("int").alias("verified_class"), (F.col("session") % 3 == 0).alias("confirmed"))
    return game.verified(post, verdicts).select("session", "class", r6(F.col("p")).alias("p"))


def b14(spark, d):
    responses = views.responses(spark, d)
    from pyspark.sql import Window

    ran = Window.partitionBy("example").orderBy("attribute").rowsBetween(Window.unboundedPreceding, 0)
    return responses.select("example", "attribute", r6(F.sum("seconds").over(ran)).alias("elapsed"))


def b16(spark, d):
    scores = views.responses(spark, d).join(views.centroids(spark, d).select(F.col("class").alias("c"), F.col("j").alias("attribute"), "w"), "attribute")
    by_class = scores.groupBy("example", F.col("c").alias("class")).agg(F.sum(F.when(F.col("answer") == 1, F.col("w")).otherwise(-F.col("w"))).alias("score"))
    return by_class.select("example", "class", r6(prob.log_normalise(10 * F.col("score"), "example")).alias("p"))


def b17(spark, d):
    x = views.responses(spark, d).select("example", "attribute", (F.col("seconds") / 10 - 1).alias("s"))
    return x.select("example", "attribute", r6(2 * F.col("s") + prob.two_class_log_normaliser(F.col("s"), 2.0)).alias("loglik"))


def b18(spark, d):
    classes = views.responses(spark, d).select("class").distinct()
    from pyspark.sql import Window

    return classes.select("class", r6(1 / F.count("*").over(Window.partitionBy(F.lit(0)))).alias("p"))


def a11(spark, d):
    truth = views.responses(spark, d).select(F.col("example").alias("session"), F.col("class").alias("gt")).distinct()
    ranks = game.ranked(posterior_of(spark, d)).join(truth, "session").where(F.col("class") == F.col("gt")).withColumnRenamed("rank", "true_rank")
    windows = ranks.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    return windows.groupBy("k").agg(r6(F.avg((F.col("true_rank") <= F.col("k")).cast("double"))).alias("accuracy"), F.count("*").alias("n"))


def a10(spark, d):
    truth = views.responses(spark, d).select(F.col("example").alias("session"), F.col("class").alias("gt")).distinct()
    top = game.ranked(posterior_of(spark, d)).where("rank = 1").join(truth, "session")
    return evaluation.confusion(top.select((F.col("session") % 4).cast("int").alias("q"), "gt", F.col("class").alias("pred")), "q")


def a18(spark, d):
    truth = views.responses(spark, d).select(F.col("example").alias("session"), F.col("class").alias("gt")).distinct()
    scores = posterior_of(spark, d).join(truth, "session").select(F.col("session").alias("example"), "class", "gt", F.col("p").alias("score"))
    return evaluation.softmax_nll(scores, [0.5, 1.0, 2.0, 4.0]).select("gamma", F.round("nll", 4).alias("nll"))


def e2e(spark, d):
    responses = views.responses(spark, d)
    history = game.play(responses, rm.response_model(responses), rounds=views.ATTRIBUTES)
    return game.accuracy_by_round(history, 1, views.ATTRIBUTES).select("round", r6(F.col("accuracy")).alias("accuracy"), "sessions")


def mixed_questions(spark: SparkSession) -> DataFrame:
    """Eight yes-no questions, three choices of four attributes, one batch of four, and two clicks."""
    rows = [(a, "binary", [a], 1.0 + a % 3) for a in range(8)] + [(20 + i, "multiple", list(range(8 + 4 * i, 12 + 4 * i)), 2.5) for i in range(3)]
    rows += [(30, "batch", list(range(20, 24)), 4.0), (40, "click", [], 1.5), (41, "click", [], 1.5)]
    return spark.createDataFrame(rows, "question int, kind string, attributes array<int>, seconds double")


def e2e_mixed(spark, d):
    responses = views.responses(spark, d)
    # places of a part, out of the vectors' last components, each of which speaks for the classes near it
    e = F.col("embedding")
    samples = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(
        (F.get(e, 24 + i) * 40).cast("double").alias("x"), (F.get(e, 32 + i) * 40).cast("double").alias("y"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.when((c + i) % 5 == F.col("label") % 5, 0.3).otherwise(0.1)).alias("p")))
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("example"), F.explode(F.array(F.lit(40), F.lit(41))).alias("question"), e, "label")
    clicks = t.select("example", "question", (F.get(e, 24 + F.col("question") - 40) * 40).cast("double").alias("x"), (F.get(e, 32 + F.col("question") - 40) * 40).cast("double").alias("y"), F.lit(1.0).alias("seconds"), samples.alias("samples"))
    history = mixed_game.play_mixed(responses, rm.response_model(responses), mixed_questions(spark), 14, "time", False, 1.0, clicks)
    return game.accuracy_by_round(history, 1, 14).select("round", r6(F.col("accuracy")).alias("accuracy"), "sessions")


def e2e_batch(spark, d):
    m = model_of(spark, d)
    questions = m.select("attribute").distinct().withColumn("question", F.floor(F.col("attribute") / 3).cast("int"))
    joint = game.batch_answers(few_priors(m), m, questions, samples=500)
    e = game.expected_entropy(joint, "session", "question", answer=("sample",))
    return e.select("session", "question", r6(F.col("expected_entropy")).alias("expected_entropy"))


def b5(spark, d):
    parts = views.parts(spark, d)
    samples = parts.select(F.col("object").alias("session"), F.col("part").alias("sample"), "x", "y", (F.col("part") % 3).cast("int").alias("class"), F.lit(1.0).alias("p"))
    clicks = parts.where("part = 1").select(F.col("object").alias("session"), F.lit(0).alias("click"), (F.col("x") + 10).alias("x"), "y")
    return game.click_answers(samples, clicks, 0.01, (0.01, 0.01)).select("session", "class", r6(F.col("p")).alias("p"))


QUERIES = {
    "a1_response_model": (a1, MODEL + "SELECT class, attribute, certainty, round(weight, 6) AS weight, round(pos, 6) AS pos, round(neg, 6) AS neg, round(p, 6) AS p FROM model"),
    "a2_upper_median": (a2, cte("log") + """, s AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS i, count(*) OVER (PARTITION BY kind) AS n FROM log)
        SELECT kind, value AS median FROM s WHERE i = n // 2 + 1"""),
    "a2_attribute_seconds": (a2_attributes, cte("responses") + """, s AS (SELECT attribute, round(seconds, 6) AS v, row_number() OVER (PARTITION BY attribute ORDER BY seconds) AS i, count(*) OVER (PARTITION BY attribute) AS n FROM responses)
        SELECT attribute, v AS median FROM s WHERE i = n // 2 + 1"""),
    "a8_expected_entropy": (a8, MODEL + PRIORS + JOINT + "SELECT session, attribute, round(expected_entropy, 6) AS expected_entropy FROM expected"),
    "a10_confusion_by_question": (a10, MODEL + POSTERIOR + """, top AS (SELECT session, class AS pred FROM post QUALIFY row_number() OVER (PARTITION BY session ORDER BY round(p, 9) DESC, class) = 1)
        SELECT (session % 4)::INT AS q, r.class AS gt, pred, count(*) AS n FROM top JOIN (SELECT DISTINCT example, class FROM responses) r ON r.example = top.session GROUP BY 1, 2, 3"""),
    "a11_topk_accuracy": (a11, MODEL + POSTERIOR + """, ranks AS (SELECT session, class, row_number() OVER (PARTITION BY session ORDER BY round(p, 9) DESC, class) AS rk FROM post),
        t AS (SELECT rk FROM ranks JOIN (SELECT DISTINCT example, class FROM responses) r ON r.example = ranks.session AND r.class = ranks.class)
        SELECT k, round(avg((rk <= k)::INT::DOUBLE), 6) AS accuracy, count(*) AS n FROM t CROSS JOIN (SELECT unnest([1, 3, 5])::INT AS k) GROUP BY k"""),
    "a18_calibration": (a18, MODEL + POSTERIOR + """, z AS (SELECT g::DOUBLE AS gamma, session, post.class, r.class AS gt, g * p AS s FROM post JOIN (SELECT DISTINCT example, class FROM responses) r ON r.example = post.session CROSS JOIN (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS g)),
        e AS (SELECT gamma, session, ln(sum(exp(s))) AS total, max(CASE WHEN class = gt THEN s END) AS t FROM z GROUP BY 1, 2)
        SELECT gamma, round(sum(total - t), 4) AS nll FROM e GROUP BY 1"""),
    "b1_likelihood": (b1, MODEL + """SELECT class, attribute, certainty, answer, round(CASE WHEN q > 0 THEN exp(weight * ln(q)) ELSE 0 END, 6) AS likelihood
        FROM (SELECT *, CASE WHEN answer = 1 THEN p ELSE 1 - p END AS q FROM model CROSS JOIN (SELECT unnest([0, 1])::INT AS answer))"""),
    "b2_binary_answers": (b2, MODEL + PRIORS + JOINT + "SELECT session, attribute, certainty, answer, round(mass, 6) AS mass FROM answers"),
    "b3_multiple_choice_answers": (b3, MODEL + PRIORS + """,
        u AS (SELECT session, (attribute // 4)::INT AS question, certainty, attribute, CASE WHEN model.p > 0 THEN priors.p * exp(weight * ln(model.p)) ELSE 0 END AS u FROM priors JOIN model USING (class)),
        a AS (SELECT session, question, certainty, attribute, sum(u) AS mass, sum(CASE WHEN u > 0 THEN u * ln(u) ELSE 0 END) AS ulnu FROM u GROUP BY 1, 2, 3, 4)
        SELECT session, question, round(sum(mass * ln(mass) - ulnu) / sum(mass), 6) AS expected_entropy FROM a GROUP BY 1, 2"""),
    "b4_batch_question": (e2e_batch, MODEL + FEW_PRIORS + """, sure AS (SELECT attribute, class, arg_max(p, weight) AS q, max(weight) AS weight FROM model GROUP BY 1, 2),
        known AS (SELECT session, (attribute // 3)::INT AS question, attribute, class, priors.p,
          CASE WHEN q > 0 THEN exp(weight * ln(q)) ELSE 0 END AS yes, CASE WHEN q < 1 THEN exp(weight * ln(1 - q)) ELSE 0 END AS no FROM priors JOIN sure USING (class)),
        shared AS (SELECT *, sum(p * yes) OVER k / sum(p * (yes + no)) OVER k AS share FROM known WINDOW k AS (PARTITION BY session, question, attribute)),
        drawn AS (SELECT *, (('0x' || substr(md5(session || '|' || question || '|' || sample || '|' || attribute || '|0'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496 < share AS said
          FROM shared CROSS JOIN (SELECT unnest(range(500))::INT AS sample)),
        factors AS (SELECT *, CASE WHEN said THEN yes / share ELSE no / (1 - share) END AS f FROM drawn),
        mass AS (SELECT session, question, sample, class, CASE WHEN min(f) <= 0 THEN 0 ELSE any_value(p) * exp(sum(CASE WHEN f > 0 THEN ln(f) END)) END / 500 AS u FROM factors GROUP BY 1, 2, 3, 4),
        told AS (SELECT session, question, sample, sum(u) AS m, sum(CASE WHEN u > 0 THEN u * ln(u) ELSE 0 END) AS ulnu FROM mass GROUP BY 1, 2, 3)
        SELECT session, question, round(sum(CASE WHEN m > 0 THEN m * ln(m) - ulnu ELSE 0 END) / sum(m), 6) + 0 AS expected_entropy FROM told GROUP BY 1, 2"""),
    "b5_click_answers": (b5, cte("parts") + """, p AS (SELECT * FROM parts),
        u AS (SELECT s.object AS session, (s.part % 3)::INT AS class, sum(exp(-0.01::DOUBLE * (0.01::DOUBLE * (s.x - c.x - 10) ** 2 + 0.01::DOUBLE * (s.y - c.y) ** 2))) AS u FROM p s JOIN p c ON s.object = c.object AND c.part = 1 GROUP BY 1, 2)
        SELECT session, class, round(CASE WHEN sum(u) OVER (PARTITION BY session) <> 0 THEN u / sum(u) OVER (PARTITION BY session) ELSE 0 END, 6) AS p FROM u"""),
    "b7_select_question": (b7, MODEL + PRIORS + JOINT + """, h AS (SELECT session, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM priors GROUP BY 1),
        g AS (SELECT session, attribute, round(h - expected_entropy, 9) AS gain FROM expected JOIN h USING (session) WHERE attribute % 4 <> 0)
        SELECT session, attribute, round(gain, 6) AS gain FROM g QUALIFY row_number() OVER (PARTITION BY session ORDER BY gain DESC, attribute) = 1"""),
    "b7_select_by_time": (b7_time, MODEL + PRIORS + JOINT + """, h AS (SELECT session, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM priors GROUP BY 1),
        g AS (SELECT session, attribute, round((h - expected_entropy) / (1 + attribute % 7), 9) AS gain FROM expected JOIN h USING (session))
        SELECT session, attribute, round(gain, 6) AS gain FROM g QUALIFY row_number() OVER (PARTITION BY session ORDER BY gain DESC, attribute) = 1"""),
    "b8_posterior": (b8, MODEL + POSTERIOR + "SELECT session, class, round(p, 6) AS p FROM post"),
    "b10_vision_prior": (b10, MODEL + POSTERIOR + "SELECT session, class, round(p * (1 + class) / sum(p * (1 + class)) OVER (PARTITION BY session), 6) AS p FROM post"),
    "b11_rank_classes": (b11, MODEL + POSTERIOR + """, r AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY round(p, 9) DESC, class)::INT AS rank, class, round(p, 6) AS p FROM post)
        SELECT * FROM r WHERE rank <= 3"""),
    "b13_verify_class": (b13, MODEL + POSTERIOR + """, v AS (SELECT session, class, CASE WHEN session % 3 = 2 THEN p WHEN session % 3 = 0 THEN (class = session % 10)::INT::DOUBLE WHEN class = session % 10 THEN 0 ELSE p END AS m FROM post)
        SELECT session, class, round(CASE WHEN sum(m) OVER (PARTITION BY session) <> 0 THEN m / sum(m) OVER (PARTITION BY session) ELSE 0 END, 6) AS p FROM v"""),
    "b14_elapsed": (b14, cte("responses") + " SELECT example, attribute, round(sum(seconds) OVER (PARTITION BY example ORDER BY attribute ROWS UNBOUNDED PRECEDING), 6) AS elapsed FROM responses"),
    "b16_log_softmax": (b16, cte("responses", "centroids") + """, s AS (SELECT example, c.class, 10 * sum(CASE WHEN answer = 1 THEN w ELSE -w END) AS z FROM responses r JOIN centroids c ON c.j = r.attribute GROUP BY 1, 2),
        e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY example)) AS e FROM s)
        SELECT example, class, round(e / sum(e) OVER (PARTITION BY example), 6) AS p FROM e"""),
    "b17_attribute_loglik": (b17, cte("responses") + """, x AS (SELECT example, attribute, seconds / 10 - 1 AS s FROM responses)
        SELECT example, attribute, round(2 * s - abs(2 * s) - ln(exp(2 * s - abs(2 * s)) + exp(-2 * s - abs(2 * s))), 6) + 0 AS loglik FROM x"""),
    "b18_initial_priors": (b18, "SELECT label AS class, round(1.0::DOUBLE / (SELECT count(DISTINCT label) FROM embeddings), 6) AS p FROM embeddings GROUP BY 1"),
    "e2e_question_game": (e2e, None),
    "e2e_mixed_game": (e2e_mixed, None),
}
