"""Queries on matrix completion, classification and regression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.numbers import id_uniform, rounded
from ..operators import als, linear
from ..session import cut
from . import check_sql, views
from .registry import query
from .views import table, with_views

REGULARIZATION = 0.1
SEED = 42
START = check_sql.als_start("items_0", "SELECT DISTINCT item AS id FROM ratings", 2, SEED)
STEP = [*START, *check_sql.als_step("users", "ratings", "user", "item", "items_0", REGULARIZATION)]
USERS = "SELECT id, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM users"
MODEL = check_sql.als("ratings", 2, REGULARIZATION, SEED)
FACTORS = """SELECT 'user' AS side, id, round(f0, 5) AS f0, round(f1, 5) AS f1 FROM users
             UNION ALL SELECT 'item', id, round(f0, 5), round(f1, 5) FROM items"""


def start(ratings: DataFrame, rank: int = 2) -> DataFrame:
    return als.start_factors(als.rated_items(ratings), rank, SEED)


def two_factors(factors: DataFrame, digits: int = 6) -> DataFrame:
    return factors.select("id", *[rounded(F.col("factors")[k], digits).alias(f"f{k}") for k in (0, 1)])


def both_sides(model: als.Factorization) -> DataFrame:
    users, items = two_factors(model.users, 5), two_factors(model.items, 5)
    return (users.withColumn("side", F.lit("user")).unionByName(items.withColumn("side", F.lit("item")))
            .select("side", "id", "f0", "f1"))


# ---- matrix completion -------------------------------------------------------------------

@query(with_views("SELECT id, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM items_0", "ratings", more=START))
def als_init(spark, folder):
    return two_factors(start(views.ratings(spark, folder)))


@query(with_views("""SELECT id, n, round(g00, 6) AS g00, round(g01, 6) AS g01, round(g11, 6) AS g11,
                     round(b0, 6) AS b0, round(b1, 6) AS b1 FROM users_sums""", "ratings", more=STEP[:-1]))
def als_gram(spark, folder):
    ratings = cut(views.ratings(spark, folder))
    vectors_ = start(ratings).withColumnRenamed("id", "item")
    sums = als.normal_sums(ratings.join(vectors_, "item"), 2)
    return sums.select("id", "n", *[rounded(F.col("gram")[i]).alias(c) for i, c in enumerate(("g00", "g01", "g11"))],
                       *[rounded(F.col("rhs")[i]).alias(f"b{i}") for i in (0, 1)])


@query(with_views(USERS, "ratings", more=STEP))
def als_step(spark, folder):
    ratings = cut(views.ratings(spark, folder))
    return two_factors(als.joined_step(als.by_item(ratings), start(ratings), 2, REGULARIZATION))


@query(with_views(USERS, "ratings", more=STEP))
def als_broadcast(spark, folder):
    ratings = cut(views.ratings(spark, folder))
    return two_factors(als.broadcast_step(ratings, cut(start(ratings)), 2, REGULARIZATION))


@query(with_views(FACTORS, "ratings", more=MODEL))
def als_join(spark, folder):
    return both_sides(als.factorize(views.ratings(spark, folder), 2, REGULARIZATION, 2, SEED, most_bytes=0))


@query(with_views(FACTORS, "ratings", more=MODEL))
def als_blocked(spark, folder):
    return both_sides(als.factorize_blocked(views.ratings(spark, folder), 2, REGULARIZATION, 2, SEED))


def als_rank_10(spark, folder):
    """Rank 10 and 10 iterations, by joins."""
    return als.factorize(views.ratings(spark, folder), 10, REGULARIZATION, 10, SEED, most_bytes=0).users


WIDE = 50


@query(with_views(f"""
    SELECT r."user" AS id, COUNT(*) AS n, round(SUM(v.square), 6) AS trace, round(SUM(v.total * v.total), 5) AS gram, round(SUM(r.rating * v.total), 5) AS rhs
    FROM ratings r JOIN (SELECT id, list_sum(f) AS total, list_sum(list_transform(f, lambda x: x * x)) AS square
                         FROM (SELECT id, list_transform(range({WIDE}), lambda k: {check_sql.uniform('id', 'k', SEED)}) AS f
                               FROM (SELECT DISTINCT item AS id FROM ratings))) v ON v.id = r.item
    GROUP BY 1""", "ratings"))
def als_gram_wide(spark, folder):
    """Normal equations at rank 50: the trace and the sum of all cells of each user's matrix, and the sum of the right side."""
    diagonal = [i * WIDE - i * (i - 1) // 2 for i in range(WIDE)]
    trace = F.aggregate(F.array(*[F.lit(d) for d in diagonal]), F.lit(0.0), lambda t, d: t + F.get("gram", d))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)

    def reduced(sums):
        return (sums.withColumn("trace", trace)
                .select("id", "n", rounded(F.col("trace")).alias("trace"), rounded(2 * total(F.col("gram")) - F.col("trace"), 5).alias("gram"),
                        rounded(total(F.col("rhs")), 5).alias("rhs")))
    # most ratings are of one line
    return als.in_passes(views.ratings(spark, folder), lambda ratings: start(ratings, WIDE), WIDE, reduced, table(spark, folder, "lineitem").count())


@query(with_views("""SELECT r."user", r.item, round(r.rating, 6) AS rating, round(u.f0 * v.f0 + u.f1 * v.f1, 4) AS predicted
                     FROM ratings r JOIN users u ON u.id = r."user" JOIN items v ON v.id = r.item""", "ratings", more=MODEL))
def predict_cells(spark, folder):
    """Predictions for the given cells, here those that were rated."""
    ratings = cut(views.ratings(spark, folder))
    model = als.factorize_blocked(ratings, 2, REGULARIZATION, 2, SEED)
    return als.predicted(ratings, model, 2).withColumn("rating", rounded(F.col("rating"))).withColumn("predicted", rounded(F.col("predicted"), 4))


BEST = 5


@query(with_views(f"""SELECT "user", item, round(predicted, 4) AS predicted, place
    FROM (SELECT u.id AS "user", v.id AS item, u.f0 * v.f0 + u.f1 * v.f1 AS predicted,
                 CAST(row_number() OVER (PARTITION BY u.id ORDER BY u.f0 * v.f0 + u.f1 * v.f1 DESC, v.id) AS INTEGER) AS place FROM users u CROSS JOIN items v)
    WHERE place <= {BEST}""", "brand_ratings", more=check_sql.als("brand_ratings", 2, REGULARIZATION, SEED)))
def recommend_topk(spark, folder):
    """The five items of the highest prediction for every user."""
    model = als.factorize(cut(views.brand_ratings(spark, folder)), 2, REGULARIZATION, 2, SEED)
    return als.best_items(model, 2, BEST).withColumn("predicted", rounded(F.col("predicted"), 4))


BRAND_MODEL = check_sql.als("brand_ratings", 2, REGULARIZATION, SEED)
PRODUCT = """SELECT u.id AS "user", v.id AS item, round(u.f0 * v.f0 + u.f1 * v.f1, 4) AS predicted
             FROM users u CROSS JOIN items v"""


@query(with_views(PRODUCT, "brand_ratings", more=BRAND_MODEL))
def matrix_complete(spark, folder):
    ratings = cut(views.brand_ratings(spark, folder))
    model = als.factorize(ratings, 2, REGULARIZATION, 2, SEED)
    return als.completed(model, 2, model.items.count()).withColumn("predicted", rounded(F.col("predicted"), 4))


@query(with_views("""SELECT p."user", p.item, round(COALESCE(r.rating, p.predicted), 4) AS value, r.rating IS NOT NULL AS observed
                     FROM product p LEFT JOIN brand_ratings r ON p."user" = r."user" AND p.item = r.item""",
                  "brand_ratings", more=[*BRAND_MODEL, ("product", PRODUCT)]))
def matrix_fill(spark, folder):
    ratings = cut(views.brand_ratings(spark, folder))
    model = als.factorize(ratings, 2, REGULARIZATION, 2, SEED)
    cells = als.completed(model, 2, model.items.count()).withColumn("predicted", rounded(F.col("predicted"), 4))
    return als.filled(ratings, cells).withColumn("value", rounded(F.col("value"), 4))


# ---- classification ----------------------------------------------------------------------

DIMENSIONS = 64
# a fixed classifier: weight k is (k % 7 - 3) / 7
FIXED = [(k % 7 - 3) / 7 for k in range(DIMENSIONS)]
FIXED_SQL = f"list_transform(range({DIMENSIONS}), lambda k: (k % 7 - 3) / CAST(7 AS DOUBLE))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


@query(with_views(f"""
    SELECT index, label, round(score, 6) AS score, CASE WHEN score < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS prediction
    FROM (SELECT index, label, {DOT.format(a='data', b=FIXED_SQL)} AS score FROM points)""", "points"))
def svm_predict(spark, folder):
    return (linear.predict(views.points(spark, folder), FIXED).withColumn("score", rounded(F.col("score")))
            .select("index", "label", "score", "prediction"))


STRENGTH = "(0.01::DOUBLE * (SELECT COUNT(*) FROM points))"


@query(with_views(f"""
    SELECT index, round(alpha, 6) AS alpha, round(label * (alpha - old) / {STRENGTH}, 6) AS factor
    FROM (SELECT index, label, old,
                 CASE WHEN grad = 0 THEN old WHEN square = 0 THEN 1.0::DOUBLE
                      ELSE greatest(least(old - grad / square, 1.0::DOUBLE), 0.0::DOUBLE) END AS alpha
          FROM (SELECT index, label, {check_sql.uniform('index', 0, 3)} AS old,
                       (label * {DOT.format(a='data', b=FIXED_SQL)} - 1.0::DOUBLE) * {STRENGTH} AS grad,
                       {DOT.format(a='data', b='data')} AS square FROM points))""", "points"))
def sdca_step(spark, folder):
    points = views.points(spark, folder)
    step = linear.dual_step(F.col("data"), F.col("label"), id_uniform(F.col("index"), 0, 3),
                            vectors.literal(FIXED), 0.01, points.count())
    return (points.select("index", step.alias("step"))
            .select("index", rounded(F.col("step.alpha")).alias("alpha"), rounded(F.col("step.factor")).alias("factor")))


def positions_of(weights: list[float], spark) -> DataFrame:
    return spark.createDataFrame([(k, w) for k, w in enumerate(weights)], "pos INT, weight DOUBLE")


COCOA = dict(blocks=10, outer=2, inner=3, regularization=0.01, scaling=1.0)
SVM = dict(blocks=4, outer=3, inner=2, regularization=0.1, scaling=0.5)
WEIGHTS = "SELECT CAST(pos AS INTEGER) AS pos, round(weight, 6) + 0.0 AS weight FROM trained"


def trained(model: linear.DualModel, spark) -> DataFrame:
    return positions_of(model.weights, spark).withColumn("weight", rounded(F.col("weight")))


@query(with_views(WEIGHTS, "points", more=check_sql.dual_ascent("points", DIMENSIONS, SEED, **COCOA)))
def cocoa_short(spark, folder):
    return trained(linear.train_dual(views.points(spark, folder), **COCOA, seed=SEED), spark)


@query(with_views(WEIGHTS, "points", more=check_sql.dual_ascent("points", DIMENSIONS, SEED, **SVM)))
def svm_weights_short(spark, folder):
    model = linear.train_svm(views.points(spark, folder), SVM["blocks"], SVM["outer"], SVM["regularization"], SVM["scaling"], SEED, SVM["inner"])
    return trained(model, spark)


# all rounds and steps; the short runs above are queries of their own
COCOA_FULL = COCOA | dict(outer=10, inner=10)
SVM_FULL = dict(blocks=10, outer=20, inner=10, regularization=0.01, scaling=1.0)


@query(with_views(WEIGHTS, "points", more=check_sql.dual_ascent("points", DIMENSIONS, SEED, **COCOA_FULL)))
def cocoa(spark, folder):
    """Ten rounds of ten steps in ten blocks."""
    return trained(linear.train_dual(views.points(spark, folder), **COCOA_FULL, seed=SEED), spark)


def cocoa_ten_rounds(spark, folder):
    """Ten rounds of ten steps in ten blocks."""
    return positions_of(linear.train_dual(views.points(spark, folder), 10, 10, 10, 0.01).weights, spark)


@query(with_views(WEIGHTS, "points", more=check_sql.dual_ascent("points", DIMENSIONS, SEED, **SVM_FULL)))
def svm_weights(spark, folder):
    """Twenty rounds of ten steps in ten blocks."""
    f = SVM_FULL
    model = linear.train_svm(views.points(spark, folder), f["blocks"], f["outer"], f["regularization"], f["scaling"], SEED, f["inner"])
    return trained(model, spark)


# ---- regression --------------------------------------------------------------------------

@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
                 round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, COUNT(*) AS n
          FROM lineitem GROUP BY 1""")
def linreg(spark, folder):
    fitted = linear.fit_line(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag")
    return fitted.select("l_returnflag", rounded(F.col("slope"), 4).alias("slope"),
                         rounded(F.col("intercept"), 2).alias("intercept"), "n")


PREDICTORS = ("l_quantity / 50", "l_discount", "l_tax")
TARGET = "l_extendedprice / 100000"
GD_ROUNDS = 5
GD_STEP = 0.05


@query(with_views("SELECT unnest(range(4)) AS pos, unnest([round(w0, 8), round(w1, 8), round(w2, 8), round(w3, 8)]) AS weight FROM w",
                  more=[("line_points", "SELECT " + ", ".join(f"{p} AS x{j}" for j, p in enumerate(PREDICTORS))
                         + f", {TARGET} AS y FROM lineitem"),
                        *check_sql.gradient("line_points", len(PREDICTORS), GD_ROUNDS, GD_STEP)]))
def linreg_gd(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.array(*[F.expr(p) for p in PREDICTORS]).alias("data"), F.expr(TARGET).alias("label"))
    weights, intercept = linear.fit_gradient(rows, GD_ROUNDS, GD_STEP)
    return (positions_of([*weights, intercept], spark)
            .select(F.col("pos").cast("long").alias("pos"), rounded(F.col("weight"), 8).alias("weight")))

