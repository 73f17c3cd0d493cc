from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyline.plans import models as M
from tallyline.plans import train as T


def test_fitted_models_score_in_a_session_that_was_tagged_and_observed(spark):
    own = spark.newSession()
    df = own.range(200).select(
        F.col("id").alias("match_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        F.lit(1).alias("innings_number"), (F.col("id") % 7).cast("double").alias("x"),
        (F.col("id") % 5 - 2).cast("double").alias("elo_difference"),
        (F.col("id") % 7 + F.col("id") % 2 > 4).cast("int").alias("batting_team_eventual_win"),
    )
    own.addTag("one")
    own.removeTag("one")
    df.observe(Observation("seen"), F.count(F.lit(1)).alias("n")).count()
    bundle, rows = T.train_live(
        df, innings_number=1, features=["x", "elo_difference"], train_end="2020-03-31", valid_end="2020-05-15",
        candidates=(M.Candidate(M.LOGISTIC, intercept=True),),
    )
    assert rows.where("model = 'logistic_regression'").count() == 2
    assert not bundle.model.stages[-1].hasSummary
    assert M.probability(bundle, df, symmetric=False).where("p between 0 and 1").count() == 200
