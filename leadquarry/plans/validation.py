"""External validation of a ranking: hit rate per decile and whether it ever rises."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadquarry.operators.rank import row_numbers
from leadquarry.session import cut


def decile_hit_rates(df: DataFrame, score: str, hit: str, id_col: str = "biz_id", parts: int = 10) -> DataFrame:
    """Deciles by descending score (the first ones take the remainder); one row per decile."""
    ranked = cut(row_numbers(df.select(id_col, score, hit), [F.desc_nulls_last(score), F.asc(id_col)], "rank"))
    n = ranked.count()
    small, extra = divmod(n, parts)
    edge = extra * (small + 1)
    in_big = F.floor((F.col("rank") - 1) / (small + 1)) + 1
    in_small = F.floor((F.col("rank") - 1 - edge) / max(small, 1)) + 1 + extra
    decile = F.when(F.col("rank") <= edge, in_big).otherwise(in_small).cast("long")
    per = ranked.groupBy(decile.alias("decile")).agg(
        F.count("*").alias("n"), F.sum(hit).cast("long").alias("hits"), F.avg(hit).alias("hit_rate"))
    w = Window.orderBy("decile")                                    # ten rows
    return per.withColumn("not_rising", F.col("hit_rate") <= F.lag("hit_rate").over(w))
