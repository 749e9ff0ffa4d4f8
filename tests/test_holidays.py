import datetime as dt

from pyspark.sql import functions as F

from ticketscope.functions.holidays import holiday_calendar, is_holiday


def test_rule_test_equals_calendar(spark):
    """The per-row integer test agrees with the date-built calendar on every day of 46 years."""
    days = (spark.range(1)
            .select(F.explode(F.sequence(F.lit(dt.date(1990, 1, 1)), F.lit(dt.date(2035, 12, 31))))
                    .alias("date")))
    cal = holiday_calendar(spark, 1990, 2035).select("date", F.lit(True).alias("in_cal"))
    got = (days.withColumn("flag", is_holiday("date"))
           .join(cal, "date", "left")
           .where(F.col("flag") != F.coalesce(F.col("in_cal"), F.lit(False))))
    assert got.count() == 0
    assert cal.count() > 46 * 11


def test_known_days(spark):
    cases = {
        dt.date(2024, 1, 1): True,     # New Year's Day
        dt.date(2024, 1, 15): True,    # Martin Luther King Jr. Day
        dt.date(2023, 12, 31): False,
        dt.date(2021, 12, 31): True,   # 1 Jan 2022 is a Saturday → observed Friday
        dt.date(2022, 12, 26): True,   # Christmas on Sunday → observed Monday
        dt.date(2024, 5, 27): True,    # Memorial Day
        dt.date(2024, 11, 5): True,    # Election Day (NY)
        dt.date(2020, 6, 19): False,   # Juneteenth only from 2021
        dt.date(2021, 6, 18): True,    # Juneteenth 2021 on Saturday → observed Friday
        dt.date(2024, 11, 28): True,   # Thanksgiving
        dt.date(2024, 7, 5): False,
    }
    df = spark.createDataFrame([(d,) for d in cases], "date date")
    got = {r.date: r.h for r in df.select("date", is_holiday("date").alias("h")).collect()}
    assert got == cases


def test_calendar_unique_on_date(spark):
    cal = holiday_calendar(spark, 2000, 2030)
    assert cal.count() == cal.select("date").distinct().count()


def test_null_date_is_not_holiday(spark):
    df = spark.createDataFrame([(None,)], "date date")
    assert df.select(is_holiday("date").alias("h")).first().h is False
