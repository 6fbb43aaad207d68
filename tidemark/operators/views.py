"""What the map, the panel and the search show, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1.4
AXES = "XYZWS"


def _wide(at: DataFrame, by: list[str], axes: tuple[str, ...]) -> DataFrame:
    return at.where(F.col("axis").isin(*axes)).groupBy(*by).agg(*[F.max(F.when(F.col("axis") == a, F.col("value"))).alias(a) for a in axes])


def _known(axes: tuple[str, ...]) -> Column:
    return sum((F.col(a).isNotNull().cast("int") for a in axes[1:]), F.col(axes[0]).isNotNull().cast("int"))


def placed(latest: DataFrame, people: DataFrame, axes: tuple[str, ...], entry: DataFrame, month: str) -> DataFrame:
    """Headline people at one month in one view: placed if two of the view's axes are known, unknown ones are free and at 0; else the
    allowed axes that are missing, and whether the month is before the person's first."""
    rows = people.where("headline").select("person_id", "axes_allowed").join(
        _wide(latest, ["person_id"], axes), "person_id", "left"
    ).join(entry, "person_id", "left")
    ok = _known(axes) >= 2
    free = F.concat(*[F.when(F.col(a).isNull(), a).otherwise("") for a in axes])
    missing = F.concat(*[F.when(F.col(a).isNull() & F.array_contains("axes_allowed", a), a).otherwise("") for a in axes])
    return rows.select(
        "person_id", *[F.when(ok, F.bround(F.coalesce(a, F.lit(0.0)) * SCALE, 4)).alias(f"c{k}") for k, a in enumerate(axes)], ok.alias("placed"),
        F.when(ok, free).alias("free_axes"),
        F.when(~ok, missing).alias("missing_axes"), F.when(~ok, F.coalesce(F.lit(month) < F.col("enters_at"), F.lit(False))).alias("before_entry"),
    )


def visible(at: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """person_id, month_end and whether the person is placed then."""
    return _wide(at, ["person_id", "month_end"], axes).select("person_id", "month_end", (_known(axes) >= 2).alias("visible"))


def first_placed(at: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    return visible(at, axes).where("visible").agg(F.date_format(F.min("month_end"), "yyyy-MM").alias("first_month"))


def nearest_visible(at: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """For each month the nearest other month in which the person is placed; of two as near, the later."""
    own = Window.partitionBy("person_id").orderBy("month_end")
    rows = visible(at, axes).withColumn("idx", F.row_number().over(own))
    shown = F.when(F.col("visible"), F.struct("idx", "month_end"))
    rows = rows.withColumn("after", F.first(shown, True).over(own.rowsBetween(1, Window.unboundedFollowing))).withColumn(
        "before", F.last(shown, True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    )
    later = F.col("before").isNull() | (F.col("after.idx") - F.col("idx") <= F.col("idx") - F.col("before.idx"))
    return rows.select(
        "person_id", "month_end",
        F.when(later & F.col("after").isNotNull(), F.col("after.month_end")).otherwise(F.col("before.month_end")).alias("nearest")
    )


def trail(at: DataFrame, axis: str, months: int) -> DataFrame:
    """The values of the last ``months`` months and this one, where there are any."""
    own = Window.partitionBy("person_id").orderBy("month_end").rowsBetween(-months, 0)
    cell = F.when(F.col("value").isNotNull(), F.struct("month_end", "value"))
    return at.where(F.col("axis") == axis).select("person_id", "month_end", F.collect_list(cell).over(own).alias("trail"))


def panel(latest: DataFrame, people: DataFrame, stale: int = 12, blurry: float = 0.8) -> DataFrame:
    """A row for each person and axis: its state, value, flags and bar of 0 to 100."""
    cells = people.select("person_id", "axes_allowed", F.explode(F.split(F.lit(AXES), "")).alias("axis"))
    rows = cells.join(latest, ["person_id", "axis"], "left")
    has = F.col("value").isNotNull()
    state = F.when(~F.array_contains("axes_allowed", F.col("axis")), "not applicable").when(~has, "no evidence").otherwise("value")
    return rows.select(
        "person_id", "axis", state.alias("state"), "value", ((F.bround("newest_age_months", 0) > stale) & has).alias("stale"),
        ((F.col("dispersion") > blurry) & has).alias("blurry"),
        ((F.col("status") == "sparse") & has).alias("sparse"), F.bround((F.col("value") + 3) / 6 * 100, 6).alias("bar"),
    )


def _matches(people: DataFrame, query: str) -> DataFrame:
    return people.where(F.contains(F.lower("display_name"), F.lit(query.strip().lower())))


def search(people: DataFrame, query: str) -> DataFrame:
    return _matches(people.where("headline"), query).select("person_id", "display_name")


def hits(people: DataFrame, query: str, most: int = 6) -> DataFrame:
    return _matches(people, query).orderBy("display_name", "person_id").limit(most).select("person_id", "display_name")


def events_of_month(events: DataFrame, month: str, most: int = 2) -> DataFrame:
    return events.where(F.date_format("d", "yyyy-MM") == month).orderBy("d", "event_id").limit(most)


def totals(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count("*").alias("claims"), F.count_distinct("person_id").alias("people"))


def person_cards(people: DataFrame, positions: DataFrame, credits: DataFrame, claims: DataFrame) -> DataFrame:
    """People with how many positions and claims they have and their portrait's licence, whichever there are."""
    has = positions.where("value is not null").groupBy("person_id").agg(F.count("*").alias("n_positions"))
    said = claims.groupBy("person_id").agg(F.count("*").alias("n_claims"))
    rows = people.select("person_id", "display_name").join(has, "person_id", "left").join(credits, "person_id", "left").join(said, "person_id", "left")
    return rows.fillna(0, ["n_positions", "n_claims"])
