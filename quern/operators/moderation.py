"""Task queues, pages, suggestions, patches, evaluation and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import rules
from quern.operators.catalogue import checkpointed, top_k

# What a task of each kind may be closed with, besides rejection.
TRANSITIONS = {
    "unknown_model_code": ["link_model_code"],
    "unknown_screen_signature": ["link_screen_signature"],
    "csv_quarantine": ["confirm_quarantine", "reject_quarantine"],
    "source_disagreement": ["resolve_source_disagreement"],
    "user_feedback": ["acknowledge_feedback"],
    "ambiguous_query": ["link_model_code"],
    "unmatched_query": ["link_model_code"],
}


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """The rows of a page, counted from 1, with the total of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))  # one row


def nearest_screens(asked: DataFrame, screens: DataFrame, key: str, k: int) -> DataFrame:
    """The k screens (w, h, dpr) nearest to each asked one: by width, height and a hundred times the pixel ratio; ties by w, h, dpr.

    Screens lie in square cells, of about k each at first. An asked geometry outside of all screens starts from the nearest place of their
    rectangle: every screen is further from it by the same way. It meets those of that place's cell and the eight around it. What
    lies further is further away than those cells' edge, so where the k-th best is nearer the answer is final; the
    rest go on with cells twice as large, until these hold all screens. Equal geometries are asked once. Rows with a null are left out.
    """
    numbers = ["w", "h", "dpr"]
    own = checkpointed(screens.select(*[F.col(c).alias(f"_{c}") for c in numbers]).dropna().distinct())
    area = own.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for c in ("_w", "_h") for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    different = checkpointed(asked.select(*numbers).dropna().distinct())
    none = different.select(*[F.col(c).alias(f"a_{c}") for c in numbers], *[F.col(c) for c in numbers], F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).where("false")
    found, open_ = none, different
    if area["n"]:
        width, height = area["hi_w"] - area["lo_w"], area["hi_h"] - area["lo_h"]
        cell = max(1.0, float(width * height * k / area["n"]) ** 0.5)
        # Every screen is further away by the nearest pixel ratio that any has; where there are many ratios the bound does without.
        ratios = [r[0] for r in own.select("_dpr").distinct().limit(101).collect()]
        ratio = F.array_min(F.array(*[F.abs(F.lit(r) - F.col("dpr")) for r in ratios])) * 100 if len(ratios) <= 100 else F.lit(0.0)
        while True:
            place = {c: F.least(F.greatest(F.col(c), F.lit(area[f"lo_{c}"])), F.lit(area[f"hi_{c}"])) for c in ("w", "h")} | {c: F.col(c) for c in ("_w", "_h")}
            floor = lambda c, cell=cell, place=place: F.floor(place[c] / cell)
            around = F.explode(F.array(*[F.struct((floor("w") + x).alias("cw"), (floor("h") + y).alias("ch")) for x in (-1, 0, 1) for y in (-1, 0, 1)])).alias("c")
            distance = F.abs(F.col("_w") - F.col("w")) + F.abs(F.col("_h") - F.col("h")) + F.abs(F.col("_dpr") - F.col("dpr")) * 100
            cells = own.withColumns({"cw": floor("_w"), "ch": floor("_h")})
            met = open_.select(*numbers, around).select(*numbers, "c.*").join(cells, ["cw", "ch"]).withColumn("distance", distance)
            best = top_k(met, numbers, [F.asc("distance"), F.asc("_w"), F.asc("_h"), F.asc("_dpr")], k)
            # The nearest place outside of the nine cells, and whether nothing lies there.
            edge = F.least(*[x for c in ("w", "h") for x in (place[c] - (floor(c) - 1) * cell, (floor(c) + 2) * cell - place[c])])
            edge = (edge + ratio + F.abs(F.col("w") - place["w"]) + F.abs(F.col("h") - place["h"])) * (1 - 1e-12)  # ties by rounding stay open
            whole = F.lit(True)
            for c in ("w", "h"):
                whole = whole & ((floor(c) - 1) * cell <= area[f"lo_{c}"]) & ((floor(c) + 2) * cell > area[f"hi_{c}"])
            worst = best.groupBy(*numbers).agg(F.count("*").alias("_n"), F.max("distance").alias("_worst"))
            state = checkpointed(open_.join(worst, numbers, "left").select(*numbers, (whole | ((F.col("_n") == k) & (F.col("_worst") < edge))).alias("_done")))
            final = best.join(state.where("_done").select(*numbers), numbers, "left_semi")
            found = found.unionByName(checkpointed(final.select(*[F.col(c).alias(f"a_{c}") for c in numbers], *[F.col(f"_{c}").alias(c) for c in numbers], F.col("distance").cast("double").alias("distance"), "rank")))
            open_ = state.where("not coalesce(_done, false)").select(*numbers)
            if open_.isEmpty():
                break
            cell *= 2
    same = [F.col(f"_own_{c}") == F.col(f"a_{c}") for c in numbers]
    return asked.select(F.col(key), *[F.col(c).alias(f"_own_{c}") for c in numbers]).join(found, same).select(key, *numbers, "distance", "rank")


def merged_patch(old: Column, new: Column, set_: Column, fields: Sequence[str]) -> Column:
    """The fields that set_ (an array of names) names from the new patch, null ones too, the others from the old."""
    return F.struct(*[F.when(F.coalesce(F.array_contains(set_, f), F.lit(False)), new[f]).otherwise(old[f]).alias(f) for f in fields])


def with_source(sources: Column, confidence: Column, url: Column) -> tuple[Column, Column]:
    """The sources with a new one added once, and the confidence, which a source lifts to verified."""
    more = F.when(url.isNull() | F.array_contains(sources, url), sources).otherwise(F.concat(sources, F.array(url)))
    return more, F.when(url.isNotNull(), "verified").otherwise(confidence)


def patch_fault(sources: Column, confidence: Column) -> Column:
    """VALIDATION_ERROR where what a patch leads to is verified without a source, else null."""
    return F.when((confidence == "verified") & (F.coalesce(F.size(sources), F.lit(0)) <= 0), "VALIDATION_ERROR")


def device_from_form(forms: DataFrame) -> DataFrame:
    """Devices as a moderator enters them; code is VALIDATION_ERROR, and the rest of no use, where a supported one has no source.

    forms: id, brand, brand_title, marketing_name, support, and sources, aliases (lists), notes, popularity, which may be null.
    """
    sourced = F.coalesce(F.size("sources"), F.lit(0)) > 0
    name = F.concat_ws(" ", "brand_title", "marketing_name")
    none = F.array().cast("array<string>")
    return forms.select(
        "id", "brand", "brand_title", "marketing_name", "support",
        F.when((F.col("support") == "supported") & ~sourced, "VALIDATION_ERROR").alias("code"),
        name.alias("display_name"),
        F.array_distinct(F.concat(F.coalesce("aliases", none), F.array(F.lower(name)))).alias("aliases"),
        F.when(F.col("support") == "not_supported", "none").otherwise("physical+esim").alias("dual_sim"),
        F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("popularity", F.lit(0.5)).alias("popularity"),
        F.coalesce("sources", none).alias("sources"),
        F.when(sourced, "verified").otherwise("derived").alias("confidence"),
    )


def transition(kind: Column, action: Column) -> Column:
    """rejected, resolved or invalid."""
    out = F.when(action == "reject", "rejected")
    for name, allowed in TRANSITIONS.items():
        out = out.when((kind == name) & action.isin(*allowed), "resolved")
    return out.otherwise("invalid")


def refused(kept: Column, rejected: Column, most: float = 0.2) -> Column:
    """Whether too large a share was rejected for a load to go on."""
    return (kept + rejected > 0) & (rejected > most * (kept + rejected))


def evaluated(rows: DataFrame, category: str) -> DataFrame:
    """Counts by category and in total of rows (expected, expected_id, status, device, matches, kind)."""
    asks = F.col("status") == rules.ASK
    grouped = F.col("device").isNull() & (~asks | F.coalesce(F.col("kind").isin("answer_question", "check_on_device"), F.lit(False)))
    actual = F.when(asks & (F.col("matches") > 0), "clarification").when(F.col("device").isNotNull() | grouped, "match").otherwise("not_found")
    named = F.col("expected_id").isNull() | F.coalesce(F.col("device") == F.col("expected_id"), F.lit(False)) | (grouped & (F.col("expected") == "match"))
    r = rows.withColumn("actual", actual).withColumn("right", (F.col("actual") == F.col("expected")) & named)
    n = lambda c, name: F.count_if(c).alias(name)
    want, got = F.col("expected"), F.col("actual")
    out = r.rollup(category).agg(F.count("*").alias("total"), n(F.col("right"), "correct"), n((got == "match") & F.col("device").isNotNull() & ~F.col("right"), "false_positive"), n(want == "clarification", "expected_clarifications"), n((want == "clarification") & (got == "clarification"), "correct_clarifications"), n(want == "match", "expected_matches"), n((want == "match") & (got == "clarification"), "excess_clarifications"), n(got == "match", "automatic"))
    return out.withColumn(category, F.coalesce(category, F.lit("total")))


def detection_evaluated(rows: DataFrame, category: str) -> DataFrame:
    """Counts by category and in total of rows that compare given and expected status, platform, type, exact and device."""
    same = lambda c: F.col(f"given_{c}").eqNullSafe(F.col(f"expected_{c}"))
    right = same("status") & same("platform") & same("type") & same("exact") & (~F.col("expected_exact") | same("device"))
    automatic, wants = F.col("given_status") != rules.ASK, F.col("expected_status") != rules.ASK
    n = lambda c, name: F.count_if(c).alias(name)
    out = rows.rollup(category).agg(F.count("*").alias("total"), n(right, "correct"), n(automatic & ~same("status"), "false_positive"), n(~wants & ~automatic, "correct_clarifications"), n(wants & ~automatic, "excess_clarifications"), n(automatic, "automatic"))
    return out.where("total > 0").withColumn(category, F.coalesce(category, F.lit("total")))


def retained(rows: DataFrame, time: str, now: Column, days: int, shorter: Mapping[str, int], kind: str) -> DataFrame:
    """Rows of the last `days`; those of a kind in `shorter` only of so many. A null kind has the full time."""
    own = F.coalesce(*[F.when(F.col(kind) == k, n) for k, n in shorter.items()], F.lit(days))
    return rows.where(F.col(time) > now - F.make_dt_interval(own))


def filled_counts(rows: DataFrame, by: str, levels: Sequence[str], name: str) -> DataFrame:
    """A row per level with its number of rows, 0 too."""
    every = rows.sparkSession.createDataFrame([(x,) for x in levels], f"{name} string")
    counted = rows.groupBy(F.col(by).alias(name)).agg(F.count("*").alias("n"))
    return every.join(counted, name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def presented(status: Column, name: Column, exact: Column) -> Column:
    """struct(title, action) of an answer."""
    title = F.when(status == rules.YES, F.concat(name, F.lit(" can use an eSIM"))).when(status == rules.NO, F.concat(name, F.lit(" has no eSIM"))).otherwise("Which model is it?")
    return F.struct(title.alias("title"), F.when(status == rules.ASK, "clarify").when((status == rules.NO) | exact, "manual_search").otherwise("clarify").alias("action"))
