"""Synthetic reviews: templates, slots and joins chosen by hashes of a row's id.

A product has a latent quality on each axis, drawn from its name; a review draws
one to three axes, a polarity for each from the quality, a clause for each
polarity, and joins that tell agreement from contrast. Surface noise roughens
case and punctuation at last. Every draw is a hash of the row's id and the
draw's name, so a review is the same in every run and on every machine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.constants import AXES
from aspectra.functions.scores import hash_uniform

OPENINGS = ("", "", "I have had the {p} for a month. ", "Bought the {p} last week. ", "My second {p} by now. ", "After some weeks with it: ")
CLOSINGS = ("", "", "", " Make of that what you will.", " That is all I can say so far.")
SLOTS = {
    "good": ("excellent", "a pleasure", "better than I hoped"),
    "bad": ("a let-down", "poor", "worse than I feared"),
    "fair": ("all right", "what you would expect", "neither here nor there"),
    "very": ("", "really ", "honestly "),
    "time": ("a day", "a week", "two months"),
}
CLAUSES = {
    "battery": {"positive": ("the battery is {very}{good}", "one charge gets me through {time}"), "neutral": ("the battery is {fair}",), "negative": ("the battery is {very}{bad}", "it was flat before noon after {time}")},
    "camera": {"positive": ("the camera is {very}{good}", "pictures came out sharp even at dusk"), "neutral": ("the camera is {fair}",), "negative": ("the camera is {very}{bad}", "pictures have looked washed out for {time}")},
    "price": {"positive": ("it costs little for what it does", "the price is {very}{good}"), "neutral": ("the price is {fair}",), "negative": ("the price is {very}{bad}", "it cost far too much for {time} of use")},
    "display": {"positive": ("the screen is {very}{good}", "I can read it in full sun"), "neutral": ("the screen is {fair}",), "negative": ("the screen is {very}{bad}", "it began to flicker within {time}")},
    "performance": {"positive": ("it is {very}fast", "nothing has slowed it down in {time}"), "neutral": ("speed is {fair}",), "negative": ("it is {very}slow", "it hangs every time I open a page")},
}
JOINS = {True: (", but ", ". Then again, ", ", although ", ". Sadly or not, "), False: (". ", ", and ", ". Also, ", ". Besides, ")}
MOST_ASPECTS = 3
NEUTRAL = 0.06
QUALITY = (2.5, 9.5)
# Shares of reviews in capitals and in small letters, with an exclamation mark, and with dots at the end.
NOISE = (0.06, 0.08, 0.10, 0.06)


def _pick(options: tuple[str, ...], u: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in options)), F.floor(u * len(options)).cast("int"))


def quality_of(name: Column, axis: Column) -> Column:
    """Latent quality of a product on an axis."""
    return QUALITY[0] + (QUALITY[1] - QUALITY[0]) * hash_uniform(F.concat_ws("|", name, axis), "quality")


def polarity_of(quality: Column, u: Column) -> Column:
    """Neutral in a fixed share; else positive in proportion to the quality's place on its scale."""
    positive = (quality - 1) / 9 * (1 - NEUTRAL)
    return F.when(u < NEUTRAL, "neutral").when(u < NEUTRAL + positive, "positive").otherwise("negative")


def surface_noise(text: Column, draw) -> Column:  # noqa: ANN001
    u = draw("case")
    out = F.when(u < NOISE[0], F.upper(text)).when(u < NOISE[0] + NOISE[1], F.lower(text)).otherwise(text)
    at = F.instr(out, ".")
    out = F.when((draw("mark") < NOISE[2]) & (at > 0), F.concat(out.substr(F.lit(1), at - 1), F.lit("!"), out.substr(at + 1, F.length(out)))).otherwise(out)
    return F.when(draw("dots") < NOISE[3], F.concat(F.rtrim(out, F.lit(".")), F.lit("..."))).otherwise(out)


def reviews(products: DataFrame, each: int, most_aspects: int = MOST_ASPECTS) -> DataFrame:
    """``each`` reviews of every product, with their labels and the clauses that carry them."""
    rows = products.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(each)))).withColumn("review_id", F.concat_ws("-", F.lit("syn"), "model_key", F.col("number").cast("string")))
    draw = lambda name: hash_uniform(F.col("review_id"), name)
    shuffled = F.array_sort(F.array(*(F.struct(draw(f"axis-{a}").alias("u"), F.lit(a).alias("axis")) for a in AXES)))
    n = (1 + F.floor(draw("aspects") * most_aspects)).cast("int")
    out = rows.select("*", F.slice(F.transform(shuffled, lambda x: x["axis"]), 1, n).alias("axes"))
    parts: list[tuple[Column, Column]] = []
    for k in range(most_aspects):
        axis = F.get("axes", k)
        polarity = polarity_of(quality_of(F.col("name"), axis), draw(f"polarity-{k}"))
        out = out.withColumns({f"_axis{k}": axis, f"_polarity{k}": F.when(axis.isNotNull(), polarity)})
        cases = [((F.col(f"_axis{k}") == a) & (F.col(f"_polarity{k}") == p), _pick(options, draw(f"clause-{k}"))) for a, by in CLAUSES.items() for p, options in by.items()]
        clause = reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0]))
        for slot, words in SLOTS.items():
            clause = F.replace(clause, F.lit(f"{{{slot}}}"), _pick(words, draw(f"{slot}-{k}")))
        out = out.withColumn(f"_clause{k}", clause)
        contrast = F.col(f"_polarity{k}") != F.col(f"_polarity{k - 1}") if k else F.lit(False)
        join = F.when(contrast, _pick(JOINS[True], draw(f"join-{k}"))).otherwise(_pick(JOINS[False], draw(f"join-{k}"))) if k else F.lit("")
        parts.append((F.col(f"_clause{k}"), F.coalesce(F.concat(join, f"_clause{k}"), F.lit(""))))
    body = F.concat(F.replace(_pick(OPENINGS, draw("opening")), F.lit("{p}"), F.col("name")), *(p for _, p in parts), F.lit("."), _pick(CLOSINGS, draw("closing")))
    text = F.concat(F.upper(F.substring(body, 1, 1)), body.substr(F.lit(2), F.length(body)))
    listed = lambda c: F.filter(F.array(*(F.struct(F.col(f"_axis{k}").alias("key"), F.col(f"_{c}{k}").alias("value")) for k in range(most_aspects))), lambda x: x["key"].isNotNull())
    labels, clauses = (F.to_json(F.map_from_entries(listed(c))) for c in ("polarity", "clause"))
    return out.select("review_id", "model_key", surface_noise(text, draw).alias("text"), labels.alias("labels"), clauses.alias("clauses"))
