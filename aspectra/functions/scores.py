"""Score, price and match arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectra.constants import ANCHORS, AXES, BANDS, POLARITIES


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(c: Column | str, places: int) -> Column:
    """Half up on the binary product, as SQL engines round; ``round`` takes the shortest decimal instead, and halves differ."""
    scale = 10.0**places
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def positivity(p: list[Column]) -> Column:
    return sum((c * a for c, a in zip(p[1:], ANCHORS[1:])), p[0] * ANCHORS[0])


def to_score(p: list[Column]) -> Column:
    """Probabilities of the three polarities on the scale of 1 to 10."""
    return 1 + 9 * positivity(p)


def score_label(score: Column) -> Column:
    out = F.lit(BANDS[0][1])
    for low, name in BANDS[1:]:
        out = F.when(score >= low, name).otherwise(out)
    return out


def first_max(values: list[Column], names: tuple[str, ...] = POLARITIES) -> Column:
    """Name of the first largest value."""
    top = F.greatest(*values)
    out = F.lit(None).cast("string")
    for v, name in reversed(list(zip(values, names))):
        out = F.when(v == top, name).otherwise(out)
    return out


def softmax(logits: list[Column], temperature: float = 1.0) -> list[Column]:
    top = F.greatest(*logits)
    powers = [F.exp((x - top) / temperature) for x in logits]
    total = sum(powers[1:], powers[0])
    return [x / total for x in powers]


def price_to_score(price: Column, cheapest: Column, dearest: Column) -> Column:
    """Cheap is 10, dear is 1, linear in the logarithm, clipped; 5.5 where the bounds are equal."""
    clipped = F.least(F.greatest(price, cheapest), dearest)
    share = (F.ln(clipped) - F.ln(cheapest)) / F.nullif(F.ln(dearest) - F.ln(cheapest), F.lit(0.0))
    return F.coalesce(10 - 9 * share, F.when(price.isNotNull(), 5.5))


def score_to_price(score: Column, cheapest: Column, dearest: Column) -> Column:
    share = (10 - F.least(F.greatest(score, F.lit(1.0)), F.lit(10.0))) / 9
    return F.exp(F.ln(cheapest) + share * (F.ln(dearest) - F.ln(cheapest)))


def shortfall(need: Column, have: Column) -> Column:
    return F.greatest(F.lit(0.0), need - have)


def match_percent(needs: list[Column], gaps: list[Column]) -> Column:
    """100 less the length of the gaps over the length of all that was asked above 1."""
    sq = lambda xs: F.sqrt(sum((x * x for x in xs[1:]), xs[0] * xs[0]))
    return 100 * (1 - F.coalesce(sq(gaps) / F.nullif(sq([n - 1 for n in needs]), F.lit(0.0)), F.lit(0.0)))


def worst_axis(gaps: list[Column]) -> Column:
    """The first axis with the largest gap; null without any."""
    return F.when(F.greatest(*gaps) > 0, first_max(gaps, AXES))


def ladder(value: Column, steps: tuple[tuple[float, str], ...], rest: str) -> Column:
    """The name of the first step that the value reaches."""
    out = F.lit(rest)
    for low, name in reversed(steps):
        out = F.when(value >= low, name).otherwise(out)
    return out


RELIABILITY = (((0.80, "strong"), (0.60, "usable"), (0.40, "weak")), "NOISE")
STARS = (((0.90, "REDUNDANT"), (0.70, "largely redundant"), (0.40, "correlated but distinct")), "independent of stars")
NULL_RATIO = (((3.0, "well above null"), (1.5, "above null")), "NOT ABOVE NULL")
RECOVERY = (((0.7, "recovered"), (0.4, "partly recovered")), "not recovered")


def hash_uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a key and a seed, the same in every engine."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("|" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
