"""Scalar functions as columns: numbers, dates, names, scores and identities."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean that there is none.
MISSING = ["", "NA", "N/A", "NAN", "NULL", "NONE"]
#: Rounds by their other names.
ROUNDS = {"1st round": "R1", "2nd round": "R2", "3rd round": "R3", "4th round": "R4", "quarterfinals": "QF", "semifinals": "SF", "the final": "F"}


def round_code(name: Column) -> Column:
    """A round's code by its other name, or the text itself in capitals."""
    known = F.create_map(*[F.lit(x) for kv in ROUNDS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(name))), F.upper(F.trim(name)))


def logistic(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column, bound: float = 1e-9) -> Column:
    q = F.least(F.lit(1 - bound), F.greatest(F.lit(bound), p))
    return F.log(q / (1 - q))


def softplus(x: Column) -> Column:
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def recency_weight(age_days: Column, half_life: float, window: int) -> Column:
    """Two to the minus age over half life; 0 beyond the window."""
    return F.when(age_days <= window, F.pow(F.lit(2.0), -age_days / F.lit(float(half_life)))).otherwise(0.0)


def percent_half_up(p: Column) -> Column:
    return F.floor(p * 100 + 0.5).cast("long")


def platform_percent(x: Column) -> Column:
    return F.least(F.lit(99), F.greatest(F.lit(1), x))


def serve_win(f: Column, a: Column, q1: Column, d: Column, q2: Column) -> Column:
    """Points won on service from the five components."""
    return f * (a + (1 - a) * q1) + (1 - f) * ((1 - d) * q2)


def hold(p: Column) -> Column:
    """Probability to win a service game at p a point: to 0, 15 and 30, and over deuce."""
    q = 1 - p
    return p**4 * (1 + 4 * q + 10 * q**2) + 20 * p**3 * q**3 * p**2 / (p**2 + q**2)


def _not_negative(x: Column, what: str) -> Column:
    return F.when(x < 0, F.raise_error(F.lit(f"negative {what}")).cast("double")).otherwise(x)


def inactivity_factors(days: Column) -> tuple[Column, Column]:
    """Factors of mean and variance after days without a match, from the ninetieth on; negative days are an error, null days have none."""
    days = _not_negative(days, "days")
    m = F.pow(F.lit(2.0), -F.greatest(F.lit(0), days - 90) / F.lit(180.0))
    m = F.when(days.isNotNull(), m)
    return m, 2 - m * m


def inactivity_band(days: Column) -> Column:
    """Null days are a cold start; negative ones an error."""
    days = _not_negative(days, "days")
    return F.when(days.isNull(), "COLD_START").when(days <= 90, "D_LE_90").when(days <= 180, "D_91_180").when(days <= 365, "D_181_365").otherwise("D_GT_365")


def intensity(rho: Column) -> Column:
    """Retirement probability of a match as an intensity a game, over 22 games."""
    return -F.log1p(-rho) / 22


def hazard(rate: Column) -> Column:
    return -F.expm1(-rate)


def competing(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Probabilities that none, the first, the second retires in a game."""
    total = a + b
    none = F.exp(-total)
    share = F.when(total > 0, a / total).otherwise(0.0)
    return none, (1 - none) * share, F.when(total > 0, (1 - none) * (1 - share)).otherwise(0.0)


def history_band(starts: Column) -> Column:
    """Band of weighted starts; negative ones are an error."""
    starts = _not_negative(starts, "starts")
    return F.when(starts == 0, "no_history").when(starts < 25, "sparse").when(starts < 100, "intermediate").when(starts >= 100, "substantial")


def no_vig(a: Column, b: Column) -> tuple[Column, Column]:
    """Decimal prices of the two sides as probabilities that add up to 1, and the overround."""
    over = 1 / a + 1 / b
    return (1 / a) / over, over


def elo_expectation(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bounded(x: Column) -> Column:
    return x / (1 + x)


def optional_text(x: Column) -> Column:
    return F.when(~F.upper(F.trim(x)).isin(MISSING), F.trim(x))


def optional_integer(x: Column) -> tuple[Column, Column]:
    """The integer, and whether the text is malformed: neither missing nor an integer."""
    text = optional_text(x)
    whole = text.rlike(r"^-?\d+$")
    return F.when(whole, text).cast("bigint"), F.coalesce(text.isNotNull() & ~whole, F.lit(False))


def parse_date(x: Column) -> Column:
    return F.coalesce(F.try_to_date(x, "yyyyMMdd"), F.try_to_date(x, "yyyy-MM-dd"))


def clock_minutes(x: Column) -> Column:
    """H:MM as minutes, else null."""
    return F.when(x.rlike(r"^\d+:\d\d$"), F.split_part(x, F.lit(":"), F.lit(1)).cast("bigint") * 60 + F.split_part(x, F.lit(":"), F.lit(2)).cast("bigint"))


def confidence_band(p: Column) -> Column:
    far = F.abs(p - 0.5)
    return F.when(far >= 0.4, "High").when(far >= 0.25, "Medium").otherwise("Low")


def expected_round(code: Column, draw: Column) -> Column:
    """R128, R64 ... as R1, R2 ... of a draw of that size, which is filled up to a power of two."""
    levels = F.ceil(F.log2(F.greatest(draw, F.lit(2)).cast("double"))).cast("int")
    size = F.regexp_extract(code, r"^R(\d+)$", 1)
    return F.when(size != "", F.concat(F.lit("R"), (levels - F.log2(F.when(size != "", size).cast("double")).cast("int") + 1).cast("string"))).otherwise(code)


def set_pairs(score: Column) -> Column:
    """Games of each set; null if there is none."""
    found = F.regexp_extract_all(score, F.lit(r"(\d+)-(\d+)"), F.lit(0))
    pairs = F.transform(found, lambda s: F.struct(F.split_part(s, F.lit("-"), F.lit(1)).cast("int").alias("a"), F.split_part(s, F.lit("-"), F.lit(2)).cast("int").alias("b")))
    return F.when(F.size(found) > 0, pairs)


def set_winner(a: Column, b: Column) -> Column:
    """0 or 1 for a legal finished set, else null."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    legal = ((hi == 6) & (lo <= 4)) | ((hi == 7) & lo.isin(5, 6)) | ((hi >= 8) & (lo >= 6) & (hi - lo == 2))
    return F.when(legal, (b > a).cast("int"))


def reverse_score(score: Column) -> Column:
    return F.array_join(F.transform(F.split(score, " "), lambda s: F.regexp_replace(s, r"^(\[?)(\d+)-(\d+)", "$1$3-$2")), " ")


def game_score(own: Column, other: Column) -> Column:
    """0, 15, 30, 40 and advantage from points."""
    names = F.array(*map(F.lit, ["0", "15", "30", "40"]))
    return F.when((own >= 3) & (other >= 3), F.when(own == other, "40-40").when(own > other, "AD-40").otherwise("40-AD")).otherwise(F.concat(F.try_element_at(names, (own + 1).cast("int")), F.lit("-"), F.try_element_at(names, (other + 1).cast("int"))))


def tiebreak_server(first: Column, played: Column) -> Column:
    """Who serves the next point: one point, then two in turn."""
    return (first + F.floor((played + 1) / 2).cast("int")) % 2


def stable_id(*parts: Column) -> Column:
    """sha256 of the parts as text with a separator between; a null part counts as None."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Version 5 UUID, natively: sha1 of namespace and name, with the version's and the variant's bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
