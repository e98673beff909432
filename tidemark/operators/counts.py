"""Winner/loser unpivot and component counts with quarantine instead of repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The components, their inputs, and the codes' names of the inputs.
INPUTS = {
    "F": ["first_serves_in", "service_points"],
    "A": ["aces", "first_serves_in"],
    "Q1": ["first_serve_points_won", "aces", "first_serves_in"],
    "D": ["double_faults", "service_points", "first_serves_in"],
    "Q2": ["second_serve_points_won", "service_points", "first_serves_in", "double_faults"],
}


def unpivot_sides(wide: DataFrame, keys: list[str], sides: dict[str, str], fields: list[str]) -> DataFrame:
    """Two reciprocal rows for each wide row: sides maps an orientation to its column prefix."""
    (a, p), (b, q) = sides.items()

    def side(name: str, mine: str, other: str) -> Column:
        own = [F.col(f"{mine}{f}").alias(f) for f in fields]
        return F.struct(F.lit(name).alias("orientation"), F.col(f"{mine}id").alias("player_id"), F.col(f"{other}id").alias("opponent_id"), *own)

    return wide.select(*keys, F.explode(F.array(side(a, p, q), side(b, q, p))).alias("s")).select(*keys, "s.*")


def _parts() -> dict[str, tuple[Column, Column, list[tuple[str, Column]]]]:
    """For each component successes, trials and the identities that its inputs must not break."""
    n, f, a, w1, d, w2 = (F.col(c) for c in ("service_points", "first_serves_in", "aces", "first_serve_points_won", "double_faults", "second_serve_points_won"))
    first, ace, second = ("FIRST_SERVES_IN_GT_SERVICE_POINTS", f > n), ("ACES_GT_FIRST_SERVES_IN", a > f), ("DOUBLE_FAULTS_GT_SECOND_SERVE_OPPORTUNITIES", d > n - f)
    return {
        "F": (f, n, [first]),
        "A": (a, f, [ace]),
        "Q1": (w1 - a, f - a, [ace, ("ACES_GT_FIRST_SERVE_POINTS_WON", a > w1), ("FIRST_SERVE_POINTS_WON_GT_FIRST_SERVES_IN", w1 > f)]),
        "D": (d, n - f, [first, second]),
        "Q2": (w2, n - f - d, [first, second, ("SECOND_SERVE_POINTS_WON_GT_PLAYABLE_SECOND_SERVES", w2 > n - f - d)]),
    }


def component_counts(rows: DataFrame, keys: list[str], malformed: str | None = None) -> DataFrame:
    """Five rows for each service row: component, successes, trials, status, eligible and anomaly codes.

    malformed names an array column of fields that could not be parsed; components that use one are quarantined."""
    fields = sorted({c for names in INPUTS.values() for c in names})
    out = rows.select(*keys, *fields, *([malformed] if malformed else []), F.explode(F.array(*map(F.lit, INPUTS))).alias("component"))

    def by_component(values: dict[str, Column]) -> Column:
        case = None
        for name, value in values.items():
            case = F.when(F.col("component") == name, value) if case is None else case.when(F.col("component") == name, value)
        return case

    parts = _parts()
    tests = {
        name: [(f"NEGATIVE_{c.upper()}", F.col(c) < 0) for c in INPUTS[name]] + broken + [("NEGATIVE_TRIALS", of < 0), ("NEGATIVE_SUCCESSES", hit < 0), ("SUCCESSES_GT_TRIALS", hit > of)]
        for name, (hit, of, broken) in parts.items()
    }
    # Plain tests say the status; the codes are put together only for what they quarantine, and not at all where nothing reads them.
    missing = by_component({name: reduce(lambda x, y: x | y, [F.col(c).isNull() for c in INPUTS[name]]) for name in INPUTS})
    bad = by_component({name: reduce(lambda x, y: x | y, [t for _, t in found]) for name, found in tests.items()})
    broken_field = by_component({name: F.arrays_overlap(F.col(malformed), F.array(*map(F.lit, INPUTS[name]))) for name in INPUTS}) if malformed else F.lit(False)
    out = out.select(*keys, *fields, "component", by_component({n: x[0] for n, x in parts.items()}).alias("successes"), by_component({n: x[1] for n, x in parts.items()}).alias("trials"), broken_field.alias("_field"), missing.alias("_missing"), bad.alias("_bad"))
    status = F.when(F.col("_field"), "quarantined").when(F.col("_missing"), "missing_input").when(F.col("_bad"), "quarantined").when(F.col("trials") == 0, "zero_denominator").otherwise("valid")
    listed = by_component({name: F.array_distinct(F.array_compact(F.array(*[F.when(t, F.lit(code)) for code, t in found]))) for name, found in tests.items()})
    codes = F.when(F.col("_field"), F.array(F.lit("MALFORMED_INPUT"))).when(~F.col("_missing") & F.col("_bad"), listed).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, "component", "successes", "trials", status.alias("status"), codes.alias("anomaly_codes"), (status == "valid").alias("eligible"))


def status_summary(counts: DataFrame) -> DataFrame:
    valid = F.col("status") == "valid"
    return counts.groupBy("component", "status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(valid, F.col("successes"))).alias("successes"), F.sum(F.when(valid, F.col("trials"))).alias("trials"), F.count_if("eligible").alias("n_eligible")
    )


def anomalies(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each code of each count row."""
    return counts.select(*keys, "component", F.explode("anomaly_codes").alias("code"))
