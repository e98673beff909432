"""Typed predicates over simulated paths: compiled to columns, with null for unresolved; settlement and estimates.

A path row has winner, walkover, started, completed, best_of, sets (array of struct a, b, tiebreak), and for each
player struct s0 and s1 with games, aces, double_faults, breaks, first_in, first_won, winners, errors; durations is an array of displayed minutes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Predicates that cannot become false once they are true.
MONOTONE = {"PLAYER_WINS_SET", "DECIDING_SET", "ANY_TIEBREAK", "ANY_LOPSIDED_SET", "BOTH_BREAK"}
MONOTONE_COUNTS = {"TIEBREAK_COUNT", "TOTAL_GAMES", "PLAYER_GAMES", "BREAK_COUNT", "TOTAL_BREAKS", "PLAYER_ACES", "TOTAL_ACES", "PLAYER_DF", "TOTAL_DF", "WINNERS", "UNFORCED_ERRORS", "TOTAL_UNFORCED_ERRORS"}


@dataclass(frozen=True)
class Prop:
    """An atom (kind, player, operator, threshold, scope) or AND / OR over parts."""

    kind: str
    player: int | None = None
    operator: str | None = None
    threshold: float | None = None
    scope: tuple = ()
    parts: tuple["Prop", ...] = field(default=())

    def record(self) -> dict:
        return {"kind": self.kind, "operator": self.operator, "parts": [p.record() for p in self.parts], "player": self.player, "scope": list(self.scope), "threshold": self.threshold}

    @property
    def prop_id(self) -> str:
        return hashlib.sha256(json.dumps(self.record(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def from_record(r: dict) -> Prop:
    return Prop(r["kind"], r["player"], r["operator"], r["threshold"], tuple(r["scope"]), tuple(from_record(p) for p in r["parts"]))


def _stat(player: int | None, name: str) -> Column:
    return F.col(f"s{player}.{name}")


def _both(name: str) -> Column:
    return _stat(0, name) + _stat(1, name)


def _set(n: int) -> Column:
    return F.try_element_at("sets", F.lit(n))


def measure(p: Prop) -> Column | None:
    """The number that a thresholded atom compares."""
    i = p.player
    table = {
        "TIEBREAK_COUNT": lambda: F.size(F.filter("sets", lambda s: s["tiebreak"])),
        "FIRST_SET_GAMES": lambda: _set(1)["a"] + _set(1)["b"],
        "TOTAL_GAMES": lambda: _both("games"),
        "PLAYER_GAMES": lambda: _stat(i, "games"),
        "BREAK_COUNT": lambda: _stat(i, "breaks"),
        "TOTAL_BREAKS": lambda: _both("breaks"),
        "FIRST_BREAK_TIMING": lambda: F.col("first_break"),
        "PLAYER_ACES": lambda: _stat(i, "aces"),
        "TOTAL_ACES": lambda: _both("aces"),
        "PLAYER_DF": lambda: _stat(i, "double_faults"),
        "TOTAL_DF": lambda: _both("double_faults"),
        "WINNERS": lambda: _stat(i, "winners"),
        "UNFORCED_ERRORS": lambda: _stat(i, "errors"),
        "TOTAL_UNFORCED_ERRORS": lambda: _both("errors"),
        "FIRST_SERVE_WIN_PCT": lambda: F.try_divide(100 * _stat(i, "first_won"), _stat(i, "first_in")),
    }
    return table[p.kind]() if p.kind in table else None


def _compare(x: Column, operator: str, k: float) -> Column:
    return {">=": x >= k, ">": x > k, "<": x < k}[operator]


def truth(p: Prop) -> Column:
    """True, false or null (unresolved)."""
    if p.kind in ("AND", "OR"):
        out = F.lit(p.kind == "AND")
        for part in p.parts:
            out = out & truth(part) if p.kind == "AND" else out | truth(part)
        return out
    i = p.player
    own, other = ("a", "b") if i != 1 else ("b", "a")
    won = F.size(F.filter("sets", lambda s: s[own] > s[other]))
    lost = F.size(F.filter("sets", lambda s: s[own] < s[other]))
    if (x := measure(p)) is not None:
        test = _compare(x, p.operator, p.threshold)
        return test if p.kind == "FIRST_SERVE_WIN_PCT" else F.coalesce(test, F.lit(False))
    if p.kind == "DURATION_MIN":
        yes, no = F.forall("durations", lambda d: _compare(d, p.operator, p.threshold)), F.forall("durations", lambda d: ~_compare(d, p.operator, p.threshold))
        return F.when(F.size("durations") <= 0, F.lit(None)).when(yes, True).when(no, False)
    atoms = {
        "MATCH_WIN": lambda: F.col("winner") == i,
        "EXACT_SCORE": lambda: (F.col("winner") == i) & (won == p.scope[0]) & (lost == p.scope[1]),
        "STRAIGHT_SETS": lambda: (F.col("winner") == i) & (lost == 0) & (won * 2 > F.col("best_of")),
        "PLAYER_WINS_SET": lambda: won >= 1,
        "DECIDING_SET": lambda: F.size("sets") >= F.col("best_of"),
        "FIRST_SET_WIN": lambda: F.coalesce(_set(1)[own] > _set(1)[other], F.lit(False)),
        "SET_TIEBREAK": lambda: F.coalesce(_set(p.scope[0])["tiebreak"], F.lit(False)),
        "ANY_TIEBREAK": lambda: F.exists("sets", lambda s: s["tiebreak"]),
        "ANY_LOPSIDED_SET": lambda: F.exists("sets", lambda s: ~s["tiebreak"] & (F.greatest(s["a"], s["b"]) == 6) & (F.least(s["a"], s["b"]) <= 2)),
        "SET_SCORE": lambda: F.coalesce((_set(p.scope[0])["a"] == p.scope[1]) & (_set(p.scope[0])["b"] == p.scope[2]), F.lit(False)),
        "GAME_HANDICAP": lambda: _stat(i, "games") + p.threshold > _stat(1 - i, "games"),
        "BOTH_BREAK": lambda: (_stat(0, "breaks") >= 1) & (_stat(1, "breaks") >= 1),
        "ACE_COMPARE": lambda: _stat(i, "aces") > _stat(1 - i, "aces"),
        "DF_COMPARE": lambda: _stat(i, "double_faults") > _stat(1 - i, "double_faults"),
        "WINNER_COMPARE": lambda: _stat(i, "winners") > _stat(1 - i, "winners"),
        "UE_COMPARE": lambda: _stat(i, "errors") > _stat(1 - i, "errors"),
    }
    return atoms[p.kind]()


def settlement(p: Prop) -> Column:
    """YES, NO, VOID or UNRESOLVED for a path, also one that was not completed."""
    if p.kind in ("AND", "OR"):
        states = [settlement(x) for x in p.parts]
        out = F.lit(p.kind == "AND")
        for s in states:
            t = F.when(s == "YES", True).when(s == "NO", False)
            out = out & t if p.kind == "AND" else out | t
        unresolved = F.lit(False)
        for s in states:
            unresolved = unresolved | (s == "UNRESOLVED")
        return F.when(out, "YES").when(~out, "NO").when(unresolved, "UNRESOLVED").otherwise("VOID")
    t = truth(p)
    told = F.when(t, "YES").when(~t, "NO").otherwise("UNRESOLVED")
    out = F.when(F.col("walkover") | ~F.col("started"), "VOID")
    if p.kind == "MATCH_WIN":
        return out.otherwise(told)
    out = out.when(F.col("completed"), told)
    if p.kind in ("FIRST_SET_WIN", "FIRST_SET_GAMES"):
        out = out.when(F.size("sets") >= 1, told)
    if p.kind in ("SET_SCORE", "SET_TIEBREAK"):
        out = out.when(F.size("sets") >= p.scope[0], told)
    if p.kind == "FIRST_BREAK_TIMING":
        out = out.when(measure(p).isNotNull(), told)
    if p.kind == "DURATION_MIN":
        out = out.when(t.isNull(), "UNRESOLVED")
    if p.kind in MONOTONE or p.kind in MONOTONE_COUNTS and p.operator in (">=", ">"):
        out = out.when(t, "YES")
    return out.otherwise("VOID")


def estimates(paths: DataFrame, props: dict[str, Prop], by: list[str]) -> DataFrame:
    """Counts of the four states, probability over settled paths and its standard error, of all props in one scan."""
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("prop"), settlement(p).alias("state")) for n, p in props.items()]))
    rows = paths.select(*by, stack.alias("s")).select(*by, "s.*")
    count = lambda x: F.count_if(F.col("state") == x)
    out = rows.groupBy(*by, "prop").agg(count("YES").alias("yes"), count("NO").alias("no"), count("VOID").alias("void"), count("UNRESOLVED").alias("unresolved"))
    p = F.try_divide(F.col("yes").cast("double"), (F.col("yes") + F.col("no")).cast("double"))
    return out.withColumn("p", p).withColumn("se", F.sqrt(F.try_divide(F.col("p") * (1 - F.col("p")), (F.col("yes") + F.col("no")).cast("double"))))
