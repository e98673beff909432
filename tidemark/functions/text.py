"""Names, surfaces, ids and scores from text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import MISSING, set_winner

#: Tokens that end a score, and what they say.
TERMINAL = {"RET": "retirement", "RET.": "retirement", "W/O": "walkover", "WO": "walkover", "DEF": "default", "ABN": "abandoned", "ABD": "abandoned"}
#: Texts in a score that tell that it was not played out, in the order in which they are looked for.
MARKERS = [("W/O", "WALKOVER"), ("RET", "RETIREMENT"), ("DEF", "DEFAULT"), ("ABD", "ABANDONED"), ("BYE", "BYE")]
#: Surfaces.
SURFACES = ["Hard", "Clay", "Grass", "Carpet"]
#: Days from the start of an event to a round, at events of two weeks and at others.
LONG_OFFSETS = {"Q1": -6, "Q2": -4, "Q3": -2, "R128": 0, "R64": 2, "R32": 4, "R16": 6, "QF": 8, "SF": 11, "F": 13}
SHORT_OFFSETS = {"Q1": -3, "Q2": -2, "Q3": -1, "R128": 0, "R64": 1, "R32": 2, "R16": 3, "QF": 4, "SF": 5, "F": 6}


def _decomposed(text: Column) -> Column:
    """Compatibility decomposition without combining marks; the only step that Spark has no function for."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        # Names of plain letters, most of them, are left as they are.
        plain = lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
        return values.map(lambda v: v if v is None or v.isascii() else plain(v))

    return fold(text)


def spaced_name(text: Column) -> Column:
    """Accents off, lower case, runs of letters and digits with one blank between."""
    return F.array_join(F.regexp_extract_all(F.lower(_decomposed(text)), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def joined_name(text: Column) -> Column:
    """Accents off, lower case, nothing but letters and digits."""
    return F.regexp_replace(F.lower(_decomposed(text)), "[^a-z0-9]+", "")


def hyphen_name(text: Column) -> Column:
    """Accents and other letters off, lower case, hyphens as blanks, single blanks; apostrophes and points stay."""
    ascii_text = F.regexp_replace(_decomposed(text), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(ascii_text), "-", " "), r"\s+", " "))


def name_signature(text: Column) -> Column:
    """First initial and last token of a name, letters only."""
    words = F.regexp_extract_all(F.lower(_decomposed(text)), F.lit("[a-z]+"), F.lit(0))
    return F.when(F.size(words) >= 1, F.concat_ws("|", F.left(F.element_at(words, 1), F.lit(1)), F.element_at(words, -1)))


def surface(text: Column) -> Column:
    """The first word as one of SURFACES, else null."""
    first = F.initcap(F.lower(F.regexp_extract(F.trim(text), r"^([A-Za-z]+)", 1)))
    return F.when(first.isin(SURFACES), first)


def clean_id(text: Column) -> Column:
    """Trimmed, without a trailing .0; what means that there is none is empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.upper(t).isin(MISSING), "").otherwise(F.regexp_replace(t, r"\.0$", ""))


def match_number(text: Column) -> Column:
    """The integer of a number text, null if it is none."""
    return F.when(clean_id(text).rlike(r"^-?\d+$"), clean_id(text)).cast("long")


def played_on(start: Column, round_: Column, level: Column) -> tuple[Column, Column]:
    """The day of a round by the event's start and a table of offsets, and whether the round is in the table."""
    tables = [F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) for t in (LONG_OFFSETS, SHORT_OFFSETS)]
    name = F.upper(F.trim(round_))
    days = F.when(F.upper(F.trim(level)) == "G", F.try_element_at(tables[0], name)).otherwise(F.try_element_at(tables[1], name))
    return F.date_add(start, F.coalesce(days, F.lit(0))), days.isNotNull()


def partial_set(a: Column, b: Column) -> Column:
    """Whether play may stand at these games in a set that is not over."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return (hi <= 5) | ((hi == 6) & (lo >= 5)) | ((hi > 6) & (hi - lo <= 1) & (lo >= 6))


def match_tiebreak_winner(a: Column, b: Column) -> Column:
    """0 or 1 for a finished tiebreak to 7 or 10 points in place of a set, else null."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    done = F.lit(False)
    for target in (7, 10):
        done = done | ((hi == target) & (lo <= target - 2)) | ((hi > target) & (hi - lo == 2))
    return F.when(done, (b > a).cast("int"))


def partial_match_tiebreak(a: Column, b: Column) -> Column:
    hi, lo = F.greatest(a, b), F.least(a, b)
    return (hi < 10) | (hi - lo <= 1)


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def validated_score(score: Column, best_of: Column) -> Column:
    """A score from the winner's side as a struct: valid, completed, termination, anomaly_codes (array, each once), wins_a, wins_b, service_games, official_games and sets.

    A set of 7-6 has 12 service games and 13 official ones; a tiebreak in place of a set has none. Games are null where a token cannot be read.
    A score with anomalies is not valid, and nothing derived from it should be used."""
    text = F.trim(F.coalesce(score, F.lit("")))
    words = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\s+"))
    terminal = F.create_map(*[F.lit(x) for kv in TERMINAL.items() for x in kv])
    none = F.array().cast("array<string>")

    def read(token: Column, i: Column, n: Column, ended: Column) -> Column:
        """One token: its kind, games, winner and what is wrong with it alone."""
        number = lambda k: F.regexp_extract(token, r"^\[?(\d{1,9})-(\d{1,9})(\(\d{1,9}\))?\]?$", k).try_cast("int")
        regular, bracket = token.rlike(r"^\d{1,9}-\d{1,9}(\(\d{1,9}\))?$"), token.rlike(r"^\[\d{1,9}-\d{1,9}\]$")
        a, b = number(1), number(2)
        winner = F.when(bracket, match_tiebreak_winner(a, b)).otherwise(set_winner(a, b))
        last = i == n - 1
        has_tiebreak = F.regexp_extract(token, r"\((\d+)\)", 1) != ""
        tiebreak_ok = ~has_tiebreak | ((F.least(a, b) == 6) & (F.greatest(a, b) == 7))
        may_stand = ended & last & F.when(bracket, partial_match_tiebreak(a, b)).otherwise(~has_tiebreak & partial_set(a, b))
        illegal = ~tiebreak_ok | (winner.isNull() & ~may_stand)
        return F.struct(
            (regular | bracket).alias("read"), bracket.alias("bracket"), a.alias("a"), b.alias("b"), winner.alias("winner"), F.coalesce(illegal & (regular | bracket), F.lit(False)).alias("illegal"), (bracket & ~last).alias("early")
        )

    def judge(x: Column) -> Column:
        words, best = x["words"], x["best"]
        ends = F.filter(words, lambda t: F.try_element_at(terminal, F.upper(t)).isNotNull())
        how = F.coalesce(F.try_element_at(terminal, F.upper(F.try_element_at(ends, F.lit(-1)))), F.lit("completed"))
        misplaced = (F.size(ends) > 1) | ((F.size(ends) == 1) & F.try_element_at(terminal, F.upper(F.element_at(words, -1))).isNull())
        body = F.when(F.size(ends) == 1, F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
        state = F.struct(how.alias("how"), misplaced.alias("misplaced"), body.alias("body"), best.alias("best"), (F.floor(best / 2) + 1).cast("int").alias("target"))
        return _once(state, lambda s: sets(s))

    def sets(s: Column) -> Column:
        n = F.size(s["body"])
        parsed = F.transform(s["body"], lambda t, i: read(t, i, n, s["how"] != "completed"))
        return _once(F.struct(s.alias("s"), parsed.alias("sets")), lambda y: total(y["s"], y["sets"]))

    def total(s: Column, parsed: Column) -> Column:
        target, ended = s["target"], s["how"] != "completed"
        unread = F.exists(parsed, lambda p: ~p["read"])
        # Sets in order: wins so far, sets after the end, tiebreaks that are not the decider, and sets that are not over.
        start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("after"), F.lit(False).alias("context"), F.lit(False).alias("open"), F.lit(False).alias("open_early"))

        def step(w, p):
            over = (w["a"] == target) | (w["b"] == target)
            return F.struct(
                (w["a"] + F.coalesce((p["winner"] == 0).cast("int"), F.lit(0))).alias("a"), (w["b"] + F.coalesce((p["winner"] == 1).cast("int"), F.lit(0))).alias("b"), (w["after"] | over).alias("after"),
                (w["context"] | (p["bracket"] & ((w["a"] != target - 1) | (w["b"] != target - 1)))).alias("context"), (w["open"] | p["winner"].isNull()).alias("open"), (w["open_early"] | w["open"]).alias("open_early"),
            )

        return _once(F.struct(s.alias("s"), parsed.alias("sets"), unread.alias("unread"), F.aggregate(parsed, start, step).alias("w")), lambda y: result(y["s"], y["sets"], y["unread"], y["w"], ended))

    def result(s: Column, parsed: Column, unread: Column, w: Column, ended: Column) -> Column:
        how, target, n = s["how"], s["target"], F.size(s["body"])
        bad_best, walkover = F.coalesce(~s["best"].isin(3, 5), F.lit(True)), how == "walkover"
        empty, judged = n == 0, (n > 0) & ~unread
        won, lost = w["a"] == target, w["b"] == target
        codes = F.when(bad_best, F.array(F.lit("SCORE_INVALID_BEST_OF")))
        codes = codes.when(s["misplaced"], F.array(F.lit("SCORE_INVALID_STATUS"))).when(walkover, F.when(empty, none).otherwise(F.array(F.lit("SCORE_WALKOVER_WITH_SCORE"))))
        codes = codes.when(empty, F.when(how == "completed", F.array(F.lit("SCORE_MISSING"))).otherwise(none))
        first_unread = F.coalesce(F.array_position(F.transform(parsed, lambda p: p["read"]), False), F.lit(0))
        seen = F.when(first_unread > 0, F.slice(parsed, F.lit(1), F.greatest(first_unread.cast("int") - 1, F.lit(0)))).otherwise(parsed)
        listed = [
            ("SCORE_MATCH_TIEBREAK_CONTEXT", F.exists(seen, lambda p: p["early"]) | (judged & w["context"])),
            ("SCORE_ILLEGAL_SET", F.exists(seen, lambda p: p["illegal"]) | (judged & w["open_early"])),
            ("SCORE_MALFORMED", unread),
            ("SCORE_TOO_MANY_SETS", judged & (n > s["best"])),
            ("SCORE_SET_AFTER_MATCH_END", judged & w["after"]),
            ("SCORE_WINNER_ORIENTATION_MISMATCH", judged & ~ended & lost & (w["a"] < target)),
            ("SCORE_INCOMPLETE_MATCH", judged & ~ended & ~won & ~(lost & (w["a"] < target))),
            ("SCORE_STATUS_AFTER_COMPLETION", judged & ended & (won | lost)),
        ]
        codes = codes.otherwise(F.array_compact(F.array(*[F.when(test, F.lit(c)) for c, test in listed])))
        plain = ~bad_best & ~s["misplaced"] & ~walkover & judged
        done = plain & (how == "completed") & ~w["open"] & (won | lost) & ~w["after"] & (n <= s["best"])
        known = ~bad_best & ~s["misplaced"] & F.when(walkover, empty).otherwise((n > 0) & ~unread)
        add = lambda per: F.aggregate(parsed, F.lit(0), lambda t, p: t + F.when(p["bracket"], 0).otherwise(per(p)))
        tied = lambda p: (F.least(p["a"], p["b"]) == 6) & (F.greatest(p["a"], p["b"]) == 7)
        service, official = add(lambda p: F.when(tied(p), 12).otherwise(p["a"] + p["b"])), add(lambda p: p["a"] + p["b"])
        return F.struct(
            (F.size(codes) == 0).alias("valid"), done.alias("completed"), how.alias("termination"), codes.alias("anomaly_codes"), F.when(plain, w["a"]).otherwise(0).alias("wins_a"), F.when(plain, w["b"]).otherwise(0).alias("wins_b"),
            F.when(known, service).alias("service_games"), F.when(known, official).alias("official_games"), F.transform(parsed, lambda p: F.struct(p["a"], p["b"], p["bracket"], p["winner"])).alias("sets"),
        )

    return _once(F.struct(words.alias("words"), best_of.cast("int").alias("best")), judge)


def with_scores(rows: DataFrame, score: str, best_of: Column, out: str) -> DataFrame:
    """rows with their validated score as a column. Scores repeat, so each different one is read once and joined back."""
    rows = rows.withColumn("_best", best_of)
    known = rows.select(F.col(score).alias("_text"), "_best").distinct().withColumn(out, validated_score(F.col("_text"), F.col("_best")))
    left, right = rows.alias("l"), known.alias("r")
    return left.join(right, F.col(f"l.{score}").eqNullSafe(F.col("r._text")) & F.col("l._best").eqNullSafe(F.col("r._best")), "left").select("l.*", f"r.{out}").drop("_best")


def score_status(score: Column, checked: Column) -> tuple[Column, Column]:
    """Whether a match counts by its score, and why not: a marker anywhere in the text comes first, then the grammar, whose result is given."""
    upper = F.upper(F.trim(F.coalesce(score, F.lit(""))))
    reason = None
    for token, name in MARKERS:
        reason = F.when(upper.contains(token), name) if reason is None else reason.when(upper.contains(token), name)
    reason = reason.when(F.array_contains(checked["anomaly_codes"], "SCORE_INVALID_BEST_OF"), "INVALID_SCORE").when(~(checked["valid"] & checked["completed"]), "INVALID_OR_INCOMPLETE_SCORE")
    return reason.isNull(), reason


def tiebreak_count(sets: Column) -> Column:
    """Sets with a tiebreak: games of 7 and 6, or points of one. sets: array of structs with a, b and tiebreak."""
    return F.size(F.filter(sets, lambda s: s["tiebreak"].isNotNull() | ((F.least(s["a"], s["b"]) == 6) & (F.greatest(s["a"], s["b"]) == 7)))).cast("long")
