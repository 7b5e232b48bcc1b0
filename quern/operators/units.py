"""Quantities in many units to common ones, with a hidden Markov model for values whose unit isn't stated with them.

Stated quantities are parsed. A bare value's unit is the hidden state of a chain per device (here: the site that recorded it):
its log value, brought to the common unit, jumps from the last one as a smooth level would, words near it that name a unit weigh in,
and Viterbi finds where the device switched units. Stated values are known in every state, so they hold the level. How smooth a
device is, and how often it switches, is learned from its rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from quern.session import cut

# What a unit is in the common unit of its kind (g, ml, min), with its spellings.
MASS = {"1/1000": "milligrams? milligrammes? mg", "1": "grams? grammes? gr g", "1000": "kilograms? kilogrammes? kilos? kg", "28.35": "ounces? oz", "453.6": "pounds? lbs?"}
VOLUME = {"1": "millilit(?:er|re)s? ml", "10": "centilit(?:er|re)s? cl", "100": "decilit(?:er|re)s? dl", "1000": "lit(?:er|re)s? l", "5": "teaspoons? tsps?", "15": "tablespoons? tbsps? tbs", "30": r"fluid\s+ounces? fl\.?\s?ounces? fl\.?\s?oz", "240": "cups?", "480": "pints? pts?"}
TIME = {"1/60": "seconds? secs? sekunden? s", "1": "minutes? mins? minuten? min", "60": "hours? hrs? hr stunden? std heures? horas? h", "1440": "days? tage? jours? días? d"}
FRACTIONS = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "half": Fraction(1, 2), "quarter": Fraction(1, 4)}

FRAC = "[" + "".join(FRACTIONS) + "]"
DIGITS = rf"(?:\d+\s+\d+\s*[/⁄]\s*\d+|\d+\s*{FRAC}|\d+\s*[/⁄]\s*\d+|\d{{1,3}}(?:,\d{{3}})+(?![\d,])|\d+[.,]\d+|\d+|{FRAC})"
WORD = r"(?:" + "|".join(sorted((w for w in WORDS if w not in ("half", "quarter")), key=len, reverse=True)) + ")"
NUM = rf"(?<![\w.,/]){DIGITS}|\b{WORD}(?:\s+and\s+(?:a\s+half|a\s+quarter|three\s+quarters))?(?=\s)|\b(?:half|a\s+quarter|three\s+quarters)(?=\s+(?:of\s+)?an?\s)"


def spellings(table: dict[str, str]) -> str:
    return "|".join(sorted((s for v in table.values() for s in v.replace(r"fluid\s+", "fluid\0").replace(r"\s?", "\1").split()), key=len, reverse=True)).replace("\0", r"\s+").replace("\1", r"\s?")


def lookup(table: dict[str, str], kind: str) -> list[tuple[re.Pattern, Fraction, str]]:
    return [(re.compile(f"(?:{spellings({k: v})})", re.I), Fraction(k), kind) for k, v in table.items()]


AMOUNT_UNITS = lookup(VOLUME, "ml") + lookup(MASS, "g")
TIME_UNITS = lookup(TIME, "min")
UNIT = rf"(?:{spellings({**{f'm{k}': v for k, v in MASS.items()}, **{f'v{k}': v for k, v in VOLUME.items()}})})(?![^\W\d_])\.?"
LINK = r"\s*(?:-|–|—|\bto\b|\bor\b|\bbis\b)\s*"
AMOUNT = re.compile(
    rf"(?P<packs>{NUM})\s*(?:x|×)\s*(?P<each>{DIGITS})\s*(?P<u1>{UNIT})"
    rf"|(?P<low>{NUM}){LINK}(?:{DIGITS}|{WORD})\s*(?P<u2>{UNIT})"
    rf"|(?P<n3>{NUM})\s*(?:(?:of\s+)?an?\s+)?(?P<u3>{UNIT})"
    rf"|(?P<n4>{NUM})\s*[(\[]\s*(?P<u4>{UNIT})\s*[)\]]"
    rf"|[(\[](?:in\s+)?(?P<u5>{UNIT})[)\]]\s*(?P<n5>{NUM}|{WORD}\b)"
    rf"|(?<!\w)(?P<u6>{UNIT})\s*[:=]\s*(?P<n6>{NUM}|{WORD}\b)",
    re.I,
)
TUNIT = rf"(?:{spellings(TIME)})(?![^\W\d_])\.?"
TIMES = re.compile(rf"(?P<n>{NUM})(?:{LINK}(?:{DIGITS}|{WORD}))?\s*(?:(?:of\s+)?an?\s+)?(?P<u>{TUNIT}|['′](?!['′])|[\"″])(?P<half>\s+and\s+(?:a\s+half|a\s+quarter|three\s+quarters))?", re.I)
ISO = re.compile(r"P(?:(\d+)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?", re.I)
CLOCK = re.compile(rf"(\d+):([0-5]\d)(?::[0-5]\d)?\s*(?:{TUNIT})?", re.I)
JOIN = re.compile(r"\s*(?:,|and|und|et|y|&)?\s*", re.I)
BARE = re.compile(rf"\s*({DIGITS})\s*")
HALVES = {"a half": Fraction(1, 2), "a quarter": Fraction(1, 4), "three quarters": Fraction(3, 4)}


def number(s: str) -> Fraction:
    """Value of a number in digits, with a fraction, or in words."""
    s = " ".join(s.lower().split())
    if s in ("half", "a quarter", "three quarters"):
        return {"half": Fraction(1, 2), **HALVES}[s]
    if " and " in s:
        w, rest = s.split(" and ", 1)
        return Fraction(WORDS[w]) + HALVES[rest]
    if s in WORDS:
        return Fraction(WORDS[s])
    for sign, value in FRACTIONS.items():
        if sign in s:
            whole = s.replace(sign, "").strip()
            return Fraction(value) + (Fraction(whole) if whole else 0)
    if "/" in s or "⁄" in s:
        *whole, frac = re.split(r"\s+(?=\d+\s*[/⁄])", s)
        over, under = re.split(r"\s*[/⁄]\s*", frac)
        if not int(under):
            return Fraction(0)
        return Fraction(int(over), int(under)) + (Fraction(whole[0]) if whole else 0)
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+", s):
        return Fraction(s.replace(",", ""))
    return Fraction(s.replace(",", "."))


def unit(s: str, table: list) -> tuple[Fraction, str] | None:
    s = s.strip().rstrip(".")
    for pattern, factor, kind in table:
        if pattern.fullmatch(s):
            return factor, kind
    return None


def whole(x: Fraction) -> int:
    """Rounded to a whole number, halves up."""
    return int((2 * x + 1) // 2)


def parse_amount(text: str | None) -> tuple[int, str] | None:
    """(amount, ``g`` or ``ml``) of the first mass or volume stated in a line, or None."""
    m = AMOUNT.search(text) if text else None
    if not m:
        return None
    g = m.groupdict()
    if g["packs"]:
        n, u = number(g["packs"]) * number(g["each"]), g["u1"]
    elif g["low"]:
        n, u = number(g["low"]), g["u2"]
    else:
        n, u = next((number(g[f"n{k}"]), g[f"u{k}"]) for k in "3456" if g[f"n{k}"])
    factor, kind = unit(u, AMOUNT_UNITS)
    return whole(n * factor), kind


def parse_duration(text: str | None) -> tuple[float, bool] | None:
    """(value, stated): minutes of the first length of time in a text, or a bare number that isn't stated to be in any unit."""
    if not text or not text.strip():
        return None
    s = text.strip()
    if (m := ISO.fullmatch(s)) and any(m.groups()):
        return float(sum(Fraction(v) * f for v, f in zip(m.groups(), (1440, 60, 1, Fraction(1, 60))) if v)), True
    if m := BARE.fullmatch(s):
        return float(number(m[1])), False
    if m := CLOCK.search(s):
        return float(int(m[1]) * 60 + int(m[2])), True
    m = TIMES.search(s)
    if not m:
        return None
    total, last, at = Fraction(0), None, m.start()
    while m and (last is None or m.start() == at):
        f = duration_factor(m["u"])
        if last is not None and f >= last:
            break
        n = number(m["n"])
        if m["half"]:
            n += HALVES[" ".join(m["half"].lower().split())[4:]]
        total, last, at = total + n * f, f, m.end()
        if last == 60 and (rest := re.match(r"(\d{1,2})(?!\d|[.,]\d|\s*[^\W\d_])", s[at:])):  # 1h45
            return float(total + int(rest[1])), True
        at = JOIN.match(s, at).end()
        m = TIMES.match(s, at)
    return float(total), True


def duration_factor(s: str) -> Fraction:
    if s.strip() in "'′":
        return Fraction(1)
    if s.strip() in '"″':
        return Fraction(1, 60)
    return unit(s, TIME_UNITS)[0]


#: The hidden states: units of a bare length of time, in minutes.
STATES = (("s", 1 / 60), ("min", 1.0), ("h", 60.0), ("d", 1440.0))
HINT = re.compile(rf"(?<![\w.,/])(?:{TUNIT})", re.I)
COUNTED = re.compile(rf"(?:{NUM})\s*$", re.I)
CUE = re.compile(r"\b(?:time[ds]?|timings?|prep(?:aration)?|units?|throughout|plain|given|counted|measured|stated|noted|durations?)\b", re.I)


def hints(text: str | None) -> list[float]:
    """For each state how strongly a description says that bare lengths of time are in its unit.

    A clause that names a unit of time without a number before it counts 1; with words on times, units or counting beside it 8.
    """
    out = [0.0] * len(STATES)
    for clause in re.split(r"[\n.;!?)]+\s*|(?<=\s)\(", text or ""):
        for m in HINT.finditer(clause):
            if COUNTED.search(clause[: m.start()]):
                continue
            u = m.group().strip().lower().rstrip(".")
            near = clause[max(0, m.start() - 40) : m.end() + 14]
            if (len(u) < 2 or u == "day") and not (CUE.search(near) and clause[: m.start()].rstrip().endswith((":", " in", " as"))):
                continue
            f = float(duration_factor(u))
            k = next(i for i, (_, x) in enumerate(STATES) if abs(x - f) < 1e-9)
            strong = bool(CUE.search(near))
            out[k] = max(out[k], 8.0 if strong else 1.0)
    return out


# Parameters of the chain, in nats and logs of minutes. What a device's own rows say is joined with so many rows' worth of what all
# devices say, and that with as much of the values here: an hour, a smooth level, few switches, all units alike.
LEVEL, RHO, VARIANCE, SWITCH, PRIOR_ROWS = math.log(60.0), 0.9, 1.0, 0.05, 20.0
BLOCK, FAN = 4096, 4096  # rows of a block, and segments of a chain that are joined in one task
FIXED = 1 << 20  # scores are whole numbers of this part of a nat, so that sums don't depend on their order
LOGS = np.log([f for _, f in STATES])


@dataclass(frozen=True)
class Chain:
    """What is known of a device: the level of its log minutes, how they stay with the last one, their spread, and its units."""

    level: float = LEVEL
    rho: float = RHO
    variance: float = VARIANCE * (1 - RHO * RHO)
    switch: float = SWITCH
    shares: tuple[float, ...] = (1 / len(STATES),) * len(STATES)


def steps(value: np.ndarray, stated: np.ndarray, hint: np.ndarray, before: np.ndarray, before_stated: np.ndarray, tie: np.ndarray, chain: Chain) -> np.ndarray:
    """(rows, from, to): the score of each row's unit after the unit of the row before it, as whole numbers.

    A row's log minutes are expected at the level, or where the last row's jump away from it leaves them: the score is that of the
    jump, with the cost of a switch of unit and the weight of hints. Stated minutes are the same in every state, so the unit lives on
    through them. A null value before begins a chain. ``tie`` is a hash of the row that parts paths of equal score.
    """
    k = len(STATES)

    def logs(v: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(v, 1e-6))[:, None] + np.where(known[:, None], 0.0, LOGS)

    now, last = logs(value, stated) - chain.level, logs(np.nan_to_num(before, nan=1.0), before_stated) - chain.level
    jump = now[:, None, :] - chain.rho * last[:, :, None]
    move = np.log((1 - chain.switch) * np.eye(k) + chain.switch * np.array(chain.shares))
    score = -0.5 * jump**2 / chain.variance + move
    start = -0.5 * now**2 * (1 - chain.rho**2) / chain.variance + np.log(chain.shares)
    score = np.where(np.isnan(before)[:, None, None], start[:, None, :], score) + hint[:, None, :]
    noise = (tie[:, None] >> (8 * np.arange(k))) & 255
    return np.rint(score * FIXED).astype(np.int64) + noise[:, None, :]


def levels_of(m: np.ndarray) -> list[np.ndarray]:
    """Max-plus products of neighbours, of their products, and so on, up to the one of the whole; the first level is ``m`` itself."""
    out = [m]
    while len(m) > 1:
        pairs = m[: len(m) // 2 * 2]
        joined = (pairs[0::2, :, :, None] + pairs[1::2, None, :, :]).max(axis=2)
        m = np.concatenate([joined, m[-1:]]) if len(m) % 2 else joined
        out.append(m)
    return out


def unfold(levels: list[np.ndarray], entry: int, exit_: int) -> tuple[np.ndarray, np.ndarray]:
    """States before and after each segment of the first level, on the best path from ``entry`` before the whole to ``exit_`` at its end."""
    before, after = np.array([entry]), np.array([exit_])
    for m in levels[-2::-1]:
        n = len(m)
        a, b = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        h = n // 2
        left, right = m[: 2 * h : 2], m[1 : 2 * h : 2]
        at = np.arange(h)
        mid = (left[at, before[:h], :] + right[at, :, after[:h]]).argmax(axis=1)
        a[: 2 * h : 2], b[: 2 * h : 2] = before[:h], mid
        a[1 : 2 * h : 2], b[1 : 2 * h : 2] = mid, after[:h]
        if n % 2:
            a[-1], b[-1] = before[-1], after[-1]
        before, after = a, b
    return before, after


def learned(rows: DataFrame) -> DataFrame:
    """(_d, level, rho, variance, switch, shares): each device's ``Chain``, from all its rows; rows have the value before them.

    Level, persistence and spread come from stated values and stated neighbours; units and their switches from bare values and bare
    neighbours, each taken for the unit that brings it nearest to an hour. Sums are of whole numbers, so neither order nor parts show.
    """
    x, y = F.log("_before") - LEVEL, F.log("value") - LEVEL
    whole = lambda c: F.round(c * 1e6).cast("long")
    up = F.col("stated") & (F.col("value") > 0)
    pair = up & F.col("_before_stated") & (F.col("_before") > 0)
    bare, both = ~F.col("stated"), ~F.col("stated") & ~F.col("_before_stated")

    def guess(name: str) -> Column:
        v = F.log(F.greatest(F.col(name), F.lit(1e-6)))
        return F.least(*[F.struct(F.abs(v + float(f) - LEVEL).alias("far"), F.lit(k).alias("k")) for k, f in enumerate(LOGS)])["k"]

    sums = {"n": F.count_if(up), "s": F.sum(F.when(up, whole(y))), "p": F.count_if(pair), "px": F.sum(F.when(pair, whole(x))), "py": F.sum(F.when(pair, whole(y)))}
    sums |= {"pxx": F.sum(F.when(pair, whole(x * x))), "pxy": F.sum(F.when(pair, whole(x * y))), "pyy": F.sum(F.when(pair, whole(y * y)))}
    sums |= {"b": F.count_if(both), "c": F.count_if(both & (guess("value") != guess("_before")))}
    sums |= {f"u{k}": F.count_if(bare & (guess("value") == k)) for k in range(len(STATES))}
    per = cut(rows.groupBy("_d").agg(*[F.coalesce(c, F.lit(0)).cast("double").alias(k) for k, c in sums.items()]))

    def chain(prior: dict, of) -> dict:
        n, w = of("n"), PRIOR_ROWS
        p = of("p") + (of("p") == 0).cast("double") if isinstance(n, Column) else max(of("p"), 1.0)
        xx = of("pxx") / 1e6 - (of("px") / 1e6) * (of("px") / 1e6) / p
        xy = of("pxy") / 1e6 - (of("px") / 1e6) * (of("py") / 1e6) / p
        yy = of("pyy") / 1e6 - (of("py") / 1e6) * (of("py") / 1e6) / p
        least, most = (F.least, F.greatest) if isinstance(n, Column) else (min, max)
        lit = F.lit if isinstance(n, Column) else float
        spread = prior["variance"] / (1 - prior["rho"] * prior["rho"])
        rho = least(most((xy + w * prior["rho"] * spread) / (xx + w * spread), lit(0.0)), lit(0.98))
        variance = (most(yy - 2 * rho * xy + rho * rho * xx, lit(0.0)) + w * prior["variance"]) / (of("p") + w)
        total = sum((of(f"u{k}") for k in range(len(STATES))), lit(0.0))
        shares = [(of(f"u{k}") + w * prior["shares"][k]) / (total + w) for k in range(len(STATES))]
        other = 1 - sum((q * q for q in shares), lit(0.0))  # switches that lead to another unit
        switch = least((of("c") / most(other, lit(0.05)) + w * prior["switch"]) / (of("b") + w), lit(0.999))
        return {"level": (of("s") / 1e6 + w * prior["level"]) / (n + w), "rho": rho, "variance": variance, "switch": switch, "shares": shares}

    all_ = per.agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in sums]).first()
    base = {"level": 0.0, "rho": RHO, "variance": VARIANCE * (1 - RHO * RHO), "switch": SWITCH, "shares": [1 / len(STATES)] * len(STATES)}
    own = chain(chain(base, lambda k: all_[k]), F.col)
    return per.select("_d", (own["level"] + LEVEL).alias("level"), own["rho"].alias("rho"), own["variance"].alias("variance"), own["switch"].alias("switch"), F.array(*own["shares"]).alias("shares"))


def in_order(rows: DataFrame, device: str, order: list[str], block: int) -> DataFrame:
    """``rows`` with their device as a key that is never null, their block, place in it, the value before them on the device, and a hash.

    Rows are range-partitioned, so a device may lie in many parts; the last row of each part stands for it where the next begins.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = cut(rows.withColumn("_d", F.coalesce(F.concat(F.lit("="), F.col(device).cast("string")), F.lit(""))).withColumn("_tie", F.xxhash64("_d", *order)))
    keyed = keyed.repartitionByRange(parts, *[F.col(c) for c in ("_d", *order)]).sortWithinPartitions("_d", *order, "_tie")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen, chunk, value, known = None, 0, -1, np.nan, False
        for b in batches:
            d = b["_d"].to_numpy()
            new = np.concatenate([[last is None or d[0] != last], d[1:] != d[:-1]]) if len(d) else np.zeros(0, dtype=bool)
            start = np.maximum.accumulate(np.where(new, np.arange(len(d)), -1))
            nth = np.where(start >= 0, np.arange(len(d)) - start, np.arange(len(d)) + seen)
            first = nth % block == 0
            ids = chunk + np.cumsum(first)
            v, s = b["value"].to_numpy(float), b["stated"].to_numpy(bool)
            before, before_stated = np.concatenate([[value], v[:-1]])[: len(v)], np.concatenate([[known], s[:-1]])[: len(s)]
            before = np.where(new, np.nan, before)
            if len(d):
                last, seen, chunk, value, known = d[-1], int(nth[-1]) + 1, int(ids[-1]), v[-1], bool(s[-1])
            yield b.assign(_chunk=ids.astype("int64"), _at=(nth % block).astype("int64"), _new=new, _before=before, _before_stated=before_stated)

    extra = [StructField("_chunk", LongType()), StructField("_at", LongType()), StructField("_new", BooleanType()), StructField("_before", DoubleType()), StructField("_before_stated", BooleanType())]
    placed = cut(keyed.mapInPandas(number, StructType([*keyed.schema.fields, *extra])).withColumn("_part", F.spark_partition_id()))
    ends = placed.groupBy("_d", "_part").agg(F.max_by(F.struct("value", "stated"), F.struct("_chunk", "_at")).alias("_e"))
    ends = ends.select("_d", "_part", F.lit(True).alias("_new"), F.lag("_e").over(Window.partitionBy("_d").orderBy("_part")).alias("_e")).where("_e IS NOT NULL")  # one row at most for each part
    placed = placed.withColumn("_before", F.when(~F.isnan("_before"), F.col("_before"))).join(F.broadcast(ends), ["_d", "_part", "_new"], "left")
    before = [F.coalesce("_before", "_e.value").alias("_before"), F.coalesce(F.when(F.col("_new"), F.col("_e.stated")).otherwise(F.col("_before_stated")), F.lit(False)).alias("_before_stated")]
    return placed.select(*rows.columns, "_d", "_tie", "_part", "_chunk", "_at", *before)


WORK = ["_d", "_part", "_chunk", "_at", "_tie", "_before", "_before_stated"]
CHAIN = ["level", "rho", "variance", "switch", "shares"]


def decode_units(rows: DataFrame, device: str, order: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` of (``device``, ``order`` columns, value, stated, hint) with ``minutes`` and ``unit_state``, by Viterbi per device.

    ``value`` is minutes where ``stated``, else a bare number; ``hint`` an array of weights per state. Chains run in the given
    order, rows that tie in it by a hash. A device may hold any share of the rows: its chain is cut into blocks of ``block`` rows, each gives a matrix of
    best scores from state to state; matrices are joined in a tree, no more than ``FAN`` or a part's in one task, which fixes the states at
    the ends of blocks, and blocks are decoded in between. Scores are whole numbers, so blocks and parts don't show in the result: it is that of one pass. A null device is a
    chain of its own.
    """
    names, k = rows.columns, len(STATES)
    placed = cut(in_order(rows, device, order, block))
    blocks = placed.select("_d", "_part", "_chunk").distinct()
    known = cut(blocks.join(learned(placed), "_d"))
    keys = ["_d", "_part", "_chunk"]

    def emit(b: pd.DataFrame) -> np.ndarray:
        c = b.iloc[0]
        chain = Chain(c["level"], c["rho"], c["variance"], c["switch"], tuple(c["shares"]))
        hint = np.stack(b["hint"].to_numpy()).astype(float)
        return steps(b["value"].to_numpy(float), b["stated"].to_numpy(bool), hint, b["_before"].to_numpy(float), b["_before_stated"].to_numpy(bool), b["_tie"].to_numpy("int64"), chain)

    def matrix(b: pd.DataFrame) -> pd.DataFrame:
        m = levels_of(emit(b.sort_values("_at")))[-1][0]
        return b.iloc[:1][keys].assign(_m=[m.ravel().tolist()])

    work = placed.select(*WORK, "value", "stated", "hint").join(known, keys)
    tree = [cut(work.groupBy(*keys).applyInPandas(matrix, "_d string, _part int, _chunk long, _m array<long>"))]
    parts, blocks_ = tree[0].agg(F.max("_part"), F.count(F.lit(1))).first()
    widths = []
    while blocks_ > FAN and (not widths or parts // widths[-1] >= FAN):
        widths.append(widths[-1] * FAN if widths else 1)
    widths.append((parts or 0) + 1)  # the last level is the device

    def stack(b: pd.DataFrame) -> list[np.ndarray]:
        return levels_of(np.stack(b["_m"].to_numpy()).astype(np.int64).reshape(-1, k, k))

    def joined(width: int):
        def run(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(["_part", "_chunk"])
            m = stack(b)[-1][0]
            return pd.DataFrame({"_d": b["_d"].iloc[:1], "_part": (b["_part"].iloc[:1] // width * width).astype("int32"), "_chunk": [0], "_m": [m.ravel().tolist()]})

        return run

    group = lambda w: (F.col("_part") - F.col("_part") % w).cast("int").alias("_g")
    for w in widths:
        tree.append(cut(tree[-1].groupBy("_d", group(w)).applyInPandas(joined(w), "_d string, _part int, _chunk long, _m array<long>")))

    def parted(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["_part", "_chunk"])
        levels = stack(b)
        entry, exit_ = int(b["_entry"].iloc[0]), int(b["_exit"].iloc[0])
        before, after = unfold(levels, entry, exit_ if exit_ >= 0 else int(levels[-1][0][entry].argmax()))
        return b[keys].assign(_entry=before, _exit=after)

    ends = tree[-1].select("_d", "_part", F.lit(0).cast("long").alias("_entry"), F.lit(-1).cast("long").alias("_exit"))  # the first row doesn't ask what was before
    for w, level in zip(reversed(widths), reversed(tree[:-1])):
        above = ends.select("_d", F.col("_part").alias("_g"), "_entry", "_exit")
        ends = level.select("*", group(w)).join(above, ["_d", "_g"]).groupBy("_d", "_g").applyInPandas(parted, "_d string, _part int, _chunk long, _entry long, _exit long")

    def finish(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_at")
        _, path = unfold(levels_of(emit(b)), int(b["_entry"].iloc[0]), int(b["_exit"].iloc[0]))
        factor = np.where(b["stated"].to_numpy(bool), 1.0, np.array([f for _, f in STATES])[path])
        out = b[names].copy()
        out["minutes"] = b["value"].to_numpy(float) * factor
        out["unit_state"] = [STATES[s][0] for s in path]
        return out

    out = StructType([*rows.schema.fields, StructField("minutes", DoubleType()), StructField("unit_state", StringType())])
    return placed.select(*names, *[c for c in WORK if c not in names]).join(known.join(ends, keys), keys).groupBy(*keys).applyInPandas(finish, out)


AMOUNTS = "array<struct<item_no: int, amount: bigint, unit: string>>"


def amounts_of(lines):
    """Column: the masses and volumes of an array of lines, with their places (Arrow batches)."""

    @F.pandas_udf(AMOUNTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, str] | None] = {}
        for s in batches:
            out = []
            for lines in s:
                row = []
                for k, line in enumerate(lines if lines is not None else ()):
                    if line is None:
                        continue
                    if line not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[line] = parse_amount(line)
                    if got := known[line]:
                        row.append({"item_no": k, "amount": got[0], "unit": got[1]})
                out.append(row)
            yield pd.Series(out, index=s.index)

    return run(lines)


def durations_of(time, text):
    """Column: struct of a length of time, whether its unit is stated, and the hints of the text to a bare one's unit."""

    @F.pandas_udf("value double, stated boolean, hint array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for times, texts in batches:
            out = []
            for t, d in zip(times, texts):
                got = parse_duration(t)
                out.append((None, None, None) if got is None else (*got, [0.0] * len(STATES) if got[1] else hints(d)))
            yield pd.DataFrame(out, columns=["value", "stated", "hint"])

    return run(F.col(time), F.col(text))


def convert_quantities(recipes: DataFrame) -> DataFrame:
    """(field, url, item_no, amount, unit): every length of time in minutes, every mass in g, every volume in ml, whole numbers.

    One row per ``prep_time`` that states a length of time (item_no -1) and per line of ``ingredients`` that states a mass or
    volume (item_no is its place from 0). Of a range the lower end counts, of several statements the first, of packs the
    product; halves round up. Several rows of a url are one recipe; of texts that differ the greatest holds. Rows without url are
    left out; null, empty and other texts give nothing; other columns are ignored. A bare number gets its unit from the model.
    """
    line = recipes.where("url IS NOT NULL").select("url", F.struct("ingredients").alias("_i"), F.struct("prep_time", "description").alias("_p"), "crawled_at")
    one = cut(line.groupBy("url").agg(F.max("_i").alias("_i"), F.max("_p").alias("_p"), F.min("crawled_at").alias("crawled_at")))
    items = one.select("url", F.explode(amounts_of(F.col("_i.ingredients"))).alias("_a"))
    items = items.select(F.lit("ingredients").alias("field"), "url", "_a.item_no", "_a.amount", "_a.unit")
    times = one.select("url", "crawled_at", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("device"), durations_of("_p.prep_time", "_p.description").alias("_d"))
    times = times.select("url", "crawled_at", "device", "_d.*").where("value IS NOT NULL")
    decoded = decode_units(times, "device", ["crawled_at", "url"])
    spans = decoded.select(F.lit("prep_time").alias("field"), "url", F.lit(-1).alias("item_no"), F.floor(F.col("minutes") + 0.5).cast("long").alias("amount"), F.lit("min").alias("unit"))
    return spans.unionByName(items)
