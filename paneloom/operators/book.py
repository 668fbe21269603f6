"""Long/short books as convex programmes, and backtests over months.

Spark chooses each month's candidates (:func:`candidates`); what is left of a month is a quadratic programme of at most some
hundred names, solved in numpy, next to the data, by the alternating direction method of multipliers. A name that is no
candidate gets no weight, so the programme is over the candidates alone: what else is held adds a constant cost of selling it. Months of
one backtest follow each other, since the old weights enter the new month; backtests with different settings are
independent, so a grid of them is one grouped map over the settings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.operators.report import turnover as ledger_turnover


@dataclass(frozen=True)
class Settings:
    """Penalties, bounds and tolerances of a book."""

    l2: float = 100.0
    turnover: float = 0.5
    cap: float = 0.015
    candidates: int = 350
    sector_tolerance: float = 0.03
    size_tolerance: float = 0.05
    beta_tolerance: float = 0.005
    beta_target: float = 0.075
    dust: float = 1e-5
    least_names: int = 0
    most_names: int = 500
    net_cap: float = 0.0
    net_penalty: float = 100.0
    beta_doubt: float = 0.0


#: Factors on the sector, size and beta tolerances that are tried in turn until a month can be solved.
LADDER = ((1, 1, 1, ""), (2, 1, 1, "sector x2"), (2, 2, 1, "sector x2,size x2"), (2, 2, 2, "sector x2,size x2,beta x2"))


def solve(signal: np.ndarray, old: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, l2: float, cost: float, rounds: int = 20_000, tolerance: float = 1e-5, net_penalty: float = 0.0) -> np.ndarray | None:
    """Maximises signal'w - cost |w - old|_1 - l2 |w|^2 - net_penalty (sum w)^2 with low <= rows w <= high and floor <= w <= ceiling;
    None unless both residuals get below the tolerance. The constraints and the absolute changes are split off into copies that
    are projected and soft-thresholded; the quadratic step has one fixed factorisation per step size."""
    n, scale = len(signal), 1.0 / np.maximum(np.linalg.norm(rows, axis=1), 1e-12)
    a, lo, hi = rows * scale[:, None], low * scale, high * scale
    w = np.clip(old, floor, ceiling)
    rho = max(2 * l2, 1.0)
    inverse, gap = None, np.inf
    z = [a @ w, w.copy(), w.copy()]
    y = [np.zeros(len(a)), np.zeros(n), np.zeros(n)]
    for i in range(rounds):
        if inverse is None:
            inverse = np.linalg.inv((2 * l2 + 2 * rho) * np.eye(n) + 2 * net_penalty * np.ones((n, n)) + rho * a.T @ a)
        w = inverse @ (signal + rho * (a.T @ (z[0] - y[0]) + (z[1] - y[1]) + (z[2] - y[2])))
        parts = [a @ w, w, w]
        before = z
        over = [1.6 * p - 0.6 * x for p, x in zip(parts, z)]  # over-relaxation
        move = over[2] + y[2] - old
        z = [np.clip(over[0] + y[0], lo, hi), np.clip(over[1] + y[1], floor, ceiling), old + np.sign(move) * np.maximum(np.abs(move) - cost / rho, 0)]
        y = [u + p - x for u, p, x in zip(y, over, z)]
        if i % 10:
            continue
        primal = max(float(np.abs(p - x).max(initial=0)) for p, x in zip(parts, z)) / max(float(np.abs(z[1]).max(initial=0)), 1e-3)
        step = [x - b for x, b in zip(z, before)]
        dual = rho * float(np.abs(a.T @ step[0] + step[1] + step[2]).max(initial=0)) / max(float(np.abs(signal).max(initial=0)), 1e-3)
        if primal < tolerance and dual < tolerance:
            return z[1]
        if i % 500 == 0:  # rows that contradict each other leave a gap that does not close
            if i >= 1500 and primal > 100 * tolerance and primal > 0.9 * gap:
                return None
            gap = primal
        if i % 50 == 0 and i and not 0.1 < (primal + 1e-12) / (dual + 1e-12) < 10:
            factor = float(np.clip(np.sqrt((primal + 1e-12) / (dual + 1e-12)), 0.2, 5.0))
            rho, y, inverse = rho * factor, [u / factor for u in y], None
    return None


def rescale(w: np.ndarray, leg: np.ndarray, target: float, cap: float, dust: float) -> np.ndarray:
    """Weights of one leg without dust, summing to ``target``, none above ``cap``: what is cut off goes to the others in
    proportion, which is a water level found name by name from the largest."""
    w = np.where(np.abs(w) < dust, 0.0, w)
    size = np.abs(np.where(leg, w, 0.0))
    if not size.sum():
        return w
    goal, full = abs(target), np.zeros(len(w), bool)
    for _ in range(len(w)):
        room = goal - cap * full.sum()
        factor = room / size[~full].sum() if size[~full].sum() > 0 else 0.0
        over = ~full & (size * factor > cap)
        if not over.any():
            break
        full |= over
    return np.where(leg, np.sign(target) * np.where(full, cap, size * factor), w)


def candidates(rows: DataFrame, most: int) -> DataFrame:
    """The names that each month's book may hold: of ``month, permno, signal, beta, beta_var, size_z, gics2, has_filing, eligible`` the
    ``most`` largest signals less their sector's mean as longs (``side`` 1), and of the eligible others the ``most`` smallest as shorts
    (``side`` -1); at most half of a month's names a side, ties by name. ``share`` is the sector's part of all names of the month,
    ``filer_share`` that of names with a filing. Null signals are left out; a repeated name counts once, with its largest columns."""
    fields = ["signal", "beta", "beta_var", "size_z", "gics2", "has_filing", "eligible"]
    one = rows.where(F.col("signal").isNotNull()).groupBy("month", "permno").agg(F.max(F.struct(*fields)).alias("x")).select("month", "permno", "x.*")
    month, sector = Window.partitionBy("month"), Window.partitionBy("month", "gics2")
    n = F.count(F.lit(1)).over(month)
    scored = one.withColumns({"score": F.col("signal") - F.avg("signal").over(sector), "share": F.count(F.lit(1)).over(sector) / n, "filer_share": F.sum(F.when(F.col("has_filing") == 1, 1).otherwise(0)).over(month) / n, "half": F.least(F.lit(most), F.floor(n / 2))})
    up = F.row_number().over(month.orderBy(F.desc("score"), "permno"))
    sided = scored.withColumn("side", F.when(up <= F.col("half"), 1).when(F.coalesce("eligible", F.lit(True)), -1))
    down = F.row_number().over(Window.partitionBy("month", "side").orderBy("score", F.desc("permno")))
    return sided.withColumn("down", down).where((F.col("side") == 1) | (F.col("side") == -1) & (F.col("down") <= F.col("half"))).drop("half", "down", "signal", "eligible")


class Programme:
    """One month's candidates as aligned arrays, its exposures as rows and its tolerances."""

    def __init__(self, m: pd.DataFrame, s: Settings):
        self.s, self.names, self.signal = s, m["permno"].to_numpy(), m["score"].to_numpy(float)
        self.long, self.short = (m["side"] == 1).to_numpy(), (m["side"] == -1).to_numpy()
        self.beta, self.size = m["beta"].fillna(0.0).to_numpy(float), m["size_z"].fillna(0.0).to_numpy(float)
        self.doubt = s.beta_doubt * np.sqrt(m["beta_var"].fillna(0.0).to_numpy(float)) if "beta_var" in m else np.zeros(len(m))
        sectors = m.groupby("gics2", dropna=False)["share"].first()
        self.groups = {f"sector {k}": ((m["gics2"] == k).to_numpy(), float(v)) for k, v in sectors.items()}
        self.groups["filer"] = ((m["has_filing"] == 1).to_numpy(), float(m["filer_share"].iloc[0]) if len(m) else 0.0)

    def exposures(self) -> dict[str, tuple[str, np.ndarray, float, float]]:
        """By name: kind, weights' factors, wanted value and tolerance. A group may hold its part of the book's net exposure; the beta
        is wanted at a share of the long leg."""
        s, ones = self.s, np.ones(len(self.names))
        out = {"gross": ("", self.long * 1.0 - self.short, 2.0, 0.0), "net": ("", ones, 0.0, s.net_cap), "beta": ("beta", self.beta - s.beta_target * self.long, 0.0, s.beta_tolerance), "size": ("size", self.size, 0.0, s.size_tolerance)}
        return out | {k: ("sector", mask - share * ones, 0.0, s.sector_tolerance) for k, (mask, share) in self.groups.items()}

    def attempt(self, old: np.ndarray, widened: dict[str, float], allowed: np.ndarray) -> np.ndarray | None:
        """Weights under widened tolerances, only on ``allowed`` names, without dust; None if there are none that keep all rules. Where
        taking the dust off breaks a rule, the dusted names are left out and the rest is solved once more."""
        for _ in range(2):
            raw = self.raw(old, widened, allowed)
            if raw is None:
                return None
            net = float(np.clip(raw.sum(), -self.s.net_cap, self.s.net_cap))
            w = rescale(rescale(raw, self.long, 1 + net / 2, self.s.cap, self.s.dust), self.short, net / 2 - 1, self.s.cap, self.s.dust)
            if not self.broken(w, widened, names=False):
                return w
            allowed = allowed & (np.abs(raw) >= self.s.dust)
        return None

    def raw(self, old: np.ndarray, widened: dict[str, float], allowed: np.ndarray) -> np.ndarray | None:
        s, rows = self.s, self.exposures()
        factor = np.array([f for _, f, _, _ in rows.values()])
        wanted = np.array([v for _, _, v, _ in rows.values()])
        room = np.array([t * widened.get(kind, 1.0) for kind, _, _, t in rows.values()])
        margin, place, w = 0.0, list(rows).index("beta"), None
        for _ in range(4 if self.doubt.any() else 1):  # the doubt about the betas narrows what is left for the beta itself
            tight = room.copy()
            tight[place] = max(room[place] - margin, 0.0)
            w = solve(self.signal, old, factor, wanted - tight, wanted + tight, np.where(self.short & allowed, -s.cap, 0.0), np.where(self.long & allowed, s.cap, 0.0), s.l2, s.turnover, net_penalty=s.net_penalty if s.net_cap else 0.0)
            if w is None:
                return None
            margin = float(np.linalg.norm(self.doubt * w))
        return w

    def broken(self, w: np.ndarray, widened: dict[str, float], tolerance: float = 1e-4, names: bool = True) -> list[str]:
        """The rules that weights break, by name."""
        out = [k for k, (kind, f, v, t) in self.exposures().items() if abs(f @ w - v) + (np.linalg.norm(self.doubt * w) if k == "beta" else 0.0) > t * widened.get(kind, 1.0) + tolerance]
        out += ["cap"] if np.abs(w).max(initial=0) > self.s.cap + 1e-9 else []
        out += ["side"] if (w[self.long] < 0).any() or (w[self.short] > 0).any() else []
        return out + (["names"] if names and not self.s.least_names <= (w != 0).sum() <= self.s.most_names else [])

    def solved(self, old: np.ndarray) -> tuple[np.ndarray, str] | None:
        """The weights of the first step of the ladder that keep all rules, and its label; a book of too many names is solved once more
        with the largest ones only."""
        for sector, size, beta, label in LADDER:
            widened = {"sector": sector, "size": size, "beta": beta}
            w = self.attempt(old, widened, np.ones(len(self.names), bool))
            if w is None:
                continue
            if (w != 0).sum() > self.s.most_names:
                largest = np.argsort(-np.abs(w), kind="stable")[: self.s.most_names]
                w = self.attempt(old, widened, np.isin(np.arange(len(w)), largest))
                label = ",".join(x for x in (label, "cardinality") if x)
            if w is not None and not self.broken(w, widened):
                return w, label
        return None


def optimise(m: pd.DataFrame, old: dict[int, float], s: Settings) -> tuple[dict[int, float], str]:
    """Weights by name for one month of :func:`candidates`, and what was widened; where no step of the ladder can be solved, the old
    weights, marked as "failed"."""
    p = Programme(m.sort_values("permno"), s)
    found = p.solved(np.array([old.get(int(k), 0.0) for k in p.names])) if len(p.names) else None
    if found is None:
        return old, "failed"
    w, label = found
    return {int(k): float(x) for k, x in zip(p.names, w) if x != 0}, label


def violations(book: DataFrame, s: Settings, names: tuple[int, int] = (0, 500), tolerance: float = 1e-4) -> DataFrame:
    """``month, rule, value``: what a book (``month, permno, weight, beta, size_z, gics2, has_filing``, ``share`` and ``filer_share``) breaks of
    the settings' rules, one row a month and rule; none for a correct book. Rules: repeated or null names, the legs' gross of 2, net
    exposure, largest weight, number of names, beta (against its target on the long leg), size, and each sector's and the
    filers' exposure beyond their part of the net."""
    w = F.col("weight")
    beyond = lambda x, bound: F.greatest(F.abs(x) - F.lit(bound), F.lit(0.0))
    net = F.sum(w)
    filers = F.sum(F.when(F.col("has_filing") == 1, w).otherwise(0.0)) - net * F.coalesce(F.max("filer_share"), F.lit(0.0))
    rules = {
        "repeated": (F.count(F.lit(1)) - F.countDistinct("permno") * 1.0, 0.5), "gross": (beyond(F.sum(F.abs(w)) - 2, 0.0), tolerance), "net": (beyond(net, s.net_cap), tolerance),
        "cap": (beyond(F.max(F.abs(w)), s.cap), 1e-9), "names": (F.greatest(F.lit(names[0]) - F.count(F.lit(1)), F.count(F.lit(1)) - F.lit(names[1]), F.lit(0)).cast("double"), 0.5),
        "beta": (beyond(F.sum(w * F.coalesce("beta", F.lit(0.0))) - s.beta_target * F.sum(F.when(w > 0, w).otherwise(0.0)), s.beta_tolerance), tolerance),
        "size": (beyond(F.sum(w * F.coalesce("size_z", F.lit(0.0))), s.size_tolerance), tolerance), "filer": (beyond(filers, s.sector_tolerance), tolerance),
    }
    by = book.groupBy("month").agg(*[v.alias(k) for k, (v, _) in rules.items()], net.alias("_net"))
    long = by.unpivot(["month"], list(rules), "rule", "value")
    bound = F.create_map(*[F.lit(x) for k, (_, t) in rules.items() for x in (k, float(t))])
    sectors = book.groupBy("month", "gics2").agg(F.sum(w).alias("_w"), F.max("share").alias("_share")).join(by.select("month", "_net"), "month")
    sectors = sectors.select("month", F.concat(F.lit("sector "), F.coalesce("gics2", F.lit("none"))).alias("rule"), beyond(F.col("_w") - F.col("_net") * F.coalesce("_share", F.lit(0.0)), s.sector_tolerance).alias("value"))
    return long.where(F.col("value") > bound[F.col("rule")]).unionByName(sectors.where(F.col("value") > tolerance))


BOOK = "setting int, month date, permno long, weight double, relax string"


def backtest(rows: DataFrame, settings: Sequence[Settings], strict: bool = False) -> DataFrame:
    """``setting, month, permno, weight, relax`` for each of ``settings``: the months of ``rows`` (as for :func:`candidates`) one after the
    other. A month that can't be solved keeps the old book, marked as "failed"; with ``strict`` it is an error that names the month. One task per setting holds its months' candidates: months times twice the candidates of a side, not the panel."""
    grid = {i: s for i, s in enumerate(settings)}
    sizes = sorted({s.candidates for s in settings})
    chosen = None
    for most in sizes:
        own = F.explode(F.array(*[F.lit(i) for i, s in grid.items() if s.candidates == most]))
        part = candidates(rows, most).withColumn("setting", own)
        chosen = part if chosen is None else chosen.unionByName(part)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        number = int(g["setting"].iloc[0])
        old: dict[int, float] = {}
        out = []
        for month, m in g.groupby("month", sort=True):
            old, relax = optimise(m, old, grid[number])
            if strict and relax == "failed":
                raise ValueError(f"no book for {month} under setting {number}")
            out.append(pd.DataFrame({"setting": number, "month": month, "permno": np.array(list(old), "int64"), "weight": np.array(list(old.values()), float), "relax": relax}))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in BOOK.split(", ")])

    return chosen.groupBy("setting").applyInPandas(run, BOOK)


def grid(base: Settings, l2: Sequence[float], turnover: Sequence[float]) -> list[Settings]:
    return [replace(base, l2=a, turnover=b) for a in l2 for b in turnover]


def shape_score(book: DataFrame, names: float, turnover: float) -> DataFrame:
    """``setting, names, turnover, score``: how far the mean names of a side and the mean turnover are from wanted ones, the latter counted
    in wanted names; the setting of least score (ties: the first) is the calibrated one."""
    counts = book.groupBy("setting", "month").agg((F.count(F.lit(1)) / 2).alias("n")).groupBy("setting").agg(F.avg("n").alias("names"))
    moved = ledger_turnover(book, ("permno",), ("setting",))
    first = F.min("month").over(Window.partitionBy("setting"))
    held = book.select("setting", "month").distinct().withColumn("first", first).where("month > first")
    turn = moved.join(held, ["setting", "month"]).groupBy("setting").agg((F.avg("moved") / 4).alias("turnover"))
    out = counts.join(turn, "setting", "left")
    return out.withColumn("score", F.abs(F.col("names") - names) + F.abs(F.coalesce("turnover", F.lit(0.0)) - turnover) * names)
