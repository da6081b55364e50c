"""Constrained picks: squads, line-ups, transfers, captains. Candidates are prepared in Spark; one pick is sequential.

A pick works on one scenario's candidates, which are pruned in Spark before, exactly: within a position
and club, a player goes who at least as many others as a club may give beat in points at no higher price. What
is left of a club is a few players, however many it has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rules import BUDGET, FORMATION, PER_CLUB, QUOTAS


def _undominated(pool: DataFrame, scenario: str, depth: int) -> tuple[DataFrame, Column]:
    """`pool` with marks of layers, and whether a row is in one of the first `depth`.

    Sorted by price, a layer is what has more points than all before it, leaving out the layers above. A row below
    `depth` layers has so many before it with as many points at no higher price. Running maxima are all that is kept.
    """
    order = Window.partitionBy(scenario, "position", "club").orderBy("price", F.desc("points"), "player_id").rowsBetween(Window.unboundedPreceding, -1)
    rows, taken = pool, F.lit(False)
    for i in range(depth):
        best = F.max(F.when(~taken, F.col("points"))).over(order)
        rows = rows.withColumn(f"_layer{i}", ~taken & (best.isNull() | (F.col("points") > best)))
        taken = reduce(lambda a, b: a | b, (F.col(f"_layer{j}") for j in range(i + 1)))
    return rows, taken


def candidates(pool: DataFrame, scenario: str = "scenario", per_club: int = PER_CLUB) -> DataFrame:
    """Players that some best squad can need. `pool` has scenario, player_id, position, club, price, points.

    Ties go by price, points and id, so the same players stay on every run.
    """
    rows, kept = _undominated(pool, scenario, per_club)
    return rows.where(kept).select(pool.columns)


def greedy_candidates(pool: DataFrame, quotas: Mapping[str, int] = QUOTAS, per_club: int = PER_CLUB, locked: Sequence[int] = (), scenario: str = "scenario") -> DataFrame:
    """Players that a greedy pick can take or that its test of what is still possible can count: the pick is the same as from all.

    A player whom a club's full share of others beats is never the next to be taken. The test adds up the cheapest
    players of each position, so the cheapest of each club stay as well; so do locked ones and those of negative points.
    """
    rows, kept = _undominated(pool, scenario, per_club)
    cheap = F.row_number().over(Window.partitionBy(scenario, "position", "club").orderBy("price", "player_id")) <= max(quotas.values()) + per_club
    rows = rows.withColumn("_kept", kept | cheap | (F.col("points") < 0) | F.col("player_id").isin(list(locked)))
    return rows.where("_kept").select(pool.columns)


def _cheapest(rest: dict[str, list[int]], need: Mapping[str, int]) -> int | None:
    """The least price of what is still needed, clubs aside; None if there are too few players."""
    if any(len(rest[p]) < n for p, n in need.items()):
        return None
    return sum(sum(sorted(rest[p])[:n]) for p, n in need.items())


def greedy_squad(pool: pd.DataFrame, quotas: Mapping[str, int] = QUOTAS, budget: int = BUDGET, per_club: int = PER_CLUB, locked: Sequence[int] = (), by_position: bool = False) -> pd.DataFrame:
    """Picks by points and by points per price in turn, taking only players after whom the squad can still be completed.

    With `by_position` one position after another is filled, by points. Locked players are in from the start; no rows if that or the rest cannot be made legal.
    """
    rows = pool.to_dict("records")
    need, clubs, left, taken = dict(quotas), {}, budget, []
    for r in (r for r in rows if r["player_id"] in set(locked)):
        taken.append(r)
        need[r["position"]] = need.get(r["position"], 0) - 1
        clubs[r["club"]] = clubs.get(r["club"], 0) + 1
        left -= r["price"]
    if len(taken) < len(set(locked)) or left < 0 or min(need.values()) < 0 or max(clubs.values(), default=0) > per_club:
        return pd.DataFrame(columns=pool.columns)
    by_points = sorted(rows, key=lambda r: (-r["points"], r["price"], r["player_id"]))
    by_value = sorted(rows, key=lambda r: (-r["points"] / max(r["price"], 1), r["price"], r["player_id"]))

    def fits(r: dict) -> bool:
        if not need.get(r["position"]) or clubs.get(r["club"], 0) >= per_club or r["price"] > left or r in taken:
            return False
        after = need | {r["position"]: need[r["position"]] - 1}
        full = {c for c, n in clubs.items() if n + (c == r["club"]) >= per_club} | ({r["club"]} if clubs.get(r["club"], 0) + 1 >= per_club else set())
        rest = {p: [x["price"] for x in rows if x["position"] == p and x not in taken and x is not r and x["club"] not in full] for p in after}
        least = _cheapest(rest, after)
        return least is not None and least <= left - r["price"]

    while any(need.values()):
        position = next(p for p, n in need.items() if n)
        order = [r for r in by_points if r["position"] == position] if by_position else by_points if len(taken) % 2 == 0 else by_value
        pick = next((r for r in order if fits(r)), None)
        if pick is None:
            return pd.DataFrame(columns=pool.columns)
        taken.append(pick)
        need[pick["position"]] -= 1
        clubs[pick["club"]] = clubs.get(pick["club"], 0) + 1
        left -= pick["price"]
    return pd.DataFrame(taken, columns=pool.columns)


def exact_squad(pool: pd.DataFrame, quotas: Mapping[str, int] = QUOTAS, budget: int = BUDGET, per_club: int = PER_CLUB, steps: int = 2_000_000) -> tuple[pd.DataFrame, bool]:
    """The squad of most points, and whether the search has proved it.

    Branch and bound over players in order of points less a charge on price; the bound relaxes the
    club limit and prices the budget with the multiplier that makes it lowest at the root. Ties go to the
    first found. After `steps` nodes the best squad so far is returned as not proved.
    """
    rows = sorted(pool.to_dict("records"), key=lambda r: (-r["points"], r["price"], r["player_id"]))
    first = greedy_squad(pool, quotas, budget, per_club)
    best, best_rows = (float(first["points"].sum()), first.to_dict("records")) if len(first) else (float("-inf"), [])

    def root(m: float) -> float:
        return m * budget + sum(sum(sorted((r["points"] - m * r["price"] for r in rows if r["position"] == p), reverse=True)[:n]) for p, n in quotas.items())

    low, high = 0.0, max((r["points"] / max(r["price"], 1) for r in rows), default=0.0) + 1
    for _ in range(60):  # the bound is convex in the multiplier
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if root(a) <= root(b) else (a, high)
    m = (low + high) / 2
    order = sorted(rows, key=lambda r: (-(r["points"] - m * r["price"]), r["player_id"]))
    worth = [r["points"] - m * r["price"] for r in order]
    names = list(quotas)
    later = [[i for i, r in enumerate(order) if r["position"] == p] for p in names]
    nodes, proved = 0, True
    stack: list[tuple[int, tuple, int, float, tuple]] = [(0, tuple(quotas.values()), budget, 0.0, ())]
    while stack:
        nodes += 1
        if nodes > steps:
            proved = False
            break
        i, need, left, points, chosen = stack.pop()
        if not any(need):
            if points > best + 1e-9:
                best, best_rows = points, [order[k] for k in chosen]
            continue
        bound, possible = points + m * left, True
        for k, n in enumerate(need):
            rest = [j for j in later[k] if j >= i][:n] if n else []
            possible = possible and len(rest) == n
            bound += sum(worth[j] for j in rest)
        if not possible or bound <= best + 1e-9 or i >= len(order):
            continue
        r = order[i]
        k = names.index(r["position"]) if r["position"] in quotas else -1
        stack.append((i + 1, need, left, points, chosen))
        if k >= 0 and need[k] and r["price"] <= left and sum(order[c]["club"] == r["club"] for c in chosen) < per_club:
            stack.append((i + 1, (*need[:k], need[k] - 1, *need[k + 1 :]), left - r["price"], points + r["points"], (*chosen, i)))
    return pd.DataFrame(best_rows, columns=pool.columns), proved


def squads(pool: DataFrame, exact: bool, quotas: Mapping[str, int] = QUOTAS, budget: int = BUDGET, per_club: int = PER_CLUB) -> DataFrame:
    """The chosen players of each scenario; `proved` says whether the squad is known to be the best. No rows if none is legal."""
    columns = ["scenario", "player_id", "position", "club", "price", "points"]
    quotas = dict(quotas)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, proved = exact_squad(pdf, quotas, budget, per_club) if exact else (greedy_squad(pdf, quotas, budget, per_club), False)
        return chosen.assign(proved=proved).astype({"proved": bool})

    pool = candidates(pool.select(*columns), per_club=per_club) if exact else greedy_candidates(pool.select(*columns), quotas, per_club)
    pool = pool.select("scenario", "player_id", "position", "club", F.col("price").cast("long").alias("price"), F.col("points").cast("double").alias("points"))
    return pool.groupBy("scenario").applyInPandas(pick, pool.withColumn("proved", F.lit(True)).schema)


def locked_squads(pool: DataFrame, locked: Sequence[int], quotas: Mapping[str, int] = QUOTAS, budget: int = BUDGET, per_club: int = PER_CLUB) -> DataFrame:
    """The greedy squad of each scenario around players that are in it for certain."""
    columns = ["scenario", "player_id", "position", "club", "price", "points"]
    quotas, locked = dict(quotas), list(locked)
    rows = pool.select("scenario", "player_id", "position", "club", F.col("price").cast("long").alias("price"), F.col("points").cast("double").alias("points"))
    rows = greedy_candidates(rows, quotas, per_club, locked)
    return rows.groupBy("scenario").applyInPandas(lambda pdf: greedy_squad(pdf, quotas, budget, per_club, locked)[columns], rows.schema)


def wildcard_squads(horizon: DataFrame, first: int, last: int, locked: Sequence[int] = (), quotas: Mapping[str, int] = QUOTAS, budget: int = BUDGET, per_club: int = PER_CLUB) -> DataFrame:
    """Each scenario's squad for a whole horizon: filled position by position by the sum of points, with `starts`, `captain` and `vice`.

    `horizon` has scenario, player_id, position, club, price, period, points; unknown points add nothing.
    Captain and vice are the starters of most points in the first period, ties by the whole horizon and id.
    """
    columns, quotas, locked = ["scenario", "player_id", "position", "club", "price", "points", "first_points"], dict(quotas), list(locked)
    inside = horizon.where(F.col("period").between(first, last))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    rows = inside.groupBy("scenario", "player_id", "position", "club", F.col("price").cast("long").alias("price")).agg(
        total("points").alias("points"), total(F.when(F.col("period") == first, F.col("points"))).alias("first_points")
    )
    rows = greedy_candidates(rows, quotas, per_club, locked)
    squad = rows.groupBy("scenario").applyInPandas(lambda pdf: greedy_squad(pdf, quotas, budget, per_club, locked, by_position=True)[columns], rows.select(columns).schema)
    starts = lineups(squad).select("scenario", "player_id", "starts")
    place = F.row_number().over(Window.partitionBy("scenario", "starts").orderBy(F.desc("first_points"), F.desc("points"), "player_id"))
    out = squad.join(starts, ["scenario", "player_id"]).withColumn("_place", place)
    return out.withColumns({"captain": F.col("starts") & (F.col("_place") == 1), "vice": F.col("starts") & (F.col("_place") == 2)}).drop("_place")


def relaxed_squad(pool: pd.DataFrame, ladder: Sequence[tuple[int, int]], quotas: Mapping[str, int] = QUOTAS) -> tuple[pd.DataFrame, int, bool]:
    """The best squad under the first (budget, club limit) of the ladder that allows one, which step that was (-1: none), and whether all searches up to it have closed."""
    sure = True
    for step, (budget, per_club) in enumerate(ladder):
        chosen, proved = exact_squad(pool, quotas, budget, per_club)
        sure &= proved
        if len(chosen):
            return chosen, step, sure
    return pool.iloc[:0], -1, sure


def relaxed_squads(pool: DataFrame, ladder: Sequence[tuple[int, int]], quotas: Mapping[str, int] = QUOTAS) -> DataFrame:
    """The best squad of each scenario under the first (budget, club limit) of the ladder that allows one, with `step` and `proved`; no rows where none does."""
    columns, quotas, ladder = ["scenario", "player_id", "position", "club", "price", "points"], dict(quotas), list(ladder)
    rows = candidates(pool.select(*columns), per_club=max(n for _, n in ladder)).select("scenario", "player_id", "position", "club", F.col("price").cast("long").alias("price"), F.col("points").cast("double").alias("points"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, step, proved = relaxed_squad(pdf, ladder, quotas)
        return chosen.assign(step=step, proved=proved)[[*columns, "step", "proved"]].astype({"proved": bool})

    return rows.groupBy("scenario").applyInPandas(pick, rows.withColumn("step", F.lit(0)).withColumn("proved", F.lit(True)).schema)


def _with_proof(squad: DataFrame) -> list[str]:
    """The column that says whether a squad is proved, where there is one."""
    return ["proved"] if "proved" in squad.columns else []


def lineups(squad: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Each squad's players with `starts` by the legal formation of most points, and `proved` if the squad says it. A group is one squad."""
    rows = squad.select(scenario, "player_id", "position", F.col("points").cast("double").alias("points"), *_with_proof(squad))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(starts=pdf["player_id"].isin(best_lineup(pdf)))

    return rows.groupBy(scenario).applyInPandas(pick, rows.withColumn("starts", F.lit(True)).schema)


#: What the points of the bench count for (its goalkeeper, then the outfield players in order), and what the captain's count for once more.
BENCH_WEIGHTS = (0.05, 0.12, 0.06, 0.03)
CAPTAIN_BONUS = 1.0


def best_plans(squad: pd.DataFrame, formation: Mapping[str, tuple[int, int]] = FORMATION, starting: int = 11, bench: Sequence[float] = BENCH_WEIGHTS, captain_bonus: float = CAPTAIN_BONUS) -> dict[str, tuple[float, list, list, object, object]]:
    """(value, starters, bench in order, captain, vice) of the best plan of a squad, of the best with other starters and of the best with another captain.

    Starters count in full, the captain once more by the bonus, the bench by its weights; no weight of the bench is above one.
    The second plan differs from the first by one swap between bench and starters of a legal formation. Ties go to the smaller ids.
    """
    worth, position = dict(zip(squad["player_id"], squad["points"].astype(float))), dict(zip(squad["player_id"], squad["position"]))
    order = sorted(worth, key=lambda i: (-worth[i], i))
    keepers = [i for i in order if position[i] == "GKP"]

    def legal(starters: Sequence) -> bool:
        return all(low <= sum(position[i] == p for i in starters) <= high for p, (low, high) in formation.items())

    def plan(starters: Sequence, captain=None) -> tuple:
        starters = sorted(starters)
        ranked = sorted(starters, key=lambda i: (-worth[i], i))
        captain = ranked[0] if captain is None else captain
        rest = [i for i in order if i not in starters]
        seats = [next((i for i in rest if position[i] == "GKP"), None)]
        seats = [i for i in seats if i is not None] + [i for i in rest if i not in seats]  # outfield by worth: heavier weights come first
        value = sum(worth[i] for i in starters) + captain_bonus * worth[captain] + sum(w * worth[i] for w, i in zip(bench, seats))
        return value, starters, seats, captain, next(i for i in ranked if i != captain)

    best_first = lambda plans: min(plans, key=lambda p: (-p[0], p[1], p[2], p[3], p[4]), default=None)
    outfield = [p for p in formation if p != "GKP"]
    counts = [()]
    for p in outfield:
        counts = [(*c, n) for c in counts for n in range(formation[p][0], formation[p][1] + 1)]
    line = {p: [i for i in order if position[i] == p] for p in outfield}
    legal_counts = [c for c in counts if sum(c) == starting - 1 and all(len(line[p]) >= n for p, n in zip(outfield, c))]
    first = best_first(plan([keepers[0], *(i for p, n in zip(outfield, c) for i in line[p][:n])]) for c in legal_counts) if keepers else None
    if first is None:
        return {}
    _, starters, seats, captain, _ = first
    swaps = ([*(i for i in starters if i != out), into] for out in starters for into in seats if (position[out] == "GKP") == (position[into] == "GKP"))
    found = {"primary": first, "lineup": best_first(plan(x) for x in swaps if legal(x)), "captaincy": best_first(plan(starters, i) for i in starters if i != captain)}
    return {k: v for k, v in found.items() if v is not None}


@dataclass(frozen=True)
class Caps:
    """Further limits on a squad: what its bench may cost, how many of some players it may share, what its players' risks may add up to. None: no limit."""

    bench_cost: int | None = None
    overlaps: tuple[tuple[frozenset, int], ...] = ()
    risk: float | None = None


def _role_sets(quotas: Mapping[str, int], formation: Mapping[str, tuple[int, int]], starting: int, bench: Sequence[float]) -> list[dict[str, tuple]]:
    """For each count of starters by position and each way to give the seats of the bench to positions: the roles of each position as (weight, name), heaviest first."""
    counts: list[dict] = [{}]
    for p, (low, high) in formation.items():
        counts = [c | {p: n} for c in counts for n in range(low, min(high, quotas[p]) + 1)]
    out = []
    for starts in (c for c in counts if sum(c.values()) == starting):
        seats = [(w, f"bench_{k}") for k, w in enumerate(bench)]
        keepers, rest = quotas["GKP"] - starts["GKP"], [p for p in quotas if p != "GKP" for _ in range(quotas[p] - starts[p])]
        for given in sorted(set(permutations(rest))):
            mine = {p: [(1.0, "starter")] * starts[p] for p in quotas}
            mine["GKP"] += seats[:keepers]
            for p, seat in zip(given, seats[keepers:]):
                mine[p].append(seat)
            out.append({p: tuple(r) for p, r in mine.items()})
    return out


def role_squad(pool: pd.DataFrame, quotas: Mapping[str, int] = QUOTAS, formation: Mapping[str, tuple[int, int]] = FORMATION, budget: int = BUDGET, per_club: int = PER_CLUB, bench: Sequence[float] = BENCH_WEIGHTS, captain_bonus: float = CAPTAIN_BONUS, caps: Caps = Caps(), starting: int = 11, steps: int = 2_000_000) -> tuple[dict, float, bool]:
    """The squad whose best plan is worth most: (role of each player, value, whether the search has proved it). No players if none is legal.

    Starters count in full, the captain once more by the bonus, the bench by its weights, which fall from seat to seat and are one at most.
    Branch and bound over positions, and in each over players from the most points down, who take the heaviest role that is
    open (any open role where the bench's cost is capped) or stay out. What the rest of a position can add at most is
    tabulated: clubs and caps are left out of it, and prices charged with the multiplier that makes the bound lowest at the
    root. After `steps` nodes the best so far is returned as not proved.
    """
    rows = sorted(pool.to_dict("records"), key=lambda r: (-r["points"], r["price"], r["player_id"]))
    names = list(quotas)
    line = {p: [r | {"points": float(r["points"]), "price": int(r["price"]), "risk": float(r.get("risk") or 0.0)} for r in rows if r["position"] == p] for p in names}
    if any(len(line[p]) < quotas[p] for p in names):
        return {}, float("-inf"), True
    sets = _role_sets(quotas, formation, starting, bench)

    def rest_of(p: str, roles: tuple, m: float) -> list[list[float]]:
        """[i][k]: the most that players from i on can add to roles[k:], price charged."""
        table = [[float("-inf")] * len(roles) + [0.0]]
        for r in reversed(line[p]):
            below = table[-1]
            table.append([max(below[k], w * r["points"] - m * r["price"] + below[k + 1]) for k, (w, _) in enumerate(roles)] + [0.0])
        return table[::-1]

    def root(m: float, roles: dict) -> float:
        return m * budget + sum(rest_of(p, roles[p], m)[0][0] for p in names)

    low, high = 0.0, max((r["points"] / max(r["price"], 1) for own in line.values() for r in own), default=0.0) + 1
    for _ in range(30):  # the bound is convex in the multiplier, and holds for each
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if root(a, sets[0]) <= root(b, sets[0]) else (a, high)
    m, tables, best, chosen_best, nodes, proved = (low + high) / 2, {}, float("-inf"), (), 0, True

    def most(p: str, roles: tuple, i: int) -> float:
        if (p, roles) not in tables:
            tables[p, roles] = [x[0] for x in rest_of(p, roles, m)]
        return tables[p, roles][i]

    for roles in sorted(sets, key=lambda x: -root(m, x)):
        after = [0.0] * (len(names) + 1)
        for k in range(len(names) - 1, -1, -1):
            after[k] = after[k + 1] + most(names[k], roles[names[k]], 0)
        leader = [max((line[p][0]["points"] for p in names[k:]), default=0.0) for k in range(len(names))] + [float("-inf")]
        stack: list[tuple] = [(0, 0, roles[names[0]], budget, 0.0, float("-inf"), ())]
        while stack:
            nodes += 1
            if nodes > steps:
                proved = False
                break
            at, i, left_roles, left, value, captain, chosen = stack.pop()
            if not left_roles:
                if at + 1 == len(names):
                    if value + captain_bonus * captain > best + 1e-9:
                        best, chosen_best = value + captain_bonus * captain, chosen
                    continue
                at, i = at + 1, 0
                left_roles = roles[names[at]]
            own = line[names[at]]
            here = own[i]["points"] if i < len(own) and left_roles[0][1] == "starter" else float("-inf")
            bound = value + m * left + most(names[at], left_roles, i) + after[at + 1] + captain_bonus * max(captain, here, leader[at + 1])
            if i >= len(own) or bound <= best + 1e-9:
                continue
            r = own[i]
            stack.append((at, i + 1, left_roles, left, value, captain, chosen))
            taken = [x for x, _ in chosen]
            fits = r["price"] <= left and sum(x["club"] == r["club"] for x in taken) < per_club and (caps.risk is None or sum(x["risk"] for x in taken) + r["risk"] <= caps.risk + 1e-9)
            fits = fits and all(r["player_id"] not in ids or sum(x["player_id"] in ids for x in taken) < n for ids, n in caps.overlaps)
            open_ = range(1) if caps.bench_cost is None else [k for k in range(len(left_roles)) if k == 0 or left_roles[k] != left_roles[k - 1]]
            for k in reversed(open_) if fits else ():
                weight, role = left_roles[k]
                if role != "starter" and caps.bench_cost is not None and sum(x["price"] for x, y in chosen if y != "starter") + r["price"] > caps.bench_cost:
                    continue
                best_starter = max(captain, r["points"]) if role == "starter" else captain
                stack.append((at, i + 1, (*left_roles[:k], *left_roles[k + 1 :]), left - r["price"], value + weight * r["points"], best_starter, (*chosen, (r, role))))
    roles_of = {r["player_id"]: role for r, role in chosen_best}
    ranked = sorted((r for r, role in chosen_best if role == "starter"), key=lambda r: (-r["points"], r["player_id"]))
    return roles_of | {r["player_id"]: name for r, name in zip(ranked, ("captain", "vice"))}, best, proved


def role_squads(pool: DataFrame, quotas: Mapping[str, int] = QUOTAS, budget: int = BUDGET, per_club: int = PER_CLUB, caps: Caps = Caps()) -> DataFrame:
    """player_id, role, value and proved of the squad of each scenario whose best plan is worth most. `pool` as in `squads`, and risk where it is capped.

    Without a cap on overlap or risk the candidates are pruned in Spark first; those caps forbid it, as a player who is beaten may be the one they allow.
    """
    quotas, risky = dict(quotas), caps.risk is not None
    columns = ["scenario", "player_id", "position", "club", "price", "points", *(["risk"] if risky else [])]
    rows = pool.select(*columns)
    rows = rows if risky or caps.overlaps else candidates(rows, per_club=per_club)
    rows = rows.withColumns({"price": F.col("price").cast("long"), "points": F.col("points").cast("double")})

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        roles, value, proved = role_squad(pdf, quotas, FORMATION, budget, per_club, caps=caps)
        return pd.DataFrame([(key[0], i, role, value, proved) for i, role in roles.items()], columns=["scenario", "player_id", "role", "value", "proved"])

    kind = rows.schema
    return rows.groupBy("scenario").applyInPandas(pick, f"scenario {kind['scenario'].dataType.simpleString()}, player_id {kind['player_id'].dataType.simpleString()}, role string, value double, proved boolean")


def lineup_plans(squad: DataFrame, scenario: str = "scenario") -> DataFrame:
    """The plans of each squad as rows: plan, player_id, role (captain, vice, starter, bench_1 ...), the plan's value, and `proved` if the squad says it. A group is one squad; none legal gives no rows."""
    proof = _with_proof(squad)
    rows = squad.select(scenario, "player_id", "position", F.col("points").cast("double").alias("points"), *proof)

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, (value, starters, seats, captain, vice) in best_plans(pdf).items():
            role = {i: "starter" for i in starters} | {i: f"bench_{k}" for k, i in enumerate(seats)} | {captain: "captain", vice: "vice"}
            out += [(key[0], name, i, role[i], value, *(bool(pdf[c].all()) for c in proof)) for i in role]
        return pd.DataFrame(out, columns=[scenario, "plan", "player_id", "role", "value", *proof])

    kind = rows.schema
    return rows.groupBy(scenario).applyInPandas(pick, f"{scenario} {kind[scenario].dataType.simpleString()}, plan string, player_id {kind['player_id'].dataType.simpleString()}, role string, value double" + "".join(f", {c} boolean" for c in proof))


#: What the points of a role count for.
ROLE_WEIGHTS = {"starter": 1.0, "captain": 2.0, "vice": 1.05, "bench": 0.1}


def objective(lines: DataFrame, discounts: Mapping[int, float], weights: Mapping[str, float] = ROLE_WEIGHTS) -> DataFrame:
    """Value of each squad by period and player, by period, and in all (nulls in the columns summed over), in one pass.

    `lines` has scenario, period, player_id, role, points. Periods without a discount do not count.
    """
    table = lambda m: F.create_map(*(F.lit(x) for pair in m.items() for x in pair))
    worth = F.col("points") * F.try_element_at(table(weights), F.col("role")) * F.try_element_at(table(discounts), F.col("period").cast("int"))
    rows = lines.withColumn("_worth", worth).where("_worth IS NOT NULL")
    return rows.groupingSets([("scenario", "period", "player_id"), ("scenario", "period"), ("scenario",)], "scenario", "period", "player_id").agg(F.sum("_worth").alias("value"))


def backtest(before: DataFrame, after: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: players out and in, the actual points of both squads, and what the change brought."""
    a, b = before.select("player_id").distinct(), after.select("player_id").distinct()
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "player_id", "full").join(actual.select("player_id", "points"), "player_id", "left")
    total = lambda side: F.coalesce(F.sum(F.when(F.col(side).isNotNull(), F.col("points"))), F.lit(0))
    out = both.agg(F.count_if(F.col("_b").isNull()).alias("out"), F.count_if(F.col("_a").isNull()).alias("in"), total("_a").alias("points_before"), total("_b").alias("points_after"))
    return out.withColumn("delta", F.col("points_after") - F.col("points_before"))


def starting_eleven(squad: DataFrame, formation: Mapping[str, int] | None = None, scenario: str = "scenario") -> DataFrame:
    """Each squad with `starts`, by the best of each position for a fixed formation, and a bench order."""
    counts = dict(formation or {"GKP": 1, "DEF": 3, "MID": 4, "FWD": 3})
    table = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))
    place = F.row_number().over(Window.partitionBy(scenario, "position").orderBy(F.desc("points"), "player_id"))
    rows = squad.withColumn("starts", place <= F.coalesce(F.try_element_at(table, F.col("position")), F.lit(0)))
    bench = F.row_number().over(Window.partitionBy(scenario, "starts").orderBy((F.col("position") == "GKP").desc(), F.desc("points"), "player_id"))
    return rows.withColumn("bench_order", F.when(~F.col("starts"), bench))


def captains(starters: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Starters with captain and vice: the two of most points, ties by id."""
    place = F.row_number().over(Window.partitionBy(scenario).orderBy(F.desc("points"), "player_id"))
    return starters.withColumn("_p", place).withColumn("captain", F.col("_p") == 1).withColumn("vice", F.col("_p") == 2).drop("_p")


def best_lineup(squad: pd.DataFrame, formation: Mapping[str, tuple[int, int]] = FORMATION, starting: int = 11) -> list:
    """Ids of the starting players of most points over all legal formations."""
    by = {p: squad[squad["position"] == p].sort_values(["points", "player_id"], ascending=[False, True]) for p in formation}
    best, names = (float("-inf"), []), list(formation)

    def walk(k: int, left: int, points: float, ids: list) -> None:
        nonlocal best
        if k == len(names):
            if left == 0 and points > best[0]:
                best = (points, ids)
            return
        low, high = formation[names[k]]
        for n in range(low, min(high, left, len(by[names[k]])) + 1):
            top = by[names[k]].head(n)
            walk(k + 1, left - n, points + float(top["points"].sum()), ids + top["player_id"].tolist())

    walk(0, starting, 0.0, [])
    return sorted(best[1])


def transfer_candidates(squad: DataFrame, pool: DataFrame, bank: int, free: int = 1, hit: int = 4, per_club: int = PER_CLUB, scenario: str = "scenario") -> DataFrame:
    """For each squad's worst player of each position the others of that position, with the first rule that forbids the swap, or null, and the gain."""
    worst = squad.withColumn("_p", F.row_number().over(Window.partitionBy(scenario, "position").orderBy("points", F.desc("price"), "player_id"))).where(F.col("_p") == 1)
    out = worst.select(scenario, "position", F.col("player_id").alias("out_id"), F.col("price").alias("out_price"), F.col("points").alias("out_points"), F.col("club").alias("out_club"))
    owned = squad.select(scenario, F.col("player_id").alias("in_id"), F.lit(True).alias("_owned"))
    clubs = squad.groupBy(scenario, F.col("club").alias("in_club")).agg(F.count("*").alias("_n"))
    into = pool.select("position", F.col("player_id").alias("in_id"), F.col("price").alias("in_price"), F.col("points").alias("in_points"), F.col("club").alias("in_club"), "selectable")
    rows = out.join(into, "position").join(owned, [scenario, "in_id"], "left").join(clubs, [scenario, "in_club"], "left")
    after = F.coalesce("_n", F.lit(0)) + 1 - (F.col("in_club") == F.col("out_club")).cast("int")
    reason = F.when(F.col("_owned"), "owned").when(~F.col("selectable"), "not_selectable").when(F.col("in_price") > F.col("out_price") + bank, "too_expensive").when(after > per_club, "club_limit").when(F.col("in_points") <= F.col("out_points"), "no_gain")
    cost = hit if free < 1 else 0
    return rows.select(scenario, "position", "out_id", "in_id", reason.alias("reason"), (F.col("in_points") - F.col("out_points") - cost).alias("gain"))


def paired_transfers(squad: DataFrame, pool: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Worst of the squad against best of the rest, position by position and rank by rank, where the rest is better."""
    rest = pool.join(squad.select("player_id"), "player_id", "left_anti")
    out = squad.select(scenario, "position", F.col("player_id").alias("out_id"), F.col("points").alias("out_points"), F.row_number().over(Window.partitionBy(scenario, "position").orderBy("points", "player_id")).alias("rank"))
    into = rest.select("position", F.col("player_id").alias("in_id"), F.col("points").alias("in_points"), F.row_number().over(Window.partitionBy("position").orderBy(F.desc("points"), "player_id")).alias("rank"))
    return out.join(into, ["position", "rank"]).where("in_points > out_points").withColumn("gain", F.col("in_points") - F.col("out_points"))


def scenario_delta(points: DataFrame, starters: Column, bench: Column, captain: Column) -> DataFrame:
    """One row: base points, with the bench counted, and with two further copies of the captain's points."""
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("points"))), F.lit(0))
    out = points.agg(part(starters).alias("base"), part(bench).alias("bench_gain"), (2 * part(captain)).alias("captain_gain"))
    return out.withColumn("bench_boost", F.col("base") + F.col("bench_gain")).withColumn("triple_captain", F.col("base") + F.col("captain_gain"))
