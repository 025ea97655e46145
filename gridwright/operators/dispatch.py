"""Crew dispatch: assignment costs as joins, and the dispatch automaton as one ordered fold a region."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.schema import DEFAULT_REPAIR_S, DETOUR_S, PREEMPT, REPAIR_S

METRES_A_SECOND = 25 / 3.6


def assignment_costs(incidents: DataFrame, crews: DataFrame) -> DataFrame:
    """(incident, crew, travel_s) over the idle crews, or all of them where none is idle.

    Crews are a table of a few rows; incidents meet each of them once.
    """
    idle = crews.where("not busy")
    pool = idle if not idle.isEmpty() else crews
    d = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    return incidents.crossJoin(F.broadcast(pool.select("crew", F.col("x").alias("cx"), F.col("y").alias("cy")))).select("incident", "crew", (d / METRES_A_SECOND).alias("travel_s"))


def replay(jobs: DataFrame, crews_a_region: int = 4, smart: bool = True) -> DataFrame:
    """(region, incident, crew, assigned_at, started_at, resolved_at, batched, preempted) of (region, incident, t, x, y, severity, priority).

    Events in order of (time, kind, incident). A new job goes to the idle crew that is there first; a
    smart dispatcher lets a driving crew take it as a detour of at most five minutes, or turns a
    driving crew round for a job of 1.35 times the priority. Otherwise it waits for the first crew
    that gets free. A crew's position moves only when it arrives. Each region is one fold.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "incident"], kind="stable")
        crews = [{"id": k, "xy": (0.0, 0.0), "job": None, "until": 0.0, "arrive": 0.0, "next": []} for k in range(crews_a_region)]
        done: dict[int, dict] = {}
        waiting: list[tuple[float, int, dict]] = []

        def travel(a: tuple, b: tuple) -> float:
            return math.hypot(a[0] - b[0], a[1] - b[1]) / METRES_A_SECOND

        def wait(job: dict) -> None:
            heapq.heappush(waiting, (-job["priority"], job["incident"], job))

        def go(crew: dict, job: dict, now: float) -> None:
            crew["job"], crew["arrive"] = job, now + travel(crew["xy"], job["xy"])
            crew["until"] = crew["arrive"] + REPAIR_S.get(job["severity"], DEFAULT_REPAIR_S)
            done[job["incident"]].update(crew=crew["id"], assigned_at=now, started_at=crew["arrive"], resolved_at=crew["until"])

        def advance(now: float) -> None:
            while ready := [c for c in crews if c["job"] is not None and c["until"] <= now]:
                crew = min(ready, key=lambda c: (c["until"], c["id"]))
                at = crew["until"]
                crew["xy"], crew["job"] = crew["job"]["xy"], None
                if crew["next"]:
                    go(crew, crew["next"].pop(0), at)
                elif waiting:
                    go(crew, heapq.heappop(waiting)[2], at)

        for row in frame.itertuples(index=False):
            job = {"incident": int(row.incident), "xy": (row.x, row.y), "severity": row.severity, "priority": row.priority}
            done[job["incident"]] = {"region": row.region, "incident": job["incident"], "crew": None, "assigned_at": None, "started_at": None, "resolved_at": None, "batched": False, "preempted": False}
            advance(row.t)
            idle = [c for c in crews if c["job"] is None]
            if idle:
                go(min(idle, key=lambda c: (travel(c["xy"], job["xy"]), c["id"])), job, row.t)
                continue
            driving = [c for c in crews if smart and c["arrive"] > row.t]
            detours = [(travel(c["job"]["xy"], job["xy"]), c["id"]) for c in driving if not c["next"]]
            if detours and min(detours)[0] <= DETOUR_S:
                crews[min(detours)[1]]["next"].append(job)
                done[job["incident"]]["batched"] = True
                continue
            weaker = [(c["job"]["priority"], c["id"]) for c in driving if job["priority"] >= PREEMPT * c["job"]["priority"]]
            if weaker:
                crew = crews[min(weaker)[1]]
                done[crew["job"]["incident"]].update(crew=None, assigned_at=None, started_at=None, resolved_at=None, preempted=True)
                wait(crew["job"])
                go(crew, job, row.t)
            else:
                wait(job)
        advance(math.inf)
        return pd.DataFrame(list(done.values())).astype({"crew": "Int64"})

    return jobs.groupBy("region").applyInPandas(fold, "region long, incident long, crew long, assigned_at double, started_at double, resolved_at double, batched boolean, preempted boolean")
