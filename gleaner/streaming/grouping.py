"""Grouping questions as they arrive: each joins the nearest group of its profile or begins one.

A question joins the group whose centroid has the highest cosine with it if that is at
least the threshold (ties: the older group); the centroid is the mean of its members.
The order within a profile matters, so a profile's rows are handled in sequence: by
``applyInPandas`` for a table and by ``applyInPandasWithState`` for a stream, where the
state holds a profile's centroid sums and counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STATE = "sums array<array<double>>, counts array<long>"
_UPDATE = "profile {p}, id {i}, group_id int, similarity double, joined boolean"


class Groups:
    """The groups of one profile."""

    def __init__(self, sums: list | None = None, counts: list | None = None):
        self.sums = [np.asarray(s, float) for s in sums or []]
        self.counts = [int(c) for c in counts or []]

    def add(self, vec: np.ndarray, threshold: float) -> tuple[int, float, bool]:
        """(group, similarity to its centroid before, whether it joined one)."""
        if self.sums:
            m = np.array(self.sums)
            scale = np.sqrt((m * m).sum(1)) * np.sqrt((vec * vec).sum())
            sim = np.where(scale > 0, m @ vec / np.where(scale > 0, scale, 1), 0.0)
            best = int(sim.argmax())
            if sim[best] >= threshold:
                self.sums[best] = self.sums[best] + vec
                self.counts[best] += 1
                return best, float(sim[best]), True
        self.sums.append(vec.astype(float))
        self.counts.append(1)
        return len(self.sums) - 1, 1.0, False


def _assign(groups: Groups, rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    rows = rows[rows["vec"].notna()].sort_values(["pos", "id"], kind="stable")
    got = [groups.add(np.asarray(v, float), threshold) for v in rows["vec"]]
    return pd.DataFrame({"profile": rows["profile"].to_numpy(), "id": rows["id"].to_numpy(), "group_id": [g[0] for g in got], "similarity": [g[1] for g in got], "joined": [g[2] for g in got]})


def _schema(df: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return _UPDATE.format(p=kind["profile"], i=kind["id"])


def group_in_order(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """profile, id, group_id, similarity, joined. rows: profile, id, pos, vec."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return _assign(Groups(), part, threshold)

    return rows.select("profile", "id", "pos", "vec").groupBy("profile").applyInPandas(run, _schema(rows))


def group_stream(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The same for a streaming DataFrame; a micro-batch's rows are taken by pos."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        groups = Groups(*state.get) if state.exists else Groups()
        part = pd.concat(list(parts), ignore_index=True)
        out = _assign(groups, part, threshold)
        state.update(([s.tolist() for s in groups.sums], groups.counts))
        yield out

    return rows.select("profile", "id", "pos", "vec").groupBy("profile").applyInPandasWithState(run, _schema(rows), STATE, "append", "NoTimeout")
