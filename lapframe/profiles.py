"""Profiles: which source columns make up a channel, under which name and in which unit."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    name: str
    #: target name -> (source name, factor)
    channels: dict[str, tuple[str, float]]

    def matches(self, columns: list[str]) -> bool:
        """All its source columns are there; a profile without any matches everything."""
        return {s for s, _ in self.channels.values()} <= set(columns)


def read_profiles(path: str) -> list[Profile]:
    """Profiles of a configuration file: target_name, then a column of source names and one of factors for each."""
    with open(path, newline="") as f:
        rows = list(csv.reader(f))
    head, body = rows[0], [r for r in rows[1:] if r]
    out = []
    for k in range(1, len(head)):
        if head[k].startswith("conversion"):
            continue
        has_factor = k + 1 < len(head) and head[k + 1].startswith("conversion")
        channels = {}
        for r in body:
            source = r[k].strip() if len(r) > k else ""
            factor = r[k + 1].strip() if has_factor and len(r) > k + 1 else ""
            if source:
                channels[r[0].strip()] = (source, float(factor) if factor else 1.0)
        out.append(Profile(head[k], channels))
    return out


def read_topics(path: str) -> list[str]:
    """The topics of a list file, which has no header: the first field of each line, blank ones left out, a repeated one once."""
    with open(path, newline="") as f:
        named = [r[0].strip() for r in csv.reader(f) if r]
    return list(dict.fromkeys(t for t in named if t))


def select_profile(columns: list[str], profiles: list[Profile]) -> Profile | None:
    """The first profile that matches."""
    return next((p for p in profiles if p.matches(columns)), None)


def unify(df: DataFrame, profile: Profile) -> DataFrame:
    """Configured columns under their target names and in their units, others as they are: one projection."""
    by_source: dict[str, tuple[str, float]] = {s: (t, f) for t, (s, f) in profile.channels.items()}
    out = []
    for c in df.columns:
        target, factor = by_source.get(c, (c, 1.0))
        value = F.col(f"`{c}`")
        out.append((value * F.lit(factor) if factor != 1.0 else value).alias(target))
    return df.select(*out)
