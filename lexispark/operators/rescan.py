"""A chain of stages over a store that reruns only what is stale, and goes on where it was stopped.

Stages are tables made from sources and from stages before them, either by resource or whole. A part's fingerprint is a
digest of its stage's name and version and of the fingerprints of what it reads: of the same resource in stages by
resource, of all resources in whole ones. A part whose fingerprint the store has already is up to date. Each stage is
committed as a snapshot of its own, so a run that was stopped begins again at the first stage that it hadn't committed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import snapshots as S


@dataclass(frozen=True)
class Source:
    """Rows with fingerprints: by resource, or of all of them under None alone if whole."""

    rows: DataFrame
    marks: dict[str | None, str]
    whole: bool = False


@dataclass(frozen=True)
class Stage:
    """A table made from sources and stages. A change of what `make` does is told by the version."""

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    whole: bool = False
    version: int = 1


@dataclass(frozen=True)
class Step:
    """What a run did of a stage: the resources that it wrote, and those that were up to date (of a whole stage None)."""

    stage: str
    written: tuple[str | None, ...]
    fresh: tuple[str | None, ...]


def _digest(*parts: str) -> str:
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def _of_all(marks: dict[str | None, str]) -> str:
    return _digest(*(f"{'' if r is None else '=' + r}:{mark}" for r, mark in sorted(marks.items(), key=lambda x: (x[0] is None, x[0] or ""))))


def plan(before: S.Snapshot, stages: list[Stage], sources: dict[str, Source]) -> list[tuple[Stage, dict[str | None, str], dict[str | None, str]]]:
    """Stages in order with the fingerprints that their parts should have, and those of the parts that are stale."""
    whole = {name: s.whole for name, s in sources.items()}
    marks = {name: s.marks for name, s in sources.items()}
    out = []
    for stage in stages:
        missing = [n for n in stage.needs if n not in marks]
        if missing:
            raise ValueError(f"{stage.name} needs {missing}, which no stage before it makes")
        rule = f"{stage.name}:{stage.version}"
        if stage.whole:
            own = {None: _digest(rule, *(_of_all(marks[n]) for n in stage.needs))}
        else:
            by_resource = [n for n in stage.needs if not whole[n]]
            resources = set().union(*(marks[n] for n in by_resource))
            own = {r: _digest(rule, *(marks[n].get(r, "none") if n in by_resource else _of_all(marks[n]) for n in stage.needs)) for r in resources}
        whole[stage.name], marks[stage.name] = stage.whole, own
        known = before.fingerprints(stage.name)
        out.append((stage, own, {r: mark for r, mark in own.items() if known.get(r) != mark}))
    return out


def run(spark: SparkSession, path: str, stages: list[Stage], sources: dict[str, Source]) -> list[Step]:
    """Brings a store up to date, stage by stage. Resources that the sources no longer have go from the stages, too."""
    now, steps = S.snapshot(spark, path), []
    for stage, marks, stale in plan(now, stages, sources):
        gone = set(now.fingerprints(stage.name)) - set(marks)
        if stale or gone or stage.name not in now.tables:
            inputs = [sources[n].rows if n in sources else now.read(spark, n) for n in stage.needs]
            if not stage.whole:
                # what is stale is all that is read: of stored tables only those folders
                by = [n not in sources or not sources[n].whole for n in stage.needs]
                by = [b and not (n in now.tables and now.tables[n].whole) for b, n in zip(by, stage.needs)]
                inputs = [x.filter(S.of_resources(F.col("resource_id"), stale)) if b else x for x, b in zip(inputs, by)]
            table = S.write_table(now, stage.name, stage.make(*inputs), stale, stage.whole)
            now = S.commit(spark, now, {stage.name: S.Table(table.schema, table.whole, {r: p for r, p in table.parts.items() if r in marks})})
        order = lambda rs: tuple(sorted(rs, key=lambda r: (r is None, r or "")))
        steps.append(Step(stage.name, order(stale), order(set(marks) - set(stale))))
    return steps
