"""Publish a candidate through its contract's gate, restate published data, and recall the answers that changed."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from plumbline.operators import recall as R
from plumbline.operators.quality import may_publish, run_tests
from plumbline.plans.contracts import Contract
from plumbline.sources.tables import VersionedTable


class VersionTaken(ValueError):
    """Another writer has this version number."""


@dataclass(frozen=True)
class Release:
    version: int
    published: bool
    reason: str
    replaced: int | None = None


def release(
    table: VersionedTable,
    candidate: DataFrame,
    contract: Contract,
    version: int,
    parents: Mapping[str, DataFrame] | None = None,
    approved: bool = True,
    partition_by: list[str] | None = None,
) -> Release:
    """Write `candidate` as a version that no reader sees, test what was written, and point readers at it only if the gate lets it.

    The tests read the staged files, so what is published is what was tested. A refused version is deleted and readers stay
    where they are. A version is taken once: a second writer of the same number fails before anything is tested.
    """
    current = table.current()
    try:
        table.write(candidate, version, partition_by)
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            raise VersionTaken(f"version {version} is taken") from e
        raise
    results = run_tests(table.read(version), contract, parents)
    ok, reason = may_publish(replace(contract, version=version), results, approved, current)
    if ok:
        table.publish(version)
    else:
        table.drop(version)
    return Release(version, ok, reason, current)


def recall(
    table: VersionedTable,
    done: Release,
    answers: DataFrame,
    shapes: list[R.Shape],
    settings: DataFrame,
    time: str,
    scope: str,
    noticed: DataFrame | None = None,
) -> DataFrame | None:
    """Notices for the answers that a published release changed, from the version it replaced; None where nothing was replaced."""
    if not done.published or done.replaced is None:
        return None
    asked = R.requests(answers)
    old, new = (R.cells(asked, table.read(v), shapes, time, scope) for v in (done.replaced, done.version))
    return R.notices(answers, old, new, settings, noticed)
