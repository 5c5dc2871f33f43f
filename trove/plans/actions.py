"""Carrying out plans on a file system that all executors share: verified copies, never an overwrite.

A move copies to a temporary name, compares length and hash, links the copy to its name only if that is free, and removes
the source last. Each source's size and time are noted before anything moves: a missing source counts as moved only if
its target has them, so a task may be run twice, and a file that is gone is reported. The outcome is a stored table, so
reading it moves nothing again.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.sources.decoders import payload
from trove.sources.storage import stored

_BLOCK = 64 * 1024


def digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(_BLOCK):
            h.update(block)
    return h.hexdigest()


def verified_copy(source: str, target: str) -> None:
    """Copy, check, then take the name, which must be free."""
    if os.path.lexists(target):
        raise FileExistsError(f"{target} exists")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        shutil.copy2(source, part)
        if os.path.getsize(part) != os.path.getsize(source) or digest(part) != digest(source):
            raise OSError("the copy differs from its source")
        os.link(part, target)  # fails where the name has been taken meanwhile
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(part)


def stamp(path: str) -> str | None:
    """Size and time of a file, which a move keeps; None where there is none."""
    try:
        found = os.stat(path)
    except OSError:
        return None
    return f"{found.st_size}:{found.st_mtime_ns}"


def transfer(source: str, target: str, move: bool = True, noted: str | None = None) -> None:
    """Move or copy to an exact path. noted: the source's stamp before the plan was begun."""
    if not os.path.lexists(source):
        if move and noted is not None and stamp(target) == noted:
            return  # done before
        raise FileNotFoundError(f"{source} is gone")
    if not move and noted is not None and stamp(target) == noted and digest(target) == digest(source):
        return  # copied before
    if move and not os.path.lexists(target):
        os.makedirs(os.path.dirname(target), exist_ok=True)
        try:
            os.link(source, target)
            os.remove(source)
            return
        except OSError:
            if os.path.lexists(target):
                raise
    verified_copy(source, target)
    if move:
        os.remove(source)


def prune_empty(root: str) -> int:
    """Remove empty folders below root, not root itself."""
    n = 0
    for d, _, _ in os.walk(root, topdown=False):
        if d != root.rstrip("/"):
            with contextlib.suppress(OSError):
                os.rmdir(d)
                n += 1
    return n


def prove_duplicate(path: str, keeper: str) -> str | None:
    """Why a file may not be removed in favour of a keeper just now; None if it may."""
    try:
        if not os.path.isfile(keeper):
            return "the keeper is gone"
        if os.path.samefile(path, keeper):
            return "both are the same file"
        if digest(path) == digest(keeper):
            return None
        with open(path, "rb") as f, open(keeper, "rb") as g:
            a = payload(f.read(), os.path.splitext(path)[1][1:], rescue=False)
            b = payload(g.read(), os.path.splitext(keeper)[1][1:], rescue=False)
    except OSError as e:
        return f"can't be read: {e}"
    if a is None or b is None:
        return "not proven identical"
    return None if a == b else "contents differ"


def _carry_out(one) -> object:  # noqa: ANN001
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            errors = []
            for r in rows.itertuples():
                try:
                    errors.append(one(r))
                except OSError as e:
                    errors.append(str(e))
            yield pd.DataFrame({"source": rows["source"], "target": rows["target"], "moved": [e is None for e in errors], "error": pd.Series(errors, dtype=object)})

    return run


_OUTCOME = "source string, target string, moved boolean, error string"


def _noted(plan: DataFrame) -> DataFrame:
    """The plan with each source's stamp, stored before anything moves."""

    @F.pandas_udf("string")
    def look(source: pd.Series) -> pd.Series:
        return source.map(stamp)

    return stored(plan.withColumn("noted", look("source")), "plan")


def run_plan(plan: DataFrame, move: bool = True) -> DataFrame:
    """source, target, moved, error of each row of a plan, which is carried out at once."""

    def one(r) -> str | None:  # noqa: ANN001
        if r.target is None:
            return "no target"
        transfer(r.source, r.target, move, r.noted)
        return None

    return stored(_noted(plan.select("source", "target")).mapInPandas(_carry_out(one), _OUTCOME), "outcome")


def purge_proven(plan: DataFrame) -> DataFrame:
    """The same for (source, target, keeper): each source is proven equal to its keeper again before it moves."""

    def one(r) -> str | None:  # noqa: ANN001
        why = prove_duplicate(r.source, r.keeper) if os.path.lexists(r.source) else None
        if why is None:
            transfer(r.source, r.target, noted=r.noted)
        return why

    return stored(_noted(plan.select("source", "target", "keeper")).mapInPandas(_carry_out(one), _OUTCOME), "outcome")
