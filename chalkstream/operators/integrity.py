"""Checks around a run: hashes of files and vectors, required columns, licences, timed steps, and a column catalogue."""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("chalkstream")


def file_hash(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def verify_manifest(manifest: str, folder: str) -> list[str]:
    """The files of a manifest ('hash  name' a line) that are missing or differ; raises if there are any."""
    bad = []
    for line in Path(manifest).read_text().splitlines():
        if line.strip() and not line.startswith("#"):
            want, name = line.split(maxsplit=1)
            path = Path(folder) / name.strip().lstrip("*")
            if not path.is_file() or file_hash(path) != want:
                bad.append(name.strip())
    if bad:
        raise RuntimeError(f"files that differ from the manifest: {', '.join(bad)}")
    return bad


def frozen_hash(rows: DataFrame, key: str, value: str) -> str:
    """One hash of a column by key that no order of rows changes: row hashes are summed, so nothing is gathered."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col(value).cast("string")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = rows.agg(F.sum(h).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{r.n}|{r.s}".encode()).hexdigest()


def require_columns(df: DataFrame, columns: list[str], block: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{block} lacks {len(missing)} columns: {', '.join(missing[:8])}")
    return df


# Licences that allow any use, and those that do not.
LICENCES = {"own": True, "cc-by": True, "cc0": True, "mit": True, "cc-by-nc": False}


@dataclass(frozen=True)
class Provenance:
    corpus: str
    licence: str

    def check(self) -> "Provenance":
        if self.licence not in LICENCES:
            raise ValueError(f"{self.corpus}: no known licence {self.licence}")
        if not LICENCES[self.licence]:
            raise PermissionError(f"{self.corpus}: {self.licence} does not allow this use")
        return self


@contextmanager
def step(name: str) -> Iterator[None]:
    """Logs how long a step took, and nothing of what it saw."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log.info("%s took %.1f s", name, time.perf_counter() - began)


# Families of columns by prefix.
FAMILIES = {"lo_": "objective", "loc_": "local window", "delta_": "local window", "ctg_": "contingency", "rep_": "repair", "rec_": "record", "histpos_": "history", "kcdiff_": "shared parts", "irt_": "contrast", "student_": "session", "tutor_": "session", "n_": "session", "session_": "task", "late_": "session"}


def family(column: str) -> str:
    return next((f for p, f in FAMILIES.items() if column.startswith(p)), "other")


def column_catalogue(frames: dict[str, DataFrame], known: str | None = None) -> str:
    """A table of every column, its block and family; raises if known, an earlier catalogue, says otherwise."""
    lines = ["| column | block | family |", "|---|---|---|", *(f"| {c} | {block} | {family(c)} |" for block, df in frames.items() for c in df.columns)]
    text = "\n".join(lines) + "\n"
    if known is not None and known != text:
        raise ValueError("the catalogue is out of date")
    return text


def disjoint_members(groups: DataFrame, group: str, item: str) -> DataFrame:
    """Items that stand in more than one group, for controls that must not leak."""
    return groups.groupBy(item).agg(F.countDistinct(group).alias("n")).where("n > 1")


def shuffled(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """key, other: a bijection of the keys onto themselves by the order of seeded hashes, for control runs.

    Both orders are numbered by blocks of the hash's first two digits, so no task sorts all keys.
    """
    from chalkstream.functions.scan import numbered

    d = keys.select(key).distinct().withColumn("one", F.lit(1))
    order = lambda s, name: numbered(d.withColumn("h", F.md5(F.concat_ws("|", F.lit(s), F.col(key).cast("string")))).withColumn("b", F.substring("h", 1, 2)), "one", "b", ["h"], index="rank_", total="total_").select(F.col(key).alias(name), "rank_")
    return order(0, key).join(order(seed + 1, "other"), "rank_").select(key, "other")
