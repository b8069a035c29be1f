"""Layout files: user bins, configuration and the tree of technical bins, as text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sketchloom.config import RunConfig
from sketchloom.sources.files import read_text


@dataclass
class Layout:
    """``user_bins``: (ub_id, path to the bin's filter, its first bin there, bins it spans);
    ``max_bins``: filter path -> its fullest technical bin (the root's path is empty)."""

    user_bins: list[tuple[int, tuple[int, ...], int, int]] = field(default_factory=list)
    max_bins: dict[tuple[int, ...], int] = field(default_factory=dict)

    def to_text(self) -> str:
        out = [f"#TOP_LEVEL_IBF fullest_technical_bin_idx:{self.max_bins.get((), 0)}"]
        out += [f"#LOWER_LEVEL_IBF_{';'.join(map(str, p))} fullest_technical_bin_idx:{m}" for p, m in sorted(self.max_bins.items()) if p]
        out.append("#USER_BIN_IDX\tTECHNICAL_BIN_INDICES\tNUMBER_OF_TECHNICAL_BINS")
        for ub, path, tb, n in self.user_bins:
            out.append(f"{ub}\t{';'.join(map(str, [*path, tb]))}\t{';'.join(map(str, [*[1] * len(path), n]))}")
        return "\n".join(out) + "\n"

    @classmethod
    def from_text(cls, text: str) -> Layout:
        out = cls()
        for line in text.splitlines():
            if m := re.fullmatch(r"#TOP_LEVEL_IBF fullest_technical_bin_idx:(\d+)", line):
                out.max_bins[()] = int(m[1])
            elif m := re.fullmatch(r"#LOWER_LEVEL_IBF_([\d;]+) fullest_technical_bin_idx:(\d+)", line):
                out.max_bins[tuple(map(int, m[1].split(";")))] = int(m[2])
            elif m := re.fullmatch(r"(\d+)\t([\d;]+)\t([\d;]+)", line):
                *path, tb = map(int, m[2].split(";"))
                out.user_bins.append((int(m[1]), tuple(path), tb, int(m[3].split(";")[-1])))
        return out

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """layout(ord, ub_id, prev_tbs, storage_tb, num_tbs) and max_bins(ibf_path, max_tb)."""
        rows = [(i, u, list(p), t, n) for i, (u, p, t, n) in enumerate(self.user_bins)]
        return (spark.createDataFrame(rows, "ord long, ub_id long, prev_tbs array<long>, storage_tb long, num_tbs long"),
                spark.createDataFrame([(list(p), m) for p, m in self.max_bins.items()], "ibf_path array<long>, max_tb long"))


def user_bins_text(files: list[list[str]], prefix: str = "") -> str:
    mark = f"{prefix.upper()}_USER_BINS" if prefix else "USER_BINS"
    return "\n".join([f"@{mark}", *(f"@{i} {' '.join(f)}" for i, f in enumerate(files)), f"@{mark}_END"]) + "\n"


def user_bins_from(text: str) -> list[list[str]]:
    """Files by user bin id, from between the markers (whatever the tool's prefix)."""
    m = re.search(r"^@(\w*USER_BINS)\n(.*?)^@\1_END$", text, re.M | re.S)
    if not m:
        raise ValueError("the user bin section is missing")
    rows = {}
    for line in m[2].splitlines():
        key, *files = line.removeprefix("@").split(" ")
        rows[int(key)] = files
    return [rows[i] for i in sorted(rows)]


def layout_text(files: list[list[str]], config: RunConfig, layout: Layout, prefix: str = "") -> str:
    return user_bins_text(files, prefix) + config.to_text(prefix) + layout.to_text()


def read_layout(spark: SparkSession, path: str) -> tuple[list[list[str]], RunConfig, Layout]:
    text = read_text(spark, path)
    return user_bins_from(text), RunConfig.from_text(text), Layout.from_text(text)
