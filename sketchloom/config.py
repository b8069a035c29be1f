"""Run configuration: defaults, validation, and the text form kept inside layout files."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, replace


def next_multiple_of_64(value: int) -> int:
    return -(-value // 64) * 64


@dataclass(frozen=True)
class IndexConfig:
    number_of_user_bins: int = 0
    number_of_hash_functions: int = 2
    maximum_fpr: float = 0.05
    relaxed_fpr: float = 0.3
    threads: int = 1
    sketch_bits: int = 12
    tmax: int = 0
    empty_bin_fraction: float = 0.0
    track_occupancy: bool = False
    alpha: float = 1.2
    max_rearrangement_ratio: float = 0.5
    disable_estimate_union: bool = False
    disable_rearrangement: bool = False

    def completed(self, user_bins: int) -> IndexConfig:
        """Defaults that depend on the input, and range checks."""
        tmax = self.tmax or next_multiple_of_64(math.ceil(math.sqrt(max(user_bins, 1))))
        if not 5 <= self.sketch_bits <= 32:
            raise ValueError("sketch_bits must lie in [5, 32]")
        if not 0 < self.maximum_fpr < 1 or not 0 < self.relaxed_fpr < 1 or self.relaxed_fpr < self.maximum_fpr:
            raise ValueError("rates must lie in (0, 1), the relaxed one not below the other")
        if not 0 <= self.max_rearrangement_ratio <= 1 or not 0 <= self.empty_bin_fraction < 1 or self.alpha < 0 or self.threads < 1 or self.number_of_hash_functions < 1:
            raise ValueError("a layout parameter is out of range")
        off = self.disable_rearrangement or self.disable_estimate_union or self.max_rearrangement_ratio == 0
        return replace(self, number_of_user_bins=user_bins, tmax=tmax, disable_rearrangement=off)


@dataclass(frozen=True)
class RunConfig:
    data_file: str = ""
    debug: bool = False
    sketch_directory: str = ""
    k: int = 19
    window_size: int = 19
    disable_sketch_output: bool = True
    precomputed_files: bool = False
    output_filename: str = "layout.txt"
    determine_best_tmax: bool = False
    force_all_binnings: bool = False
    output_verbose_statistics: bool = False
    index: IndexConfig = field(default_factory=IndexConfig)

    #: Names of the run section that are paths (kept as {"value0": path}).
    PATHS = ("data_file", "sketch_directory", "output_filename")
    RUN = ("data_file", "debug", "sketch_directory", "k", "window_size", "disable_sketch_output", "precomputed_files", "output_filename", "determine_best_tmax", "force_all_binnings")
    INDEX = ("number_of_user_bins", "number_of_hash_functions", "maximum_fpr", "relaxed_fpr", "threads", "sketch_bits", "tmax", "empty_bin_fraction", "track_occupancy", "alpha", "max_rearrangement_ratio", "disable_estimate_union", "disable_rearrangement")

    def to_text(self, prefix: str = "") -> str:
        """Two marked JSON sections, every line led by ``@``. ``prefix`` names the format's tool."""
        own = f"{prefix.lower()}_config" if prefix else "run_config"
        mark = f"{prefix.upper()}_CONFIG" if prefix else "RUN_CONFIG"
        run = {"version": 2} | {k: {"value0": getattr(self, k)} if k in self.PATHS else getattr(self, k) for k in self.RUN}
        index = {"version": 3} | {k: getattr(self.index, k) for k in self.INDEX}
        out = []
        for name, key, body in ((mark, own, run), ("HIBF_CONFIG", "hibf_config", index)):
            out += [f"@{name}", *("@" + line for line in json.dumps({key: body}, indent=4, ensure_ascii=False).split("\n")), f"@{name}_END"]
        return "\n".join(out) + "\n"

    @classmethod
    def from_text(cls, text: str) -> RunConfig:
        """Read both sections from anywhere in a layout file, whatever the tool's prefix."""
        found = {}
        for name, body in re.findall(r"^@(\w*CONFIG)\n(.*?)^@\1_END$", text, re.M | re.S):
            data = json.loads("\n".join(line.removeprefix("@") for line in body.splitlines()))
            found["index" if name == "HIBF_CONFIG" else "run"] = next(iter(data.values()))
        if set(found) != {"index", "run"}:
            raise ValueError("the configuration sections are missing")
        run, index = found["run"], found["index"]
        values = {k: run[k]["value0"] if k in cls.PATHS else run[k] for k in cls.RUN if k in run}
        return cls(**values, index=IndexConfig(**{k: index[k] for k in cls.INDEX if k in index}))


def reconcile(given: RunConfig, sketched: RunConfig, options: set[str]) -> tuple[RunConfig, list[str]]:
    """Settings of a run on stored sketches: inherited unless set; (config, warnings)."""
    if "sketch-bits" in options:
        raise ValueError("You cannot set --sketch-bits when using a sketch file as input.")
    warnings = []
    k, window = sketched.k, sketched.window_size
    if "kmer" in options and given.k != sketched.k:
        k = given.k
        warnings.append(f"[WARNING] Given k-mer size ({given.k}) differs from k-mer size in the sketch file ({sketched.k}). The results may be suboptimal. If this was a conscious decision, you can ignore this warning.")
    if "window" in options and given.window_size != sketched.window_size:
        raise ValueError("You are using a sketch file as input but want to use a --window size that differs from the one used for sketching. This will result in a layout (and subsequently an index that does not represent your data correctly.")
    return replace(given, k=k, window_size=window, index=replace(given.index, sketch_bits=sketched.index.sketch_bits), precomputed_files=sketched.precomputed_files), warnings
