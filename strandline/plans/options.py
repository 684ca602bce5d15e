"""Options of the tasks: defaults, what is allowed, and presets of the aligner."""

from __future__ import annotations

#: Options by command, with their defaults.
DEFAULTS = {
    "bubble": {"depth": 2000, "paths": 20, "DFS_guard": 10_000, "cx_depth": 6, "cx_nodes": 60, "cx_branches": 12, "cx_deg_branch": 3, "cx_deg_hub": 8, "cx_deg_cap": 12, "path_diff": 0.05, "min_len": 0, "min_num": 0, "keep_nested": False},
    "depth": {"base_depth": False, "min_mapq": 20, "min_frac": 0.7},
    "deoverlap": {"min_eq": 3, "max_iters": 10},
    "collapse": {"min_eq": 3, "max_iters": 10, "min_jaccard": 0.8, "min_new_frac": 0.10},
    "align": {"secondary": 0.8, "N": 5, "preset": "hifi"},
    "gfa2fa": {"min_len": 0, "extend": 50, "wrap": 60, "keep_unknown": False},
    "file2map": {"all": False, "min_len": 50_000, "min_mapq": 5},
    "liftover": {"regex": None, "min_frac": 0.9, "flank_win": 5000, "max_flank": 20_000, "max_gap": 20_000, "max_hit": 5, "min_len": 10_000, "min_mapq": 5, "win": 500, "step": 500, "max_examples": 20},
    "mapq_boost": {"mapq_low": 3, "mapq_new": 60, "min_frac": 0.95, "min_equivalents": 1, "name_check": False, "sub_ovlp_frac": 0.95},
}
_HOPS = {"cm_max_hops": 8, "cm_max_fanout": 512, "cm_min_len": 15, "cm_min_frac": 0.10, "cm_max_hits": 2000}
for _command in ("liftover", "mapq_boost"):
    DEFAULTS[_command] |= _HOPS
DEFAULTS["collapse"] |= {k: v for k, v in DEFAULTS["bubble"].items() if k not in ("min_len", "min_num", "keep_nested")}

#: Options that lie in a closed range; all other numbers are 0 at least.
_SHARE, _QUALITY = (0.0, 1.0), (0, 60)
RANGES = {
    "path_diff": _SHARE, "min_frac": _SHARE, "min_jaccard": _SHARE, "min_new_frac": _SHARE, "secondary": _SHARE, "cm_min_frac": _SHARE, "sub_ovlp_frac": _SHARE,
    "min_mapq": _QUALITY, "mapq_low": (0, 255), "mapq_new": (0, 255),
}
#: Options that are 1 at least.
POSITIVE = {"depth", "paths", "DFS_guard", "cx_depth", "cx_nodes", "cx_branches", "cx_deg_branch", "cx_deg_hub", "cx_deg_cap", "min_eq", "max_iters", "win", "step", "max_examples", "flank_win", "max_flank", "max_hit", "cm_max_fanout", "cm_min_len", "cm_max_hits", "min_equivalents"}
#: Shares that must be above 0, by command.
ABOVE_ZERO = {("align", "secondary"), ("mapq_boost", "min_frac")}


def checked(command: str, **given) -> dict:
    """All options of a command, those given in place of their defaults. An unknown one, or one out of its range, is
    a ValueError that names it."""
    own = DEFAULTS[command]
    unknown = sorted(set(given) - set(own))
    if unknown:
        raise ValueError(f"{command} has no option {', '.join(unknown)}")
    every = {**own, **given}
    for name, value in every.items():
        if isinstance(value, bool) or not isinstance(value, int | float):
            continue
        low, high = RANGES.get(name, (1 if name in POSITIVE or (command, name) == ("mapq_boost", "cm_max_hops") else 0, float("inf")))
        if not low <= value <= high or (value == 0 and (command, name) in ABOVE_ZERO):
            raise ValueError(f"{name} must lie in [{low}, {high}], not {value}")
    return every


def check_words(k: int, w: int, wide: bool = False) -> None:
    """Lengths of k-mers and minimizer windows; ``wide`` allows k-mers that don't fit a seed."""
    most = 61 if wide else 28
    if not 1 <= k <= most:
        raise ValueError(f"k must lie in [1, {most}], not {k}")
    if not 1 <= w <= 255:
        raise ValueError(f"w must lie in [1, 255], not {w}")
