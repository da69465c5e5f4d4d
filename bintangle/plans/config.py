"""Settings of the pipeline: typed, with defaults and bounds, read from ``key = value`` text."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    resolution: int = 0
    bed_file: str = ""
    bias_file: str = ""
    matrix_file: str = ""
    sizes_file: str = ""
    sites_file: str = ""
    pairs_file: str = ""
    fasta_file: str = ""
    save_directory: str = ""
    strategy: str = "overlap"
    min_size: int = 5
    modularity: float = 0.05
    restarts: int = 20
    psig: float = 0.05
    convergence_rounds: int = 5
    look_ahead: float | None = 0.2
    first_scaffolds: int = 6
    scan_scaffolds: int = 5
    length_cutoff: int = 500_000


#: What each part needs.
NEEDS = {1: ("resolution", "bed_file", "bias_file", "matrix_file", "sizes_file"), 2: ("bed_file", "bias_file", "matrix_file"), 3: ("resolution", "sizes_file", "sites_file", "pairs_file"), 4: ("fasta_file",)}
_SHARES = {"modularity": 0.05, "psig": 0.05, "look_ahead": 0.2}


def parse_config(text: str) -> Config:
    """Comments and blank lines are skipped; values that do not fit their type keep the default, except ``resolution``, which is an error; shares above 1 become their default."""
    kinds = {f.name: f for f in fields(Config)}
    found: dict[str, object] = {}
    for line in text.splitlines():
        key, mark, value = (x.strip() for x in line.partition("="))
        if not line.strip() or line.lstrip().startswith("#") or not mark or key not in kinds:
            continue
        default = kinds[key].default
        if key == "look_ahead" and value.lower() == "false":
            found[key] = None
            continue
        try:
            found[key] = type(default)(value)
        except ValueError:
            if key == "resolution":
                raise ValueError(f"resolution is no integer: {value!r}") from None
            continue
        if key in _SHARES and found[key] > 1:
            found[key] = _SHARES[key]
    return Config(**found)


def missing(config: Config, parts: tuple[int, ...]) -> list[str]:
    """Settings that the chosen parts need and that are not set."""
    return sorted({name for part in parts for name in NEEDS[part] if not getattr(config, name)})
