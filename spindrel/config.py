"""Settings of a run, checked when they are made."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from spindrel.errors import ConfigurationError

#: Dimensions of the known encoders, and the grade from which a judgment is relevant.
DIMENSIONS = {"intfloat/multilingual-e5-small": 384, "intfloat/multilingual-e5-base": 768, "intfloat/multilingual-e5-large": 1024, "hashing-64": 64}
RELEVANT = 2.0


@dataclass(frozen=True)
class IndexSettings:
    """Cells of the approximate index (0: about the square root of the rows), at most `sample`, and how many a query visits."""

    cells: int = 0
    probes: int = 12
    sample: int = 16_384

    def __post_init__(self) -> None:
        if self.cells < 0 or self.probes < 1 or (self.cells and not self.probes <= self.cells <= self.sample):
            raise ConfigurationError("an index needs 1 <= probes <= cells <= sample")


@dataclass(frozen=True)
class Settings:
    model: str = "hashing-64"
    collection: str = "spindrel-catalog"
    prefix: str = "spindrel"
    batch_size: int = 256
    allow_reset: bool = False
    index: IndexSettings = field(default_factory=IndexSettings)

    def __post_init__(self) -> None:
        if not self.model.strip():
            raise ConfigurationError("a model needs a name")
        if isinstance(self.batch_size, bool) or self.batch_size < 1:
            raise ConfigurationError("a batch holds one row at least")
        check_name(self.collection, self.prefix)

    @property
    def dimension(self) -> int:
        if self.model not in DIMENSIONS:
            raise ConfigurationError(f"the dimension of {self.model!r} isn't known")
        return DIMENSIONS[self.model]

    def may_reset(self, confirmed: bool) -> bool:
        """A reset needs the setting and the caller's word."""
        return self.allow_reset and confirmed


def check_name(name: str, prefix: str) -> str:
    """Names of collections begin with the prefix, letters and digits only counting."""
    plain = [re.sub(r"[^a-z0-9]", "", x.lower()) for x in (name, prefix)]
    if not plain[0].startswith(plain[1]) or not plain[1]:
        raise ConfigurationError(f"{name!r} doesn't begin with {prefix!r}")
    return name


def frozen(path: str) -> dict:
    """The frozen parameters of a run: a JSON file, or YAML where a YAML reader is installed. A file of the driver."""
    try:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                found = yaml.safe_load(f)
            else:
                found = json.load(f)
    except ImportError as e:
        raise ConfigurationError(f"{path}: no YAML reader is installed; use JSON") from e
    except (OSError, ValueError) as e:
        raise ConfigurationError(f"{path} can't be read: {e}") from e
    if not isinstance(found, dict):
        raise ConfigurationError(f"{path} holds no parameters")
    return found


def _number(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, "") or default)
    except ValueError as e:
        raise ConfigurationError(f"{name} must be a whole number") from e


def _switch(name: str, default: bool) -> bool:
    text = os.environ.get(name, "").strip().lower()
    if text in ("", "1", "true", "yes", "0", "false", "no"):
        return default if not text else text in ("1", "true", "yes")
    raise ConfigurationError(f"{name} must be true or false")


def from_environment(prefix: str = "SPINDREL_") -> Settings:
    base = Settings()
    return Settings(
        model=os.environ.get(f"{prefix}MODEL", base.model),
        collection=os.environ.get(f"{prefix}COLLECTION", base.collection),
        batch_size=_number(f"{prefix}BATCH_SIZE", base.batch_size),
        allow_reset=_switch(f"{prefix}ALLOW_RESET", base.allow_reset),
        index=IndexSettings(cells=_number(f"{prefix}CELLS", base.index.cells), probes=_number(f"{prefix}PROBES", base.index.probes)),
    )
