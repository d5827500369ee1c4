"""Settings: defaults, strict TOML files and environment variables."""

from __future__ import annotations

import logging
import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from docloom.schema import BLOCK_TYPES

ENV_PREFIX = "DOCLOOM_"
FILE_VARIABLE = "DOCLOOM_CONFIG"
FILE_NAME = "docloom.toml"


_TRUE = ("1", "true", "yes", "on")


def as_bool(raw: str) -> bool:
    """For text that people write: blanks around it don't count.  Variables are read by :func:`as_flag`."""
    return as_flag(raw.strip())


def as_flag(raw: str) -> bool:
    return raw.lower() in _TRUE


def as_strings(raw: str) -> tuple[str, ...]:
    return tuple(x for x in map(str.strip, raw.split(",")) if x)


def as_block_types(raw: str) -> frozenset[str]:
    return _checked_types(x.lower() for x in as_strings(raw))


def _checked_types(names: Any) -> frozenset[str]:
    found = frozenset(names)
    if unknown := found - set(BLOCK_TYPES):
        raise ValueError(f"unknown block types: {', '.join(sorted(unknown))}")
    return found


def _optional_int(raw: str) -> int | None:
    return int(raw)


@dataclass(frozen=True, slots=True)
class PipelineSettings:
    """One field a knob; defaults are fixed values."""

    render_dpi: int = 300
    render_dpi_digital_born: int = 150
    page_format: str = "png"
    crop_format: str = "png"
    jpeg_quality: int = 95
    render_workers: int | None = None
    retain_temp_dir: bool = False
    layout_confidence: float = 0.5
    layout_batch_size: int = 8
    layout_device: str = "cuda:0"
    layout_fp16: bool = False
    layout_fast_preproc: bool = False
    ocr_batch_size: int = 64
    ocr_min_score: float = 0.5
    ocr_use_cuda: bool = False
    ocr_workers: int = 1
    scanned_enabled: bool = True
    digital_born_sample_pages: int = 5
    digital_born_text_ratio: float = 0.3
    digital_born_min_text_chars: int = 100
    digital_born_workers: int = 1
    bundle_miss_images_for: frozenset[str] = field(default_factory=lambda: frozenset(BLOCK_TYPES))
    formula_enabled: bool = True
    formula_model_id: str = "PaddlePaddle/PP-FormulaNet-L_safetensors"
    formula_device: str = "cuda:0"
    formula_dtype: str = "fp16"
    formula_batch_size: int = 4
    formula_max_new_tokens: int = 1536
    formula_torch_compile: bool = False
    formula_bucketed: bool = True
    formula_bucket_small_threshold: int = 2500
    formula_bucket_medium_threshold: int = 15000
    formula_bucket_small_tokens: int = 192
    formula_bucket_medium_tokens: int = 512
    table_enabled: bool = False
    table_batch_size: int = 8
    table_device: str = "cuda:0"
    table_min_side_px: int = 120
    references_enabled: bool = False
    citation_url: str = "http://localhost:8070"
    citation_timeout_s: float = 60.0
    reference_labels: tuple[str, ...] = ("reference", "reference_content")

    def __post_init__(self) -> None:
        object.__setattr__(self, "bundle_miss_images_for", _checked_types(self.bundle_miss_images_for))
        object.__setattr__(self, "reference_labels", tuple(self.reference_labels))
        for name, allowed in (("page_format", ("jpeg", "png")), ("crop_format", ("jpeg", "png")), ("formula_dtype", ("fp16", "fp32"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> PipelineSettings:
        """Overrides from variables like DOCLOOM_RENDER_DPI; an empty variable counts as unset."""
        env = os.environ if env is None else env
        given = {f.name: env.get(ENV_PREFIX + f.name.upper(), "") for f in fields(cls)}
        return cls(**{k: parser(k)(raw) for k, raw in given.items() if raw != ""})


def parser(name: str) -> Callable[[str], Any]:
    """How a field's text is read."""
    special = {"bundle_miss_images_for": as_block_types, "reference_labels": as_strings, "render_workers": _optional_int}
    if name in special:
        return special[name]
    kind = {f.name: f.type for f in fields(PipelineSettings)}[name]
    return {"bool": as_flag, "int": int, "float": float}.get(kind, str)


@dataclass(frozen=True, slots=True)
class ApiSettings:
    host: str = "0.0.0.0"
    port: int = 8000
    boot_timeout_s: int = 120


@dataclass(frozen=True, slots=True)
class LoggingSettings:
    """Levels of the root and this package, and of the PDF library, which says much at INFO."""

    level: str = "INFO"
    pdf_oxide_level: str = "WARNING"
    format: str = "%(asctime)s %(levelname)-7s %(name)s :: %(message)s"

    def apply(self) -> None:
        """Sets handlers and levels anew; applications call this once, the package itself never does."""
        logging.basicConfig(level=self.level, format=self.format, force=True)
        for name, level in (("docloom", self.level), ("pdf_oxide", self.pdf_oxide_level)):
            logging.getLogger(name).setLevel(level)


@dataclass(frozen=True, slots=True)
class Settings:
    pipeline: PipelineSettings = field(default_factory=PipelineSettings)
    api: ApiSettings = field(default_factory=ApiSettings)
    logging: LoggingSettings = field(default_factory=LoggingSettings)


def _section(kind: type, name: str, given: dict[str, Any]) -> Any:
    unknown = sorted(set(given) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"unknown keys in [{name}]: {', '.join(unknown)}")
    return kind(**given)


def settings_path(path: str | Path | None = None) -> Path | None:
    """The argument, else the variable, else a file here, else one at the project's root; None: defaults."""
    if path is not None or os.environ.get(FILE_VARIABLE):
        found = Path(path if path is not None else os.environ[FILE_VARIABLE])
        if not found.is_file():
            raise FileNotFoundError(found)
        return found
    places = (Path.cwd() / FILE_NAME, Path(__file__).resolve().parents[1] / FILE_NAME)
    return next((p for p in places if p.is_file()), None)


def load_settings(path: str | Path | None = None) -> Settings:
    """Settings of a TOML file; unknown sections and keys are errors."""
    found = settings_path(path)
    given = {} if found is None else tomllib.loads(found.read_text(encoding="utf-8"))
    kinds = {"pipeline": PipelineSettings, "api": ApiSettings, "logging": LoggingSettings}
    if unknown := sorted(set(given) - set(kinds)):
        raise ValueError(f"unknown sections: {', '.join(unknown)}")
    return Settings(**{k: _section(kind, k, given.get(k, {})) for k, kind in kinds.items()})
