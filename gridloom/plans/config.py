"""Settings of the plans, with the keys of the YAML sections experiment, dataset, dataloader and trainer."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class DatasetConfig:
    root_dir: str = ""
    masks: tuple[tuple[str, str | None], ...] = ()
    patch_size: int = 256
    stride: int = 128
    lr_patch_size: int = 64
    bands: tuple[int, ...] = (1, 2, 3, 4)
    overlap_threshold: float = 0.8
    max_nodata_ratio: float = 0.2
    nodata_value: float | None = None

    def __post_init__(self):
        if min(self.patch_size, self.stride, self.lr_patch_size) < 1 or not self.bands:
            raise ValueError("sizes are positive and at least one band is chosen")
        if not (0 <= self.overlap_threshold <= 1 and 0 <= self.max_nodata_ratio <= 1):
            raise ValueError("shares lie in 0..1")


@dataclass(frozen=True)
class LoaderConfig:
    batch_size: int = 8
    num_workers: int = 0


@dataclass(frozen=True)
class TrainerConfig:
    """Epochs, batches whose gradients are one step, rate and decay of the optimiser, and steps of the chain of validation."""

    max_epochs: int = 100
    accumulate_grad_batches: int = 8
    learning_rate: float = 1e-4
    weight_decay: float = 1e-2
    steps: int = 2000
    seed: int = 0


@dataclass(frozen=True)
class Config:
    name: str = "run"
    log_dir: str = "logs"
    dataset: DatasetConfig = DatasetConfig()
    dataloader: LoaderConfig = LoaderConfig()
    trainer: TrainerConfig = TrainerConfig()


@dataclass(frozen=True)
class InferConfig:
    """Options of joint denoising. steps is a parameter; save_every bounds what an interruption loses."""

    patch_size: int = 512
    stride: int = 384
    bands: tuple[int, ...] = (1, 2, 3)
    batch_size: int = 8
    save_every: int = 200
    fusion: str = "sdvc"
    seed: int = 0
    norm_range: tuple[float, float] | None = None
    steps: int = 2000
    precision: str = "f64"
    predictor: str = "oracle"  # a name of diffusion.EXPRESSIONS, or network


def _section(kind, values: dict | None):
    values = dict(values or {})
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if "masks" in values:
        values["masks"] = tuple(sorted((values["masks"] or {}).items()))
    if "bands" in values:
        values["bands"] = tuple(values["bands"])
    return kind(**values)


def config_of(values: dict) -> Config:
    """A configuration from nested settings; unknown keys are an error."""
    unknown = set(values) - {"experiment", "dataset", "dataloader", "trainer"}
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    experiment = values.get("experiment") or {}
    return Config(experiment.get("name", "run"), experiment.get("log_dir", "logs"), _section(DatasetConfig, values.get("dataset")), _section(LoaderConfig, values.get("dataloader")), _section(TrainerConfig, values.get("trainer")))


def load(path: str) -> Config:
    """A configuration from a YAML file (PyYAML) or a JSON file."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        import yaml
    except ImportError:
        import json

        return config_of(json.loads(text))
    return config_of(yaml.safe_load(text))


def norm_range(text: str | None) -> tuple[float, float] | None:
    """`lo,hi` as two numbers."""
    if not text:
        return None
    lo, hi = (float(x) for x in text.split(","))
    return lo, hi
