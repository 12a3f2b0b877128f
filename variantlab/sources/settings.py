"""Settings files: `key = value` lines, and hyperparameters as `key = value` or `key value`. Small, so the driver reads them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


def pairs(text: str) -> list[tuple[str, str]]:
    """Keys and values; `#` starts a comment, and a value ends before a second `=`."""
    out = []
    for line in text.splitlines():
        parts = line.split("#", 1)[0].split("=")
        if len(parts) >= 2:
            out.append((parts[0].strip(), parts[1].strip()))
    return out


def hyperparameters(text: str) -> dict[str, int | float | str]:
    """Numbers where they are."""
    out: dict[str, int | float | str] = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].replace("=", " ").split()
        if len(line) >= 2:
            out[line[0]] = _number(line[1])
    return out


def _number(text: str) -> int | float | str:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _truth(text: str) -> bool:
    if text not in ("True", "False"):
        raise ValueError(f"{text!r} is neither True nor False")
    return text == "True"


def _names(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def _numbers(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in _names(text))


def _map(text: str) -> dict[str, str]:
    return dict((a.strip(), b.strip()) for a, _, b in (x.partition(":") for x in _names(text)))


def _set(default: Any, read: Callable[[str], Any], key: str | None = None) -> Any:
    """A setting with its default, how its text is read, and its key in files where that isn't the field's name; `None` stands for no value where there may be none."""
    about = {"read": read, "key": key}
    return field(default_factory=lambda: dict(default), metadata=about) if isinstance(default, dict) else field(default=default, metadata=about)


@dataclass(frozen=True)
class Project:
    """The settings of a project, typed, with defaults. Keys and defaults of project files."""

    dataset_name: str = _set("", str)
    outfolder: str | None = _set(None, str)
    samples: str | None = _set(None, str, "Path_to_dataset_file")
    sequences: str | None = _set(None, str, "Path_to_sequences_file")
    structural_features: str | None = _set(None, str, "Path_to_structman_features_file")
    variant_sets: str | None = _set(None, str, "Path_to_multi_savs_table")
    features: str | None = _set(None, str, "path_to_features_file")
    processed_features: str | None = _set(None, str, "path_to_processed_features_file")
    imputed_features: str | None = _set(None, str, "path_to_imputed_features_file")
    impute_map: str | None = _set(None, str, "path_to_impute_map")
    alignments: str | None = _set(None, str, "msa_folder_path")
    more_samples: tuple[str, ...] = _set((), _names, "additional_samples")
    folds: int = _set(4, int, "crossValidation")
    skip_cv: bool = _set(False, _truth)
    multiple_lopo: int = _set(1, int)
    split_rate: float = _set(0.2, float)
    by_protein: bool = _set(False, _truth, "prot_based_separation")
    binary_thresh: float = _set(0.5, float)
    target_values: tuple[float, ...] | None = _set(None, _numbers)
    class_labels: tuple[str, ...] | None = _set(None, _names)
    target_map: dict[str, str] = _set({}, _map)
    transform: bool = _set(False, _truth)
    tag_filter: tuple[str, ...] = _set((), _names)
    protein_filter: tuple[str, ...] = _set((), _names)
    blacklist: tuple[str, ...] = _set((), _names)
    structure_threshold: int | None = _set(None, int)
    drop_structural: bool = _set(False, _truth, "filterStructuralFeatures")
    drop_single_variants: bool = _set(False, _truth, "filter_single_variant_prots")
    fuse_positions: bool = _set(False, _truth, "fusePositions")
    add_bias: bool = _set(False, _truth, "addBias")
    balance: float | None = _set(None, float, "balanceSubsampling")
    selection: str = _set("threeStaged", str, "feature_selection")
    search: str = _set("twoDim", str, "hyperOptimization")
    search_selection: bool = _set(True, _truth, "hpo_do_feat_selection")
    search_forest: bool = _set(True, _truth, "hpo_do_forest_param")
    search_weights: bool = _set(True, _truth, "hpo_do_sample_weighting")
    optimize_mean: bool = _set(True, _truth)
    error_exponent: float = _set(1.584, float, "err_warping_exp")
    norm_exponent: float = _set(1.2, float, "confusion_normalization_exp")
    confusion_goodwill: float = _set(0.3720368, float)
    confusion_rank: int = _set(311, int, "confusion_rank_threshold")
    corr_thresh: float = _set(0.9, float)
    weight_exponent: float = _set(2.0, float, "geometric_exp")
    trees: int = _set(382, int, "num_of_trees")
    depth: int = _set(194, int, "tree_depth")
    min_sample_split: int = _set(4, int)
    tree_min_leaf_samples: int = _set(1, int)
    learning_rate: float = _set(0.1, float)
    early_stopping: int = _set(30, int)
    feat_impact_thresh: float = _set(0.0, float)
    other: dict[str, str] = field(default_factory=dict)


def project(text: str, more: str = "") -> Project:
    """A project from its file's text and, over it, that of its hyperparameters.

    A later line replaces an earlier one; an empty value or `None` leaves the default.  Keys without a
    field are kept as text in `other`; a value that isn't of its field's type is an error that names the key.
    """
    known = {f.metadata["key"] or f.name: f for f in fields(Project) if f.name != "other"}
    values: dict[str, Any] = {}
    other: dict[str, str] = {}
    for key, value in [*pairs(text), *((k, str(v)) for k, v in hyperparameters(more).items())]:
        if key not in known:
            other[key] = value
        elif value not in ("", "None"):
            try:
                values[known[key].name] = known[key].metadata["read"](value)
            except ValueError as e:
                raise ValueError(f"setting {key}: {e}") from e
    return Project(**values, other=other)


def updated(text: str, key: str, value: object) -> str:
    """The text with the line of a key replaced, or added at the end."""
    lines = text.splitlines()
    new = f"{key} = {value}"
    for i, line in enumerate(lines):
        if line.split("#", 1)[0].split("=")[0].strip() == key:
            lines[i] = new
            return "\n".join(lines) + "\n"
    return "\n".join([*lines, new]) + "\n"


def save(path: str, values: dict[str, object]) -> None:
    Path(path).write_text("".join(f"{k} = {v}\n" for k, v in values.items()))
