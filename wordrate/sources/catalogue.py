"""Experiment catalogue (YAML: section -> name -> settings).

The catalogue is a few kilobytes of settings, read once on the driver.  It becomes a
list of ``Experiment`` values (turned into literal columns by the request builder) or
a small DataFrame for reporting.
"""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..operators.requests import Experiment

_KNOWN = {"company", "model_name", "temperature", "logprobs", "top_logprobs", "dataset_column", "ft_dir"}


class CatalogueError(KeyError):
    pass


def read_catalogue(text_or_path: str) -> dict:
    if "\n" not in text_or_path and text_or_path.endswith((".yaml", ".yml")):
        with open(text_or_path, encoding="utf-8") as fh:
            return yaml.safe_load(fh) or {}
    return yaml.safe_load(text_or_path) or {}


def lookup(catalogue: dict, section: str, name: str) -> dict:
    """Unknown section or name is an error naming what exists."""
    if section not in catalogue:
        raise CatalogueError(f"Configuration type {section} not found; available: {sorted(catalogue)}")
    if name not in catalogue[section]:
        raise CatalogueError(f"{section.capitalize()} {name} not found; available: {sorted(catalogue[section])}")
    return dict(catalogue[section][name])


def experiments(catalogue: dict, experiment_path: str, prompts: dict[str, str],
                names: list[str] | None = None, section: str = "experiments") -> list[Experiment]:
    """Catalogue entries -> ``Experiment`` values; ``prompts`` maps prompt_path -> text."""
    out = []
    for name in names or list(catalogue.get(section, {})):
        args = lookup(catalogue, section, name)
        kw = {k: v for k, v in args.items() if k in _KNOWN}
        extra = {k: v for k, v in args.items() if k not in _KNOWN}
        out.append(Experiment(name=name, experiment_path=experiment_path,
                              prompt=prompts[args["prompt_path"]], extra=extra, **kw))
    return out


def catalogue_frame(spark: SparkSession, exps: list[Experiment]) -> DataFrame:
    rows = [(e.name, e.experiment_path, e.company, e.model_name, float(e.temperature), bool(e.logprobs),
             int(e.top_logprobs), e.dataset_column, e.ft_dir, e.prompt_key) for e in exps]
    return spark.createDataFrame(rows, "run string, experiment_path string, company string, model_name string, "
                                       "temperature double, logprobs boolean, top_logprobs int, "
                                       "dataset_column string, ft_dir string, prompt_key string")
