"""Datasets by name: metadata, a source language, subsets, and loading."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.normalize import auto_messages, keep_standard, rename_aliases
from millrace.operators.reshape import union_all
from millrace.sources import jsonl

HUBS = ("hf", "ms")


@dataclass(frozen=True)
class Source:
    """``hub::id_or_path:subset/subset#count``."""

    name: str
    hub: str | None = None
    subsets: tuple[str, ...] = ()
    count: int | None = None

    @classmethod
    def parse(cls, text: str) -> "Source":
        hub, sep, rest = text.partition("::")
        hub, rest = (hub.lower(), rest) if sep and hub.lower() in HUBS else (None, text)
        head, sep, tail = rest.rpartition("#")
        count = int(tail) if sep and tail.isdigit() else None
        rest = head if count is not None else rest
        name, sep, subsets = rest.rpartition(":")
        if not sep or "/" in name and "." in subsets:
            name, subsets = rest, ""
        return cls(name, hub, tuple(s for s in subsets.split("/") if s), count)

    def text(self) -> str:
        return (f"{self.hub}::" if self.hub else "") + self.name + (":" + "/".join(self.subsets) if self.subsets else "") + (f"#{self.count}" if self.count is not None else "")


@dataclass(frozen=True)
class Subset:
    name: str = "default"
    split: tuple[str, ...] = ("train",)
    weak: bool = False
    preprocess: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Meta:
    """What is known of a dataset: ids on hubs or a path, columns to rename, subsets, and how to preprocess or load."""

    path: str | None = None
    hf_id: str | None = None
    ms_id: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    subsets: list[Subset] = field(default_factory=lambda: [Subset()])
    preprocess: Callable[[DataFrame], DataFrame] = auto_messages
    load: Callable[..., DataFrame] | None = None
    tags: tuple[str, ...] = ()

    @property
    def keys(self) -> set[str]:
        return {k.lower() for k in (self.path, self.hf_id, self.ms_id) if k}


REGISTRY: list[Meta] = []
LOG = logging.getLogger(__name__)


def register(meta: Meta, exist_ok: bool = False) -> Meta:
    for old in [m for m in REGISTRY if m.keys & meta.keys]:
        if not exist_ok:
            raise ValueError(f"{sorted(old.keys & meta.keys)} is registered already")
        REGISTRY.remove(old)
    REGISTRY.append(meta)
    return meta


def register_json(text: str) -> list[Meta]:
    """Datasets from a JSON list; paths, ids, columns, subsets and tags."""
    out = []
    for d in json.loads(text):
        subsets = [Subset(s) if isinstance(s, str) else Subset(s.get("name", "default"), tuple(s.get("split", ["train"])), s.get("is_weak_subset", False)) for s in d.get("subsets", ["default"])]
        out.append(register(Meta(d.get("dataset_path"), d.get("hf_dataset_id"), d.get("ms_dataset_id"), d.get("columns", {}), subsets, tags=tuple(d.get("tags", ()))), exist_ok=True))
    return out


def lookup(source: Source) -> Meta:
    """By path or hub id, then by the last part of an id; an unknown name is a path."""
    name = source.name.lower()
    found = [m for m in REGISTRY if name in m.keys] or [m for m in REGISTRY if name in {k.rsplit("/", 1)[-1] for k in m.keys}]
    return found[0] if found else Meta(path=source.name, subsets=[Subset(s) for s in source.subsets] or [Subset()])


def select_subsets(wanted: tuple[str, ...], meta: Meta) -> list[Subset]:
    """None: the only one or ``default``; ``all``: those that are not weak; else by name."""
    names = {s.name: s for s in meta.subsets}
    if not wanted:
        if len(names) <= 1:
            return meta.subsets
        if "default" in names:
            return [names["default"]]
        raise ValueError(f"choose a subset of {sorted(names)}")
    if wanted == ("all",) and "all" not in names:
        return [s for s in meta.subsets if not s.weak]
    return [names.get(w, Subset(w)) for w in wanted]


#: Fixed value: a hub is asked so often, a local folder once.
HUB_ATTEMPTS = 3


def attempted(load: Callable[[], DataFrame], times: int) -> DataFrame:
    """What ``load`` gives at its first success; the error of the last attempt otherwise."""
    for _ in range(times - 1):
        try:
            return load()
        except Exception as e:
            LOG.warning("a load failed and is tried again: %s", e)
    return load()


def load_one(spark: SparkSession, text: str, base: str = "") -> DataFrame:
    """Resolve a source, read its subsets, rename, preprocess, prune and sample."""
    from pyspark.sql import functions as F

    from millrace.operators.sampling import sample_times

    source = Source.parse(text)
    meta = lookup(source)
    frames = []
    for subset in select_subsets(source.subsets, meta):
        if meta.load:
            df = attempted(lambda subset=subset: meta.load(spark, meta, subset), 1 if meta.path else HUB_ATTEMPTS)
        elif meta.path is None:
            raise NotImplementedError(f"{source.name} is on a hub; give a local path or a load function")
        elif "." in meta.path.rsplit("/", 1)[-1]:
            df = jsonl.read_by_extension(spark, base + meta.path)
        else:
            df = jsonl.read_subsets(spark, base + meta.path, [subset.name], list(subset.split))
        frames.append(keep_standard((subset.preprocess or meta.preprocess)(rename_aliases(df, meta.columns))))
    out = union_all(*frames)
    if source.count is None:
        return out
    return sample_times(out.withColumn("_key", F.abs(F.xxhash64(*[F.to_json(F.struct(c)) for c in out.columns])) % 1000003), source.count, "_key").drop("_key")
