"""Session settings that the operators count on, and where an application reads, writes and finds its models."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import KindError

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: What an environment may set, and what counts where it doesn't.
PLACES = {"input": ("CAIRN_INPUT", "input"), "output": ("CAIRN_OUTPUT", "output"), "model": ("CAIRN_MODEL", "models"), "workdir": ("CAIRN_WORKDIR", ""), "server": ("CAIRN_SERVER", "")}
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "CRITICAL")


def environment(places: dict[str, tuple[str, str]] | None = None) -> dict[str, str]:
    """Each place from its variable, else its default; places: (variable, default) that count before the engine's own."""
    return {k: os.environ.get(var, default) for k, (var, default) in (PLACES | (places or {})).items()}


@dataclass(frozen=True)
class Context:
    """Arguments count first, then those given before, then the environment, then defaults."""

    input: str = "input"
    output: str = "output"
    model: str = "models"
    workdir: str = ""
    server: str = ""
    args: dict[str, str] = field(default_factory=dict)
    places: dict[str, tuple[str, str]] = field(default_factory=dict)

    @staticmethod
    def of(places: dict[str, tuple[str, str]] | None = None, **given: str | None) -> Context:
        return Context(places=places or {}).updated(**given)

    def updated(self, **given: str | None) -> Context:
        """The context with further arguments; empty ones don't count."""
        args = self.args | {k: v for k, v in given.items() if v}
        found = environment(self.places) | {k: v for k, v in args.items() if k in PLACES}
        return replace(self, args=args, **{k: found[k] for k in PLACES})


def _existing(text: str) -> str:
    if "://" not in text and not Path(text).exists():
        raise argparse.ArgumentTypeError(f"no such path: {text}")
    return text


def _folder(text: str) -> str:
    if "://" not in text:
        if Path(text).is_file():
            raise argparse.ArgumentTypeError(f"not a folder: {text}")
        Path(text).mkdir(parents=True, exist_ok=True)
    return text


def parsed_args(argv: Sequence[str]) -> argparse.Namespace:
    """The arguments of an application; argv without the program's name. A level that isn't given stays None."""
    p = argparse.ArgumentParser()
    p.add_argument("-l", "--log-level", dest="log_level", type=str.upper, choices=LEVELS)
    p.add_argument("-i", "--input", type=_existing)
    p.add_argument("-o", "--output", type=_folder)
    p.add_argument("-m", "--model", type=_existing)
    p.add_argument("-w", "--workdir", type=_folder)
    p.add_argument("-s", "--server")
    return p.parse_args(list(argv))


def context_of(argv: Sequence[str], spark: SparkSession | None = None, places: dict[str, tuple[str, str]] | None = None) -> Context:
    """The context of a command line; a given level becomes the session's."""
    args = vars(parsed_args(argv))
    level = args.pop("log_level")
    if spark is not None and level:
        spark.sparkContext.setLogLevel("FATAL" if level == "CRITICAL" else level)
    return Context.of(places, **args)


class MemoryStore:
    """Values by key for the time of a session."""

    def __init__(self) -> None:
        self._held: dict[object, object] = {}

    def get(self, key: object, default: object = None) -> object:
        return self._held.get(key, default)

    def put(self, key: object, value: object) -> None:
        self._held[key] = value

    def delete(self, key: object) -> None:
        del self._held[key]

    def __contains__(self, key: object) -> bool:
        return key in self._held

    def __len__(self) -> int:
        return len(self._held)

    def keys(self) -> list[object]:
        return list(self._held)


def store_of(kind: str = "memory") -> MemoryStore:
    if kind != "memory":
        raise KindError(f"no store of kind {kind!r}")
    return MemoryStore()


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; the cluster's own master and sizes unless given."""
    builder = SparkSession.builder.appName("cairn")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map=SETTINGS | settings).getOrCreate()
