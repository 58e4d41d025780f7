"""Benchmarks: lists of tasks from YAML files, addresses or dicts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path
from urllib.request import urlopen

from .task import Task


@dataclass
class Benchmark:
    tasks: list[Task]

    @classmethod
    def from_list(cls, configs: Sequence[dict]) -> Benchmark:
        return cls([Task.of(**c) for c in configs])

    @classmethod
    def from_yaml(cls, source: str | Path) -> Benchmark:
        """A file or address with a list under ``tasks``."""
        try:
            import yaml

            text = urlopen(str(source)).read() if "://" in str(source) else Path(source).read_bytes()
            configs = yaml.safe_load(text)["tasks"]
        except Exception as e:
            raise ValueError(f"Failed to load the file {source}") from e
        return cls.from_list(configs)

    def __len__(self) -> int:
        return len(self.tasks)

    def __getitem__(self, i: int) -> Task:
        return self.tasks[i]
