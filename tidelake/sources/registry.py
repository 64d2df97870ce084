"""Schema registries: by HTTP with a cache that lasts and a last good copy on disk, and in memory."""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from tidelake.errors import SchemaError


@dataclass(frozen=True)
class Registered:
    id: int
    subject: str
    version: int
    source: str
    references: tuple[tuple[str, str, int], ...] = field(default_factory=tuple)  # name, subject, version


class InMemoryRegistry:
    def __init__(self):
        self._by_id: dict[int, Registered] = {}

    def register(self, subject: str, source: str, schema_id: int | None = None, references=()) -> Registered:
        version = 1 + max((s.version for s in self._by_id.values() if s.subject == subject), default=0)
        made = Registered(schema_id or len(self._by_id) + 1, subject, version, source, tuple(references))
        self._by_id[made.id] = made
        return made

    def by_id(self, schema_id: int) -> Registered:
        if schema_id not in self._by_id:
            raise SchemaError(f"no schema {schema_id}")
        return self._by_id[schema_id]

    def version(self, subject: str, version: int) -> Registered:
        return next((s for s in self._by_id.values() if (s.subject, s.version) == (subject, version)), None) or self._none(subject)

    def latest(self, subject: str) -> Registered:
        return max((s for s in self._by_id.values() if s.subject == subject), key=lambda s: s.version, default=None) or self._none(subject)

    def _none(self, subject: str):
        raise SchemaError(f"no schema of {subject}")


class HttpRegistry:
    """A registry's REST interface.  Answers are kept for ``ttl_s``; if the registry doesn't answer, the
    last good one from the folder is given."""

    def __init__(self, url: str, folder: str | None = None, ttl_s: float = 300, fetch: Callable[[str], dict] | None = None, clock: Callable[[], float] = time.monotonic):
        self.url, self.folder, self.ttl_s, self.clock = url.rstrip("/"), folder, ttl_s, clock
        self.fetch = fetch or self._get
        self._kept: dict[str, tuple[float, Registered]] = {}
        if folder:
            os.makedirs(folder, exist_ok=True)

    def _get(self, path: str) -> dict:
        with urllib.request.urlopen(f"{self.url}{path}", timeout=10) as r:
            return json.load(r)

    def _file(self, path: str) -> str:
        return os.path.join(self.folder, urllib.parse.quote(path, safe="") + ".json")

    def _ask(self, path: str, schema_id: int | None = None, subject: str = "") -> Registered:
        kept = self._kept.get(path)
        if kept and self.clock() < kept[0]:
            return kept[1]
        try:
            a = self.fetch(path)
            made = Registered(a.get("id", schema_id), a.get("subject", subject), a.get("version", 0), a["schema"], tuple((r["name"], r["subject"], r["version"]) for r in a.get("references", [])))
        except Exception as e:
            if self.folder and os.path.exists(self._file(path)):
                with open(self._file(path)) as f:
                    d = json.load(f)
                return Registered(**d | {"references": tuple(map(tuple, d["references"]))})
            raise SchemaError(f"the registry doesn't answer {path}: {e}") from e
        self._kept[path] = (self.clock() + self.ttl_s, made)
        if self.folder:
            with open(self._file(path), "w") as f:
                json.dump(asdict(made), f)
        return made

    def by_id(self, schema_id: int) -> Registered:
        return self._ask(f"/schemas/ids/{schema_id}", schema_id)

    def latest(self, subject: str) -> Registered:
        return self._ask(f"/subjects/{urllib.parse.quote(subject, safe='')}/versions/latest", subject=subject)

    def version(self, subject: str, version: int) -> Registered:
        return self._ask(f"/subjects/{urllib.parse.quote(subject, safe='')}/versions/{version}", subject=subject)


def sources_of(registry, registered: Registered, seen: set | None = None) -> list[str]:
    """A schema's source and those of all it refers to."""
    seen = set() if seen is None else seen
    out = [registered.source]
    for _, subject, version in registered.references:
        if (subject, version) not in seen:
            seen.add((subject, version))
            out += sources_of(registry, registry.version(subject, version), seen)
    return out
