"""The manifest: which log batches and segments make up the table.

Each change writes ``manifest-<version>.json`` under another name and renames it;
the highest version is the table. A file that isn't whole JSON is passed over
for the version before it, so a crash at any point leaves the last good state.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from .files import Folder

KEEP = 3


@dataclass
class Segment:
    """A sorted run: a Parquet file, its level, key range (plain values) and size."""

    id: int
    level: int
    file: str
    lo: list
    hi: list
    rows: int
    bytes: int


@dataclass
class Manifest:
    mode: str
    version: int = 0
    next_seq: int = 0
    next_tx: int = 1
    next_segment: int = 0
    log: list[str] = field(default_factory=list)
    segments: list[Segment] = field(default_factory=list)
    #: Level -> last key, as stored, of what was moved down last.
    cursors: dict[str, list] = field(default_factory=dict)

    def at_level(self, level: int) -> list[Segment]:
        return [s for s in self.segments if s.level == level]

    def changed(self, **to) -> Manifest:
        return replace(self, version=self.version + 1, **to)


def name(version: int) -> str:
    return f"manifest-{version:012d}.json"


def load(folder: Folder) -> Manifest | None:
    versions = sorted((n for n in folder.names() if n.startswith("manifest-") and n.endswith(".json")), reverse=True)
    for n in versions:
        try:
            raw = json.loads(folder.read(n))
            found = Manifest(**raw | {"segments": [Segment(**s) for s in raw["segments"]]})
            # The next version must not meet the name of a broken one.
            found.version = int(versions[0][len("manifest-") : -len(".json")])
            return found
        except (ValueError, KeyError, TypeError):
            continue
    if versions:
        raise OSError("no manifest can be read")
    return None


def store(folder: Folder, manifest: Manifest) -> None:
    """Publish a version; raises if another writer has published it."""
    temp = f"_{uuid.uuid4().hex}.tmp"
    folder.write_new(temp, json.dumps(asdict(manifest)))
    if not folder.rename(temp, name(manifest.version)):
        folder.delete(temp)
        raise RuntimeError("another writer has changed this table")
    if manifest.version >= KEEP:
        folder.delete(name(manifest.version - KEEP))
