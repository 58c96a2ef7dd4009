"""Settings that plan builders take; values as the defaults of a deployment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    max_upload_bytes: int = 10 * 1024 * 1024
    max_pages: int = 20
    least_text_chars: int = 40
    sure_confidence: float = 80.0
    low_confidence: float = 60.0
    meter_tolerance: float = 1.0
    page_size: int = 20
    largest_page: int = 100
    label_aliases_file: str | None = None
    environment: str = "development"
    database_url: str | None = None
    ocr_language: str = "eng"

    def __post_init__(self) -> None:
        """A production without a database of its own would lose its bills with the machine: an error."""
        object.__setattr__(self, "database_url", normal_url(self.database_url))
        if self.environment.lower() == "production" and (self.database_url or "sqlite").startswith(("sqlite", "jdbc:sqlite")):
            raise ValueError("in production database_url must name a database server")

    @classmethod
    def from_environment(cls, prefix: str = "METERLAKE_", file: str | None = None) -> Settings:
        """Settings whose names, upper case and after the prefix, are set in the environment or else in a file of NAME=value lines."""
        given = {**(env_file(file) if file else {}), **os.environ}
        found = {}
        for f in fields(cls):
            if (value := given.get(prefix + f.name.upper())) is not None:
                found[f.name] = value if f.type.startswith("str") else json.loads(value)
        return cls(**found)


def env_file(path: str) -> dict[str, str]:
    """Names and values of a file's lines; blank lines, comments and lines without a name are passed over, as is a missing file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        lines = [line.strip().removeprefix("export ").partition("=") for line in f if "=" in line and not line.lstrip().startswith("#")]
    unquoted = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    return {name.strip(): unquoted(value.strip()) for name, _, value in lines if name.strip()}


def normal_url(url: str | None) -> str | None:
    """The short name of one kind of server written out; a file database's relative path made absolute."""
    if url and url.startswith("postgres://"):
        return "postgresql" + url.removeprefix("postgres")
    kind, sep, path = (url or "").partition("sqlite:///")
    if sep and not kind and path and path != ":memory:" and not os.path.isabs(path):
        return sep + os.path.abspath(path)
    return url
