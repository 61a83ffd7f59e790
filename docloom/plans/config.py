"""Settings of a bundle: defaults, then a YAML file, then the environment."""

from __future__ import annotations

import ipaddress
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path
from urllib.parse import urlsplit

from docloom.functions.gating import Gates
from docloom.sources.okf import parse_yaml

FILE_NAME = "docloom.yaml"
PREFIX = "DOCLOOM_"


@dataclass(frozen=True)
class Config:
    document_root: str = "."
    model: str = ""
    model_host: str = "http://localhost:11434"
    temperature: float = 0.1
    most_tokens: int = 4096
    allow_remote_model: bool = False
    allowed_hosts: tuple[str, ...] = ()
    vision_model: str = ""
    verify_model: str = ""
    verify_host: str = ""
    dream_model: str = ""
    dream_host: str = ""
    use_layout_reader: bool = False
    chunk_threshold: int = 8000
    chunk_overlap: int = 500
    ordering_principle: str = "provenance"
    content_language: str = ""
    derive_per_file: bool = False
    generate_readme: bool = True
    exclude: tuple[str, ...] = ()
    low_priority: tuple[str, ...] = ()
    priority: tuple[str, ...] = ()

    def __post_init__(self):
        if self.ordering_principle not in ("provenance", "pertinence"):
            raise ValueError("ordering_principle is provenance or pertinence")
        for host in filter(None, (self.model_host, self.verify_host, self.dream_host)):
            name = urlsplit(host if "//" in host else f"//{host}").hostname or ""
            if not self.allow_remote_model and not is_private(host) and name not in self.allowed_hosts:
                raise ValueError(f"{host} is not a local host")

    def models(self) -> dict[str, tuple[str, str]]:
        """(model, host) of each role; a role without its own has the main one."""
        return {"extract": (self.model, self.model_host), "verify": (self.verify_model or self.model, self.verify_host or self.model_host), "dream": (self.dream_model or self.model, self.dream_host or self.model_host)}

    def summary(self) -> dict[str, str]:
        """What a dashboard shows of the settings."""
        return {name: ", ".join(v) if isinstance(v := getattr(self, name), tuple) else str(v) for name in (f.name for f in fields(self))}

    @property
    def gates(self) -> Gates:
        return Gates(self.exclude, self.low_priority, self.priority)


def is_private(host: str) -> bool:
    name = urlsplit(host if "//" in host else f"//{host}").hostname or ""
    if name == "localhost":
        return True
    try:
        return ipaddress.ip_address(name).is_private
    except ValueError:
        return False


def find_file(start: str) -> Path | None:
    """The settings file of the nearest folder upwards."""
    here = Path(start).resolve()
    return next((p / FILE_NAME for p in (here, *here.parents) if (p / FILE_NAME).is_file()), None)


def _as(kind, value):
    if kind.startswith("tuple"):
        return tuple(value) if isinstance(value, list) else tuple(filter(None, str(value).split(",")))
    return str(value).lower() in ("1", "true", "yes") if kind == "bool" else int(value) if kind == "int" else float(value) if kind == "float" else str(value)


def load(start: str, environment: dict[str, str] | None = None) -> Config:
    environment = dict(os.environ) if environment is None else environment
    kinds = {f.name: str(f.type) for f in fields(Config)}
    found = find_file(start)
    given = {k: v for k, v in (parse_yaml(found.read_text("utf-8")) if found else {}).items() if k in kinds and v is not None}
    given |= {k: environment[PREFIX + k.upper()] for k in kinds if PREFIX + k.upper() in environment}
    return replace(Config(), **{k: _as(kinds[k], v) for k, v in given.items()})
