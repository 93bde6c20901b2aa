"""Settings from the environment, with what each command needs."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from logging.handlers import RotatingFileHandler
from pathlib import Path


class ConfigError(ValueError):
    """A setting that a command needs is missing or malformed."""


@dataclass(frozen=True)
class Config:
    data_dir: str
    log_root: str
    allowed_senders: tuple[str, ...] = ()
    mail_client: str | None = None
    model_factory: str | None = None
    recipient: str | None = None
    strict: bool = True
    needs: tuple[str, ...] = field(default=(), compare=False)


def parse_senders(raw: str | None) -> tuple[str, ...]:
    """Addresses of a comma-separated list, lower case, each once, in order."""
    return tuple(dict.fromkeys(x.strip().lower() for x in (raw or "").split(",") if x.strip()))


def parse_flag(raw: str | None, default: bool) -> bool:
    return default if raw is None or not raw.strip() else raw.strip().lower() in ("1", "true", "yes", "on")


def load_config(needs: tuple[str, ...] = (), env: Mapping[str, str] | None = None) -> Config:
    """Settings QUILLSTONE_*; needs names those that must be there."""
    env = os.environ if env is None else env
    get = lambda k: (env.get(f"QUILLSTONE_{k.upper()}") or "").strip() or None
    c = Config(data_dir=get("data_dir") or "data", log_root=get("log_root") or "log", allowed_senders=parse_senders(get("allowed_senders")),
        mail_client=get("mail_client"),
               model_factory=get("model_factory"), recipient=get("recipient"), strict=parse_flag(get("strict"), True), needs=needs)
    missing = [k for k in needs if not getattr(c, k)]
    if missing:
        raise ConfigError("missing settings: " + ", ".join(f"QUILLSTONE_{k.upper()}" for k in missing))
    return c


def setup_logging(folder: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The package's logger: to the console, and with a folder to a file that is turned over at a megabyte, five of which are kept. Calling it
    again changes nothing, and what it writes goes to no other logger."""
    log = logging.getLogger("quillstone")
    log.setLevel(level)
    log.propagate = False
    kinds = {type(h) for h in log.handlers}
    form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    made = [] if logging.StreamHandler in kinds else [logging.StreamHandler()]
    if folder is not None and RotatingFileHandler not in kinds:
        Path(folder).mkdir(parents=True, exist_ok=True)
        made.append(RotatingFileHandler(Path(folder) / "quillstone.log", maxBytes=1_000_000, backupCount=5, encoding="utf-8"))
    for h in made:
        h.setFormatter(form)
        log.addHandler(h)
    return log
