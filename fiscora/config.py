"""Settings from the environment, checked before a run, and daily log files (2.B B7)."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from pathlib import Path

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@dataclass(frozen=True)
class Settings:
    email: str = ""
    password: str = ""
    limit: int = 10
    log_folder: str = "logs"
    log_level: str = "INFO"
    state: str = "data/state"
    archive: str = "Facturas"
    receiver: str = ""
    receiver_name: str = ""

    def problems(self, mailbox: bool = True) -> list[str]:
        """What is wrong; a run without a mailbox needs no account."""
        missing = [n for n, v in (("EMAIL", self.email), ("APP_PASSWORD", self.password)) if mailbox and not v]
        out = [f"missing: {', '.join(missing)}"] if missing else []
        if self.limit <= 0:
            out.append("EMAIL_PROCESSING_LIMIT must be above zero")
        if self.log_level not in LEVELS:
            out.append(f"LOG_LEVEL must be one of {', '.join(LEVELS)}")
        return out


def from_environment(env: Mapping[str, str] | None = None) -> Settings:
    """Settings by the names that users know; a limit that is no number counts as zero, and so as wrong."""
    env = os.environ if env is None else env
    limit = env.get("EMAIL_PROCESSING_LIMIT", "10").strip()
    path = lambda name, default: str(Path(env.get(name, "").strip() or default).expanduser())
    return Settings(env.get("EMAIL", "").strip(), env.get("APP_PASSWORD", "").strip(), int(limit) if limit.isdigit() else 0, path("LOG_FOLDER", "logs"), env.get("LOG_LEVEL", "INFO").strip().upper(), path("STATE_DB_PATH", "data/state"), path("ARCHIVE_FOLDER", "Facturas"), "".join(c for c in env.get("RECEIVER_TAX_ID", "") if c.isdigit()), env.get("RECEIVER_NAME", "").strip().upper())


def daily_log(folder: str, level: str = "INFO") -> Path:
    """Send the root logger to a file for each day, in place of earlier handlers; that file."""
    target = Path(folder).expanduser().resolve() / f"{date.today().isoformat()}.log"
    target.parent.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(target, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logging.basicConfig(level=level if level in LEVELS else "INFO", handlers=[handler], force=True)
    return target
