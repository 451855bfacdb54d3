"""Settings: read once from the environment, checked, then fixed."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import MISSING, dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least characters of an admin token.
TOKEN_CHARS = 32
POSITIVE = ("work_lease_seconds", "inference_rate_limit_per_minute", "poll_rate_limit_per_minute", "retention_hours")


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class AppSettings:
    database_url: str
    work_lease_seconds: int = 300


@dataclass(frozen=True)
class PlatformSettings:
    database_url: str
    inference_rate_limit_per_minute: int = 600
    poll_rate_limit_per_minute: int = 1200
    retention_hours: int = 24


@dataclass(frozen=True, repr=False)
class AdminSettings:
    """Its repr does not show the token."""

    token: str

    def __repr__(self) -> str:
        return "AdminSettings(token='**********')"


def load(kind: type, prefix: str, environment: Mapping[str, str] | None = None):
    """Settings of a kind from variables with a prefix (case does not matter); unknown ones are ignored."""
    given = {k.upper(): v for k, v in (os.environ if environment is None else environment).items()}
    out = {}
    for f in fields(kind):
        raw = given.get(f"{prefix}{f.name}".upper())
        if raw is None:
            if f.default is not MISSING:
                continue
            raise SettingsError(f"{f.name} is missing")
        if f.name in POSITIVE:
            if not raw.strip().lstrip("+").isdigit() or int(raw) < 1:
                raise SettingsError(f"{f.name} must be a positive number")
            raw = int(raw)
        elif f.name == "token" and len(raw) < TOKEN_CHARS:
            raise SettingsError(f"token must have {TOKEN_CHARS} characters or more")
        out[f.name] = raw
    return kind(**out)


def setting_fault(name: Column, value: Column) -> Column:
    """The same rules on columns: missing, not positive, too short, or NULL."""
    positive = F.coalesce(F.when(value.rlike(r"\A\s*\+?[0-9]+\s*\z"), F.trim(F.replace(value, F.lit("+"), F.lit(""))).cast("bigint")), F.lit(0)) > 0
    return F.when(value.isNull(), "missing").when(name.isin(*POSITIVE) & ~positive, "not_positive").when((name == "token") & (F.length(value) < TOKEN_CHARS), "too_short")
