"""What a harvest needs to know of its user."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

# Levels and forms of the log; names and places of addresses that are nobody's.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
FORMS = ("console", "json")
NOBODY = ("noreply", "no-reply", "researcher", "test", "user")
NOWHERE = ("example.com", "example.org", "example.net")


@dataclass(frozen=True)
class Settings:
    """Checked when made: sources ask for a real address of whoever fetches from them."""

    polite_email: str
    tavily_api_key: str = ""
    s2_api_key: str = ""
    data_dir: str = "data"
    cache_enabled: bool = True
    log_level: str = "INFO"
    log_format: str = "console"

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("polite_email", self.polite_email.strip())
        put("log_level", self.log_level.upper())
        put("log_format", self.log_format.lower())
        if "@" not in self.polite_email:
            raise ValueError("polite_email must be an address")
        name, _, place = self.polite_email.lower().partition("@")
        if name in NOBODY or place in NOWHERE:
            raise ValueError("polite_email must be a real address, not a placeholder")
        for name, allowed in (("log_level", LEVELS), ("log_format", FORMS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")

    @classmethod
    def of(cls, environment: Mapping[str, str]) -> Settings:
        """From variables named like the fields, in capitals."""
        given = {f: environment[f.upper()] for f in cls.__dataclass_fields__ if f.upper() in environment}
        if "cache_enabled" in given:
            given["cache_enabled"] = given["cache_enabled"].strip().lower() not in ("0", "false", "no", "off")
        return cls(**{"polite_email": ""} | given)

    @property
    def user_agent(self) -> str:
        return f"lectern (mailto:{self.polite_email})"
