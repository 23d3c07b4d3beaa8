"""Settings from a mapping such as the environment, checked, with secrets that do not show."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

PREFIX = "LODESTACK_"
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


@dataclass(frozen=True)
class Settings:
    root: str = "catalogue"
    requests_per_minute: int = field(default=10, metadata={"low": 1, "high": 10_000})
    requests_per_day: int = field(default=250, metadata={"low": 0, "high": 1_000_000})
    min_quality: float = field(default=0.65, metadata={"low": 0.0, "high": 1.0})
    ocr: str = field(default="auto", metadata={"choices": ("auto", "tesseract", "rapidocr", "none")})
    retire: bool = False
    allowed_domains: tuple[str, ...] = ()
    allowed_emails: tuple[str, ...] = ()
    sink_url: str = ""
    model_key: str = field(default="", repr=False)
    source_token: str = field(default="", repr=False)
    session_secret: str = field(default="", repr=False)

    @classmethod
    def from_mapping(cls, env: Mapping[str, str]) -> Settings:
        """Values named PREFIX and the field in capitals; what is missing or blank keeps its default, what is wrong
        raises with its name and never with a secret's value."""
        values = {}
        for f in fields(cls):
            name = PREFIX + f.name.upper()
            raw = env.get(name, "").strip()
            if not raw:
                continue
            shown = "its value" if not f.repr else repr(raw)
            kind = type(f.default)
            try:
                value = tuple(x.strip().lower() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw) if kind is not bool else raw.lower() in TRUE
            except ValueError:
                raise ValueError(f"{name}: {shown} is no {kind.__name__}") from None
            if kind is bool and raw.lower() not in TRUE + FALSE:
                raise ValueError(f"{name}: {shown} is neither yes nor no")
            low, high = f.metadata.get("low"), f.metadata.get("high")
            if low is not None and not low <= value <= high:
                raise ValueError(f"{name}: {shown} is not within {low} and {high}")
            if (choices := f.metadata.get("choices")) and value not in choices:
                raise ValueError(f"{name}: {shown} is none of {', '.join(choices)}")
            values[f.name] = value
        return cls(**values)
