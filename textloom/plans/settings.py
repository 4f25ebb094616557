"""Banks: settings with a closed grammar, validated when set, and kept as a JSON file that is swapped in whole."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field

from textloom.operators.chunk import BUDGET, CHUNKERS, LEAST_BUDGET
from textloom.operators.gate import CHECKS

NAME = re.compile(r"[a-z0-9][a-z0-9_-]*")


class SettingError(ValueError):
    pass


def number(low: float, high: float = float("inf"), kind: type = float):
    def read(value: str):
        x = kind(value)
        if not low <= x <= high:
            raise SettingError(f"{value} is not between {low} and {high}")
        return x

    return read


def names(value: str) -> list[str]:
    return [x for x in value.split(",") if x]


def period(value: str) -> int:
    """Seconds, a minute at least; off is 0."""
    if value == "off":
        return 0
    m = re.fullmatch(r"(\d+)([smhd])", value)
    seconds = int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]] if m else 0
    if seconds < 60:
        raise SettingError("a period is a minute at least, or off")
    return seconds


def switch(value: str) -> bool:
    if value not in ("on", "off"):
        raise SettingError("on or off")
    return value == "on"


def one_of(*allowed: str):
    def read(value: str) -> str:
        if value not in allowed:
            raise SettingError(f"one of {', '.join(allowed)}")
        return value

    return read


#: Plain keys and how their values are read. A trailing note says what has to be done again after a change.
KEYS = {
    "chunker": (one_of(*CHUNKERS), "texts are cut again"),
    "chunk.budget": (number(LEAST_BUDGET, kind=int), "texts are cut again"),
    "embedder": (str, "all vectors are made again"),
    "search.seeds": (number(1, kind=int), ""),
    "search.k": (number(1, kind=int), ""),
    "search.half_life": (number(0), ""),
    "search.graph": (switch, ""),
    "search.mute": (names, ""),
    "index.every": (period, ""),
    "compact.kinds": (names, ""),
    "compact.days": (number(1, kind=int), ""),
    "semantic": (switch, "texts are read again"),
    "semantic.kinds": (names, "texts are read again"),
    "semantic.mentions": (number(1, kind=int), ""),
    "semantic.votes": (number(1, kind=int), ""),
    "semantic.rounds": (number(1, kind=int), ""),
    "semantic.hops": (number(0, kind=int), ""),
    "semantic.region": (number(1, kind=int), ""),
    "semantic.concurrency": (number(1, kind=int), ""),
}
DEFAULTS = {"chunker": "text", "chunk.budget": BUDGET, "embedder": "hash", "search.seeds": 10, "search.k": 4, "search.half_life": 0.0, "search.graph": True, "search.mute": [], "index.every": 0, "compact.kinds": [], "compact.days": 0, "semantic": False, "semantic.kinds": [], "semantic.mentions": 5, "semantic.votes": 2, "semantic.rounds": 3, "semantic.hops": 2, "semantic.region": 2000, "semantic.concurrency": 2}
ENRICH_KEYS = {"prompt": str, "kinds": names, "paths": names, "kind": str, "neighbours": number(1, kind=int), "ratio": number(0.0001, 1), "votes": number(1, kind=int), "fields": names, "enabled": switch}


@dataclass
class Bank:
    name: str
    settings: dict = field(default_factory=dict)
    connectors: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not NAME.fullmatch(self.name):
            raise SettingError(f"{self.name!r} is no bank name")

    def get(self, key: str):
        return self.settings.get(key, DEFAULTS.get(key))

    def set(self, key: str, value: str) -> str:
        """Set a key and give a note on what has to be done again. off removes classes, key patterns and weights."""
        if key in KEYS:
            read, note = KEYS[key]
            try:
                self.settings[key] = read(value)
            except SettingError:
                raise
            except ValueError as e:
                raise SettingError(f"{key}: {e}") from None
            return note
        head, _, rest = key.partition(".")
        if head == "keys" and NAME.fullmatch(rest):
            return self._pattern(key, value)
        if head == "weight" and rest:
            return self._put(key, value, number(0), "")
        if head == "degree_cap" and rest:
            return self._put(key, value, number(1, kind=int), "")
        if head == "class" and NAME.fullmatch(rest):
            return self._put(key, value, names, "")
        if head == "check" and rest.split(".")[0] in CHECKS:
            name, _, part = rest.partition(".")
            if part and part not in CHECKS[name]:
                raise SettingError(f"{name} has no parameter {part}")
            self.settings[key] = number(-1e9)(value) if part else switch(value)
            return ""
        if head == "enrich" and rest.count(".") == 1 and rest.split(".")[1] in ENRICH_KEYS:
            if rest.endswith(".prompt") and value.startswith("@"):
                try:
                    with open(value[1:]) as f:
                        value = f.read()
                except OSError as e:
                    raise SettingError(f"{key}: {e}") from None
            return self._put(key, value, ENRICH_KEYS[rest.split(".")[1]], "texts are read again")
        raise SettingError(f"no setting {key}")

    def _pattern(self, key: str, value: str) -> str:
        def read(v: str) -> str:
            try:
                re.compile(v)
            except re.error as e:
                raise SettingError(f"{key}: {e}") from None
            return v

        return self._put(key, value, read, "keys are made again")

    def _put(self, key: str, value: str, read, note: str) -> str:
        if value == "off" and read is not switch:
            self.settings.pop(key, None)
        else:
            self.settings[key] = read(value)
        return note

    def under(self, head: str) -> dict:
        return {k[len(head) + 1 :]: v for k, v in self.settings.items() if k.startswith(head + ".")}

    def add_connector(self, name: str, spec: dict) -> None:
        if name.startswith("~") or not NAME.fullmatch(name) or name in self.connectors:
            raise SettingError(f"{name!r} can't be a connector's name")
        self.connectors[name] = spec

    def remove_connector(self, name: str) -> None:
        if self.connectors.pop(name, None) is None:
            raise SettingError(f"no connector {name}")

    def add_preset(self, preset: str, root: str, name: str = "", **options) -> None:
        """fs, or the session logs of either form, by one word."""
        specs = {"fs": {"fs": root}, "messages": {"sessions": root, "form": "messages"}, "events": {"sessions": root, "form": "events"}}
        if preset not in specs:
            raise SettingError(f"no preset {preset}; there are {', '.join(specs)}")
        self.add_connector(name or preset, specs[preset] | options)

    def save(self, home: str) -> None:
        os.makedirs(f"{home}/{self.name}", exist_ok=True)
        with open(f"{home}/{self.name}/bank.json.new", "w") as f:
            json.dump(asdict(self), f, indent=1)
        os.replace(f"{home}/{self.name}/bank.json.new", f"{home}/{self.name}/bank.json")

    @staticmethod
    def load(home: str, name: str) -> Bank:
        try:
            with open(f"{home}/{name}/bank.json") as f:
                return Bank(**json.load(f))
        except FileNotFoundError:
            raise SettingError(f"no bank {name}") from None


def banks(home: str) -> list[str]:
    return sorted(n for n in os.listdir(home) if os.path.exists(f"{home}/{n}/bank.json")) if os.path.isdir(home) else []
