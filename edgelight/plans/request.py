"""What a user asks for: a form, a command line or a line of chat, as one request."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..functions.text import read_number

DEFAULT_MINUTES, MOST_COMMAND_MINUTES = 60, 240

#: What chat and forms may choose from.
SERVICES = ["all", "live", "vod"]
REGIONS = ["all", "use1", "usw2", "usw1", "euw1", "apse1"]
POPS = ["all", "iad", "sjc", "dfw", "mia", "ord", "lhr"]
ALLOWED = {"service": SERVICES, "region": REGIONS, "pop": POPS}
#: Words and openings that tell small talk from questions about logs.
SHORT_GREETINGS = ["hi", "hey", "yo", "ok", "k"]
GREETINGS = [r"hi\b", r"hey\b", r"hello\b", r"yo\b", r"thanks\b", r"thank you\b", r"good (morning|afternoon|evening)\b", r"how are you\b", r"sup\b", r"what'?s up\b"]
KEYWORDS = ["service", "region", "pop", "win", "window", "errors", "p95", "p99", "ttms", "triage"]
EXAMPLE = "service=vod region=usw2 pop=sjc win=60"


class RequestError(ValueError):
    """A request that cannot be served; the message is for the user."""


@dataclass(frozen=True)
class TriageRequest:
    service: str = "all"
    region: str = "all"
    pop: str = "all"
    window_minutes: float = DEFAULT_MINUTES
    filters: tuple[Any, ...] = field(default_factory=tuple)
    debug: bool = False


def options(allowed: list[str]) -> list[str]:
    """`all`, then the others by name."""
    return sorted(allowed, key=lambda v: (v != "all", v))


def decode_filters(filters: Any) -> tuple[Any, ...]:
    """A list as it is, JSON text parsed, anything else (also broken JSON) nothing."""
    if isinstance(filters, list | tuple):
        return tuple(filters)
    if isinstance(filters, str) and filters.strip():
        try:
            filters = json.loads(filters)
        except ValueError:
            return ()
        return tuple(filters) if isinstance(filters, list) else ()
    return ()


def from_form(form: Mapping[str, Any]) -> TriageRequest:
    """Form fields: a window must be a positive number, filters proper JSON."""
    minutes = read_number(form.get("windowMinutes") or DEFAULT_MINUTES)
    if not math.isfinite(minutes) or minutes <= 0:
        raise RequestError("windowMinutes must be a positive number.")
    filters: Any = ()
    raw = str(form.get("filters") or "").strip()
    if raw:
        try:
            filters = json.loads(raw)
        except ValueError as error:
            raise RequestError(str(error)) from error
    debug = str(form.get("debug") or "").lower() in ("1", "true", "yes", "on")
    names = [str(form.get(n) or "all") for n in ("service", "region", "pop")]
    return TriageRequest(*names, minutes, decode_filters(filters), debug)


def parse_window(value: str) -> int:
    """Minutes of 90, 90m, 2h or 1d, at most MOST_COMMAND_MINUTES; the default if it is none of these."""
    m = re.fullmatch(r"([0-9]+)([mhd])?", value or "", re.IGNORECASE)
    if not m:
        return DEFAULT_MINUTES
    unit = {"m": 1, "h": 60, "d": 1440}[(m[2] or "m").lower()]
    return min(int(m[1]) * unit, MOST_COMMAND_MINUTES)


def _leading_int(value: str) -> int | None:
    m = re.match(r"\s*([+-]?[0-9]+)", value)
    return int(m[1]) if m else None


def _status_filter(value: str) -> dict | None:
    v = value.strip().lower()
    if v.endswith("xx"):
        first = _leading_int(v[0])
        low = math.nan if first is None else first * 100
        return {"key": "edge_status", "type": "range", "min": low, "max": low + 99}
    n = _leading_int(v) if v else None
    return None if n is None else {"key": "edge_status", "type": "eq", "value": n}


def _code_filter(value: str) -> dict | None:
    codes = [c.strip().upper() for c in re.split(r"[|,]+", value.strip()) if c.strip()]
    if len(codes) > 1:
        return {"key": "crc", "type": "in", "values": codes}
    return {"key": "crc", "type": "eq", "value": codes[0]} if codes else None


def parse_command(command: str) -> TriageRequest:
    """A command of key=value words, parted by white space or commas; later words override earlier ones, filters add up."""
    chosen: dict[str, Any] = {"service": "all", "region": "all", "pop": "all", "window": DEFAULT_MINUTES, "debug": False}
    filters = []
    for token in filter(None, re.split(r"[\s,]+", (command or "").strip())):
        key, _, value = token.partition("=")
        key, value, found = key.strip().lower(), value.strip(), None
        if key in ("service", "delivery_service", "region", "pop"):
            chosen["service" if key == "delivery_service" else key] = value.lower() or "all"
        elif key == "window":
            chosen["window"] = parse_window(value)
        elif key == "debug":
            chosen["debug"] = (value or "1").lower() in ("1", "true", "yes", "y", "on")
        elif key == "edge_status":
            found = _status_filter(value)
        elif key == "crc":
            found = _code_filter(value)
        elif key == "crc_class" and value:
            found = {"key": "crc_class", "type": "eq", "value": value.lower()}
        if found:
            filters.append(found)
    return TriageRequest(chosen["service"], chosen["region"], chosen["pop"], chosen["window"], tuple(filters), chosen["debug"])


def is_small_talk(message: str) -> bool:
    said = (message or "").strip().lower()
    if len(said) <= 3:
        return not said or said in SHORT_GREETINGS
    return any(re.match(p, said) for p in GREETINGS)


def looks_like_triage(message: str) -> bool:
    said = (message or "").strip().lower()
    return bool(said) and ("=" in said or any(k in said for k in KEYWORDS))


@dataclass(frozen=True)
class ChatReply:
    """Either a request to run, or what to answer instead."""

    request: TriageRequest | None = None
    answer: str = ""


def parse_chat(message: str, current: TriageRequest | None = None) -> ChatReply:
    """A line of chat: what it names overrides the current request; all values that are not allowed are told together."""
    current = current or TriageRequest()
    if is_small_talk(message):
        return ChatReply(answer=f"Hey! 👋 I can triage CDN logs.\n\nTry:\n{EXAMPLE}")
    if not looks_like_triage(message):
        return ChatReply(answer=f"I didn't see filters yet.\n\nTry:\n{EXAMPLE}")
    said = message.strip().lower()
    names = {"service": r"service|svc", "region": "region", "pop": "pop"}
    found = {n: re.search(rf"\b(?:{p})\s*=\s*([a-z0-9_]+)\b", said, re.ASCII) for n, p in names.items()}
    given = {n: m[1] for n, m in found.items() if m}
    bad = [f"{n}={v} (allowed: {'|'.join(ALLOWED[n])})" for n, v in given.items() if v not in ALLOWED[n]]
    window = re.search(r"\b(?:win|window)\s*=\s*([0-9]+)\b", said, re.ASCII)
    minutes = int(window[1]) if window else None
    if minutes == 0:
        bad.append("win=0 (must be a positive number)")
    if bad:
        return ChatReply(answer="I couldn’t run that because some values are invalid:\n- " + "\n- ".join(bad) + f"\n\nTry:\n{EXAMPLE}")
    chosen = {n: given.get(n, getattr(current, n)) for n in names}
    return ChatReply(TriageRequest(**chosen, window_minutes=minutes or current.window_minutes, filters=current.filters, debug=current.debug))
