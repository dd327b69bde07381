"""Configuration files, read by the driver and checked as a whole: each fault is told with its place, and any fault refuses the file."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from quern.functions.query import Dictionary


class ConfigError(ValueError):
    """faults: (place, what is wrong)."""

    def __init__(self, faults: Sequence[tuple[str, str]]):
        self.faults = list(faults)
        super().__init__("; ".join(f"{place or 'file'}: {what}" for place, what in faults))


def _object(text: str) -> dict:
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ConfigError([("", f"no JSON: {e}")]) from None
    if not isinstance(found, dict):
        raise ConfigError([("", "not an object")])
    return found


def _texts(value, place: str, faults: list, least: int = 0) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value) or len(value) < least:
        faults.append((place, "not a list of texts" if least == 0 else "not a list of texts, or empty"))
        return []
    return value


def _text_map(value, place: str, faults: list) -> dict[str, str]:
    if not isinstance(value, dict):
        faults.append((place, "not a map of texts"))
        return {}
    faults += [(f"{place}.{k}", "not a text") for k, v in value.items() if not isinstance(v, str)]
    return {k: v for k, v in value.items() if isinstance(v, str)}


def dictionary(text: str) -> Dictionary:
    """A normalisation dictionary: synonyms, transliteration, keyboardLayout, insignificantAttributes and stopWords."""
    given, faults = _object(text), []
    synonyms = given.get("synonyms")
    if not isinstance(synonyms, dict):
        faults.append(("synonyms", "not a map of lists"))
        synonyms = {}
    synonyms = {k: _texts(v, f"synonyms.{k}", faults, 1) for k, v in synonyms.items()}
    letters, keys = (_text_map(given.get(k), k, faults) for k in ("transliteration", "keyboardLayout"))
    faults += [(f"keyboardLayout.{k}", "not one character for one") for k, v in keys.items() if len(k) != 1 or len(v) != 1]
    attributes = given.get("insignificantAttributes")
    if not isinstance(attributes, dict):
        faults.append(("insignificantAttributes", "not an object"))
        attributes = {}
    names = {"storage": "storagePatterns", "color": "colors", "network": "networkMarkers", "dual_sim": "dualSimMarkers"}
    attributes = {k: _texts(attributes.get(v), f"insignificantAttributes.{v}", faults) for k, v in names.items()}
    stop = _texts(given.get("stopWords"), "stopWords", faults)
    if faults:
        raise ConfigError(faults)
    return Dictionary(synonyms, letters, keys, attributes, stop)


def code_patterns(text: str) -> dict[str, str]:
    """A pattern of model codes by brand; keys that start with _ are remarks."""
    given, faults = _object(text), []
    found = _text_map({k: v for k, v in given.items() if not k.startswith("_")}, "", faults)
    for brand, pattern in found.items():
        try:
            re.compile(pattern)
        except re.error as e:
            faults.append((brand, f"no pattern: {e}"))
    if faults:
        raise ConfigError(faults)
    return found


def version_ceilings(text: str, platforms: Sequence[str] = ("android", "ios")) -> dict[str, float]:
    """The highest version of each platform, a positive number."""
    given = _object(text)
    faults = [(p, "not a positive number") for p in platforms if isinstance(given.get(p), bool) or not isinstance(given.get(p), int | float) or given[p] <= 0]
    if faults:
        raise ConfigError(faults)
    return {p: float(given[p]) for p in platforms}


def subbrands(text: str, known: Mapping[str, str] | Sequence[str]) -> dict[str, str]:
    """The parent of each subbrand; both are known brands, and no brand is its own parent."""
    given, faults = _object(text), []
    found = _text_map({k: v for k, v in given.items() if not k.startswith("_")}, "", faults)
    for brand, parent in found.items():
        faults += [(brand, f"{b} is no known brand") for b in (brand, parent) if b not in known]
        if brand == parent:
            faults.append((brand, "its own parent"))
    if faults:
        raise ConfigError(faults)
    return found


SUFFIX = {"brand": str, "codeSuffix": str, "codeExample": str, "region": str, "sources": list, "notes": str}


def code_suffixes(text: str, regions: Sequence[str]) -> list[dict]:
    """Suffixes of model codes with their region: no field but the declared ones, one row for each brand and suffix, one source at least."""
    try:
        given = json.loads(text)
    except json.JSONDecodeError as e:
        raise ConfigError([("", f"no JSON: {e}")]) from None
    if not isinstance(given, list):
        raise ConfigError([("", "not a list")])
    faults, seen = [], set()
    for i, row in enumerate(given):
        if not isinstance(row, dict):
            faults.append((f"[{i}]", "not an object"))
            continue
        faults += [(f"[{i}].{k}", "unknown field") for k in row if k not in SUFFIX]
        faults += [(f"[{i}].{k}", "missing") for k in ("brand", "codeSuffix", "region", "sources") if k not in row]
        faults += [(f"[{i}].{k}", "of the wrong type") for k, v in row.items() if k in SUFFIX and not isinstance(v, SUFFIX[k])]
        if isinstance(row.get("sources"), list):
            _texts(row["sources"], f"[{i}].sources", faults, 1)
        if row.get("region") not in regions:
            faults.append((f"[{i}].region", "not a known region"))
        key = row.get("brand"), row.get("codeSuffix")
        if key in seen:
            faults.append((f"[{i}]", f"{key[0]} {key[1]} is there twice"))
        seen.add(key)
    if faults:
        raise ConfigError(faults)
    return given
