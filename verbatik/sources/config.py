"""Settings, from YAML or JSON files, on the driver. Nested keys win over old flat ones, those over defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Punctuation:
    """Defaults of restoring punctuation."""

    enabled: bool = True
    model_path: str = "kredor/punctuate-all"
    chunk_words: int = 180


@dataclass(frozen=True)
class Transcription:
    """Defaults of speech recognition."""

    model_path: str = "models/large"
    min_punctuation_ratio: float = 0.01
    language: str | None = "french"
    initial_prompt: str | None = None
    punctuation: Punctuation = field(default_factory=Punctuation)


@dataclass(frozen=True)
class System:
    """Defaults of the driver's guard."""

    min_ram_gb: float = 7
    task_check_interval: float = 5
    max_wait_time_minutes: float = 30


@dataclass(frozen=True)
class Summary:
    """Defaults of summaries."""

    enabled: bool = True
    chunk_max_input_tokens: int = 60_000
    chunk_overlap_tokens: int = 5_000
    prompt: str = ""
    chunk_prompt: str | None = None
    reduce_prompt: str | None = None


@dataclass(frozen=True)
class Translate:
    """Defaults of translation."""

    batch_size: int = 10
    max_tokens: int = 2048
    temperature: float = 0.1
    max_retries: int = 3
    retry_delay: float = 1.0
    translation_prompt: str = ""


@dataclass(frozen=True)
class Config:
    whisper: Transcription = field(default_factory=Transcription)
    system: System = field(default_factory=System)
    summary: Summary = field(default_factory=Summary)
    translate: Translate = field(default_factory=Translate)


def read(path: str | None) -> dict:
    """A settings file as a dict; {} if there is none."""
    if not path or not Path(path).exists():
        return {}
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def _take(kind, nested: dict | None, flat: dict, prefix: str = ""):
    nested = nested or {}
    found = {}
    for f in fields(kind):
        for source, key in ((nested, f.name), (flat, prefix + f.name)):
            if key in source and not isinstance(source[key], dict):
                found[f.name] = source[key]
                break
    return found


def resolve(raw: dict) -> Config:
    """Config of a settings dict. model_path may be a list: its first that isn't empty counts."""
    w, t = raw.get("whisper") or {}, raw.get("translation") or {}
    voice = _take(Transcription, w, raw, "whisper_")
    if isinstance(voice.get("model_path"), list):
        voice["model_path"] = next((m for m in voice["model_path"] if m), Transcription.model_path)
    voice["punctuation"] = Punctuation(**_take(Punctuation, w.get("punctuation"), {}))
    return Config(
        Transcription(**voice), System(**_take(System, raw.get("system"), raw)),
        Summary(**_take(Summary, t.get("summary") or raw.get("summary"), raw, "summary_")), Translate(**_take(Translate, t.get("translate") or t, raw)),
    )
