"""Configuration on the driver: defaults merged with project files, categories, and their stable names."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from .functions.windows import WindowRule


def deep_merge(base: dict, override: dict) -> dict:
    """``base`` with the values of ``override``; dictionaries merge at every level."""
    return {**base, **{k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}}


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def stable_id(value) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def load_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def save_json(path: str | Path, value) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")
    return path


def resolve_section(value, default: dict, root: str | Path = ".") -> dict:
    """A section that is missing, a dictionary or the path of a JSON file, merged over its defaults."""
    if value is None:
        return dict(default)
    if isinstance(value, (str, Path)):
        path = Path(value)
        value = load_json(path if path.is_absolute() else Path(root) / path)
    return deep_merge(default, value)


def first_config(folder: str | Path, name: str | None = None) -> Path | None:
    """``name`` or ``name.json`` in a folder, else the first JSON file of the folder ``name``, else of the folder; None if there is none."""
    folder = Path(folder)
    tries = [folder / name, folder / f"{name}.json"] if name else []
    for path in tries:
        if path.is_file():
            return path
    for at in ([folder / name] if name else []) + [folder]:
        if at.is_dir() and (found := sorted(at.glob("*.json"))):
            return found[0]
    return None


@dataclass(frozen=True)
class Scope:
    """Which filings the threshold is for, by their keywords; None means all."""

    keywords: tuple[str, ...] | None = ("nps",)
    strict: bool = True


@dataclass(frozen=True)
class ProcessConfig:
    rule: WindowRule = field(default_factory=lambda: WindowRule(("nps", "net promoter")))
    threshold: float = 0.34
    scope: Scope = field(default_factory=Scope)
    reference: str = "customer loyalty score"
    version: str = "v1"

    @classmethod
    def of(cls, values: dict) -> ProcessConfig:
        """From a plain dictionary; missing values keep their defaults."""
        base = cls()
        rule = WindowRule(**{**asdict(base.rule), **{k: tuple(v) if isinstance(v, list) else v for k, v in values.get("rule", {}).items()}})
        scope = values.get("scope", {})
        words = scope.get("keywords", base.scope.keywords)
        return cls(rule, float(values.get("threshold", base.threshold)), Scope(None if words is None else tuple(words), scope.get("strict", base.scope.strict)), values.get("reference", base.reference), values.get("version", base.version))


@dataclass(frozen=True)
class Property:
    name: str
    description: str
    type: str = "boolean"

    @property
    def default(self):
        return False if self.type.lower() not in ("float", "int", "integer") else None


@dataclass(frozen=True)
class Category:
    """A classification category: its properties, prompt and examples."""

    name: str
    properties: tuple[Property, ...]
    prompt_base: str = ""
    examples: tuple[tuple[str, dict], ...] = ()

    def to_dict(self) -> dict:
        return {"name": self.name, "properties": [asdict(p) for p in self.properties], "prompt_base": self.prompt_base, "examples": [{"text": t, "answer": a} for t, a in self.examples]}

    @classmethod
    def of(cls, values: dict) -> Category:
        return cls(values["name"], tuple(Property(**p) for p in values.get("properties", [])), values.get("prompt_base", ""), tuple((e["text"], e["answer"]) for e in values.get("examples", [])))

    @property
    def stable_id(self) -> str:
        return stable_id(self.to_dict())

    @property
    def types(self) -> dict[str, str]:
        return {p.name: p.type for p in self.properties}

    def save(self, folder: str | Path) -> Path:
        return save_json(Path(folder) / f"{self.name or self.stable_id}.json", self.to_dict())

    def prompt(self) -> str:
        """System prompt of a language model: task, labels, examples and the answer's JSON schema."""
        labels = "\n".join(f"- {p.name} ({p.type}): {p.description}" for p in self.properties)
        shown = "\n".join(f"Text: {t}\nAnswer: {json.dumps(a, ensure_ascii=False)}" for t, a in self.examples)
        schema = json.dumps({p.name: p.type for p in self.properties}, ensure_ascii=False)
        return "\n\n".join(x for x in (self.prompt_base, f"Labels:\n{labels}", shown and f"Examples:\n{shown}", f"Answer with one JSON object of this form: {schema}") if x)


def unique_properties(categories: list[Category]) -> dict[str, str]:
    """Property types by name over categories; the first category that has a name decides."""
    out: dict[str, str] = {}
    for c in categories:
        for name, kind in c.types.items():
            out.setdefault(name, kind)
    return out


@dataclass(frozen=True)
class Projects:
    """Project folders under a root: one file with sections each, and a marker that names the active one."""

    root: Path

    MARKER = "ACTIVE"
    SECTIONS = ("crawl", "preprocess", "classification")

    def path(self, name: str) -> Path:
        return Path(self.root) / name / "project.json"

    def create(self, name: str, values: dict | None = None) -> dict:
        """A new project, its sections empty or given; an existing one raises."""
        if self.path(name).exists():
            raise FileExistsError(name)
        made = deep_merge({"name": name, **{s: {} for s in self.SECTIONS}}, values or {})
        save_json(self.path(name), made)
        return made

    def names(self) -> list[str]:
        return sorted(p.parent.name for p in Path(self.root).glob("*/project.json"))

    def load(self, name: str, defaults: dict | None = None) -> dict:
        """A project with its sections (dictionaries or paths of JSON files) merged over defaults."""
        values, defaults = load_json(self.path(name)), defaults or {}
        return {**values, **{s: resolve_section(values.get(s), defaults.get(s, {}), self.path(name).parent) for s in self.SECTIONS}}

    def update(self, name: str, section: str, changes: dict) -> dict:
        """Changes merged into one section; a section that is a file is changed in that file."""
        values = load_json(self.path(name))
        if isinstance(values.get(section), str):
            file = Path(values[section]) if Path(values[section]).is_absolute() else self.path(name).parent / values[section]
            return load_json(save_json(file, deep_merge(load_json(file), changes)))
        values[section] = deep_merge(values.get(section) or {}, changes)
        save_json(self.path(name), values)
        return values[section]

    def activate(self, name: str | None) -> None:
        """Make a project the active one; None deactivates."""
        marker = Path(self.root) / self.MARKER
        if name is None:
            marker.unlink(missing_ok=True)
            return
        if not self.path(name).exists():
            raise FileNotFoundError(name)
        marker.write_text(name, encoding="utf-8")

    def active(self) -> str | None:
        marker = Path(self.root) / self.MARKER
        return marker.read_text(encoding="utf-8").strip() if marker.exists() else None
