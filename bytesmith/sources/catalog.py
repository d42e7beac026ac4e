"""Catalogs of formats: built-in layouts, a library of users' layouts, and declarative plugins (TOML) in directories."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.bytes import NeedleError, hex_needle
from ..plans.language import SchemaError, parse_schema
from ..plans.metadata import Metadata, order_name, read_metadata, with_metadata

BUILT_IN = Path(__file__).resolve().parent.parent / "formats"


class CatalogError(ValueError):
    pass


def slug(name: str) -> str:
    """Lower-case letters and digits, with single hyphens between."""
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


def _safe(folder: Path, name: str) -> Path:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) or ".." in name:
        raise CatalogError(f"{name!r} is no plain file name")
    return folder / name


def registry_path(path: str) -> str:
    """A pack's path within a registry: plain names joined by slashes, ending in .toml."""
    if not re.fullmatch(r"(?:[A-Za-z0-9][A-Za-z0-9_-]*/)*[A-Za-z0-9][A-Za-z0-9_-]*\.toml", path):
        raise CatalogError(f"{path!r} is no path of a pack")
    return path


def built_in() -> dict[str, str]:
    """Layout texts by the name in their header."""
    return {read_metadata(p.read_text()).name: p.read_text() for p in sorted(BUILT_IN.glob("*.layout"))}


# plugins

@dataclass(frozen=True)
class PluginFormat:
    name: str
    schema: str
    extension: str = ""
    description: str = ""
    confidence: int = 75
    entry: str | None = None
    endian: str = "le"
    detect: tuple[tuple[int, str], ...] = ()

    def rules(self) -> tuple[tuple[int, str], ...] | None:
        """(offset, hex) of each part; None if any part is invalid or empty, since then nothing matches."""
        out = []
        for offset, text in self.detect:
            try:
                data = hex_needle(text)
            except NeedleError:
                return None
            out.append((offset, data.hex().upper()))
        return tuple(out) or None


@dataclass(frozen=True)
class Plugin:
    id: str
    name: str
    version: str = "1.0.0"
    description: str = ""
    author: str = ""
    formats: tuple[PluginFormat, ...] = ()
    enabled: bool = True
    error: str | None = field(default=None, compare=False)


def read_plugin(text: str) -> Plugin:
    try:
        raw = tomllib.loads(text)
        formats = tuple(
            PluginFormat(f["name"], f["schema"], f.get("extension", ""), f.get("description", ""), f.get("confidence", 75), f.get("entry"), order_name(f.get("endian", "le")) or "le", tuple((p.get("offset", 0), p["hex"]) for p in f.get("detect", ())))
            for f in raw.get("formats", ())
        )
        return Plugin(raw["id"], raw["name"], raw.get("version", "1.0.0"), raw.get("description", ""), raw.get("author", ""), formats)
    except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError) as e:
        raise CatalogError(f"the manifest is broken: {e}") from None


def validate_plugin(plugin: Plugin) -> None:
    """Raises CatalogError at the first thing that is wrong, the layouts included."""
    if not plugin.id.strip() or not plugin.name.strip():
        raise CatalogError("a plugin needs an id and a name")
    for f in plugin.formats:
        if not f.name.strip():
            raise CatalogError("a format has no name")
        if not f.schema.strip():
            raise CatalogError(f"{f.name} has an empty schema")
        for _, text in f.detect:
            try:
                hex_needle(text, empty=True)
            except NeedleError as e:
                raise CatalogError(f"{f.name}: {e}") from None
        try:
            parse_schema(f.schema)
        except SchemaError as e:
            raise CatalogError(f"{f.name}: {e}") from None


def plugin_signatures(plugins: list[Plugin], first: int = 1000) -> list[dict]:
    """The enabled plugins' formats in the shape of the signature registry."""
    out = []
    for f in (f for p in plugins if p.enabled and not p.error for f in p.formats):
        rules = f.rules()
        if rules:
            out.append({"ordinal": first + len(out), "format": f.name, "extension": f.extension, "confidence": f.confidence, "parts": rules, "description": f.description, "magic_bytes": sum(len(h) // 2 for _, h in rules)})
    return out


def export_pack(name: str, schema: str, *, confidence: int = 75, version: str | None = None, detect: tuple[tuple[int, str], ...] = (), extension: str = "", description: str = "", author: str = "") -> str:
    """A plugin's text for a layout: what read_plugin() reads."""
    identity = slug(name)
    if not identity:
        raise CatalogError("a pack needs a name")
    if not 0 <= confidence <= 100:
        raise CatalogError("confidence runs from 0 to 100")
    if "'''" in schema or '"""' in schema:
        raise CatalogError("a layout with triple quotes can't be packed")
    for _, text in detect:
        hex_needle(text)
    meta = read_metadata(schema)
    quoted = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    head = {"id": identity, "name": name, "version": version or "1.0.0", "description": description, "author": author}
    lines = [f"{k} = {quoted(v)}" for k, v in head.items()] + ["", "[[formats]]", f"name = {quoted(name)}", f"extension = {quoted(extension)}", f"confidence = {confidence}"]
    lines += [f"entry = {quoted(meta.entry)}"] * bool(meta.entry) + [f"endian = {quoted(meta.endian or 'le')}"]
    lines.append("detect = [" + ", ".join(f"{{ offset = {o}, hex = {quoted(h)} }}" for o, h in detect) + "]")
    return "\n".join([*lines, f"schema = '''\n{schema}'''", ""])


class PluginFolder:
    """Installed plugins: a .toml each, and a .off beside those that are disabled."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def install(self, text: str) -> Plugin:
        plugin = read_plugin(text)
        validate_plugin(plugin)
        _safe(self.folder, f"{plugin.id}.toml").write_text(text)
        self.enable(plugin.id, True)
        return plugin

    def enable(self, identity: str, on: bool) -> None:
        off = _safe(self.folder, f"{identity}.off")
        if on:
            off.unlink(missing_ok=True)
        else:
            off.touch()

    def remove(self, identity: str) -> None:
        _safe(self.folder, f"{identity}.toml").unlink()
        self.enable(identity, True)

    def list(self) -> list[Plugin]:
        """All of them; a broken file comes with its error."""
        out = []
        for p in sorted(self.folder.glob("*.toml")):
            try:
                found = read_plugin(p.read_text())
                validate_plugin(found)
                out.append(Plugin(found.id, found.name, found.version, found.description, found.author, found.formats, not p.with_suffix(".off").exists()))
            except CatalogError as e:
                out.append(Plugin(p.stem, p.stem, enabled=False, error=str(e)))
        return out


class Registry:
    """Packs in a local directory tree, by paths that registry_path() allows."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def list(self) -> list[tuple[str, str, str, int]]:
        """(path, id, version, number of formats) of the packs that can be read, by path."""
        out = []
        for p in sorted(self.folder.rglob("*.toml")):
            try:
                path = registry_path(p.relative_to(self.folder).as_posix())
                found = read_plugin(p.read_text())
                validate_plugin(found)
                out.append((path, found.id, found.version, len(found.formats)))
            except CatalogError:
                continue
        return out

    def fetch(self, path: str) -> str:
        """A pack's text."""
        file = self.folder / registry_path(path)
        if not file.is_file():
            raise CatalogError(f"there is no pack {path}")
        return file.read_text()


class Library:
    """Users' layouts in a folder, a .layout each."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def add(self, name: str, text: str, meta: Metadata | None = None) -> str:
        identity = slug(name)
        if not identity:
            raise CatalogError("a layout needs a name")
        parse_schema(text)
        found = meta or read_metadata(text)
        _safe(self.folder, f"{identity}.layout").write_text(with_metadata(Metadata(name, found.entry, found.endian, found.description), text))
        return identity

    def load(self, identity: str) -> str:
        path = _safe(self.folder, f"{identity}.layout")
        if not path.is_file():
            raise CatalogError(f"there is no layout {identity}")
        return path.read_text()

    def remove(self, identity: str) -> None:
        _safe(self.folder, f"{identity}.layout").unlink()

    def list(self) -> list[tuple[str, Metadata]]:
        found = [(p.stem, read_metadata(p.read_text())) for p in self.folder.glob("*.layout")]
        return sorted(found, key=lambda x: ((x[1].name or x[0]).lower(), x[0]))


def listing(library: Library | None = None, plugins: PluginFolder | None = None) -> list[tuple[str, str, str]]:
    """(source, id, name): built-in layouts, then users' by name, then plugins'."""
    out = [("built-in", slug(n), n) for n in built_in()]
    out += [("user", i, m.name or i) for i, m in (library.list() if library else [])]
    return out + [("plugin", f"{p.id}/{slug(f.name)}", f.name) for p in (plugins.list() if plugins else []) if p.enabled for f in p.formats]


def schema_table(spark: SparkSession, plugins: list[Plugin] = ()) -> DataFrame:
    """format, source, schema_id, entry, endian, schema: a row per known format."""
    rows = []
    for name, text in built_in().items():
        meta = read_metadata(text)
        rows.append((name, "built-in", slug(name), meta.entry, meta.endian, text))
    rows += [(f.name, "plugin", f"{p.id}/{slug(f.name)}", f.entry, f.endian, f.schema) for p in plugins if p.enabled for f in p.formats]
    return spark.createDataFrame(rows, "format string, source string, schema_id string, entry string, endian string, schema string")
