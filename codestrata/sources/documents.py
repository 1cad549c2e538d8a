"""Facts of the other formats: Markdown, package manifests, compiler configurations, JSON, workspace lists."""

from __future__ import annotations

import json
import re

ENTRY_FIELDS = ("main", "module", "types", "browser", "exports", "bin")


def headings(text: str) -> list[dict]:
    """Headings outside fenced blocks."""
    out, fenced = [], False
    for n, line in enumerate(text.split("\n"), 1):
        if re.match(r"\s*(?:```|~~~)", line):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(.*)$", line.rstrip("\r"))):
            out.append({"level": len(m.group(1)), "title": re.sub(r"[#\s]+$", "", m.group(2)).strip(), "line": n})
    return out


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """(lower-case keys with values, the text without the block)."""
    end = text.find("\n---", 3) if text.startswith("---") else -1
    if end < 0:
        return {}, text
    found = {m.group(1).lower(): re.sub(r"^[\"']|[\"']$", "", m.group(2).strip()) for line in text[3:end].split("\n") if (m := re.match(r"([A-Za-z0-9_-]+)\s*:\s*(.*)$", line.strip()))}
    return found, text[end + 4 :]


def first_paragraph(text: str) -> str:
    lines: list[str] = []
    for line in map(str.strip, front_matter(text)[1].split("\n")):
        if not line or line.startswith(("#", "---", "|")):
            if lines:
                break
        else:
            lines.append(line)
    return " ".join(lines)[:480]


def read_markdown(text: str) -> dict:
    text = text.removeprefix("\ufeff")
    heads = headings(text)
    links = [{"text": m.group(1), "target": m.group(2), "line": n} for n, line in enumerate(text.split("\n"), 1) for m in re.finditer(r"\[([^\[\]]*)\]\(([^)\s]+)\)", line)]
    inner = sorted({x["target"] for x in links if x["target"].endswith(".md") and not re.match(r"https?:", x["target"], re.I)})
    signals = ["docs:decisions"] if any(re.search("decision|architecture|adr", h["title"].lower()) for h in heads) else []
    return {"status": "ok", "signals": signals, "metadata": {"headings": heads, "title": heads[0]["title"] if heads else "", "links": links, "document_links": inner, "front_matter": front_matter(text)[0], "first_paragraph": first_paragraph(text), "line_count": text.count("\n") + 1}}


def _strings(value) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def flat_exports(value) -> list[str]:
    """All paths in a nested ``exports`` value, keys in order, each once."""
    if isinstance(value, str):
        return [value]
    children = value if isinstance(value, list) else [value[k] for k in sorted(value)] if isinstance(value, dict) else []
    return list(dict.fromkeys(p for c in children for p in flat_exports(c)))


def package_facts(raw: dict) -> dict:
    entries = []
    for field in ENTRY_FIELDS:
        value = raw.get(field)
        if field == "exports":
            entries += [(field, v) for v in flat_exports(value)]
        elif field == "bin" and isinstance(value, dict):
            entries += [(field, value[k]) for k in sorted(value) if isinstance(value[k], str)]
        elif isinstance(value, str):
            entries.append((field, value))
    spaces = raw.get("workspaces")
    names = lambda k: sorted(raw[k]) if isinstance(raw.get(k), dict) else []
    text = lambda k: raw[k] if isinstance(raw.get(k), str) else None
    return {
        "name": text("name"), "version": text("version"), "private": raw.get("private") is True, "type": raw.get("type") if raw.get("type") in ("module", "commonjs") else None, "package_manager": text("packageManager"),
        "scripts": {k: v for k, v in raw["scripts"].items() if isinstance(v, str)} if isinstance(raw.get("scripts"), dict) else {},
        "dependencies": names("dependencies"), "dev_dependencies": names("devDependencies"), "peer_dependencies": names("peerDependencies"),
        "workspaces": sorted(_strings(spaces.get("packages") if isinstance(spaces, dict) else spaces)), "entries": [{"field": f, "value": v} for f, v in sorted(entries)],
    }


def relax(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON."""
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m.group(1) or " ", text)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m.group(1) or m.group(2), kept)


def compiler_facts(raw: dict) -> dict:
    ext, options = raw.get("extends"), raw.get("compilerOptions")
    options = options if isinstance(options, dict) else {}
    paths = options.get("paths") if isinstance(options.get("paths"), dict) else {}
    return {
        "extends": [ext] if isinstance(ext, str) else _strings(ext), "base_url": options["baseUrl"] if isinstance(options.get("baseUrl"), str) else None,
        "paths": {k: _strings(paths[k]) for k in sorted(paths) if isinstance(paths[k], list)}, "strict": options.get("strict") is True, "composite": options.get("composite") is True, "declaration": options.get("declaration") is True,
        **{k: options[j] if isinstance(options.get(j), str) else None for k, j in (("module", "module"), ("module_resolution", "moduleResolution"), ("target", "target"), ("jsx", "jsx"))},
    }


def _object(text: str, relaxed: bool, read) -> dict:
    try:
        raw = json.loads(relax(text.removeprefix("\ufeff")) if relaxed else text.removeprefix("\ufeff"))
        if not isinstance(raw, dict):
            raise ValueError("not an object")
    except (ValueError, RecursionError) as e:
        return {"status": "failed", "signals": [], "metadata": {"error": str(e)[:200]}}
    return {"status": "ok", "signals": [], "metadata": read(raw)}


def read_package(text: str) -> dict:
    return _object(text, False, package_facts)


def read_compiler(text: str) -> dict:
    return _object(text, True, compiler_facts)


def read_json(text: str) -> dict:
    """Validity, the kind of the outermost value and its keys in order."""
    try:
        raw = json.loads(text.removeprefix("\ufeff"))
    except (ValueError, RecursionError) as e:
        return {"status": "failed", "signals": [], "metadata": {"error": str(e)[:200]}}
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(raw), "number")
    return {"status": "ok", "signals": [], "metadata": {"keys": sorted(raw) if isinstance(raw, dict) else [], "root": kind}}


def workspace_globs(text: str) -> list[str]:
    """The items under ``packages:`` of a workspace list in YAML."""
    out, inside = [], False
    for line in text.replace("\r", "").split("\n"):
        if re.match(r"[A-Za-z]", line):
            inside = bool(re.match(r"packages\s*:", line.strip()))
        elif inside and (m := re.match(r"\s*-\s*['\"]?([^'\"#]+)['\"]?\s*(?:#.*)?$", line)) and m.group(1).strip():
            out.append(m.group(1).strip())
    return out


def read_workspace(text: str) -> dict:
    return {"status": "ok", "signals": [], "metadata": {"packages": workspace_globs(text)}}
