"""Checks of notebook files on the driver: cell ids, structure, syntax, required patterns."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Sequence
from pathlib import Path


def plain_python(source: str) -> str:
    """Shell and magic lines become ``pass`` at their own indentation."""
    out = []
    for line in source.splitlines():
        bare = line.lstrip()
        out.append(line[: len(line) - len(bare)] + "pass" if bare[:1] in ("!", "%") else line)
    return "\n".join(out)


def cells(path: str | Path) -> list[dict]:
    return json.loads(Path(path).read_text(encoding="utf-8")).get("cells", [])


def code(path: str | Path) -> str:
    """All code cells, parted by blank lines."""
    return "\n\n".join("".join(c.get("source", [])) for c in cells(path) if c.get("cell_type") == "code")


#: Fixed values of the notebook format: cell and output types, and the fields that an output must have.
CELL_TYPES = ("code", "markdown", "raw")
OUTPUTS = {"stream": ("name", "text"), "display_data": ("data", "metadata"), "execute_result": ("data", "metadata", "execution_count"), "error": ("ename", "evalue", "traceback")}
_ID = re.compile(r"[a-zA-Z0-9_-]{1,64}")


def _text(value: object) -> bool:
    return isinstance(value, str) or isinstance(value, list) and all(isinstance(x, str) for x in value)


def schema_problems(notebook: object) -> list[str]:
    """Where a notebook departs from version 4 of the format."""
    if not isinstance(notebook, dict):
        return ["not an object"]
    out = []
    if notebook.get("nbformat") != 4 or not isinstance(notebook.get("nbformat_minor"), int):
        out.append(f"version {notebook.get('nbformat')}.{notebook.get('nbformat_minor')}")
    if not isinstance(notebook.get("metadata"), dict):
        out.append("no metadata")
    if not isinstance(notebook.get("cells"), list):
        return [*out, "no cells"]
    seen: set[str] = set()
    for i, cell in enumerate(notebook["cells"]):
        if not isinstance(cell, dict):
            out.append(f"cell {i}: not an object")
            continue
        kind, name = cell.get("cell_type"), cell.get("id")
        if kind not in CELL_TYPES:
            out.append(f"cell {i}: type {kind!r}")
        if not isinstance(name, str) or not _ID.fullmatch(name):
            out.append(f"cell {i}: id {name!r}")
        elif name in seen:
            out.append(f"cell {i}: id {name!r} again")
        else:
            seen.add(name)
        if not _text(cell.get("source")):
            out.append(f"cell {i}: source")
        if not isinstance(cell.get("metadata"), dict):
            out.append(f"cell {i}: metadata")
        if kind == "code":
            if not isinstance(cell.get("execution_count", ""), int | None):
                out.append(f"cell {i}: execution_count")
            outputs = cell.get("outputs")
            if not isinstance(outputs, list):
                out.append(f"cell {i}: outputs")
            for k, one in enumerate(outputs if isinstance(outputs, list) else ()):
                wanted = OUTPUTS.get(one.get("output_type")) if isinstance(one, dict) else None
                if wanted is None or any(field not in one for field in wanted):
                    out.append(f"cell {i}: output {k}")
        elif "outputs" in cell or "execution_count" in cell:
            out.append(f"cell {i}: outputs of a {kind} cell")
    return out


def problems(path: str | Path) -> list[str]:
    """What is wrong with a notebook, in the order of cell ids, format, syntax; nothing if fine."""
    whole = json.loads(Path(path).read_text(encoding="utf-8"))
    found = whole.get("cells", []) if isinstance(whole, dict) else []
    missing = [i for i, c in enumerate(found) if not c.get("id")]
    if missing:
        return [f"cells without id: {missing}"]
    if odd := schema_problems(whole):
        return odd
    out = []
    for i, c in enumerate(found):
        if c["cell_type"] == "code":
            try:
                ast.parse(plain_python("".join(c["source"])))
            except SyntaxError as e:
                out.append(f"cell {i}: {e.msg} (line {e.lineno})")
    return out


def audit(path: str | Path, required: Sequence[Sequence[str]], forbidden: Sequence[str]) -> tuple[list[Sequence[str]], list[str]]:
    """Required groups of which the code has no pattern, and forbidden patterns that it has."""
    text = code(path)
    return [g for g in required if not any(p in text for p in g)], [p for p in forbidden if p in text]
