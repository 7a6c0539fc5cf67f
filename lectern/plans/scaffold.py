"""Starter files for a project, made from the formats that occur in it; nothing is written that exists."""

from __future__ import annotations

from pathlib import Path

from lectern.functions.text import EXTENSIONS

FILTER = "lectern"


def rc_file(formats: list[str]) -> str:
    lines = ["# Words whose period ends no sentence", "extra_abbreviations = []", "# Globs of files to leave alone", "ignore = []", "# 0 is no limit", "max_width = 0"]
    if len(formats) == 1:
        lines.append(f'format = "{formats[0]}"')
    for f in formats:
        lines += ["", f"[{f}]", "extra_abbreviations = []"]
    return "\n".join(lines) + "\n"


def attributes(formats: list[str]) -> str:
    return "".join(f"*.{ext} filter={FILTER}\n" for f in formats for ext in EXTENSIONS.get(f, ()))


def hook(formats: list[str]) -> str:
    ends = "|".join(ext for f in formats for ext in EXTENSIONS.get(f, ()))
    return f"repos:\n  - repo: local\n    hooks:\n      - id: {FILTER}\n        name: {FILTER}\n        entry: {FILTER} --in-place\n        language: system\n        files: \\.({ends})$\n"


#: Editors' major modes of each format; fixed values.
MODES = {"org": "org-mode", "latex": "latex-mode", "markdown": "markdown-mode", "rst": "rst-mode", "plaintext": "text-mode"}


def editor_snippet(formats: list[str]) -> str:
    """A snippet for Emacs that formats buffers of these formats with Apheleia when they are saved."""
    lines = ["(with-eval-after-load 'apheleia", f"  (push '({FILTER} . (\"{FILTER}\" \"--stdin-filepath\" filepath)) apheleia-formatters)"]
    lines += [f"  (push '({MODES[f]} . {FILTER}) apheleia-mode-alist)" for f in formats if f in MODES]
    return "\n".join(lines) + ")\n"


def scaffold(folder: str | Path, formats: list[str], rc_name: str, dry_run: bool = False) -> dict[str, str]:
    """What is written (or would be): name to content, without files that are there already."""
    wanted = {rc_name: rc_file(formats), ".gitattributes": attributes(formats), ".pre-commit-config.yaml": hook(formats)}
    new = {n: c for n, c in wanted.items() if not (Path(folder) / n).exists()}
    if not dry_run:
        for n, c in new.items():
            (Path(folder) / n).write_text(c, encoding="utf-8")
    return new
