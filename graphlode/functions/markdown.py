"""Lists as Markdown."""

from __future__ import annotations


def section(title: str, lines: list[str], total: int | None = None) -> list[str]:
    """A heading and a list with what is left out, nothing for no lines; a line's own breaks become blanks."""
    if not lines:
        return []
    left = (total or 0) - len(lines)
    return [f"## {title}", "", *(f"- {' '.join(x.split())}" for x in lines), *([f"- and {left} more"] if left > 0 else []), ""]
