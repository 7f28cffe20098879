"""Text and Markdown reports of small result frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST = 1000


def rows_of(df: DataFrame, most: int = MOST) -> list[dict]:
    """Rows of a report; a report has a bounded number of them."""
    return [r.asDict() for r in df.limit(most).collect()]


def markdown(title: str, df: DataFrame, most: int = MOST) -> str:
    names = df.columns
    body = [" | ".join(f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n]) for n in names) for r in rows_of(df, most)]
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *(f"| {b} |" for b in body), ""])


def plain(title: str, df: DataFrame, width: int = 20, most: int = MOST) -> str:
    names = df.columns
    lines = ["".join(str(r[n])[:width].ljust(width) for n in names).rstrip() for r in rows_of(df, most)]
    return "\n".join([title, "=" * len(title), "".join(n.ljust(width) for n in names).rstrip(), *lines, ""])


def sections(title: str, frames: dict[str, DataFrame], most: int = MOST) -> str:
    """One Markdown report of several frames, a section each."""
    return "\n".join([f"# {title}", "", *(markdown(name, df, most).replace("# ", "## ", 1) for name, df in frames.items())])


def tee(text: str, path: str | None = None) -> str:
    """A report on the terminal, and in a file of the driver if one is named."""
    print(text)
    if path:
        with open(path, "a", encoding="utf-8") as f:
            f.write(text + "\n")
    return text
