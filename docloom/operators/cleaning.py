"""Cleaning that needs state along a text: table repair and custom rules."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx
from docloom.operators.kernels import kernel


def mend_tables(text: str | None) -> str | None:
    """Fold a table row with fewer columns than the row above into that row's last cell.

    Several short rows fold into the same row. No cell is lost: the text is added to the last cell.
    """
    if text is None:
        return None
    out: list[str] = []
    width = 0
    for line in text.splitlines():
        bare = line.strip()
        row = len(bare) > 1 and bare[0] == bare[-1] == "|"
        columns = bare.count("|") - 1 if row else 0
        if row and width and 0 < columns < width:
            above = out[-1].rstrip()[:-1].rstrip()
            added = bare.strip("|").strip()
            out[-1] = f"{above} {added} |" if added else f"{above} |"
            continue
        out.append(line)
        width = columns
    return "\n".join(out)


mend_tables_column = kernel(mend_tables, T.StringType())


def load_rules(path: str | Path) -> list[dict]:
    """Rules {pattern, replace, flags} of a YAML file; none if there is no such file."""
    import yaml

    if not Path(path).is_file():
        return []
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return [r for r in raw.get("rules", []) if isinstance(r, dict) and r.get("pattern")]


_FLAGS = {"MULTILINE": "m", "M": "m", "IGNORECASE": "i", "I": "i", "DOTALL": "s", "S": "s", "VERBOSE": "x", "X": "x"}


def _letters(flags) -> str:
    if isinstance(flags, int):
        return "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if flags & f)
    names = flags if isinstance(flags, list) else [flags] if flags else []
    return "".join(sorted({_FLAGS[str(n).upper()] for n in names if str(n).upper() in _FLAGS}))


def apply_rules(text: Column, rules: list[dict]) -> Column:
    """Each rule's replacement in turn; rules whose pattern is not a regular expression are skipped."""

    def one(column: Column, rule: dict) -> Column:
        try:
            re.compile(rule["pattern"])
        except re.error:
            return column
        letters = _letters(rule.get("flags"))
        pattern = (f"(?{letters})" if letters else "") + re.sub(r"\(\?P<", "(?<", rule["pattern"])
        literal = str(rule.get("replace", "")).replace("$", r"\$")
        return F.regexp_replace(column, pattern, re.sub(r"\\g<(\w+)>|\\(\d)", lambda m: "${" + m[1] + "}" if m[1] and not m[1].isdigit() else "$" + (m[1] or m[2]), literal))

    return reduce(one, rules, text)


def clean_text(text: Column, rules: list[dict] | None = None, tables: bool = True) -> Column:
    """All steps: control characters, page breaks, tables, rules, white space, ends."""
    return tx.clean(text, repair=mend_tables_column if tables else None, rules=(lambda c: apply_rules(c, rules)) if rules else None)
