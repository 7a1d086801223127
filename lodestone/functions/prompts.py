"""Prompt files and messages."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(c: Column) -> Column:
    """Text from outside, safe inside tags."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def untrusted(name: str, c: Column) -> Column:
    return F.concat(F.lit(f'<untrusted name="{name}">\n'), escape(c), F.lit("\n</untrusted>"))


def render(template: str, values: dict[str, Column]) -> Column:
    """{{name}} by columns; a name without a column is refused."""
    if missing := set(re.findall(r"\{\{\s*(\w+)\s*\}\}", template)) - set(values):
        raise ValueError(f"no values for {sorted(missing)}")
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    return reduce(lambda a, b: F.concat(a, b), [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def parse(text: str) -> dict[str, str]:
    """Front matter of `key: value` lines between --- lines, then sections under `## name`; version is a hash of the whole."""
    m = re.match(r"---\n(.*?)\n---\n(.*)", text, re.S)
    if not m:
        raise ValueError("no front matter")
    out = dict(line.split(":", 1) for line in m[1].splitlines() if ":" in line)
    out = {k.strip(): v.strip() for k, v in out.items()}
    parts = re.split(r"^## +(.+)$", m[2], flags=re.M)
    out |= {name.strip(): body.strip() for name, body in zip(parts[1::2], parts[2::2], strict=True)}
    return out | {"version": hashlib.sha256(text.encode()).hexdigest()[:8]}


def extractor_version(prompt_id: Column, content: Column, model: Column) -> Column:
    return F.concat(prompt_id, F.lit("@"), F.substring(F.sha2(content, 256), 1, 8), F.lit("-"), model)
