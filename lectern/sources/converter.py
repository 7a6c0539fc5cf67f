"""Documents through an external converter's syntax tree (JSON), for formats that have no classifier here.

The converter is optional: :func:`convert` runs it where it is installed; the walk over its tree needs nothing else.
A text that cannot be converted is null, not prose.
"""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lectern.operators.parsers import PROSE, STRUCTURE, Region

#: Inlines that stand for fixed text.
_PLAIN = {"Space": " ", "SoftBreak": " ", "LineBreak": "\n"}
#: Inlines that wrap others; position of the others in their content.
_WRAPS = {"Emph": None, "Strong": None, "Underline": None, "Strikeout": None, "Superscript": None, "Subscript": None, "SmallCaps": None, "Quoted": 1, "Cite": 1, "Link": 1, "Image": 1, "Span": 1}


def inline_text(inlines: list[dict]) -> str:
    """Text of inline elements; notes are dropped."""
    out = []
    for x in inlines:
        kind, c = x.get("t"), x.get("c")
        if kind == "Str":
            out.append(c)
        elif kind in _PLAIN:
            out.append(_PLAIN[kind])
        elif kind == "Code":
            out.append(f"`{c[1]}`")
        elif kind == "Math":
            out.append(f"${c[1]}$")
        elif kind == "RawInline":
            out.append(c[1])
        elif kind in _WRAPS:
            out.append(inline_text(c if _WRAPS[kind] is None else c[_WRAPS[kind]]))
    return "".join(out)


def block_regions(blocks: list[dict]) -> list[Region]:
    """Regions of block elements, containers opened up. Headings and terms are lines of structure, tables a stand-in."""
    out: list[Region] = []

    def line(text: str) -> None:
        if text:
            out.append((STRUCTURE, text + "\n"))

    for b in blocks:
        kind, c = b.get("t"), b.get("c")
        if kind in ("Para", "Plain"):
            if text := inline_text(c).strip():
                out.append((PROSE, text))
        elif kind == "Header":
            line(inline_text(c[2]).strip())
        elif kind in ("CodeBlock", "RawBlock"):
            out.append((STRUCTURE, c[1]))
        elif kind in ("BulletList", "OrderedList"):
            for item in c if kind == "BulletList" else c[1]:
                out += block_regions(item)
        elif kind == "DefinitionList":
            for term, definitions in c:
                line(inline_text(term).strip())
                for d in definitions:
                    out += block_regions(d)
        elif kind == "LineBlock":
            out += [(STRUCTURE, inline_text(x) + "\n") for x in c]
        elif kind in ("BlockQuote", "Div", "Figure"):
            out += block_regions(c if kind == "BlockQuote" else c[-1])
        elif kind in ("HorizontalRule", "Table"):
            line("---" if kind == "HorizontalRule" else "[table]")
    return out


def tree_regions(tree: str) -> list[Region]:
    return block_regions(json.loads(tree)["blocks"])


def is_installed(command: str = "pandoc") -> bool:
    return shutil.which(command) is not None


def convert(df: DataFrame, text: str, reader: str, command: str = "pandoc") -> DataFrame:
    """``df`` with a column ``tree``: the text's syntax tree by the converter's reader named in column ``reader``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            trees = []
            for body, kind in zip(batch[text], batch[reader]):
                done = None
                if body is not None and kind:
                    got = subprocess.run([command, "-f", kind, "-t", "json"], input=body.encode(), capture_output=True)
                    done = got.stdout.decode() if got.returncode == 0 else None
                trees.append(done)
            yield batch.assign(tree=trees)

    from pyspark.sql.types import StringType, StructField, StructType

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("tree", StringType())]))


def with_converted_regions(df: DataFrame, tree: str = "tree", out: str = "regions") -> DataFrame:
    """``df`` with the regions of each syntax tree (null for null), for :func:`lectern.operators.formatting.reflowed`."""
    from pyspark.sql import functions as F

    kind = "array<struct<kind:string,text:string>>"

    @F.pandas_udf(kind)
    def read(trees: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"kind": k, "text": x} for k, x in tree_regions(t)] for t in trees], dtype=object)

    return df.withColumn(out, read(F.col(tree)))


def format_converted_df(df: DataFrame, tree: str = "tree", out: str = "formatted", lang: str | None = None) -> DataFrame:
    """``df`` with the text of each syntax tree, one sentence to a line; null where a text could not be converted."""
    from lectern.functions import text as tx
    from lectern.operators.formatting import reflowed, with_sentences
    from pyspark.sql import functions as F

    read = with_sentences(with_converted_regions(df, tree, "__regions_"), "__regions_", lang, None, "__sentences_")
    return tx.computed(read, out, reflowed(F.col("__regions_"), F.col("__sentences_"))).drop("__regions_", "__sentences_")
