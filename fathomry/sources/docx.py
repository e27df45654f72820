"""The text of DOCX files: a zip of XML, read with what Python has."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathomry.functions.ship import ship

# The namespace of word processing documents, the part that holds the body, and elements that stand for a character.
SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY = "word/document.xml"
MARKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


def text_of(content: bytes | None) -> str | None:
    """The paragraphs of the body in their order, one a line, those of tables included; null for what is no such file.

    Deleted text of tracked changes and field codes are not text. The XML is read as a stream, and a paragraph is let go once it is read.
    """
    if content is None:
        return None
    lines: list[str] = []
    open_: list[list[str]] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(BODY) as part:
            for event, element in ElementTree.iterparse(part, ("start", "end")):
                tag = element.tag.removeprefix(SPACE)
                if event == "start":
                    if tag == "p":
                        open_.append([])
                elif tag == "p":
                    # a paragraph within another (a text box) is a line of its own, before the one that holds it
                    lines.append("".join(open_.pop()))
                    element.clear()
                elif open_ and tag == "t":
                    open_[-1].append(element.text or "")
                elif open_ and tag in MARKS:
                    open_[-1].append(MARKS[tag])
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, RuntimeError, EOFError, ValueError):
        return None
    return "\n".join(lines)


def with_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Replaces the column of contents by ``text``, in batches of rows; rows that hold no DOCX file have null."""
    ship(files.sparkSession)
    rest = [f for f in files.schema.fields if f.name not in (content, "text")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[f.name for f in rest]].assign(text=[text_of(c) for c in b[content]])

    return files.mapInPandas(run, T.StructType([*rest, T.StructField("text", T.StringType())]))
