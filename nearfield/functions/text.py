"""String functions as Column expressions, with the white space and hashing rules of ECMAScript."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: ECMAScript white space and line ends, as a character class. Java's \s covers ASCII only, its (?U) form adds U+0085.
SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WINDOW, OVERLAP = 200, 56


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_whitespace(text: Column) -> Column:
    """Each run of white space becomes one space; none is left at the ends."""
    return F.btrim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def has_semantic_content(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def title_weight(text: Column, title: Column, weight: int) -> Column:
    """The title, weight times, before the text; both must be normalised. A blank title or no weight leaves the text."""
    if weight <= 0:
        return text
    return F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(F.btrim(F.concat(F.repeat(F.concat(title, F.lit(" ")), weight), text)))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters, and one more for each beyond the basic plane."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters; a limit of 0 or less keeps everything."""
    return text if most <= 0 else F.substring(text, 1, most)


def is_truncated(text: Column, most: int) -> Column:
    return F.lit(False) if most <= 0 else F.length(text) > most


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: as a lambda's argument, which the optimizer doesn't put back in place of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column computed once for each row: filters and later steps read a generator's output and can't pull the expression up."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def chunks(text: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Trimmed windows of the trimmed text, each window - overlap after the last, until one reaches the end. Empty ones are left out; null has none."""
    if window <= 0 or overlap < 0 or overlap >= window:
        raise ValueError("a window must be positive and longer than the overlap")
    step = window - overlap

    def cut(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(t) - window) / step) * step).cast("int")
        return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: js_trim(F.substr(t, s + 1, F.lit(window))))

    return F.filter(let(js_trim(F.coalesce(text, F.lit(""))), cut), lambda c: c != "")


def with_chunks(df: DataFrame, text: str, out: str, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    return computed(df, out, chunks(F.col(text), window, overlap))


def hash_units(units: list[np.ndarray]) -> np.ndarray:
    """FNV-1a with 32 bits over arrays of UTF-16 units, all arrays stepping together."""
    order = np.argsort([-len(u) for u in units], kind="stable")
    lengths = np.array([len(units[k]) for k in order], np.int64)
    flat = np.concatenate([units[k] for k in order]).astype(np.uint32) if len(units) else np.zeros(0, np.uint32)
    starts = np.cumsum(lengths) - lengths
    state = np.full(len(units), 2166136261, np.uint32)
    live = len(units)
    for step in range(int(lengths[0]) if len(lengths) else 0):
        while lengths[live - 1] <= step:
            live -= 1
        state[:live] = (state[:live] ^ flat[starts[:live] + step]) * np.uint32(16777619)
    out = np.empty_like(state)
    out[order] = state
    return out


@F.pandas_udf(StringType())
def content_hash(text: pd.Series) -> pd.Series:
    """8 hexadecimal digits of hash_units() of each text; null for null. Arrow batches, a vector step for each character position."""
    known = text.dropna()
    with np.errstate(over="ignore"):
        states = hash_units([np.frombuffer(t.encode("utf-16-le", "surrogatepass"), "<u2") for t in known])
    digits = dict(zip(known.index, states.tolist(), strict=True))
    return pd.Series([f"{digits[i]:08x}" if i in digits else None for i in text.index], dtype=object)


def strip_md(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md$", "")


def is_markdown(path: Column) -> Column:
    return F.lower(path).endswith(".md")


def basename(path: Column) -> Column:
    return F.element_at(F.split(strip_md(path), "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normalize_path(path: Column) -> Column:
    """Slashes forward, none at the ends, then no white space at the ends; in that order."""
    return js_trim(F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", ""))


def parse_ignored_paths(text: Column) -> Column:
    """A rule for each line, normalised, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), normalize_path), lambda r: r != ""))


def table_to_text(markdown: Column) -> Column:
    """Lines with a pipe, taken as one table, become "header: cell, ..." sentences.

    Needs two such lines, the second with a dash; replaced only where they stand together. Empty cells are
    dropped, so later ones move up. The sentences are put in as they are: "$" has no meaning.
    """
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), js_trim), lambda c: c != "")
    lines = F.filter(F.split(markdown, "\n"), lambda x: x.contains("|"))
    headers = cells(F.element_at(lines, 1))
    value = lambda row, i: F.coalesce(F.get(row, i), F.lit(""))
    said = F.array_join(
        F.transform(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), lambda line: F.array_join(F.transform(headers, lambda h, i: F.concat(h, F.lit(": "), value(cells(line), i))), ", ")),
        ". ",
    )
    joined = F.array_join(lines, "\n")
    at = F.instr(markdown, joined)
    swapped = F.concat(F.substr(markdown, F.lit(1), at - 1), said, F.substr(markdown, at + F.length(joined)))
    is_table = (F.size(lines) >= 2) & F.get(lines, F.lit(1)).contains("-") & (at > 0)
    return F.when(is_table, swapped).otherwise(markdown)


#: Markdown that markdown_to_text() takes off, as (pattern, replacement) pairs that Java and RE2 read alike.
MARKDOWN = [
    (r"^\s*---[ \t]*\n(?:[^\n]*\n)*?[ \t]*---[ \t]*(?:\n|$)", ""),
    (r"!\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"\[\[([^\]|\n]*)(?:\|[^\]\n]*)?\]\]", "$1"),
    (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"(?m)^[ \t]*(?:#{1,6}|>|[-*+]|[0-9]+[.])[ \t]+", ""),
    (r"(?:\*\*|__|~~|`)", ""),
    (r"<[^>\n]*>", ""),
]
HTML = [
    (r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?s)<[^>]*>", " "),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
]


def markdown_to_text(markdown: Column) -> Column:
    """Plain text of Markdown, an approximation of a renderer's: tables, front matter, links (their target), emphasis, headings, quotes, list marks, tags."""
    text = table_to_text(markdown)
    for pattern, replacement in MARKDOWN:
        text = F.regexp_replace(text, pattern, replacement)
    return js_trim(text)


def html_to_text(html: Column) -> Column:
    text = html
    for pattern, replacement in HTML:
        text = F.regexp_replace(text, pattern, replacement)
    return normalize_whitespace(text)
