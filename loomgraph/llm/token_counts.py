"""Token counts of the parts of a document by offset-mapped attribution.

A document's parts (fields, or the lines of one field) are joined and encoded once, so tokens may cross the borders between
parts. A byte-level vocabulary splits the text's bytes, so a token's byte span follows from the lengths of the tokens before it,
and its character span from the bytes that begin a character: it covers each character of which it has a byte. The spans of
tokens and parts, both sorted, meet in an interval join (a binary search for each border). Rules for a token that crosses borders:

* ``start``: it counts for the part that holds its first character;
* ``most``: for the part that holds most of its characters, the first of equals;
* ``share``: for each part by its share of the token's characters (fractions).

The newline, or the joint between two fields, belongs to the part before it. For all rules the parts' tokens sum to the
document's.

Results for odd inputs: a null or empty text has one empty part with no tokens; an empty part has none; repeated rows keep rows
of their own; null ids are kept; an empty table gives no rows. Whole texts are encoded, of any length, and so are runs of any character. Only the id and text
columns are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import emptied, filled

RULES = ("start", "most", "share")
_loaded: dict[tuple[str, str], tuple] = {}
# white space as the pattern's \\s has it; runs of LONG or more are encoded apart, as the pattern's engine recurses once a character
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 10_000
LONG_RUN = re.compile(f"[{SPACES}]{{{LONG},}}")


def vocabulary(path: str, pattern: str):
    """The encoding and the byte length of each token, once for each Python worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, "int64")
        for token, k in ranks.items():
            lengths[k] = len(token)
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path, pattern]


def token_ids(text: str, encoding) -> list[int]:
    """The ids of a text. In a long run of white space, all but its last character are one piece of the pattern (at the text's end: all of it), so it is encoded as one."""
    out, at = [], 0
    for m in LONG_RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : end])
        at = end
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and the character after the last, of each token."""
    encoding, lengths = vocabulary(path, pattern)
    if not text:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    text = text.encode("utf-8", "replace").decode()
    ends = np.cumsum(lengths[np.array(token_ids(text, encoding), "int64")])
    raw = np.frombuffer(text.encode(), "u1")
    if ends[-1] != len(raw):
        raise ValueError("the vocabulary doesn't keep the bytes of a text")
    starts = np.concatenate([[0], ends[:-1]]).astype("int64")
    if len(raw) == len(text):
        return starts, ends
    begun = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with this byte
    return begun[starts] - 1, begun[ends - 1]


def attribute(first: np.ndarray, after: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each part; ends: the character after the last of each part."""
    counts = np.zeros(len(ends))
    low = np.searchsorted(ends, first, side="right")
    if rule == "start":
        return np.bincount(low, minlength=len(ends)).astype("float64")
    high = np.searchsorted(ends, after - 1, side="right")
    inside = low == high
    counts += np.bincount(low[inside], minlength=len(ends))
    for k in np.flatnonzero(~inside).tolist():
        parts = np.arange(low[k], high[k] + 1)
        borders = np.concatenate([[first[k]], ends[low[k] : high[k]], [after[k]]])
        chars = np.diff(borders)
        if rule == "share":
            counts[parts] += chars / chars.sum()
        else:
            counts[parts[np.argmax(chars)]] += 1
    return counts


def counts(texts: DataFrame, path: str, pattern: str, rule: str = "start", id_col: str = "doc_id", text_cols: tuple[str, ...] = ("text",), joint: str = "\n") -> DataFrame:
    """doc_id, part (from 0), field, n_chars, n_tokens of every line of one column, or of every one of several columns."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    whole = len(text_cols) > 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, parts, fields, chars, tokens = [], [], [], [], []
            held = 0
            for doc, *values in zip(batch["id"].tolist(), *(batch[f"t{k}"].tolist() for k in range(len(text_cols)))):
                values = ["" if v is None else v for v in values]
                text = joint.join(values) if whole else values[0]
                pieces = values if whole else text.split(joint)
                sizes = np.array([len(p) for p in pieces], "int64")
                ends = np.cumsum(sizes + len(joint))
                ends[-1] -= len(joint)
                got = attribute(*token_spans(text, path, pattern), ends, rule)
                ids.append(np.full(len(pieces), doc, "int64"))
                parts.append(np.arange(len(pieces), dtype="int32"))
                fields += text_cols if whole else text_cols * len(pieces)
                chars.append(sizes)
                tokens.append(got)
                held += len(pieces)
                if held > 50_000:
                    yield pd.DataFrame({"doc_id": np.concatenate(ids), "part": np.concatenate(parts), "field": fields, "n_chars": np.concatenate(chars), "n_tokens": np.concatenate(tokens)})
                    ids, parts, fields, chars, tokens, held = [], [], [], [], [], 0
            if ids:
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "part": np.concatenate(parts), "field": fields, "n_chars": np.concatenate(chars), "n_tokens": np.concatenate(tokens)})

    rows = texts.select(filled(F.col(id_col)).alias("id"), *[F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(text_cols)])
    out = rows.mapInPandas(run, "doc_id long, part int, field string, n_chars long, n_tokens double")
    out = out.withColumn("doc_id", emptied(F.col("doc_id")))
    return out if rule == "share" else out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
