"""License scans: fuzzy search for short notices.

A notice of m characters with at most k edits is split into k+1 pieces; by the pigeonhole principle one piece
stands unedited in every match. A match starts and ends on word borders. Pieces are found by exact search, each occurrence gives a window around where
the notice would stand, and the regex library's bounded-error matching confirms the edits in the window and
reports the span. A match with no edits on word borders is a base hit.

Texts are normalised to lower-case words (ASCII letters, digits, non-ASCII) joined by one space. Null and empty
texts have no words, no labels and score 0. Work is per text, so repeated rows are judged alike; very long texts are
scanned whole, in time that grows with their length and hits. Of matches of one notice that overlap, the one with the
fewest edits is reported, then the first. Other columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import ALNUM

#: Notice, label, most edits. Notices with exact=True also give base hits.
NOTICES = (
    ("gnu general public license", "gpl", 3, True),
    ("apache license", "apache", 2, True),
    ("cc by", "cc-by", 0, True),
    ("mit license", "mit", 1, True),
    ("bsd license", "bsd", 1, False),
    ("mozilla public license", "mpl", 2, False),
    ("creative commons attribution", "cc-by", 3, False),
    ("permission is hereby granted free of charge", "mit", 4, False),
    ("redistribution and use in source and binary forms", "bsd", 4, False),
)
SCAN_TYPE = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
    "score double, spans array<struct<label:string, start_word:long, end_word:long, edits:int>>"
)


class Notice(NamedTuple):
    phrase: bytes
    label: str
    edits: int
    exact: bool
    pieces: tuple[tuple[int, bytes], ...]
    pattern: object


def prepared(notices=NOTICES) -> list[Notice]:
    """Each notice with the pieces that seed its search and the pattern that verifies it."""
    out = []
    for text, label, edits, exact in notices:
        phrase = text.encode()
        cut = [round(i * len(phrase) / (edits + 1)) for i in range(edits + 2)]
        pieces = tuple((a, phrase[a:b]) for a, b in zip(cut, cut[1:], strict=False))
        pattern = regex.compile(rb"(?b)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(phrase, special_only=True), edits))
        out.append(Notice(phrase, label, edits, exact, pieces, pattern))
    return out


def occurrences(data: bytes, piece: bytes) -> list[int]:
    found, at = [], data.find(piece)
    while at >= 0:
        found.append(at)
        at = data.find(piece, at + 1)
    return found


def candidate_windows(data: bytes, notice: Notice, known: set[int]) -> list[tuple[int, int]]:
    """Ranges of data, each little longer than the notice, that can hold it, from the exact places of its pieces.

    Places where the notice is known to stand unedited are left out.
    """
    reach = len(notice.phrase) + notice.edits
    starts = {at - offset for offset, piece in notice.pieces for at in occurrences(data, piece)} - known
    return [(max(0, at - notice.edits - 1), min(len(data), at + reach + 1)) for at in sorted(starts)]


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of matches (start, end, edits) that overlap one another in a row, the first with the fewest edits."""
    kept: list[tuple[int, int, int]] = []
    upto = -1
    for match in sorted(found):
        if kept and match[0] < upto:
            kept[-1] = min(kept[-1], match, key=lambda m: (m[2], m[0], m[1]))
        else:
            kept.append(match)
        upto = max(upto, match[1])
    return kept


def scan_text(text: str | None, notices: list[Notice]) -> tuple:
    data = text.encode("utf-8", "surrogatepass").translate(ALNUM) if isinstance(text, str) else b""
    words = data.split()
    line = b" " + b" ".join(words) + b" "
    gaps: list[int] = []

    def word_at(place: int) -> int:
        """The number of the word that begins at a place, or after it."""
        if not gaps:
            gaps.extend(np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20).tolist())
        return bisect_left(gaps, place) - 1

    base: list[int] = []
    base_labels: set[str] = set()
    spans: list[tuple[str, int, int, int]] = []
    best = 0.0
    for notice in notices:
        exact_at: set[int] = set()
        if notice.exact:
            for at in occurrences(line, b" " + notice.phrase + b" "):
                word = word_at(at + 1)
                exact_at.add(at + 1)
                base.append(word)
                base_labels.add(notice.label)
                spans.append((notice.label, word, word + notice.phrase.count(b" ") + 1, 0))
        if exact_at:
            best = 1.0
        if not notice.edits and notice.exact:
            continue
        found = {
            (m.start(), m.end(), sum(m.fuzzy_counts))
            for start, end in candidate_windows(line, notice, exact_at)
            for m in notice.pattern.finditer(line, start, end)
            if m.start() not in exact_at
        }
        for start, end, edits in apart(list(found)):
            spans.append((notice.label, max(0, word_at(start)), min(word_at(max(start, end - 1)) + 1, len(words)), edits))
            best = max(best, 1.0 - edits / len(notice.phrase))
    spans.sort(key=lambda s: (s[1], s[2], s[0], s[3]))
    return (
        len(words),
        len(base),
        min(base, default=None),
        max(base, default=None),
        sorted(base_labels),
        sorted({s[0] for s in spans}),
        best,
        [dict(zip(("label", "start_word", "end_word", "edits"), s, strict=True)) for s in spans],
    )


def license_scan(docs: DataFrame, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, n_words, n_base, first_word, last_word, base_labels, labels, score and the spans with their edits."""

    @F.pandas_udf(SCAN_TYPE)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        ready = prepared(notices)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        out = pd.DataFrame([scan_text(t, ready) for t in texts], columns=names)
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(id_col), scanned(F.col(text_col)).alias("_found")).select(id_col, "_found.*")
