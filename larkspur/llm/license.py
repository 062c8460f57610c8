"""License scans: fuzzy search for short notices.

A notice of n characters that may hold k edits is split into k + 1 pieces; by
the pigeonhole principle an occurrence holds at least one piece unedited, so
exact finds of the pieces locate all candidates; those with too few of the
notice's 3-grams cannot hold it and go.  The regex library's
bounded-error matching then verifies each candidate window, and the spans are
reported as words.

Texts are read as words: A-Z lower-cased, runs of letters, digits and
characters beyond ASCII.  `scan` also counts exact phrases.

Defined results: a null or empty text has no words and no labels; repeated rows
give repeated rows; very long texts are scanned whole; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import append

#: phrases that count exactly: (words, label)
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: notices that count with edits: (words, label, core); each word of the core has
#: to stand in the match, with an edit at most if it has five letters or more, so
#: that a notice of another license with the same frame does not count
NOTICES = [
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", "permission granted"),
    ("licensed under the apache license version 2 0", "apache-2", "apache 2"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "by nc"),
    ("licensed under the gnu general public license version 3", "gpl-3", "general public 3"),
    ("redistribution and use in source and binary forms with or without modification", "bsd", "redistribution binary"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla"),
]
#: one edit for so many characters of a notice
CHARS_AN_EDIT = 9

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> tuple[bytes, int]:
    """The words, each with one space before it and one after the last, and their count."""
    words = (text or "").encode("utf-8", "replace").translate(_WORDS).split()
    return b" " + b" ".join(words) + b" ", len(words)


@lru_cache
def _notices(notices: tuple[tuple[str, str, str], ...]) -> list[tuple]:
    out = []
    for words, label, core in notices:
        raw = words.encode()
        edits = len(raw) // CHARS_AN_EDIT
        cuts = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
        pieces = [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        grams = {raw[i : i + 3] for i in range(len(raw) - 2)}
        cores = [regex.compile(b"(?<= |^)(?:%s){e<=%d}(?= |$)" % (w, len(w) >= 5)) for w in core.encode().split()]
        out.append((label, raw, edits, pieces, grams, cores, regex.compile(b"(?:%s){e<=%d}" % (regex.escape(raw.decode()).encode(), edits), regex.BESTMATCH)))
    return out


def fuzzy(joined: bytes, notices: tuple[tuple[str, str, str], ...]) -> list[tuple[str, int, int, int, int]]:
    """(label, start, end, edits, length of the notice); places that overlap count once."""
    out = []
    for label, raw, edits, pieces, grams, cores, pattern in _notices(notices):
        windows = set()
        # an edit spoils three 3-grams at the most, so an occurrence keeps so many
        least = len(raw) - 2 - 3 * edits
        for at, piece in pieces:
            place = joined.find(piece)
            while place >= 0:
                windows.add((max(0, place - at - edits), min(len(joined), place - at + len(raw) + edits)))
                place = joined.find(piece, place + 1)
        last = -1
        for low, high in sorted(windows):
            if sum(joined[i : i + 3] in grams for i in range(low, high - 2)) < least:
                continue
            # where a match lacks a core word, later ones of the window are tried
            at = max(low, last + 1)
            while m := pattern.search(joined, at, high):
                if all(c.search(m[0]) for c in cores):
                    out.append((label, m.start(), m.end(), sum(m.fuzzy_counts), len(raw)))
                    last = m.end() - 1
                    break
                at = m.start() + 1
    return out


def spaces_of(joined: bytes) -> np.ndarray:
    """Where the spaces stand, so that a place's word number is a binary search."""
    return np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)


def exact(joined: bytes, phrase: str) -> list[int]:
    """Word numbers at which the phrase's words stand in a row."""
    probe, places = f" {phrase} ".encode(), []
    at = joined.find(probe)
    while at >= 0:
        places.append(at)
        at = joined.find(probe, at + 1)
    return np.searchsorted(spaces_of(joined), places).tolist() if places else []


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=tuple(PHRASES), notices=tuple(NOTICES)) -> DataFrame:
    """key, n_words, exact (phrase label, word), found (label, first word, end word, edits, score)."""
    phrases, notices = tuple(map(tuple, phrases)), tuple(map(tuple, notices))

    def run(texts):
        counts, exacts, founds = [], [], []
        for value in texts:
            joined, n = normalised(value)
            counts.append(n)
            exacts.append([{"label": label, "word": w} for phrase, label in phrases for w in exact(joined, phrase)])
            hits = fuzzy(joined, notices)
            spaces = spaces_of(joined) if hits else None
            founds.append([span(joined, spaces, *x) for x in hits])
        return counts, exacts, founds

    return append(docs.select(key, text), [text], run, "n_words long, exact array<struct<label: string, word: bigint>>, found array<struct<label: string, first_word: bigint, end_word: bigint, edits: int, score: double>>").drop(text)


def span(joined: bytes, spaces: np.ndarray, label: str, start: int, end: int, edits: int, chars: int) -> dict:
    """A match as words: those that hold its first and, exclusively, follow its last character."""
    start += joined[start : start + 1] == b" "
    end -= joined[end - 1 : end] == b" "
    return {"label": label, "first_word": int(np.searchsorted(spaces, start)) - 1, "end_word": int(np.searchsorted(spaces, end)), "edits": edits, "score": max(0.0, 1 - edits / chars)}


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest of `scan`: places, labels and a score for each document."""
    s = scan(docs, key, text)
    words = F.transform("exact", lambda x: x["word"])
    labels = F.transform("exact", lambda x: x["label"])
    fuzzy_labels = F.transform("found", lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return s.select(
        key,
        "n_words",
        F.size("exact").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, fuzzy_labels)).alias("labels"),
        F.when(F.size("exact") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))).alias("score"),
        F.col("found").alias("spans"),
    )
