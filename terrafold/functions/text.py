"""Keys, numbers and names as Column expressions (PRJ-9, 11-16, 28, 30)."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Words that say nothing about which place a name means.
NOISE_WORDS = (
    "pt", "cv", "tbk", "persero", "the", "and", "dan", "di", "kantor", "cabang", "pembantu", "kas", "unit", "pusat",
    "kcp", "kcu", "kck", "kc", "kk", "cab", "atm", "cdm", "setor", "tunai", "anjungan",
    "stasiun", "station", "st", "halte", "terminal", "shelter", "jl", "jalan", "no", "nomor", "raya", "km", "toko", "minimarket", "swalayan",
)
#: Cells that stand for nothing.
BLANKS = ("", "#N/A", "-", "NULL", "N/A")


def norm_key(*parts: Column) -> Column:
    """Upper-case ASCII letters and digits of all parts together (PRJ-11)."""
    return F.regexp_replace(F.upper(F.concat_ws("", *parts)), "[^A-Z0-9]", "")


def alnum_key(text: Column) -> Column:
    """The same with letters and digits of all scripts (PRJ-12)."""
    return F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]", "")


def header_key(header: Column) -> Column:
    """A spreadsheet header up to its first bracket, in lower-case letters and digits (PRJ-13)."""
    return F.regexp_replace(F.lower(F.substring_index(header, "(", 1)), "[^a-z0-9]", "")


def not_blank(text: Column) -> Column:
    """Null for the tokens that stand for nothing."""
    cut = F.trim(text)
    return F.when(~F.upper(cut).isin(*BLANKS), cut)


def first_not_blank(*options: Column) -> Column:
    """The first option that says something, in upper case (PRJ-28)."""
    return F.upper(F.coalesce(*[not_blank(c) for c in options]))


def number_with_thousands(text: Column) -> Column:
    """Commas group thousands: 1,234.5 (PRJ-14)."""
    return F.regexp_replace(not_blank(text), "[, ]", "").try_cast("double")


def number_with_decimal_comma(text: Column) -> Column:
    """A comma is the decimal point: -6,25 (PRJ-14, SRC-26)."""
    return F.regexp_replace(not_blank(text), ",", ".").try_cast("double")


def metric_and_period(header: Column) -> tuple[Column, Column]:
    """``Vlr Subs MTD 1708`` is metric ``vlr_subs`` of period ``MTD 1708`` (PRJ-9)."""
    period = F.trim(F.regexp_extract(header, r"(?i)\s((?:MTD|FM|YTD)\s*\d{4})\s*$", 1))
    name = F.trim(F.regexp_replace(header, r"(?i)\s(?:MTD|FM|YTD)\s*\d{4}\s*$", ""))
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_|_$", "")
    return slug, period


def month_period(title: Column) -> Column:
    """``Jun'26`` in a sheet title or file name such as ``outlets Jun 2026`` (PRJ-10); empty if there is none."""
    pattern = r"(?i)(?:^|[^a-z])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ _'-]*(?:20)?(\d{2})(?!\d)"
    month = F.initcap(F.regexp_extract(title, pattern, 1))
    return F.when(month != "", F.concat(month, F.lit("'"), F.regexp_extract(title, pattern, 2))).otherwise("")


def place_key(name: Column, lat: Column, lon: Column) -> Column:
    """A key from a place's name and position to six places (PRJ-15)."""
    spot = [F.format_string("%.6f", c.cast("double")) for c in (lat, lon)]
    return F.concat(F.lit("sp:"), F.substring(F.sha1(F.concat_ws("|", F.lower(F.trim(name)), *spot)), 1, 20))


def name_tokens(name: Column) -> Column:
    """Words of a place's name without noise words, or all of them if only those are left (PRJ-16)."""
    words = F.array_remove(F.split(F.replace(F.lower(name), F.lit("&"), F.lit(" dan ")), "[^a-z0-9]+"), "")
    told = F.array_except(words, F.array(*[F.lit(w) for w in NOISE_WORDS]))
    kept = F.filter(words, lambda w: ~w.isin(*NOISE_WORDS))
    return F.when(F.size(told) > 0, kept).otherwise(words)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word arrays as sets; null if either is null or empty (PRJ-17)."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b)))


#: Lengths that parts of texts are rounded up to; from the last one on ``difflib`` has a rule of its own for frequent letters.
LENGTHS = np.array([1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 18, 20, 24, 28, 32, 40, 48, 64, 96, 128, 199])
_ROUNDED = np.searchsorted(LENGTHS, np.arange(LENGTHS[-1] + 1)).astype(np.int16)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of a matrix of letters, and their lengths; null and texts that are too long are empty."""
    size = pc.utf8_length(texts).fill_null(0)
    texts = pc.if_else(pc.less_equal(size, int(LENGTHS[-1])), texts, "").fill_null("")
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(texts.to_pylist())
    kind, code = (np.uint8, "ascii") if joined.isascii() else (np.uint32, "utf-32-le")
    out = np.zeros((len(n), int(n.max(initial=1))), kind)
    told = np.frombuffer(joined.encode(code), kind)
    # 254 and 255 stay free
    out[np.arange(out.shape[1]) < n[:, None]] = told if kind is np.uint8 else np.where(told < 128, told, told + np.uint32(1 << 24))
    return out, n


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest block that each column of ``a`` shares with that of ``b``, of equals the first in ``a``, then in ``b``: its
    length and where it ends."""
    (ka, n), kb = a.shape, len(b)
    runs, most, same = np.empty((ka, kb, n), np.uint8), np.empty((ka, n), np.uint16), np.empty((kb, n), bool)
    for k in range(ka):
        np.equal(b, a[k], out=same)
        runs[k] = same
        if k:
            # a run goes on along the diagonal
            np.add(runs[k - 1, :-1], 1, out=runs[k, 1:])
            runs[k, 1:] *= same[1:].view(np.uint8)
        most[k] = runs[k].max(axis=0)
    best = ((most << 8) | (255 - np.arange(ka, dtype=np.uint16))[:, None]).max(axis=0)
    length, end = (best >> 8).astype(np.uint8), 255 - (best & 255).astype(np.int64)
    row = runs.reshape(-1).take((end * kb * n + np.arange(n)) + (np.arange(kb) * n)[:, None])
    first = ((row == length).view(np.uint8) * (255 - np.arange(kb, dtype=np.uint8))[:, None]).max(axis=0)
    return length.astype(np.int64), end + 1, 256 - first.astype(np.int64)


def matched_share(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The share of the letters of texts ``a[i]`` and ``b[j]`` that lies in matching blocks, as ``SequenceMatcher.ratio`` has it: the longest
    block first, then those left and right of it; for all pairs at once."""
    (a, na), (b, nb) = a, b
    total = na[i] + nb[j]
    matched = np.zeros(len(i), np.int64)
    flat_a, flat_b = a.ravel(), b.ravel()
    todo = [(np.arange(len(i)), i * a.shape[1], na[i], j * b.shape[1], nb[j])]
    while todo:
        pair, a0, ka, b0, kb = (np.concatenate(x) if len(todo) > 1 else x[0] for x in zip(*todo))
        todo = []
        kind = _ROUNDED[ka] * np.int16(32) + _ROUNDED[kb]
        kind[(ka == 0) | (kb == 0)] = 1023
        order = np.argsort(kind, kind="stable")
        edges = np.searchsorted(kind[order], np.arange(1024))
        for k in np.flatnonzero(np.diff(edges)):
            wide, high = int(LENGTHS[k // 32]), int(LENGTHS[k % 32])
            step = max(64, 1_500_000 // (wide * high))
            for s in range(edges[k], edges[k + 1], step):
                at = order[s : min(s + step, edges[k + 1])]
                p, x, u, y, v = pair[at], a0[at], ka[at], b0[at], kb[at]
                rows = [np.arange(w)[:, None] for w in (wide, high)]
                one, two = flat_a.take(rows[0] + x, mode="clip"), flat_b.take(rows[1] + y, mode="clip")
                # what lies beyond a part's end equals nothing
                if u.min() < wide:
                    np.putmask(one, rows[0] >= u, 254)
                if v.min() < high:
                    np.putmask(two, rows[1] >= v, 255)
                length, end_a, end_b = _longest(one, two)
                hit = np.flatnonzero(length)
                p, x, u, y, v, length, end_a, end_b = (c[hit] for c in (p, x, u, y, v, length, end_a, end_b))
                np.add.at(matched, p, length)
                for part in ((p, x, end_a - length, y, end_b - length), (p, x + end_a, u - end_a, y + end_b, v - end_b)):
                    rest = np.flatnonzero((part[2] > 0) & (part[4] > 0))
                    if len(rest):
                        todo.append(tuple(c[rest] for c in part))
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def matched_shares(a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray, made: tuple | None = None) -> np.ndarray:
    """``matched_share`` of texts of any length; ``made`` are the letters of ``a`` and ``b``, if at hand."""
    out = matched_share(*(made or (letters(a), letters(b))), i, j)
    long = [pc.greater(pc.utf8_length(t).fill_null(0), int(LENGTHS[-1])).to_numpy(zero_copy_only=False) for t in (a, b)]
    if long[0].any() or long[1].any():
        for k in np.flatnonzero(long[0][i] | long[1][j]):
            out[k] = SequenceMatcher(None, a[int(i[k])].as_py(), b[int(j[k])].as_py()).ratio()
    return out


@F.pandas_udf(DoubleType())
def _matched_share(a: pd.Series, b: pd.Series) -> pd.Series:
    asked = np.flatnonzero(a.notna() & b.notna())
    out = np.full(len(a), np.nan)
    if len(asked):
        out[asked] = matched_shares(*(pa.array(t, pa.string(), from_pandas=True) for t in (a, b)), asked, asked)
    return pd.Series(out)


def name_similarity(a: Column, b: Column, where: Column | None = None) -> Column:
    """The larger of two word arrays' Jaccard share and the share of their joined texts that lies in matching
    blocks (PRJ-17); null if either is null or empty. No built-in finds such blocks, so texts that differ, and
    only those for which ``where`` holds, go to Python in Arrow batches."""
    words = jaccard(a, b)
    ask = words.isNotNull() & (words < 1) & (F.lit(True) if where is None else where)
    texts = [F.when(ask, F.array_join(c, " ")) for c in (a, b)]
    return F.greatest(words, _matched_share(*texts))


def composed_address(full: Column, *parts: Column) -> Column:
    """The full address, or its parts joined, or null (PRJ-30)."""
    joined = F.concat_ws(", ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])
    return F.coalesce(F.when(F.trim(full) != "", F.trim(full)), F.when(joined != "", joined))
