"""Quality rules on tokeniser fertility.

Two public vocabularies measure every whole text by characters per token. By
the first one only, also the share of byte-fallback tokens (tokens that aren't
whole characters, which a vocabulary resorts to where it has no piece) is
measured, and the entropy of the tokens as a share of what a text of that length
could have. Texts outside a band of their
language are rejected; those without a language, outside that of their script.
The fewer texts a language has, the more its band is drawn to its script. Bands
come from quartiles over all texts that pass the base rules:
[q1 - REACH * iqr, q3 + REACH * iqr], as wide at least as FLOOR says. Entropy,
a share that varies much with length, has a smaller reach, and its limits go at
most half the way from a quartile to 0, and nine tenths of it to 1 (short texts
come near), so both always lie inside of what is possible.

Defined results: null and empty texts have no words, fail the base rule and are
not kept; a very long text is measured as a whole; repeated rows, and rows that
share a null ``doc_id``, are judged each by its text; a table without ``lang``
is judged by script; of scripts equally frequent in a language the first by name
counts; a measure on a band's limit is inside; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, documents, sized_join, text_bytes, written
from .packing import encoder, vocabulary
from .quality import per_doc_counts
from .repeats import SPACE, byte_symbols, gram_hashes, range_hashes, words_of

VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
MEASURES = ("chars_per_token", "chars_per_token_multi", "fallback_share", "token_entropy")
#: Interquartile ranges beyond the quartiles, by measure.
REACH = (6.0, 6.0, 6.0, 2.0)
#: No band is narrower than its median plus and minus this.
FLOOR = (0.2, 0.2, 0.1, 0.2)
#: The weight of the script, in texts, in the spread of its languages' measures.
LEAST = 50
#: Measures are rounded to one in so many for the quartiles.
GRID = 1 << 12
MIN_WORDS = 50
WINDOW = 3

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def base_statistics(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """By document: words, code points in words, symbols, repeated lines with a
    word, words inside of a three-word window that occurs again."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    starts, ends, bounds = words_of(data, off)
    words = np.diff(bounds)
    wdoc = np.repeat(np.arange(n), words)
    visible = ~SPACE[data] & ((data & 0xC0) != 0x80)
    symbols = byte_symbols(data)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        g = gram_hashes(range_hashes(symbols, starts, ends), WINDOW)
        inside = np.flatnonzero(wdoc[WINDOW - 1 :] == wdoc[: -(WINDOW - 1)])
        order = inside[np.lexsort((g[inside], wdoc[inside]))]
        same = (g[order][1:] == g[order][:-1]) & (wdoc[order][1:] == wdoc[order][:-1])
        twice = order[np.append(same, False) | np.append(False, same)]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    again = np.cumsum(covered[:-1]) > 0
    begins = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], np.flatnonzero(data == 10) + 1)))
    begins = begins[begins < len(data)]
    stops = np.append(begins[1:], len(data))
    if len(begins):
        # without the line feed; the last line of a document has none
        stops = stops - ((data[stops - 1] == 10) & (stops > begins))
        worded = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
        begins, stops = begins[worded], stops[worded]
    ldoc = np.searchsorted(off, begins, "right") - 1
    lh = range_hashes(symbols, begins, stops) if len(begins) else np.zeros(0, np.uint64)
    kinds, _, _ = per_doc_counts(ldoc, lh, n)
    return {
        "n_words": words,
        "word_chars": np.bincount(doc, visible, minlength=n).astype(np.int64),
        "n_symbols": np.bincount(doc, _SYMBOLS[data], minlength=n).astype(np.int64),
        "n_dup_lines": np.bincount(ldoc, minlength=n) - kinds,
        "n_repeat_words": np.bincount(wdoc, again, minlength=n).astype(np.int64),
    }


_fallback: dict[str, np.ndarray] = {}


def fallback_ids(path: str) -> np.ndarray:
    """By id whether a token's bytes aren't whole characters."""
    if path not in _fallback:
        import base64

        with open(path, "rb") as f:
            ranks = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]
        table = np.zeros(max(i for i, _ in ranks) + 1, bool)
        for i, token in ranks:
            try:
                token.decode()
            except UnicodeDecodeError:
                table[i] = True
        _fallback[path] = table
    return _fallback[path]


def token_measures(texts: list[str], paths: tuple[str, ...]) -> np.ndarray:
    """(documents, MEASURES); NaN for an empty text."""
    n = len(texts)
    out = np.full((n, len(MEASURES)), np.nan)
    chars = np.array([len(t) for t in texts])
    for k, path in enumerate(paths):
        encode = encoder(path)
        ids = [encode(t) for t in texts]
        count = np.array([len(x) for x in ids])
        some = count > 0
        out[some, k] = chars[some] / count[some]
        if k:
            continue
        doc = np.repeat(np.arange(n), count)
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(count.sum()))
        out[some, 2] = np.bincount(doc, fallback_ids(path)[flat], minlength=n)[some] / count[some]
        key, many = np.unique(doc << 20 | flat, return_counts=True)
        p = many / count[key >> 20]
        entropy = np.bincount(key >> 20, -p * np.log2(p), minlength=n)
        out[some, 3] = entropy[some] / np.maximum(np.log2(np.maximum(count[some], 2)), 1)
    return out


@functools.cache
def _letters() -> np.ndarray:
    """By code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def script(text: str) -> str:
    """Of the first letter of the most frequent Unicode block among the letters."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    c = c[_letters()[c]]
    return f"script {np.bincount(np.where(c < 0x250, 0, c >> 8)).argmax()}" if len(c) else "script none"


def measured(docs: DataFrame, paths: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, language, script, base statistics and measures; a map over the
    text."""
    paths = paths or tuple(map(vocabulary, VOCABULARIES))
    ints = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for part, data, off in chunks(batches, limit=1 << 20):
            base = base_statistics(data, off)
            raw, o = data.tobytes(), off.tolist()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(o, o[1:])]
            found = token_measures(texts, paths)
            cols = [part.column(0), part.column(1), pa.array(map(script, texts), pa.string()), *(pa.array(base[c].astype(np.int64)) for c in ints), *(pa.array(found[:, k], from_pandas=True) for k in range(len(MEASURES)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "script", *ints, *MEASURES])

    schema = "doc_id long, lang string, script string, " + ", ".join(f"{c} long" for c in ints) + ", " + ", ".join(f"{c} double" for c in MEASURES)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), text_bytes().alias("text")).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def band_key():
    """The language's band, or the script's if there is no language."""
    return F.coalesce(F.concat(F.lit("lang "), F.col("lang")), F.col("script"))


def quartiles(counts: DataFrame, by: str) -> DataFrame:
    """``by`` and, for every measure, its exact quartiles, to 1/GRID: the least
    values that a quarter, half and three quarters are at most. ``counts``: rows
    by ``by``, measure and value."""
    so_far = Window.partitionBy(by, "measure").orderBy("value")
    each = counts.groupBy(by, "measure", "value").agg(F.sum("n").alias("n"))
    each = each.withColumn("up", F.sum("n").over(so_far)).withColumn("all", F.sum("n").over(Window.partitionBy(by, "measure")))
    at = [F.min(F.when(4 * F.col("up") >= k * F.col("all"), F.col("value"))) / GRID for k in (1, 2, 3)]
    found = each.groupBy(by, "measure").agg(F.array(*at).alias("q"))
    return found.groupBy(by).agg(*(F.max(F.when(F.col("measure") == c, F.col("q"))).alias(c) for c in MEASURES))


def bands(found: DataFrame, reach: Sequence[float] = REACH, least: int = LEAST) -> DataFrame:
    """Low and high limits of each measure by band.

    A script's are those of its texts' quartiles. A language of n texts is
    shrunk towards the script of most of them: its median as if the script's
    were one text more, the distances of its quartiles from it as if ``least``
    texts more had the mean distances of that script's languages; and it is
    wider by 1/(n + 1) of the script's interquartile range."""
    good = found.filter(~base_failed())
    # the quartiles of languages and scripts come from one exact count of values
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.round(F.col(c) * GRID).cast("long").alias("value")) for c in MEASURES))).alias("v")
    counts = written(good.select("lang", "script", values).groupBy("lang", "script", "v.measure", "v.value").agg(F.count("*").alias("n")), "counts")
    scripts = quartiles(counts, "script")
    named = counts.filter("lang is not null")
    sizes = named.filter(F.col("measure") == MEASURES[0]).groupBy("lang", "script").agg(F.sum("n").alias("n"))
    most = sizes.groupBy("lang").agg(F.min_by("script", F.struct(-F.col("n"), F.col("script"))).alias("script"), F.sum("n").alias("n"))
    langs = written(quartiles(named, "lang").join(most, "lang"), "langs")
    mean = lambda d: F.sum(F.col("n") * d) / F.sum("n")
    apart = [mean(F.col(c)[k + 1] - F.col(c)[k]).alias(f"{c}_d{k}") for c in MEASURES for k in (0, 1)]
    usual = langs.groupBy("script").agg(*apart)
    all_ = scripts.select("script", *(F.col(c).alias(f"{c}_all") for c in MEASURES))
    own, wide = [], []
    for c in MEASURES:
        n, v, s = F.col("n"), F.col(c), F.col(f"{c}_all")
        down, up = ((n * (v[k + 1] - v[k]) + least * F.col(f"{c}_d{k}")) / (n + least) for k in (0, 1))
        mid = (n * v[1] + s[1]) / (n + 1)
        own.append(F.array(mid - down, mid, mid + up).alias(c))
        wide.append((down + up + (s[2] - s[0]) / (n + 1)).alias(f"{c}_iqr"))
    shrunk = langs.join(usual, "script").join(all_, "script").select(F.concat(F.lit("lang "), F.col("lang")).alias("band"), *own, *wide)
    some = scripts.select(F.col("script").alias("band"), *MEASURES, *((F.col(c)[2] - F.col(c)[0]).alias(f"{c}_iqr") for c in MEASURES)).unionByName(shrunk)
    limits = []
    for c, far, floor in zip(MEASURES, reach, FLOOR):
        q1, mid, q3 = (F.col(c)[i] for i in range(3))
        beyond = far * F.col(f"{c}_iqr")
        low, high = F.least(q1 - beyond, mid - floor), F.greatest(q3 + beyond, mid + floor)
        if c == "token_entropy":
            low, high = F.greatest(low, q1 / 2), F.least(high, (9 + q3) / 10)
        limits += [low.alias(f"{c}_low"), high.alias(f"{c}_high")]
    return some.select("band", *limits)


def judged(docs: DataFrame, reach: Sequence[float] = REACH, least: int = LEAST, paths: tuple[str, ...] | None = None) -> DataFrame:
    """Base columns, base_failed, kept, and the measures, of every document."""
    found = written(measured(docs, paths), "measures")
    limits = written(bands(found, reach, least), "bands")
    wide = sized_join(found.withColumn("band", band_key()), limits, "band", "left")
    inside = None
    for c in MEASURES:
        ok = F.coalesce(F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high")), F.lit(False))
        inside = ok if inside is None else inside & ok
    return wide.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"), *MEASURES)


def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))
