"""URL filters: two character models, of accepted and of rejected URLs, and the difference of what they make of a URL.

A model is a variable-order Markov chain: the probability of a character behind the last ORDER characters, smoothed into that behind
one fewer, and so on (Witten and Bell). Both are counted over all seeds. A URL's score is log2 of its probability as a
rejected URL less that as an accepted one, for each character, where characters that no seed has count nothing; it is kept up to
the score calibrated on all seeds.

Seeds: a URL whose host has one of the words BLOCKED, between anything but letters and digits, is rejected; one with a host of plain
names and none of the words in it, nor between such marks behind the host, is accepted. Others, such as hosts with a hyphen, are
neither: no model counts them, and their score decides. Callers may say otherwise with a column of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import frugal, written

ORDER = 5  # an n-gram is a number: its length in bits 48 to 50 and up to six bytes
BLOCKED = (
    "casino", "bets", "betting", "gambling", "poker", "pills", "viagra", "cialis", "ads", "porn", "xxx", "sex", "adult", "escort", "malware", "phishing", "spam", "warez",
)
#: Bytes of the URLs that are scored together.
GROUP = 256 << 10
_COUNTS = "gram long, good long, bad long"


def seed(url: Column, blocked: tuple[str, ...] = BLOCKED) -> Column:
    """True for a rejected seed, false for an accepted one, null for a URL that is neither."""
    words, whole = "|".join(blocked), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)(.*)$"
    host, rest = (F.lower(F.regexp_extract(url, "(?s)" + whole, k)) for k in (1, 2))
    told = f"(^|[^a-z0-9])({words})([^a-z0-9]|$)"
    plain = host.rlike("^[a-z0-9]+([.][a-z0-9]+)*[.][a-z]+(:[0-9]+)?$") & ~host.rlike(words) & ~rest.rlike(told)
    return F.when(host.rlike(told), F.lit(True)).when(plain, F.lit(False))


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte a row of the n-grams, of 1 to ORDER + 1 bytes, that end with it; -1 where the text begins later."""
    low = flat.LOWER[data].astype(np.int64)
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    out = np.full((len(data), ORDER + 1), -1, np.int64)
    number = np.zeros(len(data), np.int64)
    for k in range(ORDER + 1):
        number[k:] |= low[: len(low) - k] << (8 * k)
        some = place >= k
        out[some, k] = number[some] | (k + 1) << 48
    return out


def context(gram: np.ndarray) -> np.ndarray:
    """The n-gram less its last byte."""
    return ((gram >> 48) - 1) << 48 | (gram & ((1 << 48) - 1)) >> 8


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = flat.buffers(batch.column(0))
        bad = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(bool), np.diff(offs))
        own = grams(data, offs)
        keys, which = np.unique(own, return_inverse=True)
        which = which.reshape(own.shape)
        total = np.bincount(which.ravel(), minlength=len(keys))
        of_bad = np.bincount(which[bad].ravel(), minlength=len(keys))
        real = keys >= 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[real]), pa.array((total - of_bad)[real]), pa.array(of_bad[real])], ["gram", "good", "bad"])


def windows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The longest n-gram that ends with each byte: all that its probability depends on."""
    own = grams(data, offs)
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs))
    return own[np.arange(len(own)), np.minimum(place, ORDER)]


def _met(table: pa.Table) -> pa.Table:
    """The distinct windows of a group of URLs."""
    seen = np.unique(windows(*flat.buffers(table.column("url").cast(pa.large_string()))))
    return pa.table([pa.array(np.full(len(seen), table.column("part")[0].as_py())), pa.array(seen)], names=["part", "window"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window with the n-grams that end it, from one byte on."""
    for batch in batches:
        window = batch.column(0).to_numpy()
        size = window >> 48
        k = flat.runs(np.ones(len(size), np.int64), size)
        own = np.repeat(window, size)
        # the first byte of a window is its highest: its last k bytes are the lowest of the number
        gram = k << 48 | own & ((np.int64(1) << (8 * k)) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(k), pa.array(gram), pa.array(context(gram))], ["window", "k", "gram", "context"])


def _summed(urls: pa.Table, answers: pa.Table) -> pa.Table:
    """The score of each URL of a group, from the bits of the group's windows."""
    column = urls.column("url").cast(pa.large_string())
    data, offs = flat.buffers(column)
    window, bits = answers.column("window").to_numpy(), answers.column("bits").to_numpy()
    order = np.argsort(window)
    own = windows(data, offs)
    each = bits[order][np.searchsorted(window[order], own)] if len(own) else np.zeros(0)
    total = np.concatenate([[0], np.cumsum(each)])[offs]
    return pa.table([urls.column("url"), pa.array(np.round(np.diff(total) / np.maximum(np.diff(offs), 1), 6))], names=["url", "score"])


def _bits(windows_: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, bits): log2 of the probability of a window's last byte as rejected less as accepted; 0 for a byte that no seed has."""
    low = (1 << 48) - 1
    up = F.shiftleft(F.shiftright("gram", 48) - 1, 48).bitwiseOR(F.shiftright(F.col("gram").bitwiseAND(F.lit(low)), 8))
    follow = counts.groupBy(up.alias("context")).agg(*(x for s in ("good", "bad") for x in (F.sum(s).alias(f"n_{s}"), F.sum((F.col(s) > 0).cast("long")).alias(f"t_{s}"))))
    each = windows_.mapInArrow(_levels, "window long, k long, gram long, context long")
    full = each.join(counts, "gram", "left").join(follow, "context", "left").fillna(0)
    steps = F.array_sort(F.collect_list(F.struct("k", *(x for s in ("good", "bad") for x in (F.col(s).cast("double").alias(s), F.col(f"n_{s}").cast("double").alias(f"n_{s}"), F.col(f"t_{s}").cast("double").alias(f"t_{s}"))))))

    def chance(side: str) -> Column:
        step = lambda p, x: F.when(x[f"n_{side}"] > 0, (x[side] + x[f"t_{side}"] * p) / (x[f"n_{side}"] + x[f"t_{side}"])).otherwise(p)
        return F.aggregate("steps", F.lit(1 / 256), step)

    known = F.get("steps", F.lit(0))["good"] + F.get("steps", F.lit(0))["bad"] > 0
    return full.groupBy("window").agg(steps.alias("steps")).select("window", F.when(known, F.log2(chance("bad")) - F.log2(chance("good"))).otherwise(0.0).alias("bits"))


def scored(pages: DataFrame, bad: str | None = None, group: int = GROUP) -> DataFrame:
    """(page_id, url, bad, score) of pages with a URL; bad is null where it is no seed, also in a column of the caller's own.

    An empty URL scores 0, as do all where there is no seed. Neither the models nor the URLs are ever in one place: distinct URLs are
    grouped, `group` bytes to each, a group asks for the bits of its distinct windows, and these are worked out once for each window,
    beside its counts.
    """
    frugal(pages.sparkSession)
    rows = pages.where("url is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", (F.col(bad).cast("boolean") if bad else seed(F.col("url"))).alias("bad"))
    rows = written(rows, "urls")
    counts = written(rows.where("bad is not null").select("url", "bad").mapInArrow(_counted, _COUNTS).groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-grams")
    distinct = rows.select("url").distinct()
    total = distinct.agg(F.sum(F.octet_length("url").cast("long"))).first()[0] or 0
    grouped = written(distinct.where("url <> ''").withColumn("part", F.pmod(F.xxhash64("url"), F.lit(-(-total // group) or 1))), "url-groups")
    asked = written(grouped.groupBy("part").applyInArrow(_met, "part long, window long"), "url-windows")
    answers = asked.join(_bits(asked.select("window").distinct(), counts), "window").select("part", "window", "bits")
    found = grouped.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_summed, "url string, score double")
    return rows.join(found, "url", "left").select("page_id", "url", "bad", F.coalesce("score", F.lit(0.0)).alias("score"))


def kept(pages: DataFrame, bad: str | None = None, group: int = GROUP) -> DataFrame:
    """(page_id, url, score) of the pages whose URL is not rejected.

    The threshold tells accepted from rejected seeds with the highest balanced accuracy; where there are no seeds of either kind all
    pages are kept. A null URL is left out, an empty one scores 0. A null page_id stays, a repeated row comes again. Columns
    other than page_id, url and `bad` are not read.
    """
    found = written(scored(pages, bad, group), "url-scores")
    table = found.where("bad is not null").groupBy(F.round("score", 3).alias("score")).agg(F.sum(F.col("bad").cast("long")).alias("bad"), F.count("*").alias("n")).orderBy("score").collect()
    out, all_bad, total = found.select("page_id", "url", "score"), sum(r["bad"] for r in table), sum(r["n"] for r in table)
    if not all_bad or all_bad == total:
        return out
    best, most, good, worse = -math.inf, math.inf, 0, 0
    for k, r in enumerate(table[:-1]):
        good, worse = good + r["n"] - r["bad"], worse + r["bad"]
        if (value := good / (total - all_bad) - worse / all_bad) > best:
            best, most = value, (r["score"] + table[k + 1]["score"]) / 2
    return out.where(F.col("score") <= most)
