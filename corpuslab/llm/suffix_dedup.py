"""Exact repeats of a minimum length over all texts, by Burrows-Wheeler transforms of bounded blocks.

Where a repeat lies is unknown, so texts are first cut where equal strings must
be cut alike: of the ``ANCHOR``-byte strings within each window of ``least``
bytes, the one of smallest hash is the window's anchor. Consecutive windows of
one anchor form a segment; equal windows always have equal anchors. Anchors that
occur once end there. Equal segments are counted, not repeated, and the distinct
segments of an anchor meet in a block, whose transform
(:mod:`corpuslab.llm.bwt`) tells the windows that occur twice. An anchor with too
many distinct segments for a block is split by longer keys: cells of a few windows with
all bytes that the cell's windows share, and at last single windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpuslab.llm import kernels as K
from corpuslab.llm.bwt import repeated
from corpuslab.llm.common import bounded_batches, keyed, release, saved

LEAST, ANCHOR = 200, 64
#: Bytes of texts hashed at a time; bytes of a block; distinct segments of a key in a block.
CHUNK, BLOCK, CROWD = 1 << 18, 1 << 18, 2048
CELLS = (16, 1)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def segments(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """``(text, start, windows, offset of the anchor, hash of the anchor)`` of all segments, in order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n, width = len(data), least - ANCHOR + 1
    empty = np.zeros(0, dtype=np.int64)
    if n < least:
        return empty, empty, empty, empty, empty
    with np.errstate(over="ignore"):
        h, size = data.astype(np.uint64) + np.uint64(1), 1
        for m in MULTIPLIERS:  # hashes of 2, 4, ... 64 bytes
            h = h[: len(h) - size] * np.uint64(m | 1) + h[size:]
            size *= 2
        h = K.mix(h)
    bits = np.uint64(max(1, n.bit_length()))
    v = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # ties go to the left
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[: len(v) - span], v[span:])
        span *= 2
    if width > span:
        v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
    anchor = (v & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    valid = np.arange(len(anchor)) + least <= ends[text]
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    last = np.flatnonzero(stop)
    text, at = text[first], anchor[first]
    return text, first - (ends - sizes)[text], last - first + 1, at - first, h[at].view(np.int64)


def _anchors(least: int, hashes_only: bool = False):
    def run(parts):
        for pdf in parts:
            texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]
            for lo, hi in K.batches([len(t) for t in texts], CHUNK):
                some = texts[lo:hi]
                text, start, windows, off, h = segments(some, least)
                if hashes_only:
                    yield pd.DataFrame({"h": h})
                    continue
                g = [hashlib.blake2b(some[t][a : a + w + least - 1], digest_size=8).digest() for t, a, w in zip(text.tolist(), start.tolist(), windows.tolist())]
                own = pdf.iloc[lo:hi].take(text)
                yield pd.DataFrame({"h": h, "g": np.frombuffer(b"".join(g), dtype=np.int64), "doc_id": own["doc_id"].array, "fp": own["fp"].array, "at": start << 16 | windows << 8 | off})
            release()

    return run


def _cut(least: int):
    def run(parts):
        for pdf in parts:
            rows = []
            for t, wanted in zip(pdf["text"], pdf["wanted"]):
                b = t.encode("utf-8", "surrogatepass")
                for w in wanted:
                    start, windows, off = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                    rows.append((w["h"], w["h"], w["g"], 0, b[start : start + windows + least - 1], w["w"], off))
            yield pd.DataFrame(rows, columns=["k", "h", "g", "base", "text", "w", "off"])

    return run


ITEM = "k long, h long, g long, base int, text binary, w int, off int"


def _finer(least: int, cell: int):
    """Segments cut into cells of windows at fixed distances from the anchor, keyed by the bytes that all windows of a cell share."""

    def run(parts):
        for pdf in parts:
            rows = []
            for k, h, g, base, text, w, off in pdf[["k", "h", "g", "base", "text", "w", "off"]].itertuples(index=False):
                windows = len(text) - least + 1
                i = 0
                while i < windows:
                    j = (i - off) // cell  # the cell of window i
                    end = min(windows, off + (j + 1) * cell)
                    lo = off + j * cell + cell - 1
                    core = text[lo : lo + least - cell + 1]
                    key = hashlib.blake2b(core, digest_size=8, key=(k & (1 << 64) - 1).to_bytes(8, "little") + (j + 4096).to_bytes(8, "little")).digest()
                    rows.append((int.from_bytes(key, "little", signed=True), h, g, base + i, text[i : end + least - 1], w, off - i))
                    i = end
            yield pd.DataFrame(rows, columns=["k", "h", "g", "base", "text", "w", "off"])

    return run


def _blocks(least: int, block: int):
    """Windows of each distinct text that occur twice, as first and last numbers; texts of a key stay together."""

    def solve(rows):
        marks = repeated([r[2] for r in rows], [r[3] for r in rows], least)
        out = []
        for (k, d, _, _), mark in zip(rows, marks):
            first, end = K.runs(mark)
            if len(first):
                out.append((k, d, np.stack((first, end - 1), axis=1).ravel().tolist()))
        return pd.DataFrame(out, columns=["k", "d", "runs"])

    def run(parts):
        rows, size, key = [], 0, None
        for pdf in parts:
            for k, d, text, w in pdf[["k", "d", "text", "w"]].itertuples(index=False):
                if size >= block and k != key:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append((k, d, bytes(text), w))
                size += len(text)
                key = k
        if rows:
            yield solve(rows)
        release()

    return run


def repeated_windows(items: DataFrame, least: int, crowd: int, block: int, cells: tuple[int, ...] = CELLS) -> DataFrame:
    """``(h, g, base, runs)``: windows of the segments that occur twice; ``items`` have the columns of ``ITEM``."""
    items = saved(items.withColumn("d", F.xxhash64("text")), "segments")
    texts = items.groupBy("k", "d").agg(F.first("text").alias("text"), F.least(F.sum("w"), F.lit(2)).cast("int").alias("w"))
    crowds = items.select("k", "d").distinct().groupBy("k").agg(F.count("*").alias("n"))
    hot = saved(crowds.where(F.col("n") > (crowd if cells else 1 << 62)).select("k"), "crowds")
    cold = texts.join(hot, "k", "left_anti") if cells else texts
    found = cold.repartition("k").sortWithinPartitions("k").mapInPandas(_blocks(least, block), "k long, d long, runs array<int>")
    out = items.select("h", "g", "base", "k", "d").join(found, ["k", "d"]).select("h", "g", "base", "runs")
    if not cells or hot.isEmpty():
        return out
    finer = items.join(hot, "k", "left_semi").select("k", "h", "g", "base", "text", "w", "off").mapInPandas(_finer(least, cells[0]), ITEM)
    return out.unionByName(repeated_windows(finer, least, crowd, block, cells[1:]))


def repeated_spans(docs: DataFrame, least: int = LEAST, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """``(__d, __f, spans)`` of the texts of ``docs`` that have repeats, by the keys of ``keyed``; a span is a start and the repeated windows' numbers."""
    if not ANCHOR < least <= ANCHOR + 200:
        raise ValueError(f"the minimum length must be over {ANCHOR} and at most {ANCHOR + 200} bytes")
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = keyed(docs.select("doc_id", "text").where("text is not null")).select(F.col("__d").alias("doc_id"), F.col("__f").alias("fp"), "text")
    anchors = docs.mapInPandas(_anchors(least), f"h long, g long, doc_id {kind}, fp long, at long")
    # written tables on both sides of a join let Spark split the rows of one hot anchor
    twice = saved(docs.select("text").mapInPandas(_anchors(least, True), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    found = saved(anchors.join(twice, "h"), "anchors")
    # equal segments are one, with a weight
    place = F.struct("doc_id", "fp", "at")
    one = saved(found.groupBy("h", "g").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("w"), F.min(place).alias("p")), "distinct")
    mixed = saved(one.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "mixed")
    wanted = one.join(mixed, "h").groupBy(F.col("p.doc_id").alias("doc_id"), F.col("p.fp").alias("fp")).agg(F.collect_list(F.struct("h", "g", "w", F.col("p.at").alias("at"))).alias("wanted"))
    items = docs.join(wanted, ["doc_id", "fp"]).select("text", "wanted").mapInPandas(_cut(least), ITEM)
    # rows that repeat are cut each: a segment counts once
    items = items.groupBy("h", "g").agg(*(F.first(c).alias(c) for c in ("k", "base", "text", "w", "off"))).select("k", "h", "g", "base", "text", "w", "off")
    runs = repeated_windows(items, least, crowd, block)
    runs = runs.groupBy("h", "g").agg(F.flatten(F.collect_list(F.transform("runs", lambda x: x + F.col("base")))).alias("runs"))
    # an anchor with one distinct segment needs no transform: all its windows occur as often as the segment
    alone = one.join(mixed, "h", "left_anti").where("w > 1").select("h", "g", F.array(F.lit(0), F.shiftright("p.at", 8).bitwiseAND(F.lit(255)).cast("int") - 1).alias("runs"))
    runs = saved(runs.unionByName(alone), "runs")
    return found.join(runs, ["h", "g"]).groupBy(F.col("doc_id").alias("__d"), F.col("fp").alias("__f")).agg(F.collect_list(F.struct(F.shiftright("at", 16).alias("start"), "runs")).alias("spans"))


def _kept(text: str | None, spans, least: int) -> tuple[bytes, int, int, bytes]:
    """A text's bytes, the number of those removed, of removed runs, and the bytes that stay."""
    b = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    edges = np.zeros(len(b) + 1, dtype=np.int32)
    for s in spans if spans is not None else ():
        for a, z in zip(s["runs"][::2], s["runs"][1::2]):
            edges[s["start"] + a] += 1
            edges[s["start"] + z + least] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    first, end = K.runs(gone)
    kept = [b[a:z] for a, z in zip([0, *end.tolist()], [*first.tolist(), len(b)])]
    return b, int(gone.sum()), len(first), b"".join(kept)


FIGURES = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])


def _figures(least: int):
    @F.pandas_udf(FIGURES)
    def run(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        release()
        rows = [_kept(t, s, least) for t, s in zip(text, spans)]
        return pd.DataFrame([(len(b), gone, n, hashlib.sha256(kept).hexdigest()) for b, gone, n, kept in rows], columns=FIGURES.names)

    return run


def _stripped(least: int):
    @F.pandas_udf(StringType())
    def run(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_kept(t, s, least)[3].decode("utf-8", "ignore") if isinstance(t, str) else None for t, s in zip(text, spans)], dtype=object)

    return run


def _with_spans(docs: DataFrame, **knobs) -> DataFrame:
    return keyed(docs).join(repeated_spans(docs, **knobs), ["__d", "__f"], "left").drop("__d", "__f")


def removed_repeats(docs: DataFrame, least: int = LEAST, **knobs) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, a row for each row of ``docs(doc_id, text)``.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``least`` bytes
    that covers it also starts anywhere else, in its own text too; strings never
    cross texts and are judged on the input. Rows that repeat are texts of their own,
    so all their strings repeat. Other columns are ignored.
    """
    rows = _with_spans(docs.select("doc_id", "text"), least=least, **knobs)
    return rows.select("doc_id", _figures(least)("text", "spans").alias("f")).select("doc_id", "f.*")


def without_repeats(docs: DataFrame, least: int = LEAST, **knobs) -> DataFrame:
    """``docs`` with the repeats cut out of ``text`` (bytes of characters cut in two go too); null texts stay null."""
    # the other columns travel in one struct, whatever their names, and never enter Python
    plain = docs.select("doc_id", "text", F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("__row"))
    rows = _with_spans(plain, least=least, **knobs).select("__row", _stripped(least)("text", "spans").alias("__text"))
    return rows.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
