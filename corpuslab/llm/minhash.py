"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, union-find grouping.

SuperMinHash gives every element one random permutation of the registers and, at
step ``i``, the value ``i + r`` in the register that the permutation names; a
register keeps its least value. Registers of a set are therefore filled without
replacement (lower variance than independent hashes), and the steps of a set
end once every register holds a value below the next step.

Documents of equal shingle sets are one class before anything is compared. Bands
of the signature are the buckets of :func:`corpuslab.llm.grouping.resolve`, which
confirms every link on the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from corpuslab.llm import kernels as K
from corpuslab.llm.common import WORD as K_WORD
from corpuslab.llm.common import bounded_batches, keyed, release, saved, sieved
from corpuslab.llm.grouping import resolve

#: Rows and bands: a pair at 0.8 is missed with probability (1 - 0.8**4)**32 = 5e-8.
ROWS, BANDS = 4, 32
CHUNK = 1 << 18


def superminhash(values: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """Signatures (sets x registers, 32 bits: the step in the top 8, a random fraction below) of sets of 64-bit hashes.

    All sets advance together, step by step; a set stops as soon as all its
    registers are filled. Empty sets keep the largest value everywhere.
    """
    n = len(offsets) - 1
    out = np.full((n, registers), 0xFFFFFFFF, dtype=np.uint32)
    flat = out.reshape(-1)
    sets = np.repeat(np.arange(n), np.diff(offsets))
    picks: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for step in range(registers):
            if not len(values):
                break
            r = K.mix(values + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15))
            pick = (step + (r >> np.uint64(40)) % np.uint64(registers - step)).astype(np.int16)
            # position pick after the swaps of the earlier steps (Fisher-Yates, traced back)
            place = pick.copy()
            for t in range(step - 1, -1, -1):
                np.copyto(place, t, where=place == picks[t])
            value = (np.uint32(step) << np.uint32(24)) | (r & np.uint64(0xFFFFFF)).astype(np.uint32)
            np.minimum.at(flat, sets * registers + place, value)
            picks.append(pick)
            going = ((out >> np.uint32(24)) > step).any(axis=1)
            keep = going[sets]
            if not keep.all():
                values, sets = values[keep], sets[keep]
                picks = [p[keep] for p in picks]
    return out


SKETCH = StructType([StructField("n_shingles", LongType()), StructField("id", BinaryType()), StructField("bands", ArrayType(LongType()))])


def _sketch(width: int, rows: int, bands: int):
    @F.pandas_udf(SKETCH)
    def run(column: pd.Series) -> pd.DataFrame:
        texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in column]
        out = []
        for lo, hi in K.batches([len(t) for t in texts], CHUNK):
            values, off, _ = K.shingles(texts[lo:hi], width)
            sig = superminhash(values, off, rows * bands).reshape(hi - lo, bands, rows)
            digest = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off[:-1], off[1:])]
            with np.errstate(over="ignore"):
                key = np.zeros((hi - lo, bands), dtype=np.uint64)
                for r in range(rows):
                    key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r].astype(np.uint64))
                key = K.mix(key + np.arange(bands, dtype=np.uint64))
            out.append(pd.DataFrame({"n_shingles": np.diff(off), "id": digest, "bands": list(key.view(np.int64))}))
        release()
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n_shingles": [], "id": [], "bands": []})

    return run


def _sets(width: int):
    def run(parts):
        for pdf in parts:
            texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]
            for lo, hi in K.batches([len(t) for t in texts], CHUNK):
                values, off, _ = K.shingles(texts[lo:hi], width)
                yield pd.DataFrame({"id": list(pdf["id"].iloc[lo:hi]), "payload": [values[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]})

    return run


def _linked(common, a, b, percent):
    return 100 * common >= percent * (a + b - common)


def _pairs(percent: int):
    def run(us, vs):
        out = np.zeros(len(us), dtype=bool)
        for i, (u, v) in enumerate(zip(us, vs)):
            if 100 * min(len(u), len(v)) >= percent * max(len(u), len(v)):
                both = np.concatenate((np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)))
                both.sort(kind="stable")
                out[i] = _linked(int((both[1:] == both[:-1]).sum()), len(u) // 8, len(v) // 8, percent)
        return out

    return run


def _block(percent: int):
    def run(us, vs):
        every = np.frombuffer(b"".join(vs), np.uint64)
        sizes = np.array([len(v) // 8 for v in vs])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        known, number = np.unique(every, return_inverse=True)
        mark = np.zeros(len(known) + 1, dtype=np.int32)
        out = np.zeros((len(us), len(vs)), dtype=bool)
        for i, u in enumerate(us):
            mine = np.frombuffer(u, np.uint64)
            at = np.searchsorted(known, mine)
            at = at[known[np.minimum(at, len(known) - 1)] == mine]
            mark[at] = 1
            common = np.add.reduceat(mark[number], starts)
            mark[at] = 0
            out[i] = _linked(common, len(mine), sizes, percent)
        return out

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs(doc_id, text)``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds
    the distinct runs of ``width`` words, or the whole text if it is shorter. Null,
    empty and blank texts have empty sets and link with nothing. Documents link at
    a Jaccard similarity of ``percent`` or more; ``component_id`` is the smallest
    ``doc_id`` reachable by links, ``kept`` says that it is the document's own.
    Rows that repeat each get their row. A null ``doc_id`` takes part in links but
    is never a component's name unless the component has no other; then both
    ``component_id`` and ``kept`` are null and true. Other columns are ignored.
    """
    sketch, names = _grouped(docs, width, percent, rows, bands)
    out = sketch.join(names.select("id", "named"), "id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("named")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n_shingles").cast("long"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row of each group of near-duplicates in ``docs``: that of smallest ``doc_id``, of several texts the one of least hash.

    Rows without words belong to no group and stay; so rows without id stay only where they name their group.
    """
    names = _grouped(docs, width, percent, rows, bands)[1]
    first = names.select("group.*").distinct()
    solid = F.coalesce(F.col("text").rlike(K_WORD), F.lit(False))
    # the other columns travel in one struct, whatever their names
    plain = keyed(docs.select("doc_id", "text", F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("__row")))
    one = plain.where(solid).join(first, (plain["__d"] == first["d"]) & (plain["__f"] == first["f"]), "left_semi").groupBy("__d", "__f").agg(F.first("__row").alias("__row"))
    return one.select("__row").unionByName(plain.where(~solid).select("__row")).select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _grouped(docs: DataFrame, width: int, percent: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_shingles, id)`` of all rows, ``id`` naming the set, and ``(id, named, group)`` of the sets: the component's name and its first row's keys."""
    bounded_batches(docs.sparkSession)
    docs = keyed(docs.select("doc_id", "text"))
    sketch = saved(docs.select("doc_id", "__d", "__f", _sketch(width, rows, bands)("text").alias("s")).select("doc_id", "__d", "__f", "s.*"), "sketch")
    # one row for each distinct set, with the keys of a row that has it
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("__d").alias("d"), F.col("__f").alias("f")))
    classes = saved(sketch.where("n_shingles > 0").groupBy("id").agg(least.alias("one"), F.first("bands").alias("bands")), "sets")
    buckets = classes.select(F.explode(F.array_distinct("bands")).alias("key"), "id")

    def payloads(ids: DataFrame) -> DataFrame:
        # written, so that the join with the texts can split the rows of one document that repeats
        wanted = saved(classes.select("id", F.col("one.d").alias("__d"), F.col("one.f").alias("__f")).join(ids, "id", "left_semi"), "wanted")
        cut = sieved(docs, wanted, "__d", "__f").join(wanted, ["__d", "__f"]).select("text", "id")
        return cut.mapInPandas(_sets_checked(width), "id binary, payload binary").dropDuplicates(["id"])

    roots = resolve(buckets, payloads, _pairs(percent), _block(percent))
    group = saved(classes.select("id", "one").join(roots, "id").groupBy("root").agg(F.min("one").alias("group")), "groups")  # written: a large group's join is split
    names = classes.select("id", "one").join(roots.join(group, "root").select("id", "group"), "id", "left").select("id", F.coalesce("group", "one").alias("group"))
    names = names.select("id", "group", F.when(~F.col("group.none"), F.col("group.d")).alias("named"))
    return sketch.select("doc_id", "n_shingles", "id"), saved(names, "names")


def _sets_checked(width: int):
    """Payloads of the texts whose set has the digest asked for."""
    inner = _sets(width)

    def run(parts):
        for pdf in inner(parts):
            release()
            good = [hashlib.blake2b(p, digest_size=16).digest() == bytes(i) for i, p in zip(pdf["id"], pdf["payload"])]
            yield pdf[good]

    return run
