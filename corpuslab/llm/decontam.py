"""Benchmark decontamination under word edits.

Words are runs of ASCII letters and digits and of other characters, lower-cased. A passage matches an
item if its edit distance in words is at most a fifth of the item's words.

The CGK embedding walks over a string: at each step it writes the word it stands on,
and a random bit, hashed from that step and word, says whether it moves on. Two
strings within a small edit distance are written with a small Hamming
distance, because their walks fall into step again after an edit. Windows
of the size of an item start at every word of a document; sampled positions of the
embedding are the hash keys, drawn anew, with new bits, for each repetition. A window
whose key is an item's is verified: the item is aligned to the text around it
exactly, by dynamic programming.

Long items are searched by pieces: of equal pieces of an item with a fifth of its words edited,
one has at most a fifth of its own edited.

Before walking, windows with too few of the items' words, or pairs of neighbouring words, are left out; an
edit takes away one word and two pairs at most, so this drops nothing that could be verified.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corpuslab.llm import kernels as K
from corpuslab.llm.common import bounded_batches, release

#: Edits by words of an item; least embeddings, and sampled positions in each; items of one pass; ratio of lengths of a class; words from which an item is cut, and of its pieces.
TOLERANCE, REPETITIONS, SAMPLES, ITEMS, RATIO, LONG, PIECE = 0.2, 32, 4, 8_000, 1.15, 64, 48
#: Share of a class's pieces with the most edits that its embeddings must find, trials that it is taken over, embeddings at which a class stops.
RECALL, TRIALS, MOST = 0.99, 400, 512
#: Bytes of texts at a time; walks at a time.
CHUNK, ENTRIES = 1 << 20, 1 << 17


def edits(n: int, tolerance: float) -> int:
    return int(n * tolerance + 1e-9)


def _bits(words: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word's number; its product with a step's odd number has that step's bit on top."""
    with np.errstate(over="ignore"):
        return K.mix(words.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))


def _move(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    return ((hashes * odd) >> np.uint64(63)).astype(np.int64)


class Plans:
    """The embeddings of a length class: ``where`` has each one's sampled steps, ``odds`` a number for each of its steps' bits.

    The pieces' keys are one tree with a root for each embedding: for each sample the sorted
    codes (node of the sample before, word); ``leaf[at[n] : at[n + 1]]`` are the pieces of leaf ``n``.
    """

    def __init__(self, where: list[np.ndarray], odds: list[np.ndarray], keys: list[np.ndarray], pieces: np.ndarray):
        self.where = np.stack(where)
        self.odds = np.ones((len(odds), max(map(len, odds))), dtype=np.uint64)
        for row, o in zip(self.odds, odds):
            row[: len(o)] = o
        every = np.concatenate(keys)
        node = np.repeat(np.arange(len(keys)), len(pieces))
        self.levels = []
        for s in range(every.shape[1]):
            codes, node = np.unique((node << 32) + every[:, s], return_inverse=True)
            self.levels.append(codes)
        order = np.argsort(node, kind="stable")
        self.leaf, self.at = np.tile(pieces, len(keys))[order], np.searchsorted(node[order], np.arange(len(self.levels[-1]) + 1))

    def walk(self, words: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Pairs (row, leaf) of the windows, given by their first words, whose keys are in the tree: all embeddings step by step together."""
        found, last, n = [], len(words) - 1, len(self.where)
        plan = np.tile(np.arange(n), len(rows))
        rows = np.repeat(rows, n)
        place, node, due = rows, plan, self.where[plan, 0]
        sample = np.zeros(len(rows), dtype=np.int64)
        for step in range(self.odds.shape[1]):
            if not len(rows):
                break
            at = np.minimum(place, last)
            now = np.flatnonzero(due == step)
            if len(now):
                # only windows whose samples so far begin a key walk on
                stay, node = np.ones(len(rows), dtype=bool), node.copy()
                for s in np.unique(sample[now]).tolist():
                    mine = now[sample[now] == s]
                    code = (node[mine] << 32) + words[at[mine]]
                    to = np.minimum(np.searchsorted(self.levels[s], code), len(self.levels[s]) - 1)
                    good = self.levels[s][to] == code
                    stay[mine[~good]] = False
                    node[mine] = to
                    sample[mine] += 1
                    if s + 1 == len(self.levels):
                        stay[mine] = False
                        found.append(np.stack((rows[mine[good]], to[good]), axis=1))
                    else:
                        due[mine] = self.where[plan[mine], s + 1]
                rows, place, at, plan, node, due, sample = (x[stay] for x in (rows, place, at, plan, node, due, sample))
            place = place + _move(hashes[at], self.odds[plan, step])
        return found


def _samples(text: np.ndarray, hashes: np.ndarray, place: np.ndarray, where: np.ndarray, odds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sampled words of walks from ``place``; a walk waits at its end."""
    out, sample = np.empty((len(place), len(where)), dtype=np.int64), 0
    for step in range(int(where[-1]) + 1):
        at = np.minimum(place, ends)
        if step == where[sample]:
            out[:, sample] = text[at]
            sample += 1
        place = place + _move(hashes[at], odds[step])
    return out


class Items:
    """A block of items: vocabulary, pieces, length classes, and the keys of their embeddings."""

    def __init__(self, ids: list[int], texts: list[str], tolerance: float = TOLERANCE, repetitions: int = REPETITIONS, samples: int = SAMPLES, seed: int = 11):
        hashes, at = K.words([t.lower().encode("utf-8", "surrogatepass") for t in texts], K.ALNUM)
        self.tolerance, self.seed = tolerance, seed
        self.vocabulary = np.unique(hashes)
        number = np.searchsorted(self.vocabulary, hashes) + 1
        self.items = [(i, number[a:b].astype(np.int32)) for i, a, b in zip(ids, at[:-1], at[1:]) if b > a]
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.vocabulary >> np.uint64(44)] = True
        self.pieces: list[tuple[int, int, int]] = []  # (item, first word, words)
        for i, (_, words) in enumerate(self.items):
            cuts = np.linspace(0, len(words), 1 + (1 if len(words) <= LONG else -(-len(words) // PIECE))).astype(int)
            self.pieces += [(i, int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:])]
        pairs = [w[:-1].astype(np.int64) << 32 | w[1:] for _, w in self.items]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
        rng = np.random.default_rng(seed)
        self.classes = []
        order = sorted(range(len(self.pieces)), key=lambda p: (self.pieces[p][2], p))
        while order:
            low = self.pieces[order[0]][2]
            mine = [p for p in order if self.pieces[p][2] <= low * RATIO]
            order = order[len(mine) :]
            high = self.pieces[mine[-1]][2]
            # the class's own numbers of words; others are as good as unknown
            texts_ = [self._words(p) for p in mine]
            used = np.unique(np.concatenate(texts_))
            own = np.zeros(len(self.vocabulary) + 1, dtype=np.int32)
            own[used] = np.arange(1, len(used) + 1)
            texts_ = [own[t] for t in texts_]
            inside = np.zeros(len(self.pairs) + 1, dtype=bool)
            inside[np.searchsorted(self.pairs, np.concatenate([w[:-1].astype(np.int64) << 32 | w[1:] for w in map(self._words, mine)])) + 1] = True
            fewest = min(n - 1 - 2 * edits(n, tolerance) for n in range(low, high + 1))
            self.classes.append((low, high, own, inside, max(0, fewest), self._plans(np.array(mine), texts_, 2 * low, repetitions, samples, rng)))

    def _words(self, piece: int) -> np.ndarray:
        i, a, n = self.pieces[piece]
        return self.items[i][1][a : a + n]

    def _plans(self, mine: np.ndarray, texts: list[np.ndarray], steps: int, repetitions: int, samples: int, rng: np.random.Generator) -> Plans:
        """Embeddings are added until enough of the trials, pieces with the most edits allowed, are found, as longer pieces need more of them."""
        text, start, end = _joined(texts)
        hashes = _bits(text, self.seed)
        trials, truth = [], np.arange(TRIALS) % len(texts)
        for t in truth.tolist():
            words = texts[t].tolist()
            for _ in range(edits(len(words), self.tolerance)):
                at = int(rng.integers(len(words)))
                words[at : at + 1] = [[], [0], [0, words[at]]][rng.integers(3)]
            trials.append(np.array(words, dtype=np.int32))
        tried, first, last = _joined(trials)
        their = _bits(tried, self.seed)
        starts = np.array([min(len(w), 1 + edits(len(texts[t]), self.tolerance)) for t, w in zip(truth, trials)])
        trial = np.repeat(np.arange(TRIALS), starts)
        place = np.concatenate([np.arange(n) for n in starts]) + first[trial]
        missed, plans = np.ones(TRIALS, dtype=bool), ([], [], [])
        while len(plans[0]) < repetitions or missed.sum() > (1 - RECALL) * TRIALS and len(plans[0]) < MOST:
            # one position from each stretch of the walk; the first is short, as most windows end there, but longer than an edit
            cuts = np.unique(np.concatenate(([0], np.linspace(min(max(4, steps // 12), steps), steps, min(samples, steps)))).astype(int))
            where = np.array([rng.integers(a, b) for a, b in zip(cuts[:-1], cuts[1:])])
            odds = rng.integers(0, 1 << 63, int(where[-1]) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            keys = _samples(text, hashes, start, where, odds, end)
            for column, value in zip(plans, (where, odds, keys)):
                column.append(value)
            open_ = missed[trial]
            good = (_samples(tried, their, place[open_], where, odds, last[trial[open_]]) == keys[truth[trial[open_]]]).all(axis=1)
            missed[trial[open_][good]] = False
        return Plans(*plans, mine)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1, and 0 for other words."""
        out = np.zeros(len(hashes), dtype=np.int32)
        at = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        place = np.searchsorted(self.vocabulary, hashes[at])
        place[place == len(self.vocabulary)] = 0
        good = self.vocabulary[place] == hashes[at]
        out[at[good]] = place[good] + 1
        return out

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """``(first word of the item as the piece has it, number of the item, first word of the piece)`` where keys agree; ``words`` has zeros after each text."""
        found = []
        last = len(words)
        pair = np.zeros(last, dtype=np.int64)  # numbers of pairs from 1, and 0
        if len(self.pairs):
            at = np.flatnonzero((words[:-1] > 0) & (words[1:] > 0))
            code = words[at].astype(np.int64) << 32 | words[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            pair[at] = np.where(self.pairs[place] == code, place + 1, 0)
        offset = np.array([a for _, a, _ in self.pieces])
        item = np.array([i for i, _, _ in self.pieces])
        for low, high, own, inside, fewest, plans in self.classes:
            # a piece has at most a few words that the text lacks, and they are of its class's vocabulary
            padded = np.concatenate((own[words], np.zeros(1, dtype=np.int32)))
            reach = high + edits(high, self.tolerance)
            ends = np.minimum(np.arange(last) + reach, last)
            two = np.concatenate(([0], np.cumsum(inside[pair], dtype=np.int32)))
            alive = np.flatnonzero(two[np.maximum(ends - 1, 0)] - two[:-1] >= fewest)
            known = np.concatenate(([0], np.cumsum(padded[:-1] > 0, dtype=np.int32)))
            alive = alive[known[ends[alive]] - known[alive] >= low - edits(low, self.tolerance)]
            if not len(alive):
                continue
            hashes = _bits(padded, self.seed)
            step = max(1, ENTRIES // len(plans.where))
            for lo in range(0, len(alive), step):
                for row, leaf in (x.T for x in plans.walk(padded, hashes, alive[lo : lo + step])):
                    first, size = plans.at[leaf], plans.at[leaf + 1] - plans.at[leaf]
                    piece = plans.leaf[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    row = np.repeat(row, size)
                    found.append(np.stack((row - offset[piece], item[piece], row), axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in one array with a zero after each, and where they start and end."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    out = np.zeros(ends[-1] + 1, dtype=np.int32)
    out[np.repeat(ends - sizes - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.concatenate(texts)
    return out, ends - sizes, ends


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between the item and any part of the text: ``(distance, start, end)``; the first and shortest such part."""
    n = len(text)
    row, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    place = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        swap = row[:-1] + (text != word)
        drop = row[1:] + 1
        new, frm = np.empty(n + 1, dtype=np.int64), np.empty(n + 1, dtype=np.int64)
        new[0], frm[0] = i, 0
        take = swap <= drop
        new[1:] = np.where(take, swap, drop)
        frm[1:] = np.where(take, start[:-1], start[1:])
        # insertions: the running least of (value - place)
        base = (new - place) * (n + 2) - frm  # of equal values the latest start
        best = np.minimum.accumulate(base)
        value = -(-best // (n + 2))
        row, start = value + place, value * (n + 2) - best
    end = int(np.argmin(row))
    return int(row[end]), int(start[end]), end


def matches(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int]]:
    """``(text, item id, first word, words, edits)`` of the passages, overlapping ones of an item merged to the best."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    out = []
    for lo, hi in K.batches([len(t) for t in raw], CHUNK):
        hashes, at = K.words(raw[lo:hi], K.ALNUM)
        number = items.number(hashes)
        gap = np.arange(hi - lo)
        # a zero after each text keeps its words together
        words = np.zeros(len(number) + hi - lo, dtype=np.int32)
        count = np.diff(at)
        text = np.repeat(gap, count)
        words[np.arange(len(number)) + text] = number
        begin = at[:-1] + gap
        seen: dict[tuple[int, int], list[int]] = {}
        for start, item, there in items.candidates(words).tolist():
            # of a piece the item's own start may lie before the text
            t = int(np.searchsorted(begin, there, side="right")) - 1
            seen.setdefault((t, item), []).append(start)
        for (t, item), starts in sorted(seen.items()):
            name, pattern = items.items[item]
            most = edits(len(pattern), items.tolerance)
            best: list[list[int]] = []
            done = -1
            for s in sorted(set(starts)):
                if s + most < done:
                    continue
                a, z = max(int(begin[t]), s - 2 * most), min(int(begin[t] + count[t]), s + len(pattern) + 3 * most)
                d, x, y = align(pattern, words[a:z])
                if d <= most:
                    first, size = int(a - begin[t]) + x, y - x
                    if best and first < best[-1][0] + best[-1][1]:
                        if d < best[-1][2]:
                            best[-1] = [first, size, d]
                    else:
                        best.append([first, size, d])
                    done = begin[t] + first + max(1, size // 2)
            out += [(lo + t, name, *b) for b in best]
    return out


def _finders(docs: DataFrame, benchmark: DataFrame, tolerance: float, repetitions: int) -> tuple[list, StructType]:
    """A function of a text column for each block of items, which lists the passages that match."""
    bounded_batches(docs.sparkSession)
    passage = StructType([StructField("item_id", benchmark.schema["item_id"].dataType), *[StructField(c, LongType()) for c in ("first_word", "n_words", "distance")]])

    def finder(block):
        shared = docs.sparkSession.sparkContext.broadcast(Items([r[0] for r in block], [r[1] for r in block], tolerance, repetitions))  # of bounded size

        @F.pandas_udf(ArrayType(passage))
        def find(texts: pd.Series) -> pd.Series:
            found: list[list] = [[] for _ in texts]
            for t, *match in matches([t if isinstance(t, str) else "" for t in texts], shared.value):
                found[t].append(dict(zip(passage.names, match)))
            release()
            return pd.Series(found)

        return find

    finders, block = [], []
    for r in benchmark.select("item_id", "text").where("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator():
        block.append(r)
        if len(block) == ITEMS:
            finders.append(finder(block))
            block = []
    return finders + ([finder(block)] if block else []), passage


def contaminated(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, repetitions: int = REPETITIONS) -> DataFrame:
    """``(doc_id, item_id, first_word, n_words, distance)``: passages of ``docs(doc_id, text)`` that match items of ``benchmark(item_id, text)``.

    ``first_word`` counts words from 0. Null texts on either side match nothing, nor
    do items without words; items of fewer than five words must occur
    exactly. Items are a stated query set and are held against all rows in
    blocks of fixed size. Rows that repeat each give their matches; other columns
    are ignored.
    """
    docs = docs.select("doc_id", "text")
    finders, passage = _finders(docs, benchmark, tolerance, repetitions)
    out = docs.limit(0).select("doc_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in passage])
    for find in finders:
        part = docs.where("text is not null").select("doc_id", F.explode(find("text")).alias("m")).select("doc_id", "m.*")
        out = part if find is finders[0] else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, repetitions: int = REPETITIONS) -> DataFrame:
    """``docs`` without the rows that hold a passage of an item: a filter, nothing is joined or shuffled."""
    out = docs
    for find in _finders(docs, benchmark, tolerance, repetitions)[0]:
        out = out.where(F.size(find("text")) == 0)
    return out
