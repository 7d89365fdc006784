"""Language identification by cross-parsing.

A suffix automaton per language holds a bounded sample of its labelled text. A
text is parsed greedily into the longest phrases that occur in the sample; the
fewer phrases it needs (times log2 of the sample's size, per character), the
closer the language. Every letter of a sample counts. The automata are transition
tables over the DENSE most frequent letters and sorted keys for the others, and
numpy walks all languages over thousands of text segments at once; a parse starts
anew at each segment of SEGMENT characters, so long texts are read whole.

Texts are compared in lower case, with each run of other characters than
letters as one space.

Defined results: null text and text without a letter are ``und`` with score 0;
with nothing to learn from, every text is; null doc_ids and repeated rows are
kept; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import texts_of
from .pretokens import LETTER, classes, points_of
from .ragged import chunks
from .scratch import ship

SEGMENT = 1024
DENSE = 62
#: Characters that are learned from: of a language, and of all together, which bounds the tables however many languages there are.
SAMPLE_CHARS, TOTAL_CHARS = 40_000, 400_000
CHUNK = 2_000_000


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, 32 for each run of other characters; and lengths."""
    low = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    points = points_of(low)
    letter = classes()[points] == LETTER
    head = np.zeros(len(points), bool)
    head[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= head
    where = np.cumsum(np.concatenate([[0], keep]))
    edges = where[np.concatenate([[0], np.cumsum(lengths)])]
    return np.where(letter, points, 32)[keep], np.diff(edges)


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    next_, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(next_)
        next_.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in next_[p]:
            next_[p][c] = new
            p = link[p]
        if p >= 0:
            q = next_[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(next_)
                next_.append(dict(next_[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and next_[p].get(c) == q:
                    next_[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return next_


class Model:
    """Tables of all languages in one array; a negative entry begins a new phrase."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        folds = {k: folded([samples[k]])[0] for k in self.languages}
        common = Counter()
        for points in folds.values():
            common.update(points.tolist())
        known = [c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])) if c != 32]
        self.codes = len(known) + 2  # 0: letters of no sample, 1: space
        self.width = min(self.codes, DENSE + 2)  # codes from here on are looked up by keys
        self.code = np.zeros(0x110000, np.int32)
        self.code[32] = 1
        self.code[known] = np.arange(2, self.codes)
        tables, self.roots, self.bits, base = [], [], [], 0
        keys, targets, firsts = [], [], []
        for k in self.languages:
            codes = self.code[folds[k]]
            states = automaton(codes.tolist())
            # One state more than the automaton's: where the next character begins a phrase.
            begin = base + len(states)
            table = np.full((len(states) + 1, self.width), -1, np.int32)
            rare = np.full(self.codes - self.width, ~begin, np.int32)
            for i, row in enumerate(states):
                for c, to in row.items():
                    if c < self.width:
                        table[i, c] = base + to
                    else:
                        keys.append((base + i) * self.codes + c)
                        targets.append(base + to)
                        if i == 0:
                            rare[c - self.width] = ~(base + to)
            first = np.where(table[0] >= 0, table[0], begin)
            table = np.where(table >= 0, table, ~first)
            tables.append(table)
            firsts.append(rare)
            self.roots.append(begin)
            self.bits.append(math.log2(max(len(codes), 2)))
            base = begin + 1
        self.table = np.concatenate(tables).astype(np.int32).reshape(-1) if tables else np.zeros(0, np.int32)
        self.roots, self.bits = np.array(self.roots, np.int32), np.array(self.bits)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]
        self.firsts = np.array(firsts, np.int32).reshape(len(tables), self.codes - self.width)

    def steps(self, state: np.ndarray, codes: np.ndarray, rare: bool) -> np.ndarray:
        """The states that follow; of codes from ``width`` on by their keys."""
        if not rare:
            return self.table.take(state * self.width + codes)
        to = self.table.take(state * self.width + np.where(codes < self.width, codes, 0))
        at = np.flatnonzero(codes >= self.width)
        if len(at):
            key = state[:, at].astype(np.int64) * self.codes + codes[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[:, at] = np.where(self.keys[place] == key, self.targets[place], self.firsts[:, codes[at] - self.width])
        return to

    def phrases(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each language (rows) in each segment (columns)."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state = np.repeat(self.roots[:, None], len(start), 1)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
        rare = bool((codes >= self.width).any())
        for step, k in enumerate(active.tolist()):
            to = self.steps(state[:, :k], codes[start[:k] + step], rare)
            new = to < 0
            count[:, :k] += new
            state[:, :k] = np.where(new, ~to, to)
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text (columns) in each language (rows); letters and spaces of each text."""
        points, lengths = folded(texts)
        codes = self.code[points]
        n = -(-lengths // SEGMENT)
        first = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = first[owner] + step * SEGMENT
        size = np.minimum(SEGMENT, lengths[owner] - step * SEGMENT)
        total = np.zeros((len(self.languages), len(texts)))
        if len(start):
            for row, counts in zip(total, self.phrases(codes, start, size), strict=True):
                np.add.at(row, owner, counts)
        letters = np.zeros(len(texts), np.int64)
        if len(points):
            ends = np.concatenate([[0], np.cumsum(points != 32)])
            letters = ends[first + lengths] - ends[first]
        return total * self.bits[:, None] / np.maximum(lengths, 1), letters


def samples(labelled: DataFrame, chars: int = SAMPLE_CHARS, most: int = TOTAL_CHARS) -> dict[str, str]:
    """About ``chars`` characters of each language, fewer where all would be more than ``most``: whole documents in the order of a hash of doc_id."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    totals = rows.groupBy("lang").agg(F.count("text").alias("n"), F.sum(F.char_length("text")).alias("chars")).collect()  # a row a language
    chars = max(1, min(chars, most // max(1, len(totals))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    share = F.lit(None).cast("double")
    for r in totals:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, max(4 * chars / r["chars"], 64 / r["n"])))).otherwise(share)
    drawn = rows.where(draw < share * (1 << 32)).select("lang", draw.alias("draw"), F.substring("text", 1, chars).alias("text"))
    out: dict[str, str] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["draw"], r["text"])):
        have = out.get(r["lang"], "")
        if len(have) < chars:
            out[r["lang"]] = (have + "\n" + r["text"])[:chars]
    return out


def identify(docs: DataFrame, learned: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred and score of every document. The tables are made once and broadcast: at most
    two states for each of TOTAL_CHARS characters, of DENSE + 2 numbers of four bytes (200 MB), whatever the input and its languages."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Model(learned))

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = texts_of(batch)
            names, scores = [], []
            for a, b in chunks(texts, CHUNK):
                if not model.languages:
                    names += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                bits, letters = model.entropies(texts[a:b])
                best = bits.argmin(0)
                # Softmax over bits saved, with evidence of at most 64 characters.
                weight = np.exp2(-(bits - bits.min(0)) * np.minimum(letters, 64))
                scores += np.where(letters > 0, weight.max(0) / weight.sum(0), 0.0).tolist()
                names += [model.languages[i] if n else "und" for i, n in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def evaluate(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those whose crc32 modulo 3 isn't 1."""
    learned = samples(docs.where("doc_id IS NOT NULL").where(~held_out(3, 1)).select("doc_id", "lang", "text"))
    return identify(docs, learned).withColumn("held_out", held_out(3, 1)).select("doc_id", "held_out", "lang_pred", "score")
