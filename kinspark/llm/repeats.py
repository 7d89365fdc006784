"""Removal of repeated byte strings, by depth-limited radix sort of suffixes.

A byte goes if a string of SPAN bytes that covers it also starts in a document
with a smaller doc_id. Suffixes are ordered only through SPAN bytes, by passes
over digits of them from the most significant on (a digit is the 64-bit hash of
its bytes: only equality counts); a pass keeps what still has an equal. In the
groups left after the last, every string's bytes are compared with the first's,
so they are exactly the repeated strings.

Sorting every suffix of a corpus would shuffle many times its bytes. So each
string is filed under one of its GRAM-byte grams (the least by hash, a choice
that its own bytes determine), and the work takes three steps:

1. Grams: every task sends the grams of its texts, without those it knows to be
   shared, and learns which occur in different texts.
2. Strings: texts whose grams are shared send the strings filed under those,
   overlapping ones as one stretch of bytes; the radix sort of each part finds
   equal ones and the smallest doc_id of each.
3. The starts of repeated strings go to their documents, which are cut.

What many documents have in common is reduced before it is shuffled: of equal
strings that one task holds, only that of the smallest doc_id is sent. Equal
texts are settled apart: all but the smallest doc_id's are repeats as a whole.

Rows travel as compressed arrays of many documents, addressed to parts. There are
as many parts as shuffle partitions, but not more than one for PART_BYTES of text, so
that no row is made for a handful of bytes: a task sends a part one row for every
HOLD bytes, and a part works through its strings in SHARES, one at a time.

Defined results: null texts count as empty; texts shorter than SPAN stay whole;
rows without doc_id stay whole and make nothing a repeat; rows of one doc_id
make no repeats of each other; other columns are carried by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import Rolling, mix, take_runs, words_at
from .scratch import partitions, ship, tidy

SPAN, GRAM = 50, 20
DIGITS = ((0, 16), (16, 33), (33, 50))
#: Bytes of a text's SHA-256.
DIGEST = 32
#: Bytes of text in one array, and of texts whose grams are merged before they are sent.
FLUSH, HOLD = 1_000_000, 16_000_000
#: Strings of a part are sorted in so many shares, one at a time.
SHARES = 8
#: Text that a part has at least.
PART_BYTES = 1_000_000
FIRSTS, NOTES, TEXTS, WORK = range(4)
ROWS = "part int, kind int, blob binary"


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed byte string; ``spread`` needs their types."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(r) for r in raw], "<u8").tobytes() + b"".join(raw))


def spread(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<u8", len(kinds)).astype(np.int64)
    at = np.cumsum(np.concatenate([[8 * len(kinds)], sizes]))
    return [np.frombuffer(raw[a:b], k) for a, b, k in zip(at.tolist(), at[1:].tolist(), kinds, strict=False)]


def part_of(doc_ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc_ids.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def rows_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = list(zip(*rows, strict=True)) or ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["part", "kind", "blob"])


def slices_by(group: np.ndarray):
    """Order that sorts by group, and (group, first, last + 1) of each in that order."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)
    return order, [(int(g[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Texts:
    """Some texts as one array of bytes."""

    def __init__(self, raw: list[bytes]):
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def filed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every string of SPAN bytes that lies in one text: where it starts,
        its text, where its least gram is, and that gram's hash."""
        n = len(self.bytes) - SPAN + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        self.rolling = Rolling(self.bytes)
        gram = self.rolling.windows(GRAM)
        # The least of SPAN - GRAM + 1 neighbours by the upper half of the hash, the leftmost of equals.
        least = gram >> np.uint64(32) << np.uint64(32) | np.arange(len(gram), dtype=np.uint64)
        width, have = SPAN - GRAM + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        mark = np.zeros(len(self.bytes) + 1, np.int8)
        reach = np.maximum(self.ends - SPAN + 1, self.starts)
        np.add.at(mark, reach, 1)
        np.add.at(mark, self.ends, -1)
        start = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8)[:n] == 0)
        place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return start, np.searchsorted(self.ends, start, "right"), place, gram[place]


#: Places of the eight-byte words that make up SPAN bytes.
WORDS = (*range(0, SPAN - 8, 8), SPAN - 8)


def equals(values: np.ndarray, rolling: Rolling, start: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    """Whether the string at each start also stands at one of a smaller doc_id: the radix sort."""
    alive, key = np.arange(len(start)), None
    for a, b in DIGITS:
        at = start[alive]
        digit = rolling.slices(at + a, at + b)
        key = digit if key is None else mix(key ^ digit * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        has = np.zeros(len(order), bool)
        has[1:] |= same
        has[:-1] |= same
        keep = np.sort(order[has])
        alive, key = alive[keep], key[keep]
    out = np.zeros(len(start), bool)
    if len(alive):
        order = np.argsort(key)
        alive, key = alive[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        docs, at = doc_ids[alive], start[alive]
        smallest = np.repeat(np.minimum.reduceat(docs, first), size)
        out[alive] = docs > smallest
        head = np.repeat(at[first], size)
        view, differs = words_at(values), np.zeros(len(at), bool)
        for k in WORDS:
            differs |= view[at + k] != view[head + k]
        for g in np.unique(np.repeat(np.arange(len(first)), size)[differs]).tolist():  # strings with one hash
            own = np.arange(first[g], first[g] + size[g])
            spelt = [values[i : i + SPAN].tobytes() for i in at[own].tolist()]
            least: dict[bytes, int] = {}
            for w, d in zip(spelt, docs[own].tolist(), strict=True):
                least[w] = min(least.get(w, d), d)
            out[alive[own]] = [d > least[w] for w, d in zip(spelt, docs[own].tolist(), strict=True)]
    return out


def runs_of(*keys: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and sizes of runs of neighbouring starts with equal keys."""
    new = np.ones(len(start), bool)
    new[1:] = start[1:] != start[:-1] + 1
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(start)))


def by_part(batches):
    """(part, rows of it as (kind, blob)) from rows sorted by part."""
    part, rows = None, []
    for batch in batches:
        for p, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob")), strict=True):
            if p != part and rows:
                yield part, rows
                rows = []
            part = p
            rows.append((kind, blob))
    if rows:
        yield part, rows


def digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def documents_in(batch: pa.RecordBatch):
    """(doc_id, bytes) of the rows that have a doc_id."""
    for i in range(0, batch.num_rows, 256):
        some = batch.slice(i, 256)
        for d, t in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
            if d is not None:
                yield d, (t or "").encode()


def flushes(pairs, limit: int = FLUSH):
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def addressed(docs: DataFrame, parts: int, carry: bool = False) -> DataFrame:
    """The documents' texts, packed by part; with all other columns if ``carry``."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            rest, done = batch.drop_columns(["text"]), 0
            for held in flushes(documents_in(batch), HOLD):
                ids = np.array([d for d, _ in held], np.int64)
                others = rest.slice(done, len(held))
                done += len(held)
                order, groups = slices_by(part_of(ids, parts))
                rows = []
                for part, a, b in groups:
                    own = [held[i][1] for i in order[a:b]]
                    size = np.fromiter(map(len, own), np.int64, len(own))
                    table = pa.Table.from_batches([others.take(pa.array(order[a:b]))]) if carry else None
                    packed = np.frombuffer(written(table), np.uint8) if carry else np.zeros(0, np.uint8)
                    rows.append((part, TEXTS, squeezed(ids[order[a:b]], size, np.frombuffer(b"".join(own), np.uint8), packed)))
                yield rows_of(rows)

    return docs.mapInArrow(tidy(run), ROWS)


def written(table: pa.Table) -> pa.Buffer:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()


def texts_in(blob: bytes) -> list[tuple[int, bytes]]:
    ids, size, raw, _ = spread(blob, "<i8", "<i8", "u1", "u1")
    raw, ends = raw.tobytes(), np.cumsum(size).tolist()
    return [(d, raw[e - n : e]) for d, n, e in zip(ids.tolist(), size.tolist(), ends, strict=True)]


def first_of_each(docs: DataFrame, parts: int) -> DataFrame:
    """The smallest doc_id of each distinct text, packed by part."""
    firsts = docs.where("doc_id IS NOT NULL").groupBy(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")).agg(F.min("doc_id").alias("doc_id"))

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            sums = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(-1, DIGEST)
            order, groups = slices_by(part_of(ids, parts))
            yield rows_of([(part, FIRSTS, squeezed(ids[order[a:b]], sums[order[a:b]])) for part, a, b in groups])

    return firsts.mapInArrow(tidy(run), ROWS)


def notes(kind: int, doc_ids: np.ndarray, values: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Rows that take values (uint32, or pairs of them) to their documents' parts."""
    order = np.lexsort((doc_ids, part := part_of(doc_ids, parts)))
    part, doc_ids, values = part[order], doc_ids[order], values[order]
    out = []
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        ids, count = np.unique(doc_ids[a:b], return_counts=True)
        out.append((int(part[a]), kind, squeezed(ids, count.astype("<u4"), values[a:b].astype("<u4"))))
    return out


def noted(blobs: list[bytes], width: int = 1) -> dict[int, list[np.ndarray]]:
    """Values by document, from rows made by ``notes``."""
    out: dict[int, list[np.ndarray]] = {}
    for blob in blobs:
        ids, count, values = spread(blob, "<i8", "<u4", "<u4")
        values = values.reshape(-1, width)
        ends = np.cumsum(count).tolist()
        for d, a, b in zip(ids.tolist(), [0, *ends], ends, strict=False):
            out.setdefault(d, []).append(values[a:b])
    return out


def send_grams(docs: DataFrame, parts: int) -> DataFrame:
    """Step 1, in the tasks that read texts: grams to the parts of their hashes."""

    def run(batches):
        for batch in batches:
            for group in flushes(documents_in(batch), HOLD):
                smallest: dict[bytes, tuple[int, bytes]] = {}
                for d, raw in group:
                    if len(raw) >= SPAN:
                        key = digest(raw)
                        if key not in smallest or d < smallest[key][0]:
                            smallest[key] = (d, raw)
                held = [(k, d, raw) for k, (d, raw) in smallest.items()]
                if not held:
                    continue
                ids = np.array([d for _, d, _ in held], np.int64)
                sums = np.frombuffer(b"".join(k for k, _, _ in held), "<u8").reshape(-1, 2)[:, 0]
                grams, owners, done = [], [], 0
                for some in flushes(((raw,) for _, _, raw in held)):
                    _, text, place, gram = Texts([raw for (raw,) in some]).filed()
                    new = np.ones(len(place), bool)
                    new[1:] = place[1:] != place[:-1]
                    grams.append(mix(gram[new]))
                    owners.append(text[new] + done)
                    done += len(some)
                gram, owner = np.concatenate(grams), np.concatenate(owners)
                order = np.argsort(gram)
                gram, owner = gram[order], owner[order]
                if not len(gram):
                    continue
                first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                size = np.diff(np.append(first, len(gram)))
                many = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
                rows = []
                shared = np.repeat(many, size)
                rows += notes(NOTES, ids[owner[shared]], (gram[shared] >> np.uint64(32)).astype("<u4"), parts)
                single, common = gram[first[~many]], gram[first[many]]
                owner = owner[first[~many]]
                at = (single % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((owner, at))
                at, owner, single = at[order], owner[order], (single[order] >> np.uint64(32)).astype("<u4")
                to = (common % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, common = to[order], (common[order] >> np.uint64(32)).astype("<u4")
                for part in np.union1d(at, to).tolist():
                    a, b = np.searchsorted(at, [part, part + 1])
                    c, d = np.searchsorted(to, [part, part + 1])
                    own, count = np.unique(owner[a:b], return_counts=True)
                    rows.append((part, WORK, squeezed(ids[own], sums[own], count.astype("<u4"), single[a:b], common[c:d])))
                yield rows_of(rows)

    return docs.mapInArrow(tidy(run), ROWS)


def find_grams(sent: DataFrame, parts: int) -> DataFrame:
    """Step 1, in the parts: notes to documents of which of their grams other texts have too."""

    def run(batches):
        for _, rows in by_part(batches):
            out = [(p, NOTES, blob) for p, kind, blob in ((_, k, b) for k, b in rows) if kind == NOTES]
            grams, docs, sums, common = [], [], [], []
            for kind, blob in rows:
                if kind == WORK:
                    ids, own, count, single, many = spread(blob, "<i8", "<u8", "<u4", "<u4", "<u4")
                    grams += [single, many]
                    docs += [np.repeat(ids, count), np.full(len(many), -1)]
                    sums += [np.repeat(own, count), np.zeros(len(many), np.uint64)]
                    common += [np.zeros(len(single), bool), np.ones(len(many), bool)]
            if grams:
                gram, doc, own, many = (np.concatenate(x) for x in (grams, docs, sums, common))
                order = np.argsort(gram)
                gram, doc, own, many = gram[order], doc[order], own[order], many[order]
                if len(gram):
                    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                    size = np.diff(np.append(first, len(gram)))
                    shared = (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)) | np.logical_or.reduceat(many, first)
                    tell = np.repeat(shared, size) & ~many
                    out += notes(NOTES, doc[tell], gram[tell], parts)
            if out:
                yield rows_of(out)

    return sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(run), ROWS)


def by_documents(rows):
    """Which digests each doc_id is the first of, and the blobs of notes and texts, of one part."""
    firsts: dict[int, set[bytes]] = {}
    said, texts = [], []
    for kind, blob in rows:
        if kind == FIRSTS:
            ids, sums = spread(blob, "<i8", "u1")
            raw = sums.tobytes()
            for i, d in enumerate(ids.tolist()):
                firsts.setdefault(d, set()).add(raw[DIGEST * i : DIGEST * (i + 1)])
        elif kind == NOTES:
            said.append(blob)
        else:
            texts.append(blob)
    return firsts, said, texts


def send_strings(rows: DataFrame, parts: int) -> DataFrame:
    """Step 2, in the parts of documents: stretches of strings filed under shared grams,
    to the parts of the grams; repeats that are seen here go to their documents at once."""

    def by_part_rows(found: list[tuple[np.ndarray, ...]]) -> list[tuple[int, int, bytes]]:
        """A row for each part: its stretches by share, and how many each share has."""
        to, doc, at, count = (np.concatenate(x) for x in list(zip(*found, strict=True))[:4])
        raw = np.concatenate([x[4] for x in found])
        size = count.astype(np.int64) + SPAN - 1
        begin = np.cumsum(size) - size
        order, out = np.argsort(to, kind="stable"), []
        to = to[order]
        edges = np.searchsorted(to, np.arange(parts + 1) * SHARES)
        for part in np.flatnonzero(np.diff(edges)).tolist():
            i = order[edges[part] : edges[part + 1]]
            shares = np.bincount(to[edges[part] : edges[part + 1]] - part * SHARES, minlength=SHARES).astype("<i8")
            out.append((part, WORK, squeezed(shares, doc[i], at[i], count[i], take_runs(raw, begin[i], size[i]))))
        return out

    def run(batches):
        for _, own in by_part(batches):
            firsts, said, blobs = by_documents(own)
            grams = noted(said)

            def wanted(firsts=firsts, grams=grams, blobs=blobs):
                for blob in blobs:
                    for d, raw in texts_in(blob):
                        key = digest(raw)
                        if d in grams and key in firsts.get(d, ()):
                            firsts[d].discard(key)  # a row that repeats it adds nothing
                            yield d, raw

            found: list[tuple[np.ndarray, ...]] = []
            gone_doc, gone_runs = [], []
            for held in flushes(wanted()):
                ids = np.array([d for d, _ in held], np.int64)
                texts = Texts([raw for _, raw in held])
                start, text, place, gram = texts.filed()
                gram = mix(gram)
                short = (gram >> np.uint64(32)).astype("<u4")
                edges = np.searchsorted(text, np.arange(len(ids) + 1)).tolist()
                keep = np.zeros(len(start), bool)
                for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    keep[a:b] = np.isin(short[a:b], np.concatenate(grams[int(ids[i])]).reshape(-1))
                start, text, place, gram = start[keep], text[keep], place[keep], gram[keep]
                if not len(start):
                    continue
                gone = equals(texts.bytes, texts.rolling, start, ids[text])
                if gone.any():
                    doc, runs = told(start[gone], text[gone], texts, ids)
                    gone_doc.append(doc)
                    gone_runs.append(runs)
                start, text, place, gram = start[~gone], text[~gone], place[~gone], gram[~gone]
                first, count = runs_of(place, text, start=start)
                s, t = start[first], text[first]
                to = (gram[first] % np.uint64(parts * SHARES)).astype(np.int64)
                found.append((to, ids[t], (s - texts.starts[t]).astype("<u4"), count.astype("u1"), take_runs(texts.bytes, s, count + SPAN - 1)))
                if sum(len(x[4]) for x in found) >= HOLD:
                    yield rows_of(by_part_rows(found))
                    found = []
            out = by_part_rows(found) if found else []
            if gone_doc:
                out += notes(NOTES, np.concatenate(gone_doc), np.concatenate(gone_runs), parts)
            if out:
                yield rows_of(out)

    return rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(tidy(run), ROWS)


def told(start: np.ndarray, text: np.ndarray, texts: Texts, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and runs (first start, how many) of repeated strings."""
    first, count = runs_of(text, start=start)
    return ids[text[first]], np.stack([start[first] - texts.starts[text[first]], count], 1)


def find_strings(sent: DataFrame, parts: int) -> DataFrame:
    """Step 2, in the parts of grams: the starts of repeated strings, to their documents."""

    def run(batches):
        for part, rows in by_part(batches):
            out = [(part, NOTES, blob) for kind, blob in rows if kind == NOTES]
            work = [spread(blob, "<i8", "<i8", "<u4", "u1", "u1") for kind, blob in rows if kind == WORK]
            ends = [np.concatenate([[0], np.cumsum(x[0])]) for x in work]  # of shares in stretches
            bytes_ = [np.concatenate([[0], np.cumsum(x[3].astype(np.int64) + SPAN - 1)])[e] for x, e in zip(work, ends, strict=True)]
            gone_doc, gone_runs = [], []
            for share in range(SHARES) if work else ():
                docs, at, count = (np.concatenate([x[k][e[share] : e[share + 1]] for x, e in zip(work, ends, strict=True)]) for k in (1, 2, 3))
                raw = np.concatenate([x[4][e[share] : e[share + 1]] for x, e in zip(work, bytes_, strict=True)])
                if not len(docs):
                    continue
                count = count.astype(np.int64)
                size = count + SPAN - 1
                begin = np.cumsum(size) - size
                step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                gone = equals(raw, Rolling(raw), np.repeat(begin, count) + step, np.repeat(docs, count))
                doc, start = np.repeat(docs, count)[gone], (np.repeat(at, count) + step)[gone]
                first, n = runs_of(doc, start=start)
                gone_doc.append(doc[first])
                gone_runs.append(np.stack([start[first], n], 1))
            if gone_doc:
                out += notes(NOTES, np.concatenate(gone_doc), np.concatenate(gone_runs), parts)
            if out:
                yield rows_of(out)

    return sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(run), ROWS)


def covered(runs: list[np.ndarray], size: int) -> tuple[np.ndarray, int]:
    """Which bytes repeated strings cover, and in how many runs of bytes."""
    mark = np.zeros(size + 1, np.int64)
    for x in runs:
        x = x.astype(np.int64)
        np.add.at(mark, x[:, 0], 1)
        np.add.at(mark, x[:, 0] + x[:, 1] + SPAN - 1, -1)
    out = np.cumsum(mark[:-1]) > 0
    return out, int(out[0]) + int((out[1:] & ~out[:-1]).sum()) if size else 0


def gathered(whole: DataFrame, carry: bool = False) -> tuple[DataFrame, int]:
    """Texts, firsts and starts of repeated strings, by part."""
    spark = whole.sparkSession
    ship(spark)
    docs = whole.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(partitions(spark), size // PART_BYTES))
    firsts = first_of_each(docs, parts)
    grams = find_grams(send_grams(docs, parts), parts)
    starts = find_strings(send_strings(firsts.union(grams).union(addressed(docs, parts)), parts), parts)
    return firsts.union(starts).union(addressed(whole if carry else docs, parts, carry)), parts


def cuts(rows):
    """Per blob of one part's documents, (doc_id, bytes, what stays, number of removed runs) of each."""
    firsts, said, blobs = by_documents(rows)
    starts = noted(said, 2)
    for blob in blobs:
        out = []
        for d, raw in texts_in(blob):
            kept, spans = raw, 0
            if len(raw) >= SPAN and digest(raw) not in firsts.get(d, ()):
                kept, spans = b"", 1
            elif d in starts and len(raw) >= SPAN:
                gone, spans = covered(starts[d], len(raw))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((d, raw, kept, spans))
        yield blob, out


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed(docs: DataFrame) -> DataFrame:
    """What is removed from every document, and the hash of what stays."""
    rows, parts = gathered(docs)

    def run(batches):
        for _, own in by_part(batches):
            for _, out in cuts(own):
                cols = list(zip(*((d, len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()) for d, raw, kept, n in out), strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in OUT.split(", ")])

    found = rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(tidy(run), OUT)
    text = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.where("doc_id IS NULL").select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return found.unionByName(whole)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings cut out of their texts; a character of which a part goes, goes."""
    rows, parts = gathered(docs, carry=True)
    names = docs.columns

    def run(batches):
        for _, own in by_part(batches):
            for blob, out in cuts(own):
                *_, packed = spread(blob, "<i8", "<i8", "u1", "u1")
                others = pa.ipc.open_stream(packed.tobytes()).read_all()
                text = pa.array([kept.decode("utf-8", "ignore") for _, _, kept, _ in out], pa.string())
                table = pa.table([text if c == "text" else others.column(c) for c in names], names)
                yield from table.combine_chunks().to_batches()

    found = rows.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(tidy(run), docs.schema)
    return found.unionByName(docs.where("doc_id IS NULL"))
