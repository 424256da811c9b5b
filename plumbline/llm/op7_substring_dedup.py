"""Substring deduplication: runs of words that also stand earlier in the corpus, by FM-indexes of shards."""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.lineage import cut
from plumbline.llm.common import query, table
from plumbline.llm.fm_index import FMIndex
from plumbline.llm.words import rolling_hashes, texts

#: Words of an anchor. Every window has one anchor, so equal windows have equal ones, at the same place in the window.
ANCHOR = 6
#: Words of a shard on average; copies of an anchor above which its windows are dealt out one by one, by a sample of documents of
#: which so many such copies are seen; anchors told so at most.
SHARD_WORDS, HOT, SEEN, FREQUENT = 400_000, 5_000, 64, 50_000
#: Rows of arrays of places that are broadcast at most, and places in them.
BROADCAST_ROWS, BROADCAST_PLACES = 400_000, 20_000_000

ANCHORS = "doc_id long, h int, anchor long, mark long"
PIECES = "route long, doc_id long, start int, h int, words string"
FIRSTS = "doc_id long, h int, code long"


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, as texts and words of whole ones take much memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def anchors_of(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ANCHOR words; for each window, the place of the least one in it (the first of equals)."""
    hashes = rolling_hashes(words, ANCHOR)
    least, at, reach = hashes, np.arange(len(hashes)), 1
    width = window - ANCHOR + 1
    while reach < width:
        step = min(reach, width - reach)
        right = least[step:] < least[:-step]
        at, least = np.where(right, at[step:], at[:-step]), np.where(right, least[step:], least[:-step])
        reach += step
    return hashes, at


def _anchors(window: int, frequent: np.ndarray):
    """The anchors of each text. ``mark`` holds the first of the windows of an anchor, which follow each other, how many these
    are, where in the first one the anchor is, and whether it is ``frequent``. Such ones are not counted, but spread."""
    width = window - ANCHOR + 1

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            parts = []
            for doc, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), texts(batch)):
                words = text.split()
                if len(words) >= window:
                    hashes, at = anchors_of(words, window)
                    low = np.flatnonzero(np.diff(at, prepend=-1))
                    n = np.diff(low, append=len(at))
                    place = (low * width + n - 1) * width + at[low] - low
                    parts.append((np.full(len(low), doc), np.full(len(low), h, np.int32), hashes[at[low]].view(np.int64), place))
            if parts:
                doc, h, anchor, place = (np.concatenate(c) for c in zip(*parts))
                hot = np.isin(anchor, frequent)
                spread = (doc * 0x9E3779B97F4A7 + place) * 0x2545F4914F6CDD1D
                columns = [doc, h, np.where(hot, spread, anchor), place * 2 + hot]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "h", "anchor", "mark"])

    return anchors


def _read(marks: list, window: int) -> tuple[np.ndarray, ...]:
    """First window, number of windows and place of the anchor of each mark; those of hot anchors one for each window, at -1."""
    width = window - ANCHOR + 1
    place, hot = np.divmod(np.sort(np.array(marks, np.int64)), 2)
    place, offset = np.divmod(place, width)
    low, n = np.divmod(place, width)
    n += 1
    if hot.any():
        times = np.where(hot == 1, n, 1)
        single = np.repeat(hot == 1, times)
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        low, n, offset = np.repeat(low, times) + inside, np.where(single, 1, np.repeat(n, times)), np.where(single, -1, np.repeat(offset, times))
    return low, n, offset


def _pieces(window: int):
    """The distinct pieces of a batch with their words, the first place of each, and what they are dealt out by: the words of
    the anchor, or of the window. Rows that share the id and the first place, not the text, are all first."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, list] = {}
            documents = (row for part in _slices([batch]) for row in zip(*(part.column(c).to_pylist() for c in ("doc_id", "h", "marks")), texts(part)))
            for doc, h, marks, text in documents:
                words = text.split()
                line = b" ".join(words)
                low, n, offset = _read(marks, window)
                begin = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
                anchor = np.where(offset < 0, low, low + offset)
                length = np.where(offset < 0, window, ANCHOR)
                cuts = (low, begin[low], begin[low + n - 1 + window] - 1, begin[anchor], begin[anchor + length] - 1)
                for start, a, b, c, d in zip(*(x.tolist() for x in cuts)):
                    piece, place = line[a:b], (doc, start)
                    seen = first.get(piece)
                    if seen is None or place < seen[0]:
                        first[piece] = [place, xxhash.xxh3_64_intdigest(line[c:d]), h]
                    elif place == seen[0] and h not in seen[2:]:
                        seen.append(h)
            rows = [(route - (1 << 63), *place, h, piece) for piece, (place, route, *hs) in first.items() for h in hs]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*arrays[:4], arrays[4].cast(pa.string())], names=["route", "doc_id", "start", "h", "words"])

    return pieces


def _later(runs: list[list[str]], doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and offset of the windows of ``runs`` that also start earlier in one of them, by the index of all."""
    number: dict[str, int] = {}
    ids = [[number.setdefault(w, len(number) + 1) for w in run] + [0] for run in runs]
    text = np.array([i for run in ids for i in run], np.int64)
    sizes = np.array([len(run) for run in ids])
    windows = sizes - window
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(ids)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    low, _ = FMIndex(text, window).search(text, base[owner] + offset, window)
    place = np.stack([doc[owner], start[owner] + offset])
    order = np.lexsort(place[::-1])
    rank = np.empty(len(owner), np.int64)
    rank[order] = np.cumsum(np.any(np.diff(place[:, order], prepend=place[:, order[:1]]) != 0, axis=0))
    least = np.full(len(text), len(owner), np.int64)
    np.minimum.at(least, low, rank)
    later = rank > least[low]
    return owner[later], offset[later]


def _firsts(window: int):
    """Per shard: the first copy of each distinct piece, code 0 after the start, and its windows that also start earlier, code 1 and
    the offset. Pieces whose anchor no other piece has cannot share a window with one and need no index."""
    codes = window - ANCHOR + 2

    def firsts(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc_id", "start"], kind="stable", ignore_index=True)
        piece = pd.factorize(shard["words"])[0]
        first = np.unique(piece, return_index=True)[1]
        doc, start, h = (shard[c].to_numpy() for c in ("doc_id", "start", "h"))
        whole = (doc == doc[first][piece]) & (start == start[first][piece])
        out = [(doc[whole], h[whole], start[whole].astype(np.int64) * codes)]
        _, group, size = np.unique(shard["route"].to_numpy()[first], return_inverse=True, return_counts=True)
        several = first[size[group] > 1]
        if len(several):
            owner, offset = _later([w.split(" ") for w in shard["words"].to_numpy()[several]], doc[several], start[several], window)
            found = pd.DataFrame({"piece": piece[several][owner], "offset": offset})
            found = found.merge(pd.DataFrame({"piece": piece, "doc": doc, "h": h, "start": start})[whole], on="piece")
            out.append((found["doc"], found["h"], found["start"].astype(np.int64) * codes + 1 + found["offset"]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("doc_id", "h", "code"), zip(*out))})

    return firsts


def _gone(window: int):
    """The runs of words to remove, as begin and end in turns: all windows of marks but of first copies, and what is later in these."""
    codes = window - ANCHOR + 2

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for marks, firsts in zip(batch.column("marks").to_pylist(), batch.column("firsts").to_pylist()):
                low, n, _ = _read(marks, window)
                start, code = np.divmod(np.array(firsts or [], np.int64), codes)
                copies = ~np.isin(low, start[code == 0])
                begin = np.concatenate([low[copies], (start + code - 1)[code > 0]])
                end = np.concatenate([(low + n - 1)[copies], (start + code - 1)[code > 0]]) + window
                order = np.argsort(begin)
                begin, end = begin[order], np.maximum.accumulate(end[order])
                fresh = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else order
                runs.append(np.stack([begin[fresh], end[np.append(fresh[1:], len(end))[: len(fresh)] - 1]], 1).ravel())
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(runs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "gone"])

    return gone


def _frequent(named: DataFrame, window: int) -> np.ndarray:
    """Anchors that probably have more than HOT copies, by a sample. It is the same list for all texts, and only decides where windows go."""
    rate = max(1, HOT // SEEN)
    some = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0).mapInArrow(_anchors(window, np.empty(0, np.int64)), ANCHORS)
    counts = some.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT // rate)
    return np.array([r["anchor"] for r in counts.orderBy(F.desc("n"), "anchor").limit(FREQUENT).collect()], np.int64)


def _near(docs: DataFrame, marks: DataFrame, places: str, how: str) -> DataFrame:
    """``docs`` with their row of ``marks``; broadcast if it is small, so that texts need not be shuffled."""
    size = marks.agg(F.count("*").alias("n"), F.sum(F.expr(places)).alias("p")).first()
    if size["n"] <= BROADCAST_ROWS and (size["p"] or 0) <= BROADCAST_PLACES:
        marks = F.broadcast(marks)
    return docs.join(marks, ["doc_id", "h"], how)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        counts, removed, left = [], [], []
        for text, gone in zip(texts(batch), batch.column("gone").to_pylist()):
            words = (text or b"").split()
            ends = [0, *(gone or ()), len(words)]
            kept = [w for begin, end in zip(ends[::2], ends[1::2]) for w in words[begin:end]]
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            left.append(b" ".join(kept))
        columns = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row of ``docs`` (doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts earlier: in a smaller doc_id, or in the same
    document before. Every window has an anchor, the run of six of its words with the least hash. Anchors that occur
    once cannot be of a repeated window. For the others, the windows of an anchor are cut out as one piece; equal
    pieces are reduced to the first before they are shuffled, and the distinct pieces are dealt to shards by anchor
    (by window, where an anchor has very many copies; which ones have is told by a sample, and these are not counted). There the first copy of each piece is told by its words. The
    pieces of anchors that have several are indexed, and backward search finds for every window the range of
    suffixes it begins; windows of one range are equal, and all but the earliest are later ones. Only first copies go
    back to their documents: in every other copy of a piece, all windows are later ones.

    Null texts have no words. Rows that repeat id and text are one document. Rows without an id keep all their words.
    Texts are read three times, in place of shuffling them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("h"), "text")
    named = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = named.mapInArrow(_anchors(window, _frequent(named, window)), ANCHORS)
    repeated = anchors.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).filter("n > 1 OR mark % 2 = 1")
    marked = cut(repeated.groupBy("doc_id", "h").agg(F.collect_set("mark").alias("marks")))
    held = _near(named, marked, "size(marks)", "inner").select("doc_id", "h", "marks", "text")
    places = marked.agg(F.sum(F.size("marks"))).first()[0] or 0
    shards = max(1, math.ceil(places * window / 2 / SHARD_WORDS))
    dealt = held.mapInArrow(_pieces(window), PIECES).withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    firsts = dealt.groupBy("shard").applyInPandas(_firsts(window), FIRSTS)
    firsts = firsts.groupBy("doc_id", "h").agg(F.collect_set("code").alias("firsts"))
    gone = marked.join(firsts, ["doc_id", "h"], "left").select("doc_id", "h", "marks", "firsts").mapInArrow(_gone(window), "doc_id long, h int, gone array<long>")
    gone = cut(gone.filter(F.size("gone") > 0))
    return _near(rows, gone, "size(gone)", "left").select("doc_id", "text", "gone").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY v ORDER BY doc_id, i) AS k FROM v) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g),
e AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT e.doc_id, count(c.i) AS n_removed, string_agg(e.w, ' ' ORDER BY e.i) FILTER (c.i IS NULL) AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


@query("op7_substring_dedup", SQL)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
