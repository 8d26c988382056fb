"""Groups of records whose words are nearly the same, without comparing all pairs.

Method: SetSketch.  A record is the multiset of its words (case, order and punctuation ignored).  Register j of its sketch is
the largest ``floor(1 - log_b h_j(e))`` over the elements e, where h_j is an exponential variable with rate ``RATE`` times the
weight of e, so registers are exponentially spaced truncated minima: sketches merge by maximum, and two registers are equal
about as often as the weighted sets overlap.  Bands of registers are the join keys of candidate pairs; the overlap of a
candidate is estimated from all registers jointly by maximum likelihood, and what may reach the threshold is verified on the
whole word multisets.

A word that a part f of its kind's texts hold weighs ``min(1, COMMON / f)`` in sketches, at every corpus size, so words that
nearly all texts share don't make unlike texts meet, and no word is left out.  Two texts over the threshold that differ in
rare words only overlap less by weight; where that could be less than ``GUARANTEE`` (by a text's own words and the threshold,
beside a text of as many words), the text has bands of its words with equal weights as well.  Verification counts words equally.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm.components import connected_components
from hindcast.runtime import Scratch, pairs_within, shuffle_partitions

BASE, RATE, TOP = 1.001, 2000.0, (1 << 16) - 2
BANDS, ROWS = 66, 6
#: Part of a kind's texts from which on a word weighs less than 1.
COMMON = 0.10
#: Least weighted overlap that a text's words must leave to a pair at the threshold, else equal weights are used as well.
GUARANTEE = 0.4
#: Candidates are dropped before verification only if their estimate lies this many standard deviations below the least that
#: a pair over the threshold can have, by its sizes: once in a thousand million pairs by chance.
DEVIATIONS = 6.0
#: Registers from which a candidate's overlap is estimated, of those that make the bands.
ESTIMATED = 180
#: Texts of a band up to which each is paired where it is met; the texts of a larger band are paired in salted parts.
BAND = 64
#: Two texts that share a band go on only if of the ``MARK`` registers behind the band, of which it carries two bits each, at least
#: ``MARK_LEAST`` look equal.  With 66 bands a pair that overlaps by 0.6 or more is found no less often than by 60 without marks.
MARK, MARK_LEAST = 32, 19
#: Rows of band keys for one shuffle partition.
BAND_ROWS = 500_000
#: Elements whose registers are held at once; longer texts are sketched in parts, which merge by maximum.
BLOCK, PART = 1 << 18, 1 << 15
WORD = re.compile(r"\w+")
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of a good mixing hash."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def elements(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Word hashes, sorted within each text, made different for the second, third ... occurrence in the same text."""
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[starts[starts < len(words)]] = False
    run = np.arange(len(words)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(words))))
    return mixed(words.astype(np.uint32).astype(U64) | run.astype(U64) << U64(32))


def registers(element: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """Register values of single elements, one row each."""
    out = np.empty((len(element), count), np.uint16)
    steps = mixed(np.arange(1, count + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    rate = np.log(RATE * weight)
    for at in range(0, len(element), 4096):
        bits = mixed(element[at : at + 4096, None] ^ steps[None, :])
        log_least = np.log(-np.log(((bits >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)) - rate[at : at + 4096, None]
        out[at : at + 4096] = np.clip(np.floor(1.0 - log_least / np.log(BASE)), 0, TOP + 1).astype(np.uint16)
    return out


def merged(into: np.ndarray, row: int, part: np.ndarray) -> None:
    """Merge the sketch ``part`` into the ``row`` of ``into``: the larger value of each register."""
    np.maximum(into[row], part, out=into[row])


def sketches(element: np.ndarray, weight: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """One sketch (row of registers) for each slice of ``element`` that begins at ``starts``; no slice may be empty."""
    out = np.zeros((len(starts), count), np.uint16)
    for block in range(0, len(element), BLOCK):
        distinct, first, place = np.unique(element[block : block + BLOCK], return_index=True, return_inverse=True)
        single = registers(distinct, weight[block : block + BLOCK][first], count)
        end = block + len(place)
        for row in range(int(np.searchsorted(starts, block, "right")) - 1, int(np.searchsorted(starts, end, "left"))):
            begin, stop = max(starts[row], block), min(starts[row + 1] if row + 1 < len(starts) else end, end)
            for part in range(begin, stop, PART):  # row by row: numpy's maximum along an axis is ten times as fast as reduceat
                merged(out, row, single.take(place[part - block : min(part + PART, stop) - block], axis=0).max(axis=0))
    return out


def joint_estimate(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood overlap of set pairs: counts of registers larger, smaller and equal in a, and the set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, best_j = np.full(len(u), -np.inf), np.zeros(len(u))
    top = np.minimum(u / v, v / u)
    for share in np.linspace(0, 1, 101):
        j = share * top
        more, less = p(u - v * j), p(v - u * j)
        like = larger * np.log(np.maximum(more, 1e-12)) + smaller * np.log(np.maximum(less, 1e-12)) + equal * np.log(np.maximum(1 - more - less, 1e-12))
        better = like > best
        best, best_j = np.where(better, like, best), np.where(better, j, best_j)
    return best_j


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and first positions of a list column without nulls."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]


def hashed_words(df: DataFrame, kind_col: str, id_col: str, text_col: str) -> DataFrame:
    """``kind``, ``id``, ``uid`` and ``words`` of each row: the sorted word hashes and their digest.

    ``words`` is null where the same task had the same words before, so copies add next to nothing.  Rows without a word
    have no row.
    """
    kind_type, id_type = (df.select(c).schema[c].dataType.simpleString() for c in (kind_col, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        seen: set[int] = set()
        crc = lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass"))
        for batch in batches:
            if len(known) > 1_000_000:
                known.clear()
            keep, uids, lists = [], [], []
            for at, (kind, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                found = WORD.findall(text.lower()) if text else None
                if not found:
                    continue
                for w in found:
                    if w not in known:
                        known[w] = crc(w)
                words = np.sort(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                raw = words.tobytes()
                uid = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=str(kind).encode()[:64]).digest(), "big", signed=True)
                keep.append(at)
                uids.append(uid)
                lists.append(None if uid in seen else words.view(np.int32))
                seen.add(uid)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(uids, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["kind", "id", "uid", "words"])

    source = df.select(F.col(kind_col).alias("kind"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    return source.mapInArrow(run, f"kind {kind_type}, id {id_type}, uid long, words array<int>")


def common_words(texts: DataFrame, common: float) -> tuple[int, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The number of texts, and for each kind the word hashes that more than ``common`` of its texts hold, with their weights.

    By counting there are at most (mean words of a text) / ``common`` of them, so they may go through the driver.
    """
    total = {str(k): n for k, n in texts.groupBy("kind").agg(F.count(F.lit(1))).collect()}
    kinds = texts.sparkSession.createDataFrame(list(total.items()), "name string, n long")
    held = texts.select(F.col("kind").cast("string").alias("name"), F.explode(F.array_distinct("words")).alias("word")).na.fill("None", ["name"])
    often = held.groupBy("name", "word").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(kinds), "name").filter(F.col("m") > F.col("n") * common)
    out: dict[str, list[tuple[int, float]]] = {}
    for kind, word, weight in often.select("name", "word", common * F.col("n") / F.col("m")).orderBy("name", "word").collect():
        out.setdefault(kind, []).append((word, weight))
    return sum(total.values()), {k: (np.array([w for w, _ in v], np.int32), np.array([x for _, x in v])) for k, v in out.items()}


def weighed(words: np.ndarray, starts: np.ndarray, kinds: list, common: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Elements of texts (words of text i from ``starts[i]`` to ``starts[i + 1]``), different from kind to kind, and their weights."""
    names, of = np.unique(np.array([str(k) for k in kinds], dtype=object), return_inverse=True)
    of = np.repeat(of, np.diff(starts))
    salts = np.array([zlib.crc32(n.encode("utf-8", "surrogatepass")) for n in names], U64)
    weight = np.ones(len(words))
    for at, name in enumerate(names):
        if name in common:
            stop, weights = common[name]
            mine = np.flatnonzero(of == at)
            place = np.minimum(np.searchsorted(stop, words[mine]), len(stop) - 1)
            hit = stop[place] == words[mine]
            weight[mine[hit]] = weights[place[hit]]
    return mixed(elements(words, starts[:-1]) ^ mixed(salts)[of]), weight


def band_keys(texts: DataFrame, common: dict[str, tuple[np.ndarray, np.ndarray]], share: float, bands: int, rows: int) -> DataFrame:
    """``key``, ``uid`` and ``mark``: one row for each band of each text.  Keys have 48 bits, which packs the shuffled rows."""

    def keys(sketch: np.ndarray, salt: int) -> np.ndarray:
        parts = sketch.reshape(len(sketch), bands, rows)
        key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=U64) + U64(salt << 32))[None, :], (len(sketch), bands))
        for r in range(rows):
            key = mixed(key * U64(0x100000001B3) ^ parts[:, :, r].astype(U64))
        return (key >> U64(16)).view(np.int64)

    def marks(sketch: np.ndarray) -> np.ndarray:
        """Two bits of each of the registers behind each band, which differ from band to band."""
        low, mark = (sketch & np.uint16(3)).astype(U64), np.zeros((len(sketch), bands), U64)
        for t in range(MARK):
            mark |= low[:, ((np.arange(bands) + 1) * rows + t) % (bands * rows)] << U64(2 * t)
        return mark.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, uids = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            words, starts = flat_lists(batch.column(2))
            if not len(uids):
                continue
            element, weight = weighed(words, starts, kinds, common)
            sizes, first = np.diff(starts), starts[:-1]
            total = np.add.reduceat(weight, first)
            sketch = sketches(element, weight, first, bands * rows)
            out = [(keys(sketch, 0), marks(sketch), uids)]
            loose = least_estimate(sizes, sizes, total, total, share) < GUARANTEE
            if loose.any():
                ends = np.cumsum(sizes[loose])
                sketch = sketches(element[np.repeat(loose, sizes)], np.ones(ends[-1]), ends - sizes[loose], bands * rows)
                out.append((keys(sketch, 1), marks(sketch), uids[loose]))
            for key, mark, of in out:
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(of, bands)), pa.array(mark.ravel())], names=["key", "uid", "mark"])

    return texts.select("kind", "uid", "words").mapInArrow(run, "key long, uid long, mark long")


def candidates(keyed: DataFrame, parts: int, scratch: Scratch) -> DataFrame:
    """``uid_a`` < ``uid_b``: texts that share a band and whose marks there look alike, each pair once.  Without ``mark``, all that share a band.

    A band of up to ``BAND`` texts is paired where its rows meet, from a window of bounded width; the texts of a larger band go
    through a join whose salts follow their number, so no task holds a band.
    """
    keyed = keyed if "mark" in keyed.columns else keyed.withColumn("mark", F.lit(0).cast("long"))
    keyed = keyed.select("key", F.struct("uid", "mark").alias("text"))
    of_band, before = Window.partitionBy("key"), Window.partitionBy("key").orderBy("text.uid").rowsBetween(-BAND, -1)
    bits = lambda a, b: a["mark"].bitwiseXOR(b["mark"])
    alike = lambda a, b: F.bit_count(bits(a, b).bitwiseOR(F.shiftrightunsigned(bits(a, b), 1)).bitwiseAND(F.lit(0x5555555555555555))) <= MARK - MARK_LEAST
    met = keyed.repartition(parts, "key").withColumn("near", F.collect_list("text").over(before)).withColumn("n", F.count(F.lit(1)).over(of_band)).filter("n > 1")
    close = F.filter("near", lambda x: alike(x, F.col("text")))
    near = F.when(F.col("n") <= BAND, F.transform(close, lambda x: x["uid"]))
    kept = scratch.keep(met.select("text", near.alias("near"), F.when(F.col("n") > BAND, F.col("key")).alias("key")).filter("key is not null or size(near) > 0"))
    few = kept.filter("key is null").select(F.explode("near").alias("uid_a"), F.col("text.uid").alias("uid_b")).filter("uid_a < uid_b")
    many = pairs_within(kept.filter("key is not null").select("key", "text").distinct(), "key", "text", "a", "b").filter("a.uid < b.uid").filter(alike(F.col("a"), F.col("b")))
    return few.unionByName(many.select(F.col("a.uid").alias("uid_a"), F.col("b.uid").alias("uid_b"))).distinct()


def least_estimate(size_a: np.ndarray, size_b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, share: float) -> np.ndarray:
    """The least weighted overlap of a pair whose words overlap by ``share``: what is not common weighs at most 1 a word."""
    common = share / (1 + share) * (size_a + size_b)
    both = np.maximum(weight_a - (size_a - common), weight_b - (size_b - common))
    return np.clip(both, 0, None) / np.maximum(weight_a + weight_b - both, 1e-9)


def verified(pairs: DataFrame, common: dict[str, tuple[np.ndarray, np.ndarray]], share: float, count: int) -> DataFrame:
    """Candidates (kind, uid_a, uid_b, words_a, words_b) that reach ``share``: estimated from sketches, then counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, sides = np.array(batch.column(0).to_pylist(), dtype=object), []
            for c in (1, 2):
                _, first, place = np.unique(batch.column(c).to_numpy(), return_index=True, return_inverse=True)
                words, starts = flat_lists(batch.column(c + 2).take(pa.array(first)))
                element, weight = weighed(words, starts, kinds[first], common)
                total = np.add.reduceat(weight, starts[:-1])
                sides.append((np.split(words, starts[1:-1]), place, np.diff(starts)[place], sketches(element, weight, starts[:-1], count)[place], total[place]))
            (wa, ia, na, x, va), (wb, ib, nb, y, vb) = sides
            more, less = (x > y).sum(1), (x < y).sum(1)
            least = least_estimate(na, nb, va, vb, share)
            maybe = joint_estimate(more, less, count - more - less, va, vb) >= least - DEVIATIONS * np.sqrt(least * (1 - least) / count)
            keep, shares = [], []
            for i in np.flatnonzero(maybe):
                value = overlap(wa[ia[i]], wb[ib[i]])
                if value >= share:
                    keep.append(int(i))
                    shares.append(value)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(shares, pa.float64())], names=["kind", "uid_a", "uid_b", "share"])

    kind = pairs.schema["kind"].dataType.simpleString()
    return pairs.select("kind", "uid_a", "uid_b", "words_a", "words_b").mapInArrow(run, f"kind {kind}, uid_a long, uid_b long, share double")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Words common to both, counted with repeats, over all words of the two together (sorted multisets)."""
    values, counts_a = np.unique(a, return_counts=True)
    other, counts_b = np.unique(b, return_counts=True)
    at = np.searchsorted(other, values)
    at[at == len(other)] = 0
    hit = other[at] == values
    both = int(np.minimum(counts_a[hit], counts_b[at[hit]]).sum())
    return both / (len(a) + len(b) - both)


def near_duplicates(
    df: DataFrame, kind_col: str, id_col: str, text_col: str, scratch: Scratch, share: float = 0.65, bands: int = BANDS, rows: int = ROWS, common: float = COMMON
) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and which rows hold them: (``uid_a, uid_b, share``), (``id, uid``).

    Rows are compared within their ``kind`` only; a null kind is a kind of its own.  Texts with the same words in any order are
    one ``uid``; each link is there once, whatever number of rows holds its texts.  Null ids, null texts and texts without a
    word take no part.  Repeated rows count once.  Extra columns are not read.  Both results are tables of ``scratch``.
    """
    base = scratch.keep(hashed_words(df, kind_col, id_col, text_col))
    texts = base.filter("words is not null").select("kind", "uid", "words")
    n_texts, often = common_words(texts, common)
    parts = max(shuffle_partitions(df.sparkSession), -(-n_texts * bands // BAND_ROWS))
    pairs = candidates(band_keys(texts, often, share, bands, rows), parts, scratch)
    one = texts.groupBy("uid").agg(F.first("kind").alias("kind"), F.first("words").alias("words"))
    met = pairs.join(one.select(F.col("uid").alias("uid_a"), "kind", F.col("words").alias("words_a")), "uid_a").join(
        one.select(F.col("uid").alias("uid_b"), F.col("words").alias("words_b")), "uid_b"
    )
    links = scratch.keep(verified(met, often, share, min(ESTIMATED, bands * rows)).select("uid_a", "uid_b", "share"))
    members = scratch.keep(base.select("id", "uid").distinct())
    scratch.drop(base)
    return links, members


def near_duplicate_pairs(df: DataFrame, kind_col: str, id_col: str, text_col: str, share: float = 0.65) -> DataFrame:
    """``id_a`` < ``id_b``: all pairs of different ids of a kind whose texts share at least ``share`` of their words.

    The links and members of ``near_duplicates``, expanded; where pairs of copies aren't wanted, ``near_duplicate_groups`` has
    the same content in one row an id.
    """
    links, members = near_duplicates(df, kind_col, id_col, text_col, Scratch(df.sparkSession), share)
    left, right = members.select(F.col("uid").alias("uid_a"), F.col("id").alias("x")), members.select(F.col("uid").alias("uid_b"), F.col("id").alias("y"))
    across = links.join(left, "uid_a").join(right, "uid_b").filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return across.unionByName(pairs_within(members, "uid", "id", "id_a", "id_b").select("id_a", "id_b")).distinct()


def near_duplicate_groups(df: DataFrame, kind_col: str, id_col: str, text_col: str, share: float = 0.65) -> DataFrame:
    """``id, group_id, n_links``: one row for each id that has a near duplicate or a copy under another id.

    ``n_links`` is the number of other texts that the id's text is linked to; copies are one text and no links of each other.
    Links run between the least ids of texts, so groups of copies are never expanded.
    """
    links, members = near_duplicates(df, kind_col, id_col, text_col, Scratch(df.sparkSession), share)
    texts = members.groupBy("uid").agg(F.min("id").alias("head"))
    heads = links.join(texts.select(F.col("uid").alias("uid_a"), F.col("head").alias("a")), "uid_a").join(texts.select(F.col("uid").alias("uid_b"), F.col("head").alias("b")), "uid_b").select("a", "b")
    copies = members.join(texts, "uid").filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    grouped = connected_components(heads.unionByName(copies), "a", "b", "id", "group_id")
    degree = links.select(F.col("uid_a").alias("uid")).unionByName(links.select(F.col("uid_b").alias("uid"))).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    linked = members.join(degree, "uid", "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_links"))
    return grouped.join(linked, "id").select("id", "group_id", "n_links")
