"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix64, sliced, words_of, written
from .components import components

#: Two sets link when 100 * intersection >= SIMILARITY * union.
WORDS, SIMILARITY = 5, 80
#: The most frequent shingles, this many at most (8 bytes each), go last in the
#: global order. Any order gives the same links; this one keeps tiles small.
FREQUENT = 1 << 16
#: Occurrences within one batch from which a shingle is reported as frequent.
OFTEN = 8
#: Rows of one side of a tile; larger tiles are cut into cells.
TILE = 4096
#: Partners that a cell reports for a set in the first round; tiles with more go
#: on to a second one, without a limit, when most of them are merged.
PARTNERS, NO_LIMIT = 4, 1 << 62
#: Bits of the filter that finds the texts of some sets: 1 MB.
FILTER = 1 << 23
#: Later rounds and single comparisons have signatures so many times as wide.
WIDE = 4


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; with fewer
    words, of the whole sequence; none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    # The number of words is part of the hash: a short sequence is no part of a longer one.
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    return np.unique(mix64(out))


def set_id(s: np.ndarray) -> int:
    """64-bit id of a set; equal sets have equal ids."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def prefix_sizes(n: int) -> tuple[int, int]:
    """(probe, index): of two linked sets, the first shingle they share, in the
    global order, is among the first ``probe`` of the larger and the first
    ``index`` of the smaller: after it, too few are left for the least overlap."""
    return n - (-(-SIMILARITY * n // 100)) + 1, n - (-(-2 * SIMILARITY * n // (100 + SIMILARITY))) + 1


def least_overlap(a, b):
    """Smallest intersection with which sets of sizes a and b link."""
    return -(-SIMILARITY * (a + b) // (100 + SIMILARITY))


def bitmap(s: np.ndarray, wide: int = 1) -> bytes:
    """Bitmap signature, its width a power of two of at least 64 and the set's
    size, times ``wide``."""
    bits = wide * max(64, 1 << int(len(s) - 1).bit_length())
    out = np.zeros(bits >> 3, np.uint8)
    at = s & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return out.tobytes()


def folded(b: np.ndarray, size: int) -> np.ndarray:
    """A wider bitmap at a narrower width: the same signature as if built there."""
    while len(b) > size:
        b = b[: len(b) >> 1] | b[len(b) >> 1 :]
    return b


def may_link(na, ba, nb, bb) -> bool:
    """Upper bound of the overlap by bit counts: every bit set in one signature
    alone is an element that the other set lacks."""
    x, y = np.frombuffer(ba, np.uint8), np.frombuffer(bb, np.uint8)
    size = min(len(x), len(y))
    x, y = folded(x, size), folded(y, size)
    only_a, only_b = int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum())
    return min(na - only_a, nb - only_b) >= least_overlap(na, nb)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact: intersection of two sorted arrays."""
    if not len(a) or not len(b):
        return False
    both = np.searchsorted(a, b)
    both = int((a[np.minimum(both, len(a) - 1)] == b).sum())
    return 100 * both >= SIMILARITY * (len(a) + len(b) - both)


def _frequent(docs: DataFrame) -> np.ndarray:
    """The FREQUENT most frequent shingles, by counts over all documents."""

    def rows(batches):
        for b in batches:
            sets = {}
            for x in b.column("text"):
                s = shingles(x.as_py())
                if len(s):
                    sets[set_id(s)] = s
            if sets:
                h, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                often = n >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["h", "n"])

    counts = docs.select("text").mapInArrow(rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def _prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``(doc_id, text_hash, n, fp, sig, wide, prefix)``: size, set id, signatures, and the first
    shingles in the global order (frequent ones last, else by hash), as many as
    two linked sets must share one of."""
    last = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches):
        hot = last.value
        for b in sliced(batches, 4096):
            n, fp, sig, wide, prefix = [], [], [], [], []
            seen: dict[int, tuple] = {}
            for x in b.column("text"):
                s = shingles(x.as_py())
                n.append(len(s))
                if not len(s):
                    fp.append(None), sig.append(None), wide.append(None), prefix.append(None)
                    continue
                i = set_id(s)
                if i not in seen:
                    size = prefix_sizes(len(s))[0]
                    if len(hot):
                        late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                        first = s[~late][:size]
                        if len(first) < size:
                            first = np.r_[first, s[late][: size - len(first)]]
                    else:
                        first = s[:size]
                    seen[i] = bitmap(s), bitmap(s, WIDE), first.view(np.int64)
                fp.append(i)
                for out, value in zip((sig, wide, prefix), seen[i], strict=True):
                    out.append(value)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(sig, pa.binary()), pa.array(wide, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "fp", "sig", "wide", "prefix"],
            )

    return docs.mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n long, fp long, sig binary, wide binary, prefix array<long>")


def _arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(fp, s)``: the sorted shingles of the sets ``wanted`` (fp, doc_id).

    Texts are not shuffled: a bitmap of the wanted ids' hashes, of FILTER bits
    whatever their number, lets through what may be wanted, the set id decides.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)).cast("int")
    marked = np.zeros(FILTER, bool)
    marked[wanted.select(bit.alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marked))

    def rows(batches):
        marked = np.unpackbits(shared.value).astype(bool)
        for b in sliced(batches):
            b = b.filter(pa.array(marked[b.column("bit").to_numpy()]))
            s = [shingles(x.as_py()).view(np.int64) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in s], pa.int64()), pa.array(s, pa.list_(pa.int64()))], names=["fp", "s"])

    found = docs.select("text", bit.alias("bit")).mapInArrow(rows, "fp long, s array<long>")
    # Copies, and texts under a repeated doc_id, are one row for each set in the end.
    return found.join(wanted.select("fp").distinct().hint("merge"), "fp", "left_semi").groupBy("fp").agg(F.first("s").alias("s"))


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of an array of bytes."""
    return np.frombuffer(col.buffers()[2], np.uint8), np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def _narrow(sigs: np.ndarray, width: int) -> np.ndarray:
    """Signatures, one a row, at a narrower width."""
    while sigs.shape[1] > width:
        half = sigs.shape[1] >> 1
        sigs = sigs[:, :half] | sigs[:, half:]
    return sigs


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link."""

    def rows(batches):
        for b in sliced(batches, 1024):
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            (x, ox), (y, oy) = _bytes(b.column("siga")), _bytes(b.column("sigb"))
            width, ok = np.stack([np.diff(ox), np.diff(oy)]), np.zeros(len(na), bool)
            # Signatures of equal widths together.
            for wa, wb in np.unique(width, axis=1).T.tolist():
                at = np.flatnonzero((width[0] == wa) & (width[1] == wb))
                one, other = (_narrow(d[o[at][:, None] + np.arange(w)], min(wa, wb)) for d, o, w in ((x, ox, wa), (y, oy, wb)))
                only_a, only_b = (np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((one, other), (other, one)))
                ok[at] = np.minimum(na[at] - only_a, nb[at] - only_b) >= least_overlap(na[at], nb[at])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    side = lambda k: sets.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"sig{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fit = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILARITY
    return both.filter(fit).select("a", "b", "na", "siga", "nb", "sigb").mapInArrow(rows, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection."""

    def rows(batches):
        for b in batches:
            x, y = b.column("sa"), b.column("sb")
            get = lambda col: (np.asarray(col.values).view(np.uint64), np.asarray(col.offsets))
            (va, oa), (vb, ob) = get(x), get(y)
            ok = [linked(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    arrays = written(_arrays(docs, sets.join(nodes, "fp", "left_semi").select("fp", "doc_id")), "arrays")
    both = pairs.join(arrays.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(arrays.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    links = written(both.select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long"), "links")
    dropped(arrays)
    return links


def _band(n):
    """Size band: linked sets are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(100 / SIMILARITY) + 1e-9)))


def _cells(tiles: DataFrame) -> DataFrame:
    """Deals rows (h, fp, n, label) into cells (h, family, kind, i, j), with role.

    Family f compares the sets of band f with one another and with those of band
    f - 1. Cells hold at most about 2 * TILE rows: a family of more is cut by the
    hash of the set, and every two parts meet in one cell.
    """
    banded = tiles.withColumn("band", _band(F.col("n")).cast("int"))
    # A deep row is the larger one of its pairs, never the smaller.
    roles = F.when(F.col("deep"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    both = banded.withColumn("role", F.explode(roles)).withColumn("family", F.col("band") + F.col("role"))
    parts = both.groupBy("h", "family").agg(
        F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"), F.min("role").alias("any_own"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("deep").alias("all_deep")
    )
    # A family without its own band, of one label, or of deep rows has nothing to compare.
    parts = parts.filter("any_own = 0 and l0 <> l1 and not all_deep").select("h", "family", "parts")
    dealt = both.join(parts, ["h", "family"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    every = "transform(sequence(0, parts - 1), k -> "
    own = F.expr(f"concat({every} struct(0 AS kind, least(part, k) AS i, greatest(part, k) AS j)), {every} struct(1 AS kind, part AS i, k AS j)))")
    lower = F.expr(f"{every} struct(1 AS kind, k AS i, part AS j))")
    cell = F.explode(F.when(F.col("role") == 0, own).otherwise(lower))
    return dealt.select("h", "family", "role", "part", "fp", "n", "deep", "label", cell.alias("c")).select("h", "family", "c.kind", "c.i", "c.j", "role", "part", "fp", "n", "deep", "label")


class _Side:
    """Sets of one side of a cell, by size, with their signatures at one width."""

    def __init__(self, at: np.ndarray, cols: dict, sigs):
        at = at[np.lexsort((cols["fp"][at], cols["n"][at]))]
        self.n, self.fp, self.label, self.part, self.deep = (cols[c][at] for c in ("n", "fp", "label", "part", "deep"))
        raw = [sigs(k) for k in at.tolist()]
        self.width = min(map(len, raw))
        self.sig = np.stack([folded(x, self.width) for x in raw]).view(np.uint64)

    def at(self, width: int) -> np.ndarray:
        s = self.sig
        while s.shape[1] * 8 > width:
            half = s.shape[1] >> 1
            s = s[:, :half] | s[:, half:]
        return s


def _cell_pairs(x: _Side, y: _Side, within: bool, one_part: bool, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a cell that signatures allow, of different labels, within a side
    or between two; for each set the ``limit`` most alike at most, and whether
    that left any out."""
    out_a, out_b, more = [], [], False
    width = min(x.width, y.width)
    a, b = x.at(width), y.at(width)
    bits_a, bits_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    for k in range(len(x.n)):
        n = x.n[k]
        lo = k + 1 if within else int(np.searchsorted(y.n, -(-SIMILARITY * n // 100)))
        hi = int(np.searchsorted(y.n, 100 * n // SIMILARITY, side="right"))
        if hi <= lo:
            continue
        m = y.n[lo:hi]
        shared = np.bitwise_count(b[lo:hi] & a[k]).sum(axis=1, dtype=np.int64)
        most = np.minimum(n - (bits_a[k] - shared), m - (bits_b[lo:hi] - shared))
        room = most - least_overlap(n, m)
        ok = (room >= 0) & (y.label[lo:hi] != x.label[k])
        if within:
            # Sizes ascend: x is the smaller one.
            ok &= ~(x.deep[k] & ((m > n) | y.deep[lo:hi]))
            if not one_part:
                ok &= y.part[lo:hi] != x.part[k]
        hit = np.flatnonzero(ok)
        if len(hit) > limit:
            hit, more = hit[np.argsort(-room[hit], kind="stable")[:limit]], True
        if len(hit):
            out_a.append(np.full(len(hit), x.fp[k]))
            out_b.append(y.fp[lo + hit])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b), more) if out_a else (none, none, more)


def _single_pairs(at: np.ndarray, cols: dict, sigs) -> list[int]:
    """Of cells of two rows, at ``at`` and the next, those whose rows may link."""
    b = at + 1
    kind, role, n, label, part, deep = (cols[c] for c in ("kind", "role", "n", "label", "part", "deep"))
    small, large = np.where(n[at] <= n[b], at, b), np.where(n[at] <= n[b], b, at)
    ok = (label[at] != label[b]) & (100 * n[small] >= SIMILARITY * n[large])
    within = ~(deep[small] | deep[large] & (n[small] == n[large])) & ((cols["i"][at] == cols["j"][at]) | (part[at] != part[b]))
    ok &= np.where(kind[at] == 1, role[at] != role[b], within)
    out = []
    for k in at[ok].tolist():
        if may_link(n[k], sigs(k), n[k + 1], sigs(k + 1)):
            out.append(k)
    return out


def _tile_pairs(cells: DataFrame, sets: DataFrame, limit: int, signature: str) -> DataFrame:
    """``(a, b, h)``: pairs of different labels that some cell cannot rule out,
    h null; and, a and b null, the tiles of cells that had more than the limit."""
    key = ["h", "family", "kind", "i", "j"]
    names = [*key, "role", "part", "fp", "n", "deep", "label"]

    def found(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray):
        """Rows of the cells [start, end) of a batch."""
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        sig = batch.column("sig")
        offsets = np.frombuffer(sig.buffers()[1], np.int32)[sig.offset : sig.offset + len(sig) + 1]
        data = np.frombuffer(sig.buffers()[2], np.uint8)
        sigs = lambda k: data[offsets[k] : offsets[k + 1]]
        size = ends - starts
        single = np.array(_single_pairs(starts[size == 2], cols, sigs), np.int64)
        a, b, marks = [cols["fp"][single]], [cols["fp"][single + 1]], []
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            at = np.arange(s, e)
            own = cols["role"][s:e] == 0
            if cols["kind"][s] == 1:
                if own.all() or not own.any():
                    continue
                x, y = _Side(at[own], cols, sigs), _Side(at[~own], cols, sigs)
            else:
                x = y = _Side(at, cols, sigs)
            p, q, more = _cell_pairs(x, y, cols["kind"][s] == 0, cols["i"][s] == cols["j"][s], limit)
            a.append(p)
            b.append(q)
            if more:
                marks.append(cols["h"][s])
        a, b = np.concatenate(a), np.concatenate(b)
        n, m = len(a), len(marks)
        pad, mark = np.zeros(m, np.int64), np.arange(n + m) >= n
        low, high = np.r_[np.minimum(a, b), pad], np.r_[np.maximum(a, b), pad]
        h = np.r_[np.zeros(n, np.int64), np.array(marks, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(low, mask=mark), pa.array(high, mask=mark), pa.array(h, mask=~mark)], names=["a", "b", "h"])

    def rows(batches):
        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in key:
                v = batch.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            cuts = np.r_[0, np.flatnonzero(new)]
            if len(cuts) > 1:
                yield found(batch, cuts[:-1], cuts[1:])
            # The last cell may go on in the next batch; a cell is bounded by TILE.
            held = batch.slice(int(cuts[-1]))
        if held is not None and held.num_rows > 1:
            yield found(held, np.array([0]), np.array([held.num_rows]))

    ready = cells.join(sets.select("fp", F.col(signature).alias("sig")), "fp").repartition(*key).sortWithinPartitions(*key)
    return ready.select(*names, "sig").mapInArrow(rows, "a long, b long, h long").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Near-duplicate classes of ``documents`` (doc_id, text): ``(doc_id,
    n_shingles, component_id)``, one row for each row of the input.

    A document's set is its distinct five-word shingles (A-Z lower-cased; fewer
    words: the whole sequence as one); documents link when 100 * intersection >=
    80 * union; component_id is the smallest doc_id that links reach. Without
    words, or with a null text, a document has no shingles and its own doc_id.
    Repeated rows and exact copies are one set and cost one. Rows that share a
    doc_id but not the text are sets of their own. A null doc_id is never the
    smallest unless the whole class has none. An empty table gives an empty one;
    other columns are ignored.

    Exact but for the shingles' keys, hashes of 64 bits (two shingles of one pair
    of documents meet in one with a chance of about n * m / 2**64): two linked sets share a shingle of their prefixes, so
    they meet in that shingle's tile; a tile's size bands and bitmap signatures
    only rule out pairs that cannot link; the rest is verified on sorted arrays.
    What is merged already needs no comparison: a star round merges most of a
    group of near copies by one comparison for each member, and tile rounds
    report the most alike partners first, until a tile has none left out.
    """
    return _classes(documents).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _classes(documents: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, n, root, component_id)`` of each row; root names its
    class, and is null, like component_id, without shingles."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    first = written(_prefixes(docs, _frequent(docs)), "prefixes")
    # One row for each distinct set, before anything is exploded: copies cost one.
    sets = written(
        first.filter("fp is not null")
        .groupBy("fp")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("wide").alias("wide"), F.first("prefix").alias("prefix")),
        "sets",
    )
    shallow = f"n - cast(ceil({2 * SIMILARITY} * n / {100 + SIMILARITY}) as long) + 1"
    rows = sets.select("fp", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "fp", F.expr(f"pos >= {shallow}").alias("deep"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("deep").alias("all_deep")).filter("c > 1 and not all_deep").select("h")
    tiles = rows.join(shared, "h").join(sets.select("fp", "n"), "fp")
    tiles = written(tiles.select("h", "fp", "n", "deep", F.col("fp").alias("label")), "tiles")
    merged: DataFrame | None = None

    def merge(pairs: DataFrame) -> DataFrame:
        """What is merged once the pairs that link are, too."""
        pairs = written(pairs, "pairs")
        links = None if pairs.isEmpty() else _verified(pairs, docs, sets)
        dropped(pairs)
        if links is None or links.isEmpty():
            return merged
        every = links
        if merged is not None:
            every = links.unionByName(merged.select(F.col("node").alias("a"), F.col("root").alias("b")))
        out = written(components(every), "merged")
        dropped(links, merged)
        return out

    # A star round: every set against its tiles' centre, one for a whole group of copies.
    order = F.struct(F.xxhash64("fp"), "fp")
    centre = tiles.groupBy("h").agg(F.min(order).alias("o")).select("h", F.col("o.fp").alias("a"))
    merged = merge(_bounded(tiles.join(centre, "h").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct(), sets))
    limit = PARTNERS
    while True:
        before, tiles = tiles, _relabelled(tiles, merged)
        dropped(before)
        found = written(_tile_pairs(_cells(tiles), sets, limit, "sig" if limit == PARTNERS else "wide"), "pairs")
        merged = merge(found.filter("h is null").select("a", "b"))
        cut = written(found.filter("h is not null").select("h").distinct(), "cut")
        dropped(found)
        if cut.isEmpty():
            dropped(tiles)
            break
        # Only tiles with more partners than the limit go another round: what merged meanwhile is not compared again.
        tiles = tiles.join(cut, "h", "left_semi")
        limit = NO_LIMIT
    if merged is None:
        named = sets.select("fp", F.col("fp").alias("root"), F.col("doc_id").alias("component_id"))
    else:
        rooted = sets.select("fp", "doc_id").join(merged, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        named = rooted.join(least, "root").select("fp", "root", "component_id")
    named = written(named, "classes")
    return first.select("doc_id", "text_hash", "n", "fp").join(named, "fp", "left").select("doc_id", "text_hash", "n", "root", "component_id")


def _relabelled(tiles: DataFrame, merged: DataFrame | None) -> DataFrame:
    """Tiles that still hold more than one label, with the labels of now."""
    now, held = tiles, None
    if merged is not None:
        now = tiles.drop("label").join(merged, F.col("fp") == F.col("node"), "left").select("h", "fp", "n", "deep", F.coalesce("root", "fp").alias("label"))
        now = held = written(now, "tiles")
    mixed = now.groupBy("h").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("deep").alias("d")).filter("l0 <> l1 and not d").select("h")
    out = written(now.join(mixed, "h", "left_semi"), "tiles")
    dropped(held)
    return out


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class: one of the smallest doc_id (nulls
    last), of the texts that have it the one that hashes lowest, and of rows that
    repeat both any one. Rows without words all stay. Columns are the input's."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(row, F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("k"))
    found = written(_classes(documents), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    of = found.filter("root is not null").groupBy("root").agg(F.min(key).alias("x"))
    best = of.select(F.struct("x.doc_id", "x.text_hash").alias("best"))
    # How often a class's best row is there: mostly once, and then no text is shuffled.
    times = found.filter("root is not null").groupBy(F.struct("doc_id", "text_hash").alias("best")).agg(F.count(F.lit(1)).alias("times"))
    best = written(best.join(times, "best"), "best")
    bare = found.filter("root is null").select(F.struct("doc_id", "text_hash").alias("best"), F.lit(1).cast("long").alias("times"))
    once = rows.join(best.filter("times = 1").unionByName(bare.distinct()), F.col("k") == F.col("best"), "left_semi")
    if best.filter("times > 1").isEmpty():
        return once.select("row.*")
    again = rows.join(best.filter("times > 1"), F.col("k") == F.col("best"), "left_semi")
    # A row of its own for each key, whatever the types of the other columns.
    again = again.groupBy("k").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(again.select("row.*"))


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS s
  FROM words WHERE len(w) > 0
), distinct_sets AS (
  SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM sets GROUP BY list_sort(s), len(s)
), grams AS (
  SELECT id, n, unnest(s) AS g FROM distinct_sets
), shared AS (
  SELECT a.id AS a, b.id AS b, count(*) AS same, min(a.n) AS na, min(b.n) AS nb
  FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id
), links AS (
  SELECT a, b FROM shared WHERE 100 * same >= 80 * (na + nb - same)
  UNION ALL
  SELECT b, a FROM shared WHERE 100 * same >= 80 * (na + nb - same)
), reach AS (
  WITH RECURSIVE r(id, c) AS (
    SELECT id, id FROM distinct_sets
    UNION
    SELECT links.b, r.c FROM r JOIN links ON links.a = r.id AND r.c < links.b
  ) SELECT id, min(c) AS component_id FROM r GROUP BY id
), by_set AS (
  SELECT d.s, r.component_id FROM distinct_sets d JOIN reach r ON d.id = r.id
)
SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(b.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN by_set b ON list_sort(s.s) = b.s
"""
