"""SimHash near-duplicates: all pairs of fingerprints within a Hamming radius, by a generalised pigeonhole.

The 64 bits are grouped into partitions of correlated bits. Partition i gets a radius t_i >= -1 with
sum(t_i) = radius - partitions + 1, so that any two fingerprints within the radius agree up to t_i
differing bits in some partition i (-1: the partition is not used). A dynamic programme picks
the radii that cost least by candidate counts estimated over all fingerprints. The number of partitions is a parameter, the
same at every size, so that rows probed follow the fingerprints; fewer partitions probe more and meet fewer by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components, joined_components
from .runtime import Scratch, bounded, free_name, materialise, shielded, small_batches
from .textvec import LOWER, mix, texts_of

BITS = 64
#: Fingerprints that share a key and are compared at once; more are dealt into a grid of cells.
CELL = 4096
#: Rows of a key up to which neighbours are compared by shifting instead of as a matrix.
SHORT = 24
#: What a candidate pair costs, in probe rows.
CANDIDATE_COST = 10.0


def fingerprint(text: str | bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles, repeats included; a bit is set if it is in over half the hashes.

    Words are lower-cased (A-Z) runs of bytes other than blank and 0x09 to 0x0D. Fewer words than a
    shingle make one shingle; null or no word at all gives 0.
    """
    raw = (text or b"") if isinstance(text, bytes) else (text or "").encode()
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    ones, left = np.zeros(BITS, dtype=np.int64), n
    hashes = map(xxhash.xxh64_intdigest, parts, repeat(seed))
    while left:
        some = min(left, 1 << 15)
        h = np.fromiter(hashes, dtype="<u8", count=some)
        ones += np.unpackbits(h.view(np.uint8).reshape(some, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= some
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text_col: str = "text", shingle: int = 3, out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep and the fingerprint of the text as a signed long."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    src = df.select(*keep, F.col(text_col).alias(free_name(df, "_t")))
    names = [*keep, out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"`{out}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(len(keep)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=names)

    return src.mapInArrow(run, schema)


# Bits, partitions and radii


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often two bits are both set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(h), 4096):
                x = np.unpackbits(np.ascontiguousarray(h[lo : lo + 4096]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += x.T @ x
                n += len(x)
        i, j = np.triu_indices(BITS)
        pairs = np.append(i * BITS + j, -1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(np.append(both[i, j], n).astype(np.int64))], names=["pair", "n"])

    rows = fps.select("fp").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # 2081 rows
    found = {r["pair"]: r["n"] for r in rows}
    both = np.zeros((BITS, BITS))
    for pair, n in found.items():
        if pair >= 0:
            both[pair // BITS, pair % BITS] = both[pair % BITS, pair // BITS] = n
    return int(found.get(-1, 0)), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width, each grown greedily by the bit most correlated with it."""
    share = both / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(share - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - k)
        sub = corr[np.ix_(left, left)]
        group = [left.pop(int(sub.sum(axis=1).argmax()))]
        while len(group) < width:
            group.append(left.pop(int(corr[np.ix_(left, group)].sum(axis=1).argmax())))
        groups.append(sorted(group))
    return groups


def _value(fp: Column, bits: list[int]) -> Column:
    """The chosen bits of the fingerprint side by side, as a long."""
    out = F.lit(0).cast("long")
    for at, bit in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit(1).cast("long")), at))
    return out


def _within(bits: list[int], p: np.ndarray, radius: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most t of the bits, t = 0..radius, from the bits' shares."""
    dist = np.zeros(radius + 1)
    dist[0] = 1.0
    for b in bits:
        d = 2 * p[b] * (1 - p[b])
        dist = dist * (1 - d) + np.concatenate([[0], dist[:-1]]) * d
    return np.cumsum(dist)


def allocate(cost: np.ndarray, radius: int) -> tuple[float, list[int]]:
    """Radii t_i >= -1 with sum radius - m + 1 of least total cost; cost[i, t + 1] is that of radius t in partition i."""
    m = len(cost)
    total = radius - m + 1 + m  # in steps from -1
    best = {0: (0.0, [])}
    for i in range(m):
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(cost.shape[1]):
                if used + t <= total:
                    option = (c + cost[i, t], [*chosen, t - 1])
                    if used + t not in new or option < new[used + t]:
                        new[used + t] = option
        best = new
    return best[total]


def plan_search(fps: DataFrame, radius: int, choices: tuple[int, ...] = (3,)) -> list[tuple[list[int], int]]:
    """Partitions with their radii, of the numbers of partitions offered the one that is estimated to cost least."""
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    grouped = {m: group_bits(n, both, m) for m in choices if m <= radius + 1}
    keyed = [(m, i, bits) for m, groups in grouped.items() for i, bits in enumerate(groups)]
    values = fps.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), _value(F.col("fp"), bits).alias("v")) for k, (_, _, bits) in enumerate(keyed)))).alias("x"))
    same = values.groupBy("x").count().groupBy("x.k").agg(F.sum(F.expr("cast(count as double) * (count - 1) / 2")).alias("pairs")).collect()  # one row a partition
    pairs = {r["k"]: r["pairs"] for r in same}
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m, groups in grouped.items():
        cost = np.zeros((m, radius + 2))
        for k, (mm, i, bits) in enumerate(keyed):
            if mm != m:
                continue
            near = _within(bits, p, radius)
            floor = max(pairs.get(k, 0.0), n * n / 2 * near[0])
            probes = 0.0
            for t in range(radius + 1):
                probes += float(np.prod([(len(bits) - x) / (x + 1) for x in range(t)]))
                cost[i, t + 1] = n * (probes + (t > 0)) + CANDIDATE_COST * (floor + n * n / 2 * (near[t] - near[0]))
        total, radii = allocate(cost, radius)
        if best is None or total < best[0]:
            best = total, [(bits, t) for bits, t in zip(groups, radii, strict=True) if t >= 0]
    return best[1] if best else []


# Candidates and links


def probe_rows(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp, probe): each fingerprint under its value in each partition, and as a probe under the values near it."""
    masks = []
    for bits, t in plan:
        flips = [sum(1 << x for x in c) for d in range(1, t + 1) for c in combinations(range(len(bits)), d)]
        masks.append((bits, np.array(flips, dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            for lo in range(0, len(whole), 2048):
                fp = whole[lo : lo + 2048]
                u = fp.view(np.uint64)
                for k, (bits, flips) in enumerate(masks):
                    value = np.zeros(len(u), dtype=np.uint64)
                    for at, bit in enumerate(bits):
                        value |= ((u >> np.uint64(bit)) & np.uint64(1)) << np.uint64(at)
                    key = value.astype(np.int64) | (k << 58)
                    keys = np.concatenate([key, (key[:, None] ^ flips[None, :]).ravel()])
                    rows = np.concatenate([fp, np.repeat(fp, len(flips))])
                    probe = np.arange(len(keys)) >= len(key)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows), pa.array(probe)], names=["key", "fp", "probe"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def _matrix_links(fp: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For one key: each fingerprint with the first of those that links join it to; n rows however many links there are."""
    n, label = len(fp), np.arange(len(fp))
    u = fp.view(np.uint64)
    while True:
        before = label.copy()
        for lo in range(0, n, 256):
            near = np.bitwise_count(u[lo : lo + 256, None] ^ u[None, :]) <= radius
            near &= ~(probe[lo : lo + 256, None] & probe[None, :])
            near[np.arange(len(near)), np.arange(lo, lo + len(near))] = True
            label[lo : lo + 256] = np.where(near, label[None, :], n).min(axis=1)
        label = label[label]
        if (label == before).all():
            return fp, fp[label]


def _links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows with equal keys; rows come sorted by key."""
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(cut, len(key)))
    each = np.repeat(size, size)
    some = (each > 1) & (each <= SHORT)
    k, f, q = key[some], fp[some], probe[some]
    u = f.view(np.uint64)
    for d in range(1, SHORT):
        if d >= len(k):
            break
        same = k[d:] == k[:-d]
        if not same.any():
            break
        hit = same & ~(q[d:] & q[:-d]) & (np.bitwise_count(u[d:] ^ u[:-d]) <= radius) & (f[d:] != f[:-d])
        if hit.any():
            yield f[:-d][hit], f[d:][hit]
    for at, n in zip(cut[size > SHORT], size[size > SHORT], strict=True):
        a, b = _matrix_links(fp[at : at + n], probe[at : at + n], radius)
        yield a[a != b], b[a != b]


def link_rows(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join all rows of equal key and cell within the radius. A key's rows over CELL are dealt into a grid."""
    counts = rows.groupBy("key").count().where(F.col("count") > CELL)
    hot = materialise(counts.select("key", F.ceil(F.col("count") / CELL).cast("int").alias("cells")))
    if hot.isEmpty():
        dealt = rows.withColumn("cell", F.lit(0).cast("long"))
    else:
        # Chunk c meets chunk j in cell (min, max): each two rows of the key meet in one cell at least.
        named = rows.join(hot, "key", "left").withColumn("c", F.expr("pmod(xxhash64(fp), coalesce(cells, 1))"))
        dealt = named.withColumn("j", F.explode(F.expr("sequence(0, coalesce(cells, 1) - 1)"))).select("key", "fp", "probe", (F.least("c", "j") * F.lit(1 << 30) + F.greatest("c", "j")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(parts: list[list[np.ndarray]], whole: bool) -> Iterator[pa.RecordBatch]:
            key, cell, fp, probe = (np.concatenate(x) for x in zip(*parts, strict=True))
            end = len(key) if whole else int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if ((key != key[-1]) | (cell != cell[-1])).any() else 0
            held[:] = [[key[end:], cell[end:], fp[end:], probe[end:]]] if end < len(key) else []
            if end:
                run_no = np.cumsum(np.append(0, (key[1:end] != key[: end - 1]) | (cell[1:end] != cell[: end - 1])))
                for a, b in _links(run_no, fp[:end], probe[:end], radius):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
                if sum(len(x[0]) for x in held) >= 1 << 16:
                    yield from out(held, False)
        if held:
            yield from out(held, True)

    at_once = dealt.select("key", "cell", "fp", "probe").repartition("key", "cell").sortWithinPartitions("key", "cell", "fp")
    return at_once.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row per input row: id, text_hash, fp, root (a fingerprint of the group) and component_id.

    Texts link if their fingerprints differ in at most radius bits; component_id is the smallest id that links
    reach. Null texts count as empty, empty texts share fingerprint 0 and link like any other.
    Repeated rows each get a row. Null ids are passed over for component_id, which is null if a group
    has no other. An empty table gives an empty table; other columns, whatever their names, are not looked at.
    """
    src = df.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("_text"))
    marked = materialise(with_fingerprint(src, "_text", shingle))
    fps = materialise(marked.groupBy("fp").agg(F.min("_id").alias("least")))
    plan = plan_search(fps, radius)
    small = df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")  # rows of a few longs from here on
    try:
        links = materialise(link_rows(probe_rows(fps, plan), radius).distinct())
    finally:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    roots = connected_components(links)
    of = fps.join(roots, fps.fp == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of = materialise(of)
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    table = of.join(named, "root").select("fp", "root", "component_id")
    return marked.join(table, "fp").select(F.col("_id").alias(id_col), "text_hash", "fp", "root", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """The input's columns, one row of each group of near-duplicates: that of the smallest id (null last),
    and among rows of this id that of the smallest text hash; of wholly alike ones, any."""
    return _first_of_each(df, materialise(near_duplicates(df, id_col, text_col, radius, shingle)), id_col, text_col)


def _first_of_each(df: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of df for each root in marked (id, text_hash, root)."""
    chosen = marked.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("void"), F.col(id_col).alias("id"), F.col("text_hash").alias("h"))).alias("first"))
    keep = chosen.select(F.col("first.id").alias("_kid"), F.col("first.h").alias("_kh"))
    held, at = shielded(df)
    id_ = at[id_col.lower()]
    hashed = held.withColumn("_h", F.xxhash64(F.coalesce(F.col(at[text_col.lower()]), F.lit(""))))
    kept = hashed.join(keep, hashed[id_].eqNullSafe(F.col("_kid")) & (hashed["_h"] == F.col("_kh")), "left_semi")
    repeated = marked.groupBy(F.col(id_col).alias("_kid"), F.col("text_hash").alias("_kh")).count().where("count > 1").drop("count")
    alike = kept[id_].eqNullSafe(F.col("_kid")) & (kept["_h"] == F.col("_kh"))
    once = kept.join(repeated, alike, "left_anti")
    # Rows alike in id and text: one of them, whatever their other columns hold.
    many = kept.join(repeated, alike, "left_semi").dropDuplicates([id_, "_h"])
    return once.union(many).drop("_h").toDF(*df.columns)


# Shingle sets

#: One set in SAMPLE is looked at to find keys of very many sets; HOT of the looked at make one.
SAMPLE = 64
HOT = 8
#: SimHash bits in which sets differ at most that meet by it, and longs of a set's sketch.
RADIUS = 3
SKETCH = 4
#: Keys of a large set, values in a key, and shingles from which on a set is large.
BANDS = 14
ROWS = 4
SMALL_SET = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, shingle: int = 5) -> Iterator[np.ndarray]:
    """For each text the ascending hashes of its word shingles, each once. Fewer words than a shingle make one; no word, none."""
    for _, _, texts in texts_of(column, LOWER):
        words = texts.hashes()
        for k in range(texts.n):
            w = words[texts.first[k] : texts.first[k + 1]]
            size = min(shingle, len(w))
            h = np.full(max(len(w) - size + 1, 0) if size else 0, size, dtype=np.uint64)
            for i in range(size):
                h = mix(h * _STEP + w[i : i + len(h)])
            yield np.unique(h)


def band_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a large set (ascending hashes): hashes of ROWS of its least values in equal ranges of the hashes, an empty range lent the next one's.

    A value is the same in two sets with their similarity's chance, so sets of similarity t share one of BANDS keys with chance
    1 - (1 - t^ROWS)^BANDS: 0.9989 at 0.8, 0.07 at 0.27.
    """
    bins = BANDS * ROWS
    at = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.searchsorted(at, np.arange(bins, dtype=np.uint64))
    lent = first % len(h)  # the least value of a range, or of the next one that has any
    value = mix(h[lent] + np.arange(bins, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * _STEP + value[:, i])
    return key


def set_keys(h: np.ndarray, similarity: float) -> np.ndarray:
    """What similar sets share one of: of small sets their smallest hashes, for sets of similarity t have t * n hashes in common at least, so
    one is among the n - t * n + 1 smallest of either; of large ones band keys, which do not meet for a passage in common. Sets between have both."""
    small = h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1] if similarity * len(h) <= SMALL_SET else h[:0]
    return np.concatenate([small, band_keys(h)]) if len(h) >= SMALL_SET else small


def set_simhash(h: np.ndarray) -> np.uint64:
    """SimHash of a set of hashes: a bit is 1 if it is set in over half of them; 0 of an empty set."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        some = np.ascontiguousarray(h[at : at + (1 << 15)])
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]


def set_sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the members in each of SKETCH * 64 places: as many as differ between two sets, so many members at least are in one set alone."""
    odd = np.bincount((mix(h ^ _STEP) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _set_rows(df: DataFrame, keep: list[str], shingle: int, similarity: float, whole: bool) -> DataFrame:
    """keep (two longs or so), fp (a hash of the set), n (its size) and all of its hashes, or its keys, SimHash (sh) and sketch (p0 and so on)."""
    small_batches(df.sparkSession)
    signs = [] if whole else ["sh", *(f"p{i}" for i in range(SKETCH))]
    names = [*keep, "fp", "n", *signs, "hashes"]
    src = df.select(*keep, "_text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), "fp long, n long", *(f"{c} long" for c in signs), "hashes array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, held, marks = [], [], [], []
            for h in shingle_sets(batch.column(len(keep)), shingle):
                fps.append(mix(np.atleast_1d(mix(h + _STEP).sum(dtype=np.uint64)))[0] if len(h) else np.uint64(0))
                sizes.append(len(h))
                held.append(h if whole else set_keys(h, similarity))
                if not whole:
                    marks.append(np.append(set_simhash(h).view(np.int64), set_sketch(h)))
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            flat = np.concatenate([*held, np.empty(0, np.uint64)]).view(np.int64)
            table = np.array(marks, dtype=np.int64).reshape(-1, len(signs)) if signs else None
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(signs))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=names)

    return src.mapInArrow(run, schema)


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: id, text_hash, fp (a hash of its shingle set) and root, equal for the texts of a group.

    Texts link if the Jaccard similarity of their sets of word shingles is at least `similarity`: all such pairs of small sets, and those of
    large ones with the chance that band_keys gives, are found or lie in one group already. Texts without a word are alike. Sets meet first by SimHashes of the sets that differ
    in RADIUS bits at most, and each with one other, the least of most of its keys, which joins nearly all groups; then those of a key that lie in different groups
    are compared pair by pair, if their sketches leave it open. All pairs that meet are verified on whole sets.
    """
    scratch = Scratch(df.sparkSession)
    try:
        src = df.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        rows = scratch.keep(_set_rows(src, ["_id", "text_hash"], shingle, similarity, False))
        roots = _set_links(scratch, src, rows, shingle, similarity)
        marked = rows.select("_id", "text_hash", "fp")
        return materialise(marked.join(bounded(roots, 16), marked["fp"] == roots["node"], "left").select(F.col("_id").alias(id_col), "text_hash", "fp", F.coalesce("root", "fp").alias("root")))
    finally:
        scratch.clear()


def _simhash_pairs(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (fp, n, sh) that SimHash brings together: those of one SimHash with the least of them, and these where two SimHashes lie within the radius."""
    hashes = scratch.keep(sets.groupBy("sh").agg(F.min("fp").alias("at"), F.count("*").alias("sets")))
    fps = hashes.select(F.col("sh").alias("fp"))
    plan = plan_search(fps, RADIUS)
    small = sets.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sets.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")  # rows of a few longs
    try:
        links = scratch.keep(link_rows(probe_rows(fps, plan), RADIUS).distinct()) if plan else None
    finally:
        sets.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
    same = sets.select("sh", "fp").join(bounded(hashes.where("sets > 1").select("sh", "at"), 32), "sh").where("fp <> at").select(F.col("fp").alias("a"), F.col("at").alias("b"))
    if links is None:
        return same
    of = lambda x: hashes.select(F.col("sh").alias(x), F.col("at").alias(f"at{x}"))
    return same.union(links.join(of("a"), "a").join(of("b"), "b").select("ata", "atb"))


def _set_links(scratch: Scratch, src: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the sets that are linked."""
    signs = [f"p{i}" for i in range(SKETCH)]
    sets = rows.groupBy("fp", "n").agg(F.first("hashes").alias("hashes"))
    marks = scratch.keep(rows.groupBy("fp", "n").agg(*(F.first(c).alias(c) for c in ("sh", *signs))))
    keyed = sets.select("fp", "n", F.explode("hashes").alias("key"))
    # Keys of very many sets, as a sample shows them, are dealt over several tasks; which ones changes the plan alone, not the result.
    some = rows.where(F.pmod(F.xxhash64(F.lit(1), "fp"), F.lit(SAMPLE)) == 0).select("fp", F.explode("hashes").alias("key")).distinct()
    hot = scratch.keep(some.groupBy("key").count().where(F.col("count") >= HOT).select("key", F.lit(True).alias("hot")))
    dealt = keyed.join(bounded(hot), "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("fp"), F.lit(SAMPLE))).otherwise(F.lit(-1)))
    sharing = dealt.repartition("key", "salt").withColumn("sharing", F.count("*").over(W.partitionBy("key", "salt")))
    met = scratch.keep(sharing.where("hot or sharing > 1").select("key", "fp", "n"))
    need = f"ceil({similarity / (1 + similarity)!r} * (na + nb) - 1e-9)"
    near = f"least(na, nb) >= {similarity} * greatest(na, nb) - 1e-9"

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that reach the similarity, by whole sets."""
        wanted = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
        at = scratch.keep(rows.join(bounded(wanted, 16), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct(F.col("_id").isNull().alias("void"), F.col("_id").alias("id"), F.col("text_hash").alias("h"))).alias("at")).select(F.col("at.id").alias("_aid"), F.col("at.h").alias("_ah")))
        texts = src.join(bounded(at), src["_id"].eqNullSafe(F.col("_aid")) & (src["text_hash"] == F.col("_ah"))).select("_text")
        full = scratch.keep(_set_rows(texts, [], shingle, similarity, True).dropDuplicates(["fp"]))
        one = lambda x: full.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("hashes").alias(f"h{x}"))
        return scratch.keep(pairs.join(one("a"), "a").join(one("b"), "b").where(f"size(array_intersect(ha, hb)) >= {need}").select("a", "b"))

    # First each set with one other, the least of most of its keys.
    least = scratch.keep(met.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("at")).select("key", F.col("at.fp").alias("a"), F.col("at.n").alias("na")))
    stars = met.withColumnRenamed("n", "nb").join(least, "key").where(f"fp <> a and {near}").groupBy("a", "fp").count()
    starred = stars.groupBy(F.col("fp").alias("b")).agg(F.max_by("a", "count").alias("a")).select("a", "b")
    tried = scratch.keep(starred.union(_simhash_pairs(scratch, marks)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = verified(tried)
    roots = connected_components(links, scratch=scratch)
    placed = met.join(bounded(roots, 16), met["fp"] == roots["node"], "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    split = scratch.keep(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"))
    rest = scratch.keep(placed.join(bounded(split, 16), "key", "left_semi").join(marks.select("fp", *signs), "fp"))
    side = lambda x: rest.select(F.col("key").alias(f"key{x}"), F.col("fp").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "root", *signs)))
    # Similar sets have at most as many members in one of them alone as the sketches may differ in places.
    most = f"{(1 - similarity) / (1 + similarity)!r} * (na + nb) + 1e-9"
    can = F.expr(f"keya = keyb and a < b and roota <> rootb and {near} and {' + '.join(f'bit_count({c}a ^ {c}b)' for c in signs)} <= {most}")
    new = scratch.keep(side("a").join(side("b"), can).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    if new.isEmpty():
        return roots
    return joined_components(roots, verified(new), scratch)


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The input's columns, one row of each group of similar_texts, chosen as by drop_near_duplicates."""
    return _first_of_each(df, similar_texts(df, id_col, text_col, shingle, similarity), id_col, text_col)
