"""Near duplicates by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.components import connected_components
from corpusprep.llm.hashing import WordHashes, ascii_words, mix, shingle_hashes
from corpusprep.session import cut_lineage, shuffle_width

MINIMA = 128
BITS = 4
#: Standard deviations that an estimate may lie below the threshold.
_MARGIN = 4.5
#: Documents of a bucket that one step compares at most, times two.
_CELL = 256
_HUB_CELL = 64
_SLICE = 512

_RANDOM = np.random.default_rng(20240501)
_FLIP = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_TURN = _RANDOM.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x1111111111111111)


def band_rows(threshold: float, lost: float = 1e-6) -> int:
    """Most minima per band for which a pair at the threshold is lost with `lost` chance at most."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (MINIMA // r) <= lost)


def least_estimate(threshold: float) -> float:
    """Estimates below this are no sign of a pair at the threshold."""
    spread = (threshold * (1 - threshold) / MINIMA) ** 0.5 / (1 - 2.0**-BITS)
    return threshold - _MARGIN * spread


def minima(shingles: np.ndarray) -> np.ndarray:
    found = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), _SLICE):
        part = (shingles[k : k + _SLICE, None] ^ _FLIP) * _TURN
        np.minimum(found, part.min(axis=0), out=found)
    return found


def packed(found: np.ndarray) -> np.ndarray:
    """The low bits of the minima, sixteen to a 64-bit word."""
    low = (found & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << np.uint8(BITS))).view(np.uint64)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, corrected for low bits that agree by chance."""
    x = one ^ many
    x = x | (x >> np.uint64(2))
    x = (x | (x >> np.uint64(1))) & _LANES
    agree = 1 - np.bitwise_count(x).sum(axis=-1) / MINIMA
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def _set_hash(shingles: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _signatures(width: int, rows: int):
    bands = MINIMA // rows
    schema = pa.schema([
        ("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
        ("bands", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64())),
    ])
    offsets = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            columns = [[] for _ in schema]
            for row, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                shingles = np.unique(shingle_hashes(ascii_words(text.as_py()), width, cache))
                h1, h2 = _set_hash(shingles)
                keys = sig = None
                if len(shingles):
                    found = minima(shingles)
                    keys = offsets.copy()
                    for part in found[: bands * rows].reshape(bands, rows).T:
                        keys = mix(keys ^ part)
                    keys, sig = keys.view(np.int64), packed(found).view(np.int64)
                for column, value in zip(columns, (row, len(shingles), h1, h2, keys, sig)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _sets(width: int):
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids, sets = [], []
            for rep, h1, h2, text in zip(*[batch.column(n) for n in ("rep", "h1", "h2", "text")]):
                shingles = np.unique(shingle_hashes(ascii_words(text.as_py()), width, cache))
                if _set_hash(shingles) == (h1.as_py(), h2.as_py()):
                    ids.append(rep.as_py())
                    sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least that similarity, in whole numbers."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    both = np.concatenate((one, two))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], schema=_PAIR)


def _verify_hubs(percent: int):
    """Links between a hub, first of its sorted group, and the members that follow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            found = []
            for key, rep, shingles in zip(batch.column("hub").to_pylist(), batch.column("rep").to_pylist(), batch.column("shingles")):
                own = shingles.values.to_numpy()
                if rep == key:
                    hub, hub_set = key, own.copy()
                elif hub == key and linked(hub_set, own, percent):
                    found.append((rep, key))
            yield _pairs(found)

    return run


class _Forest:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.root(x)] = self.root(y)


def _compare(rows: list[tuple], sides: bool, percent: int, least: float) -> list[tuple[int, int]]:
    """Links that connect different components among the rows of a cell pair.

    With `sides`, rows of the two sides are compared; else all rows of the cell. A pair is
    looked at in the first band that it shares, and only while it is not yet connected.
    """
    if len({r[1] for r in rows}) < 2:
        return []
    sigs = np.array([r[4] for r in rows], np.int64).view(np.uint64)
    comps = np.array([r[1] for r in rows])
    sizes = np.array([r[3] for r in rows])
    bands = np.array([r[5] for r in rows])
    band = rows[0][6]
    side = np.array([r[2] for r in rows])
    forest, found = _Forest(), []
    for i in range(len(rows)):
        others = np.arange(i + 1, len(rows))
        others = others[comps[others] != comps[i]]
        if sides:
            others = others[side[others] != side[i]]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[100 * small >= percent * large]
        if not len(others):
            continue
        close = estimates(sigs[i], sigs[others])
        order = np.argsort(-close, kind="stable")
        others = others[order[close[order] >= least]]
        for j in others[np.argmax(bands[others] == bands[i], axis=1) == band]:
            if forest.root(comps[i]) != forest.root(comps[j]) and linked(rows[i][7], rows[j][7], percent):
                forest.join(comps[i], comps[j])
                found.append((rows[i][0], rows[j][0]))
    return found


def _verify_cells(percent: int, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            found = []
            names = ("key", "kind", "i", "j", "rep", "comp", "side", "n", "sig", "bands", "band", "shingles")
            lists = [batch.column(n) if n in ("sig", "bands", "shingles") else batch.column(n).to_pylist() for n in names]
            for key, kind, i, j, rep, comp, side, n, sig, bands, band, shingles in zip(*lists):
                if (key, kind, i, j) != now:
                    if now:
                        found += _compare(rows, now[1] == 1 or now[2] != now[3], percent, least)
                    now, rows = (key, kind, i, j), []
                own = [x.values.to_numpy().copy() for x in (sig, bands, shingles)]
                # In a pair of two cells of one kind the cell tells the sides apart.
                rows.append((rep, comp, side, n, own[0], own[1], band, own[2]))
            yield _pairs(found)
        if now:
            yield _pairs(_compare(rows, now[1] == 1 or now[2] != now[3], percent, least))

    return run


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Groups of near copies: ``id, n_shingles, component_id, kept`` with a row per input row.

    Words are those of the text with A-Z lower-cased; a document's set has its distinct runs
    of `width` words, or all its words as one run. Documents are linked whose sets share
    `percent` of their union or more; a component is named by its smallest id, which is kept.

    1. 128 minima per set give band keys and, by their low four bits, a packed signature.
    2. Documents with equal sets are one class from here on.
    3. In each bucket of a band, members are compared with one hub, which keeps the work on a
       large group of copies linear: first by signature, then by their full sets.
    4. Only members that are not connected to the hub by then are compared with the others of
       their bucket, in cells of bounded size that emit links between components only.

    Bands lose a pair at the threshold with a chance below 1e-6, signatures below 1e-5.

    A text without words (null, empty) has no shingle and is linked with nothing. A row
    without id is linked with nothing, has no component and is kept. Rows that share an id
    are one document in the links. No row gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    rows, least = band_rows(threshold), least_estimate(threshold)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    base = cut_lineage(texts.mapInArrow(
        _signatures(width, rows), "id bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>, sig array<bigint>"))
    classes = cut_lineage(
        base.filter("n > 0 and id is not null").groupBy("h1", "h2")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    keys = classes.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    multi = cut_lineage(keys.join(shared, "key"))

    # The hub of a bucket is its member with most company in all its buckets.
    company = multi.groupBy("rep").agg(F.sum("size").alias("company"))
    hubs = multi.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("o"))).alias("m"))
    hubs = hubs.select("key", (-F.col("m.o")).alias("hub"))
    near = multi.join(hubs, "key").filter("rep <> hub").select("rep", "hub").distinct()
    facts = company.select("rep").join(classes, "rep").select("rep", "n", "sig", "bands", "h1", "h2")
    facts = cut_lineage(facts)
    one = facts.select("rep", F.col("n").alias("n1"), F.col("sig").alias("s1"))
    two = facts.select(F.col("rep").alias("hub"), F.col("n").alias("n2"), F.col("sig").alias("s2"))

    def unlike(k: int):
        x = F.get("s1", F.lit(k)).bitwiseXOR(F.get("s2", F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(int(_LANES)))
        return F.bit_count(x)

    agree = 1 - sum((unlike(k) for k in range(MINIMA * BITS // 64)), F.lit(0)) / MINIMA
    close = (agree - 2.0**-BITS) / (1 - 2.0**-BITS)
    fits = 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")
    likely = cut_lineage(near.join(one, "rep").join(two, "hub").filter(fits & (close >= least)).select("rep", "hub"))

    sets = texts.join(facts.select("rep", "h1", "h2"), F.col("id") == F.col("rep")).select("rep", "h1", "h2", "text")
    sets = sets.mapInArrow(_sets(width), "rep bigint, shingles array<bigint>").dropDuplicates(["rep"])
    sets = cut_lineage(sets)
    degree = likely.groupBy("hub").agg(F.expr(f"cast((count(*) + {_HUB_CELL - 1}) div {_HUB_CELL} as int)").alias("cells"))
    members = likely.join(degree, "hub").withColumn("cell", F.pmod(F.xxhash64("rep"), F.col("cells")))
    heads = degree.select(F.col("hub").alias("rep"), "hub", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    stars = members.select("rep", "hub", "cell").unionByName(heads.select("rep", "hub", F.col("cell").cast("bigint")))
    width_out = shuffle_width(spark)
    links = cut_lineage(
        stars.join(sets, "rep").repartition(width_out, "hub", "cell")
        .sortWithinPartitions("hub", "cell", F.col("rep") != F.col("hub")).mapInArrow(_verify_hubs(percent), "a bigint, b bigint")
    )

    first = connected_components(links)
    comp = F.coalesce("component", "rep")
    left = multi.join(first, F.col("rep") == F.col("id"), "left").select("rep", "band", "key", comp.alias("comp"))
    left = left.join(hubs, "key").join(first.select(F.col("id").alias("hub_"), F.col("component").alias("hc")), F.col("hub") == F.col("hub_"), "left")
    left = left.withColumn("side", (F.col("comp") != F.coalesce("hc", "hub")).cast("int")).select("rep", "band", "key", "comp", "side")
    cells = left.groupBy("key").agg(
        F.expr(f"cast((sum(1 - side) + {_CELL - 1}) div {_CELL} as int)").alias("c0"),
        F.expr(f"cast((sum(side) + {_CELL - 1}) div {_CELL} as int)").alias("c1"),
    ).filter("c1 > 0")
    placed = left.join(cells, "key").withColumn(
        "cell", F.pmod(F.xxhash64("rep", "key"), F.when(F.col("side") == 0, F.col("c0")).otherwise(F.col("c1"))).cast("int"))
    cross = F.when(F.col("side") == 0, F.expr("transform(sequence(0, c1 - 1), y -> struct(1 as kind, cell as i, y as j))")).otherwise(
        F.expr("transform(sequence(0, c0 - 1), x -> struct(1 as kind, x as i, cell as j))"))
    inner = F.when(F.col("side") == 1, F.expr(
        "transform(sequence(0, c1 - 1), y -> struct(2 as kind, least(y, cell) as i, greatest(y, cell) as j))"))
    spread = placed.select(
        "rep", "band", "key", "comp",
        F.when(F.col("side") == 0, F.lit(-1)).otherwise(F.col("cell")).alias("side"),
        F.explode(F.concat(cross, F.coalesce(inner, F.array().cast("array<struct<kind:int,i:int,j:int>>")))).alias("at"),
    ).select("rep", "band", "key", "comp", "side", "at.kind", "at.i", "at.j")
    more = cut_lineage(
        spread.join(facts.select("rep", "n", "sig", "bands"), "rep").join(sets, "rep")
        .withColumn("side", F.when(F.col("kind") == 1, (F.col("side") >= 0).cast("int")).otherwise(F.col("side")))
        .repartition(width_out, "key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "rep")
        .mapInArrow(_verify_cells(percent, least), "a bigint, b bigint")
    )
    whole = connected_components(links.unionByName(more))
    named = classes.select("h1", "h2", "rep").join(whole, F.col("rep") == F.col("id"), "left").select(
        F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.coalesce("component", "rep").alias("component"))
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & (F.col("n") > 0)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return base.select("id", "n", "h1", "h2").join(named, same, "left").select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` with one document of each group, the one of the smallest id, and all columns.

    Of rows that repeat an id, all stay or go together.
    """
    gone = near_duplicates(docs, id_col=id_col, **options).filter("not kept").select(F.col("id").alias("_gone"))
    return docs.join(gone.distinct(), docs[id_col].cast("bigint") == F.col("_gone"), "left_anti")
