"""Near duplicates by fast similarity sketching, banding and exact verification.

* A document's set is its distinct word shingles (64-bit hashes). The sketch has ``COORDINATES`` bins. In each of the
  first rounds every element falls into one hashed bin; in later rounds all elements go to one bin each, so after
  twice as many rounds as bins every bin is filled; it stops when all are. A bin keeps the least (round, hash).
* ``BANDS`` bands of ``ROWS`` coordinates: a pair at the threshold of 0.8 meets in no band once in eight million times.
* Documents with equal sets form a class at once and only its representative goes on.
* Each representative is first compared, on whole sets, with the least document of all its buckets, and links are
  joined into components. Then only pairs of different components that share a bucket are left; they pass if their
  sketches agree in at least ``LEAST_AGREEING`` coordinates (six standard deviations below the threshold). Each member's
  best partner is compared, round by round while that joins components, and at the end all pairs that are left.
  So a group of copies costs one comparison per copy, not one per pair, and nothing is capped.
* Components come from alternating large-star and small-star steps over links.

Defined results: null texts and texts without words have an empty set and are linked with nothing; rows with a null id
take no part and have a null component and ``kept`` true; rows of one id are one document with several texts, linked
by its id; extra columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sievelab.llm.common import drop_path, pick, release, spread, trimmed, written
from sievelab.llm.wordhash import U, mix, word_hashes
from sievelab.session import cut_lineage

SHINGLE = 4
BANDS = 40
ROWS = 5
COORDINATES = BANDS * ROWS
LEAST_AGREEING = 126
PERCENT = 80
#: Ids up to this number (16 MB) are broadcast to pick the texts to compare; beyond it they are joined.
BROADCAST_IDS = 2_000_000
CHUNK = 512
#: Members of a mixed bucket that are compared as one group.
LANE = 2048
LANE_SHINGLES = 2_000_000

def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and their ends."""
    each, counts = word_hashes(column)
    ends = np.cumsum(counts)
    chain = np.full(max(0, len(each) - size + 1), 0x9E3779B97F4A7C15, U)
    for j in range(size):
        chain = mix(chain ^ each[j : j + len(chain)])
    out, n = [], np.zeros(len(column), np.int64)
    for i, (a, b) in enumerate(zip(ends - counts, ends)):
        if b - a >= size:
            own = np.unique(chain[a : b - size + 1])
        elif b > a:
            own = np.full(1, b - a, U)
            for w in each[a:b]:
                own = mix(own ^ w)
        else:
            continue
        out.append(own)
        n[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.cumsum(n)


def sketches(elements: np.ndarray, ends: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """One row of ``size`` 16-bit coordinates for each set that is not empty."""
    counts = np.diff(ends, prepend=0)
    counts = counts[counts > 0]
    sets = len(counts)
    least = np.full(sets * size, np.iinfo(U).max, U)
    owner = np.repeat(np.arange(sets), counts)
    for turn in range(2 * size):
        x = mix(elements + U((0x9E3779B97F4A7C15 * (turn + 1)) & 0xFFFFFFFFFFFFFFFF))
        bins = ((x >> U(32)) * U(size) >> U(32)).astype(np.int64) if turn < size else turn - size
        value = (U(turn) << U(54)) | (mix(x) >> U(10))
        np.minimum.at(least, owner * size + bins, value)
        missing = (least.reshape(sets, size) == np.iinfo(U).max).any(axis=1)
        if not missing.any():
            break
        on = missing[owner]
        elements, owner = elements[on], owner[on]
    return (mix(least) & U(0xFFFF)).astype(np.uint16).reshape(sets, size)


def _prints(elements: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = memoryview(np.ascontiguousarray(elements)).cast("B")
    return [
        xxhash.xxh3_128_digest(data[8 * a : 8 * b]) if b > a else b"" for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)
    ]


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            elements, ends = shingle_sets(part.column("text"))
            rows = iter(sketches(elements, ends))
            n = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(_prints(elements, ends), pa.binary()),
                    pa.array([next(rows).tobytes() if k else b"" for k in n], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "print", "sketch"],
            )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by lane; in a lane the centre stands before the texts to compare with it."""
    lane = centre = None
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            elements, ends = shingle_sets(part.column("text"))
            prints = _prints(elements, ends)
            a = b = 0
            found = []
            for i, row in enumerate(part.select(["centre", "lane", "node", "print", "member"]).to_pylist()):
                a, b = b, int(ends[i])
                if prints[i] != row["print"]:
                    continue  # another text of the same id
                own = elements[a:b]
                if (row["centre"], row["lane"]) != lane:
                    lane, centre = (row["centre"], row["lane"]), None
                if not row["member"]:
                    centre = own
                elif centre is not None:
                    both = len(np.intersect1d(centre, own, assume_unique=True))
                    if 100 * both >= PERCENT * (len(centre) + len(own) - both):
                        found.append((row["node"], row["centre"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"]
            )


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, u_print, v, v_print) whose whole sets are similar enough, as links (u, v).

    Texts are sent once per centre and lane; a centre with many partners has its own text in every lane of about
    ``CHUNK`` of them, so no lane grows with the group.
    """
    sizes = pairs.groupBy("v", "v_print").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("lanes"))
    members = pairs.join(sizes, ["v", "v_print"]).select(
        F.col("v").alias("centre"),
        F.pmod(F.xxhash64("u"), "lanes").cast("int").alias("lane"),
        F.lit(True).alias("member"),
        F.col("u").alias("node"),
        F.col("u_print").alias("print"),
    )
    centres = sizes.select(
        F.col("v").alias("centre"),
        F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"),
        F.lit(False).alias("member"),
        F.col("v").alias("node"),
        F.col("v_print").alias("print"),
    )
    wanted = cut_lineage(members.unionByName(centres))
    return (
        wanted.join(_texts_of(wanted, texts), "node")
        .repartition("centre", "lane")
        .sortWithinPartitions("centre", "lane", "member")
        .mapInArrow(trimmed(_compare), "u long, v long")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the links (u, v); the component is its least node."""
    edges = cut_lineage(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        # every greater neighbour of a node goes to the least of the node's neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # then every node and its lesser neighbours go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u <> v")
            .distinct()
        )
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _by_group(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` with tables of whole groups; rows come sorted by bucket and lanes. A group is the members of one
    lane of a bucket, or of two lanes to compare."""
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
        starts = _group_starts(rest)
        if len(starts) > 1:
            yield work(rest.slice(0, int(starts[-1])))
            rest = rest.slice(int(starts[-1]))
    if rest is not None and rest.num_rows:
        yield work(rest)


def _group_starts(rows: pa.Table) -> np.ndarray:
    first = np.zeros(rows.num_rows, bool)
    first[:1] = True
    for name in ("key", "low", "high"):
        value = rows.column(name).to_numpy()
        first[1:] |= value[1:] != value[:-1]
    return np.flatnonzero(first)


def _candidates(rows: pa.Table, sketch: np.ndarray, later: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each member: partners of other components whose sketches agree enough, in how many coordinates, and whether
    this bucket's band is the first that the pair shares. With ``later`` each pair comes once."""
    column = {c: rows.column(c).to_numpy() for c in ("band", "component", "size", "lane", "low", "high")}
    starts = _group_starts(rows)
    for begin, end in zip(starts, [*starts[1:], rows.num_rows]):
        across = column["low"][begin] != column["high"][begin]
        for i in range(begin, end):
            j = np.arange(i + 1 if later else begin, end)
            j = j[column["component"][j] != column["component"][i]]
            if across:
                j = j[column["lane"][j] != column["lane"][i]]
            least, most = np.minimum(column["size"][j], column["size"][i]), np.maximum(column["size"][j], column["size"][i])
            j = j[least * 100 >= most * PERCENT]
            if len(j):
                same = sketch[j] == sketch[i]
                agree = same.sum(axis=1)
                close = agree >= LEAST_AGREEING
                if close.any():
                    first = same[close].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                    yield i, j[close], agree[close], first == column["band"][i]


def _sketch_column(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _best_pairs(rows: pa.Table) -> pa.RecordBatch:
    """Each member with its most agreeing partner."""
    found = [(i, j[agree.argmax()]) for i, j, agree, _ in _candidates(rows, _sketch_column(rows), later=False)]
    i, j = np.array(found, int).reshape(-1, 2).T
    component = rows.column("component").to_numpy()
    swap = component[i] < component[j]
    u, v = rows.take(np.where(swap, j, i)), rows.take(np.where(swap, i, j))
    columns = [x.column(c).combine_chunks() for x in (u, v) for c in ("node", "print")]
    return pa.RecordBatch.from_arrays(columns, names=["u", "u_print", "v", "v_print"])


MEMBER = "key long, band int, component long, node long, print binary, size long, lane int, low int, high int"


def _with_partners(rows: pa.Table) -> pa.RecordBatch:
    """The members that have a partner to compare with in this group."""
    on = np.zeros(rows.num_rows, bool)
    for i, j, _, first in _candidates(rows, _sketch_column(rows), later=True):
        if first.any():
            on[i] = True
            on[j[first]] = True
    kept = rows.select([f.strip().split(" ")[0] for f in MEMBER.split(",")]).filter(pa.array(on)).combine_chunks()
    return kept.to_batches()[0] if kept.num_rows else pa.RecordBatch.from_pylist([], schema=kept.schema)


def _linked(rows: pa.Table) -> pa.RecordBatch:
    """Pairs of a group whose whole sets are similar enough."""
    texts = rows.column("text").combine_chunks()
    elements, ends = shingle_sets(texts)
    right = np.array([a == b for a, b in zip(_prints(elements, ends), rows.column("print").to_pylist())], bool)
    sets = [elements[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
    if not right.all():  # another text of the same id
        rows, sets = rows.filter(pa.array(right)), [s for s, r in zip(sets, right) if r]
    node = rows.column("node").to_numpy()
    links = []
    if sets:
        sizes = np.array([len(s) for s in sets])
        sketch = sketches(np.concatenate(sets), np.cumsum(sizes))
        for i, js, _, first in _candidates(rows, sketch, later=True):
            for j in js[first]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= PERCENT * (sizes[i] + sizes[j] - both):
                    links.append((int(node[i]), int(node[j])))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the given nodes (a column ``node``)."""
    nodes = cut_lineage(nodes.select(F.col("node").alias("doc_id")).distinct())
    few = nodes.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi").withColumnRenamed("doc_id", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    texts = pick(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col)
    sketched = written(
        spread(texts, "doc_id").mapInArrow(trimmed(_sketch_rows), "doc_id long, n_shingles long, print binary, sketch binary"), "sketches"
    )
    real = sketched.filter("doc_id is not null and n_shingles > 0")
    classes, classes_path = written(
        real.groupBy("print").agg(
            F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")
        ),
        "classes",
        with_path=True,
    )
    copies = classes.filter("n > 1").select("print", F.col("node").alias("v"))
    same = real.select("print", F.col("doc_id").alias("u")).join(copies, "print").select("u", "v").filter("u <> v")

    # a class is known by its least document and, only where that has several texts, by its print: band rows stay small
    repeated = cut_lineage(classes.groupBy("node").count().filter("count > 1").select("node", F.lit(True).alias("twin")))
    few = repeated.count() <= BROADCAST_IDS
    marked = classes.join(F.broadcast(repeated) if few else repeated, "node", "left").withColumn("mark", F.when(F.col("twin"), F.col("print")).otherwise(F.lit(b"")))
    hashed = F.xxhash64("b", F.substring("sketch", F.col("b") * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    banded = marked.select("node", "mark", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("b")).select(
        "node", "mark", hashed.bitwiseAND(F.lit(-64)).bitwiseOR(F.col("b").cast("long")).alias("key")
    )
    shared = banded.groupBy("key").agg(F.min(F.struct("node", "mark")).alias("centre"), F.count("*").alias("n")).filter("n > 1")
    met = banded.join(shared.select("key", "centre"), "key").join(marked.select("node", "mark", "print", "size"), ["node", "mark"])
    buckets, buckets_path = written(met.withColumn("band", F.col("key").bitwiseAND(F.lit(63)).cast("int")), "buckets", with_path=True)

    first = (
        buckets.filter("node <> centre.node or mark <> centre.mark")
        .groupBy("node", "print")
        .agg(F.min("centre").alias("c"))
        .select(F.col("node").alias("u"), F.col("print").alias("u_print"), F.col("c.node").alias("v"), F.col("c.mark").alias("v_mark"))
        .join(marked.select(F.col("node").alias("v"), F.col("mark").alias("v_mark"), F.col("print").alias("v_print")), ["v", "v_mark"])
        .select("u", "u_print", "v", "v_print")
    )
    links = confirmed(cut_lineage(first), texts).unionByName(same)
    found = cut_lineage(components(links))

    def groups(held: DataFrame, found: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, by bounded groups of each bucket."""
        placed = held.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("key")
        left = cut_lineage(placed.join(mixed, "key").select("key", "band", "component", "node", "print", "size"))
        load = F.greatest(F.count("*") / LANE, F.sum("size") / LANE_SHINGLES)
        lanes = left.groupBy("key").agg(F.ceil(load).cast("int").alias("lanes"))
        # a member meets every lane of its bucket; a bucket of one lane is one group
        return (
            left.join(lanes, "key")
            .withColumn("lane", F.pmod(F.xxhash64("node"), F.col("lanes")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
            .withColumns({"low": F.least("lane", "other"), "high": F.greatest("lane", "other")})
            .drop("lanes", "other")
        )

    def grouped(rows: DataFrame, work, schema: str) -> DataFrame:
        ordered = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
        return ordered.mapInArrow(trimmed(lambda batches: _by_group(batches, work)), schema)

    def sketched_groups(held: DataFrame, found: DataFrame) -> DataFrame:
        return groups(held, found).join(drawn, "print")

    def best_pairs(found: DataFrame) -> DataFrame:
        return cut_lineage(grouped(sketched_groups(held, found), _best_pairs, "u long, u_print binary, v long, v_print binary").distinct())

    def all_links(found: DataFrame) -> DataFrame:
        """Links among all that is left; pairs are compared inside tasks, a text moves once per group, not per pair."""
        members = cut_lineage(grouped(sketched_groups(held, found), _with_partners, MEMBER))
        return cut_lineage(grouped(members.join(_texts_of(members, texts), "node"), _linked, "u long, v long"))

    def merged(links: DataFrame, found: DataFrame) -> DataFrame:
        stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        return cut_lineage(components(links.unionByName(stars)))

    nodes = cut_lineage(buckets.select("node").distinct())
    few = nodes.count() <= BROADCAST_IDS
    drawn, drawn_path = written(
        classes.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").select("print", "sketch"), "bucket-sketches", with_path=True
    )
    # components only grow together, so a member without a partner to compare with in its bucket never gets one
    members = grouped(sketched_groups(buckets.drop("centre", "mark"), found), _with_partners, MEMBER)
    held = cut_lineage(members.select("key", "band", "node", "print", "size").distinct())
    for path in (classes_path, buckets_path):
        drop_path(docs.sparkSession, path)
    release(docs.sparkSession)

    # each member's best partner first, as long as that joins components; what is left is then compared in full
    tested = None
    while not (pairs := best_pairs(found)).isEmpty():
        fresh = pairs
        if tested is not None:
            few = tested.count() <= BROADCAST_IDS // 4
            fresh = cut_lineage(pairs.join(F.broadcast(tested) if few else tested, pairs.columns, "left_anti"))
        tested = fresh if tested is None else tested.unionByName(fresh)
        last = fresh.isEmpty()
        if not last:
            links = cut_lineage(confirmed(fresh, texts))
            last = links.isEmpty()
        links = all_links(found) if last else links
        if not links.isEmpty():
            found = merged(links, found)
        if last:
            break
        release(docs.sparkSession)
    drop_path(docs.sparkSession, drawn_path)
    out = sketched.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the least of its component, with their columns.

    Rows of one id are one document: they stay or go together.
    """
    gone = near_duplicates(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = cut_lineage(gone)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
