"""N-gram Jaccard join in the metric space of shingle sets.

d = 1 - Jaccard is a metric. Texts of unrelated documents share no shingle, so
nearly all distances are exactly 1 and a few fixed pivots would tell nothing. The
pivots are therefore documents found where sets meet: any two linked sets share
some of the first floor(0.2 n) + 1 + n / 25 shingles of a common order, so each such
shingle names the set with the smallest signature that holds it as pivot, and its
holders join the region of that pivot. Each linked pair meets in at least one region.

A region is joined exactly and recursively (see region.py). A region that is too
large for a task is dealt into chunks, each with the pivot; what is tied to the
pivot there is connected. Where more is loose and far from the pivot than half a task
holds, the region is divided again: its sets get a common order of their own, in which shingles that many
of its own sets hold come last, and so new pivots and smaller regions, up to DEPTH
times, as long as that makes it smaller: near copies share so much that no order of
shingles parts them. What is loose otherwise is held against its region in bands of the distance
to the pivot, which by the triangle inequality only meet their neighbours, and in
blocks of bounded size.

Shingles that are frequent in a bounded sample come last in the common order, so a
passage that many documents share brings nobody together. The order changes the
work and never the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpoint, map_columns, returning, schema_of
from .components import components
from .region import EPS, join_region
from .shingles import shingle_set, signature

#: Documents sampled for the order of shingles, copies there that make one frequent, and how many are kept.
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 4000, 4, 200_000
#: Postings of one part, and sets and shingles that one task holds at once.
PART_POSTINGS, TASK_SETS, TASK_SHINGLES = 1_000_000, 500, 1_000_000
#: Stands for the id of a class of rows without one; behind all others.
NOBODY = (1 << 63) - 1
SHORTEST = 4  # a smaller set is linked with equal sets only
#: A prefix is longer by a shingle in so many, and sizes are told apart by this factor.
EXTRA, STEP = 25, 1.06
MET = "kind byte, doc_id long, text_hash long, n long, sig long, pivot long, shared long"
#: How often a region is divided again, sets of a region that its own order is taken from, and copies there that put a shingle last.
DEPTH, REGION_SAMPLE, REGION_FREQUENT = 4, 128, 3
#: Sets that are loose but nearer to the pivot share so much with it that no order of shingles parts them.
FAR = 2 * EPS
#: A region whose loose sets take no more blocks than this is not divided, nor is one that keeps more than this share of the sets it was divided from.
MOST_BLOCKS, SHRUNK = 128, 0.75


def frequent_shingles(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Shingles to be put last, from a sample of a documented bound."""
    step = max(1, -(-docs.count() // sample_docs))
    sample = docs.where(F.coalesce(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)), F.lit(0)) == 0)

    def make():
        return lambda texts: [np.concatenate([np.empty(0, np.int64), *map(shingle_set, texts)])]

    counts = map_columns(sample, ["text"], make, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64))


def least_shared(n: int) -> int:
    """How many shingles of both prefixes two linked sets share, the smaller one of n."""
    return 1 + n // EXTRA


def prefix(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of the common order: linked sets share least_shared of them.

    floor(n / 5) is as many as may be missing from the other set.
    """
    n = len(hashes)
    if n < SHORTEST:
        return hashes[:0]
    take = n // 5 + least_shared(n)
    if len(frequent) == 0:
        return hashes[:take]
    last = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
    rare = hashes[~last][:take]
    return rare if len(rare) == take else np.concatenate([rare, hashes[last][: take - len(rare)]])


def size_class(n: int) -> int:
    return int(math.log(max(1, n)) / math.log(STEP))


#: Sizes whose classes differ by more can't be linked.
CLASSES_APART = math.ceil(math.log(1.25) / math.log(STEP)) + 1


def meet(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Rows of documents (kind 0) and of meetings of a set with a pivot (kind 1).

    Postings travel packed, 15 bytes each, a row for each part and batch, through
    one exchange; a part is sorted in one task and has about PART_POSTINGS postings.
    Keys are cut to 40 bits within a part; two that fall together only cause a
    needless meeting. A meeting counts the shingles for which another set of a
    fitting size is there.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(1 << 22, max(4 * n, -(-docs.count() * 160 // PART_POSTINGS)))
    shared = spark.sparkContext.broadcast(frequent)

    @returning
    def packed(batches):
        last = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                ids = batch.column(0).slice(at, 2048)
                texts = batch.column(1).slice(at, 2048)
                sizes, sigs, keys, owners, known = [], [], [np.empty(0, np.int64)], [np.empty((0, 2), np.int64)], set()
                for text in texts:
                    hashes = shingle_set(text.as_py())
                    sig = signature(hashes)
                    sizes.append(len(hashes))
                    sigs.append(sig)
                    if sig not in known:
                        known.add(sig)
                        keys.append(prefix(hashes, last))
                        owners.append(np.full((len(keys[-1]), 2), (sig, size_class(len(hashes)))))
                rows = len(sizes)
                key, owner = np.concatenate(keys).view(np.uint64), np.concatenate(owners)
                part = ((key >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, owner = part[order], owner[order]
                cut = np.ascontiguousarray(key[order].view(np.uint8).reshape(-1, 8)[:, :5])
                edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
                made = [(int(part[a]), cut[a:b].tobytes(), owner[a:b, 0].tobytes(), owner[a:b, 1].astype(np.uint16).tobytes()) for a, b in zip(edges[:-1], edges[1:])]
                m = len(made)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in made] + [(s ^ 2654435761 * (i or 0)) % parts for i, s in zip(ids.to_pylist(), sigs)], pa.int32()),
                        pa.array([x[1] for x in made] + [None] * rows, pa.binary()),
                        pa.array([x[2] for x in made] + [None] * rows, pa.binary()),
                        pa.array([x[3] for x in made] + [None] * rows, pa.binary()),
                        pa.concat_arrays([pa.nulls(m, pa.int64()), ids]),
                        pa.concat_arrays([pa.nulls(m, pa.int64()), batch.column(2).slice(at, 2048)]),
                        pa.array([None] * m + sizes, pa.int64()),
                        pa.array([None] * m + sigs, pa.int64()),
                    ],
                    names=["part", "keys", "owners", "sizes", "doc_id", "text_hash", "n", "sig"],
                )

    arrow = to_arrow_schema(schema_of(MET))

    def rows_of(kind, doc_id, text_hash, size, sig, pivot, shared_keys):
        count = len(sig)
        columns = [pa.array(np.full(count, kind, np.int8)), doc_id, text_hash, size, sig, pivot, shared_keys]
        return pa.RecordBatch.from_arrays([(pa.nulls(count, f.type) if c is None else pa.array(c, f.type)) for c, f in zip(columns, arrow)], schema=arrow)

    def met(held):
        key, owner, size = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((owner, size, key))
        key, owner, size = key[order], owner[order], size[order]
        same = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])  # a set that several batches have sent
        once = np.concatenate([np.ones(min(1, len(key)), bool), ~same])
        key, owner, size = key[once], owner[once], size[once]
        near = (key[1:] == key[:-1]) & (size[1:] - size[:-1] <= CLASSES_APART)
        fits = np.zeros(len(key), bool)
        fits[1:] |= near
        fits[:-1] |= near
        key, owner, size = key[fits], owner[fits], size[fits]
        if not len(key):
            return rows_of(1, None, None, key, key, key, key)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pivot = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(key))))
        order = np.lexsort((pivot, owner))
        owner, pivot, size = owner[order], pivot[order], size[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pivot[1:] != pivot[:-1])]))
        return rows_of(1, None, None, size[first], owner[first], pivot[first], np.diff(np.append(first, len(owner))))

    @returning
    def gathered(batches):
        part, held = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                plain = piece.filter(pc.is_null(piece.column(1)))
                if plain.num_rows:
                    yield rows_of(0, *(plain.column(i) for i in range(4, 8)), None, None)
                for p, k, o, s in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist()):
                    if k is None:
                        continue
                    if p != part and held:
                        yield met(held)
                        held = []
                    part = p
                    key = np.zeros((len(s) // 2, 8), np.uint8)
                    key[:, :5] = np.frombuffer(k, np.uint8).reshape(-1, 5)
                    held.append((key.view(np.int64)[:, 0], np.frombuffer(o, np.int64), np.frombuffer(s, np.uint16).astype(np.int16)))
        if held:
            yield met(held)

    sent = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(packed, "part int, keys binary, owners binary, sizes binary, doc_id long, text_hash long, n long, sig long")
    return sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(gathered, MET)


def regions(met: DataFrame) -> DataFrame:
    """(parent, sig, pivot, about_n): the regions in which each set of a parent region must be joined.

    A set that shares too few shingles with all others together is linked with
    none. Of the rest, linked sets share least_shared shingles, each in some region
    of both; so each set may leave its thinnest regions, as long as those hold less
    than half of that many, and every linked pair still meets.
    """
    per = met.groupBy("parent", "sig", "pivot").agg(F.sum("shared").alias("shared"), F.first("n").alias("n"))
    own = Window.partitionBy("parent", "sig")
    smallest = F.floor(F.ceil(F.pow(F.lit(STEP), F.col("n")) * 0.8 - 1e-6) / EXTRA) + 1
    told = per.withColumn("total", F.sum("shared").over(own)).withColumn("so_far", F.sum("shared").over(own.orderBy("shared", "pivot").rowsBetween(Window.unboundedPreceding, 0)))
    kept = told.where((F.col("total") >= smallest) & (2 * F.col("so_far") > smallest - 1))
    return kept.select("parent", "sig", "pivot", F.ceil(F.pow(F.lit(STEP), F.col("n") + 1)).cast("long").alias("about_n"))


def dealt(met: DataFrame, task_sets: int, task_shingles: int) -> DataFrame:
    """(parent, region, pivot, task, dealt, sig): the sets of each task; a region too large for one has its pivot in every chunk."""
    chunks = F.greatest(F.ceil(F.col("sets") / task_sets), F.ceil(F.col("shingles") / task_shingles)).cast("int")
    # Written, so that the join has exchanges alone below it and a hot region's rows can be split.
    sizes = checkpoint(met.groupBy("parent", "pivot").agg(F.count("*").alias("sets"), F.sum("about_n").alias("shingles")).where("sets > 1").withColumn("chunks", chunks))
    task = F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int").alias("task")
    members = met.join(sizes.select("parent", "pivot", "chunks"), ["parent", "pivot"]).where("chunks = 1 or sig != pivot").select("parent", "pivot", task, (F.col("chunks") > 1).alias("dealt"), "sig")
    pivots = sizes.where("chunks > 1").select("parent", "pivot", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("task"), F.lit(True).alias("dealt"), F.col("pivot").alias("sig"))
    region = F.when(F.col("parent") == 0, F.col("pivot")).otherwise(F.xxhash64("parent", "pivot"))
    return members.unionByName(pivots).withColumn("region", region)


FOUND = "kind byte, a long, b long, region long, pivot long, above long, n long, known long, d double, text string"
TASK = ["region", "pivot", "task"]


def join_tasks(members: DataFrame) -> DataFrame:
    """Joins each task's sets: links (kind 0), and what is known of sets in dealt regions (kind 1: tied to the pivot, 2: loose).

    Sets with the same ``known`` are connected already; a set tied to the pivot is
    from then on known by the region. ``above`` is the number of sets in the region
    that a region was divided from, and passes as it is.
    """
    arrow = to_arrow_schema(schema_of(FOUND))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @returning
    def run(batches):
        out: list[list] = [[] for _ in arrow]
        task, is_dealt, above, held, texts, known = None, False, None, {}, {}, {}

        def add(*row):
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def close():
            region, pivot, _ = task
            names = list(held)
            at = names.index(pivot) if pivot in held else None
            links, to, roots = join_region([held[x] for x in names], at, [known[x] for x in names])
            for a, b in links:
                add(0, names[a], names[b], region, None, None, None, None, None, None)
            if is_dealt and at is not None:
                for i, name in enumerate(names):
                    tied = roots[i] == roots[at]
                    add(1 if tied else 2, name, None, region, pivot, above, len(held[name]), region if tied else known[name], float(to[i]), texts[name])
            for x in (held, texts, known):
                x.clear()

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if (now := tuple(row[x] for x in TASK)) != task and held:
                        close()
                    task, is_dealt, above = now, row["dealt"], row["above"]
                    hashes = shingle_set(row["text"])
                    if signature(hashes) == row["sig"]:
                        held[row["sig"]], known[row["sig"]] = hashes, row["known"]
                        if is_dealt:
                            texts[row["sig"]] = row["text"]
                if len(out[0]) > 1_000:
                    yield flush()
        if held:
            close()
        yield flush()

    return members.select(*TASK, "dealt", "above", "known", "sig", "text").repartition(n, *TASK).sortWithinPartitions(*TASK).mapInArrow(run, FOUND)


def with_texts(tasks: DataFrame, plain: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the text of one document of each set; rows are told apart by id and text, so ids may be null or repeated.

    Where rows repeat an id, texts are first brought down to one of each (id, text),
    so that a text repeated under one id doesn't multiply.
    """
    rep = F.coalesce("doc_id", F.lit(NOBODY))
    classes = plain.where("n > 0").groupBy("sig").agg(F.min(rep).alias("rep"), F.min_by("text_hash", rep).alias("text_hash"))
    texts = docs.select(rep.alias("rep"), F.xxhash64("text").alias("text_hash"), "text")
    if not plain.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.groupBy("rep", "text_hash").agg(F.first("text").alias("text"))
    return tasks.join(classes, "sig").join(texts, ["rep", "text_hash"]).select(*TASK, "dealt", F.lit(None).cast("long").alias("above"), F.lit(None).cast("long").alias("known"), "sig", "text")


POSTED = "region long, key long, sig long, n long, loose boolean"


def own_order(opened: DataFrame, task_sets: int, task_shingles: int, sample: int = REGION_SAMPLE) -> DataFrame:
    """The prefix of each set in the common order of its region: (region, key, sig, n, loose).

    The order comes from up to ``sample`` of the region's own sets, as many as hold
    half a task's shingles; every chunk of the region gets the same ones.
    """
    first = Window.partitionBy("region").orderBy(F.xxhash64("sig"), "sig")
    chosen = opened.select("region", "sig", "n").withColumn("at", F.row_number().over(first)).where(F.col("at") <= sample)
    chosen = chosen.withColumn("so_far", F.sum("n").over(first)).where((F.col("at") == 1) | (F.col("so_far") <= task_shingles // 2)).select("region", "sig")
    chunks = F.greatest(F.ceil(F.count("*") / task_sets), F.ceil(F.sum("n") / task_shingles)).cast("int")
    sizes = checkpoint(opened.groupBy("region").agg(chunks.alias("chunks")))
    own = opened.join(sizes, "region").select("region", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int").alias("task"), F.lit(False).alias("sampled"), "sig", "loose", "text")
    seen = opened.join(chosen, ["region", "sig"]).join(sizes, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("task"), F.lit(True).alias("sampled"), "sig", "loose", "text")
    n = int(opened.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrow = to_arrow_schema(schema_of(POSTED))

    @returning
    def run(batches):
        task, held, last = None, [], None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(at, 64).to_pylist():
                    if (row["region"], row["task"]) != task:
                        task, held, last = (row["region"], row["task"]), [], None
                    hashes = shingle_set(row["text"])
                    if row["sampled"]:
                        held.append(hashes)
                        continue
                    if last is None:
                        values, counts = np.unique(np.concatenate(held), return_counts=True)
                        last, held = values[counts >= REGION_FREQUENT], []
                    key = prefix(hashes, last)
                    out.append((np.full(len(key), row["region"]), key, np.full(len(key), row["sig"]), np.full(len(key), size_class(len(hashes))), np.full(len(key), row["loose"])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    sent = own.unionByName(seen).repartition(n, "region", "task").sortWithinPartitions("region", "task", F.desc("sampled"))
    return sent.mapInArrow(run, POSTED)


def divided(opened: DataFrame, task_sets: int, task_shingles: int) -> DataFrame:
    """The tasks of new, smaller regions of regions that have loose sets."""
    posted = checkpoint(own_order(opened, task_sets, task_shingles))
    holders = checkpoint(posted.groupBy("region", "key").agg(F.min("sig").alias("pivot"), F.count("*").alias("sets"), F.count_if("loose").alias("n_loose")).where("sets > 1 and n_loose > 0"))
    met = posted.join(holders.select("region", "key", "pivot"), ["region", "key"]).select(F.col("region").alias("parent"), "sig", "n", "pivot", F.lit(1).alias("shared"))
    texts = opened.select(F.col("region").alias("parent"), F.col("n_all").alias("above"), "sig", "known", "text")
    tasks = dealt(checkpoint(regions(met)), task_sets, task_shingles)
    return tasks.join(texts, ["parent", "sig"]).select(*TASK, "dealt", "above", "known", "sig", "text")


#: Of rows with n and loose: how many sets and shingles there are, and how many of them are loose.
COUNTED = {"n_all": "count(*)", "n_loose": "count_if(loose)", "shingles": "sum(n)", "loose_shingles": "sum(if(loose, n, 0))"}


def in_blocks(sets: str, shingles: str, task_sets: int, task_shingles: int) -> Column:
    """How many blocks they are dealt in, of half a task each."""
    return F.greatest(F.ceil(F.col(sets) / max(1, task_sets // 2)), F.ceil(F.col(shingles) / max(1, task_shingles // 2))).cast("int")


def blocks(opened: DataFrame, task_sets: int, task_shingles: int) -> DataFrame:
    """The tasks that hold loose sets against all of their region, by bands of the distance to its pivot and by blocks."""
    all_ = opened.select("sig", "region", F.floor(F.col("d") / EPS).cast("int").alias("band"), "n", "loose")
    counted = all_.groupBy("region", "band").agg(*[F.expr(x).alias(name) for name, x in COUNTED.items()])
    left = counted.where("n_loose > 0").select("region", F.col("band").alias("of"), in_blocks("n_loose", "loose_shingles", task_sets, task_shingles).alias("left_blocks"))
    right = counted.select("region", F.col("band").alias("near"), in_blocks("n_all", "shingles", task_sets, task_shingles).alias("right_blocks"))
    grid = left.join(right, "region").where("abs(of - near) <= 1")
    task = F.concat_ws(":", "of", "near", "i", "j")
    i_of, j_of = F.pmod(F.xxhash64("sig", F.lit(1)), F.col("left_blocks")).cast("int"), F.pmod(F.xxhash64("sig", F.lit(2)), F.col("right_blocks")).cast("int")
    of_left = all_.where("loose").select("sig", "region", F.col("band").alias("of")).join(grid, ["region", "of"])
    loose_rows = of_left.select("sig", "region", "of", "near", i_of.alias("i"), F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("j"))
    of_right = all_.select("sig", "region", F.col("band").alias("near")).join(grid, ["region", "near"])
    other_rows = of_right.select("sig", "region", "of", "near", j_of.alias("j"), F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"))
    dealt_rows = loose_rows.unionByName(other_rows).select("sig", "region", F.xxhash64(task).alias("task")).distinct()
    texts = opened.select("sig", "region", "known", "text")
    return dealt_rows.join(texts, ["sig", "region"]).select("region", F.lit(None).cast("long").alias("pivot"), "task", F.lit(False).alias("dealt"), F.lit(None).cast("long").alias("above"), "known", "sig", "text")


def worth_dividing(task_sets: int, task_shingles: int) -> Column:
    """Of a region: whether to divide it, rather than to compare its loose sets in blocks."""
    grid = in_blocks("n_loose", "loose_shingles", task_sets, task_shingles).cast("long") * in_blocks("n_all", "shingles", task_sets, task_shingles)
    smaller = F.col("above").isNull() | (F.col("n_all") <= SHRUNK * F.col("above"))
    return (F.col("n_far") > task_sets // 2) & (grid > MOST_BLOCKS) & smaller


def links(docs: DataFrame, task_sets: int = TASK_SETS, task_shingles: int = TASK_SHINGLES, sample_docs: int = SAMPLE_DOCS, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(documents with text_hash, n and sig, spanning links between different sets)."""
    docs = docs.select("doc_id", "text")
    found = checkpoint(meet(docs, frequent_shingles(docs, sample_docs)))
    plain = found.where("kind = 0").select("doc_id", "text_hash", "n", "sig")
    met = checkpoint(regions(found.where("kind = 1").select(F.lit(0).cast("long").alias("parent"), "sig", "n", "pivot", "shared")))
    tasks, edges = with_texts(dealt(met, task_sets, task_shingles), plain, docs), None
    for level in range(depth + 2):
        done = checkpoint(join_tasks(tasks))
        made = done.where("kind = 0").select("a", "b")
        edges = made if edges is None else edges.union(made)
        told = done.where("kind > 0").select(F.col("a").alias("sig"), "region", "above", "n", "known", "d", "text", (F.col("kind") == 2).alias("loose"))
        # The pivot is in every chunk of its region.
        told = told.dropDuplicates(["region", "sig"])
        sizes = told.groupBy("region").agg(*[F.expr(x).alias(name) for name, x in COUNTED.items()], F.count_if(F.col("loose") & (F.col("d") > FAR)).alias("n_far"), F.first("above").alias("above"))
        sizes = sizes.where("n_loose > 0").select("region", "n_all", worth_dividing(task_sets, task_shingles).alias("divide"))
        opened = checkpoint(told.drop("above").join(sizes, "region"))
        if opened.isEmpty():
            break
        many = opened.where("divide")
        if level >= depth or many.isEmpty():
            tasks = blocks(opened, task_sets, task_shingles)
        else:
            tasks = divided(many, task_sets, task_shingles).unionByName(blocks(opened.where("not divide"), task_sets, task_shingles))
    return plain, edges


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and the number of copies of the set, one row a document.

    Documents without a word have an empty set, are linked with nothing and are
    their own component. A null doc_id stays null and gives its component no id;
    rows that repeat an id each keep their own text's component. Columns other
    than doc_id and text are not read.
    """
    return classified(docs, **options).select("doc_id", "n_shingles", "component_id")


def classified(docs: DataFrame, **options) -> DataFrame:
    """jaccard_components with the hash of each row's text."""
    plain, edges = links(docs, **options)
    # Written, so that links of a set that many others are linked with can be split in the joins.
    classes = checkpoint(plain.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep")))
    # Nodes in the order of their documents, so that a root is the component's first document.
    node = F.struct(F.coalesce("rep", F.lit(NOBODY)).alias("rep"), F.col("sig"))
    ends = classes.select("sig", node.alias("node"))
    named = edges.join(ends.select(F.col("sig").alias("a"), F.col("node").alias("na")), "a").join(ends.select(F.col("sig").alias("b"), F.col("node").alias("nb")), "b")
    roots = components(named.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    first = classes.join(roots.select("node.sig", F.col("root.rep").alias("root")), "sig", "left").select("sig", F.coalesce("root", "rep").alias("least"))
    # Written first, so that the join has exchanges alone below it and a hot set's rows can be split.
    joined = plain.join(checkpoint(first), "sig", "left")
    found = F.when(F.col("least") != NOBODY, F.col("least"))
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, found).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents, one of each component: the one with the smallest id.

    Rows go by their own id and text: of an id that stands for several texts, only
    those whose component has a smaller id go. Rows without an id, or that repeat a
    kept id, stay.
    """
    drop = classified(docs, **options).where("doc_id != component_id").select("doc_id", F.col("text_hash").alias("__hash")).distinct()
    name = "__text_hash"
    hashed = docs.withColumn(name, F.xxhash64("text"))
    gone = (hashed["doc_id"] == drop["doc_id"]) & (hashed[name] == drop["__hash"])
    return hashed.join(drop, gone, "left_anti").select(*docs.columns)
