"""Operator 5: near duplicates by SetSketch registers, bands, likelihood and exact verification.

Texts with equal shingle sets form a class at once.  Classes that share a
band of registers meet in a bucket.  A bucket never lists all its pairs:
its members are compared with its most central one, and only those that are
not connected to it by then are compared with the whole bucket, in blocks of
bounded size.  Sketch likelihood sieves, full shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctual.llm import setsketch
from punctual.llm.common import keep, release, steps, strings
from punctual.llm.graph import components

WORDS = 5
PERCENT = 85
# Greatest probability with which a pair at the threshold may share no band.
MISSED = 1e-6
# Deviations of the estimate that a pair may lie below the threshold and still be verified.
SLACK = 4.5
BLOCK = 1024
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SKETCH = "doc_id long, txt long, n_shingles long, key string, cls long, registers binary, bands array<long>"


def shingles(text: str) -> np.ndarray:
    """Distinct 5-word shingles as sorted 64-bit hashes; fewer words make one shingle, none make none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and split at ASCII white space
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=n)], np.uint64)
    return np.unique(setsketch.mixed(sum(setsketch.mixed(h[i:n - WORDS + 1 + i] * m) * m for i, m in enumerate(_MULTIPLIERS))))


def _txt() -> Column:
    """With doc_id it tells rows apart, as ids may be null or repeated; rows equal in both are copies."""
    return F.xxhash64("text", F.col("text").isNull())


def banding(percent: int) -> tuple[int, int]:
    """Registers of a band, and bands: the widest ones that miss a pair at the threshold with probability below MISSED.

    85 percent: 25 of 5 (4.3e-7); 80: 32 of 4 (4.7e-8); bands of one register if none are wide enough (below 11 percent).
    """
    for width in range(setsketch.REGISTERS, 1, -1):
        bands = setsketch.REGISTERS // width
        if (1 - (percent / 100) ** width) ** bands < MISSED:
            return width, bands
    return 1, setsketch.REGISTERS


def sketched(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Set size, class key, registers and band values of every document."""
    width, bands = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in steps(batches, "text"):
            sets = [shingles(t) for t in strings(b, "text")]
            sizes = np.array([len(s) for s in sets])
            rows = np.flatnonzero(sizes)
            k = len(sets)
            registers = np.zeros((k, setsketch.REGISTERS), np.uint16)
            if len(rows):
                owner = np.repeat(np.arange(len(rows)), sizes[rows])
                registers[rows] = setsketch.sketches(np.concatenate([sets[i] for i in rows]), owner, len(rows))
            band = np.full((k, bands), 1, np.uint64)
            for i in range(width):
                band = setsketch.mixed(band * _MULTIPLIERS[0] + registers[:, i:width * bands:width].astype(np.uint64) + np.uint64(1))
            band = setsketch.mixed(band + np.arange(1, bands + 1, dtype=np.uint64) * _MULTIPLIERS[1]).view(np.int64)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("txt"), pa.array(sizes.astype(np.int64)), pa.array([x and x.hex() for x in keys], pa.string()),
                 pa.array([x and int.from_bytes(x[:8], "little", signed=True) for x in keys], pa.int64()),
                 pa.array([r.tobytes() for r in registers], pa.binary()),
                 pa.array([v.tolist() if s else [] for v, s in zip(band, sizes)], pa.list_(pa.int64()))],
                names=["doc_id", "txt", "n_shingles", "key", "cls", "registers", "bands"])

    return docs.select("doc_id", "text", _txt().alias("txt")).mapInArrow(run, _SKETCH)


def _registers(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sizes allow the similarity and whose estimate does not rule it out."""
    side = lambda c: sketches.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    least = percent / 100
    floor = least - SLACK * np.sqrt(least * (1 - least) / setsketch.REGISTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            if b.num_rows:
                j = setsketch.similarity(_registers(b.column("r_u")), _registers(b.column("r_v")),
                                         b.column("n_u").to_numpy(), b.column("n_v").to_numpy())
                yield b.select(["u", "v"]).filter(pa.array(j >= floor))

    joined = pairs.join(side("u"), "u").join(side("v"), "v").filter(
        F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
    return joined.select("u", "v", "n_u", "n_v", "r_u", "r_v").mapInArrow(run, "u long, v long")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """Full shingle sets of the classes in ``needed`` (cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array([shingles(t).tobytes() for t in strings(b, "text")], pa.binary())],
                                             names=["cls", "set"])

    once = texts.join(needed, "cls", "left_semi").select("cls", "text").dropDuplicates(["cls"])  # copies of a row
    return once.mapInArrow(run, "cls long, set binary")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity; sets are made only for classes in a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            good = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                    for x, y in zip(b.column("s_u"), b.column("s_v"))]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    full = keep(_sets(texts, pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()), "sets")
    side = lambda c: full.select(F.col("cls").alias(c), F.col("set").alias(f"s_{c}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _sieved(x: pa.Table, y: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``x`` the rows of ``y`` that it may be linked to: of another component, not the
    bucket's centre, in no earlier shared bucket, and likely similar enough."""
    least = percent / 100
    floor = least - SLACK * np.sqrt(least * (1 - least) / setsketch.REGISTERS)
    rx, ry = _registers(x["registers"]), _registers(y["y_registers"])
    bx, by = (np.array(t.to_pylist(), np.int64) for t in (x["bands"], y["y_bands"]))
    nx, ny = x["n"].to_numpy(), y["y_n"].to_numpy()
    root, cls = y["y_root"].to_numpy(), y["y_cls"].to_numpy()
    bucket, centre = x["bucket"][0].as_py(), x["centre"][0].as_py()
    other = cls != centre
    for i, own in enumerate(x["root"].to_pylist()):
        hit = np.flatnonzero(other & (root != own) & ((ry == rx[i]).sum(1) >= int(setsketch.REGISTERS * floor))
                             & (np.minimum(ny, nx[i]) * 100 >= np.maximum(ny, nx[i]) * percent))
        if len(hit):
            shared = by[hit] == bx[i]
            hit = hit[by[hit, shared.argmax(1)] == bucket]
        if len(hit):
            hit = hit[setsketch.similarity(ry[hit], np.broadcast_to(rx[i], (len(hit), rx.shape[1])), ny[hit], np.full(len(hit), nx[i])) >= floor]
        if len(hit):
            yield i, hit


def _blocks(left: DataFrame, right: DataFrame, extra: list[str]):
    """Rows to compare, met by bucket and by the numbers of their blocks."""
    columns = ["bucket", "a", "b", "cls", "root", "centre", "n", "registers", "bands", *extra]
    return (left.select(columns).groupBy("bucket", "a", "b")
            .cogroup(right.select([F.col(c).alias(f"y_{c}") for c in columns]).groupBy("y_bucket", "y_a", "y_b")))


def _left_over(members: DataFrame, roots: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links in a bucket that the comparison with its centre could not show.

    Members outside the centre's component meet the whole bucket, block by
    block.  First only the rows that need their full sets are found; then
    these meet again with the sets, and one link per component is returned.
    """
    named = members.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
    centre = roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
    named = (named.join(centre, "centre", "left").withColumn("centre_root", F.coalesce("centre_root", "centre"))
             .withColumn("loose", F.col("root") != F.col("centre_root")))
    # A bucket of two has nothing to compare beyond its centre.
    count = (named.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("loose").cast("long")).alias("n_loose"))
             .filter("n_loose > 0 and size > 2"))
    named = named.join(count, "bucket").select("bucket", "cls", "centre", "root", "loose", "size", "n_loose")
    named = keep(named.join(sketches.select("cls", "n", "registers", "bands"), "cls"), "left-over")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.ceil(F.col(n) / F.lit(BLOCK))).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / F.lit(BLOCK)) - 1).cast("int")))
    left = named.filter("loose").withColumn("a", block("n_loose")).withColumn("b", spread("size"))
    right = named.withColumn("b", block("size")).withColumn("a", spread("n_loose"))

    def involved(x: pa.Table, y: pa.Table) -> pa.Table:
        xs, ys = [], set()
        if x.num_rows and y.num_rows:
            for i, hit in _sieved(x, y, percent):
                xs.append(i)
                ys.update(hit.tolist())
        ys = sorted(ys)
        got = [*x["cls"].take(pa.array(xs, pa.int64())).to_pylist(), *y["y_cls"].take(pa.array(ys, pa.int64())).to_pylist()]
        where = [x[c][0].as_py() if got else None for c in ("bucket", "a", "b")]
        return pa.table([pa.array([w] * len(got), t) for w, t in zip(where, (pa.int64(), pa.int32(), pa.int32()))]
                        + [pa.array(got, pa.int64()), pa.array([True] * len(xs) + [False] * len(ys), pa.bool_())],
                        names=["i_bucket", "i_a", "i_b", "i_cls", "i_left"])

    def link(x: pa.Table, y: pa.Table) -> pa.Table:
        u, v = [], []
        if x.num_rows and y.num_rows:
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in y["y_set"]]
            root, cls = y["y_root"].to_pylist(), y["y_cls"].to_pylist()
            for i, hit in _sieved(x, y, percent):
                own, found = np.frombuffer(x["set"][i].as_buffer(), np.uint64), set()
                for k in hit.tolist():
                    if root[k] not in found and _similar(own, sets[k], percent):
                        found.add(root[k])
                        u.append(x["cls"][i].as_py())
                        v.append(cls[k])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["x", "y"])

    some = keep(_blocks(left, right, []).applyInArrow(involved, "i_bucket long, i_a int, i_b int, i_cls long, i_left boolean"), "involved")
    sets = keep(_sets(texts, some.select(F.col("i_cls").alias("cls")).distinct()), "left-over-sets")

    def with_sets(side: DataFrame, mark: bool) -> DataFrame:
        at = some.filter(F.col("i_left") == F.lit(mark))
        on = (side.bucket == at.i_bucket) & (side.a == at.i_a) & (side.b == at.i_b) & (side.cls == at.i_cls)
        return side.join(at, on, "left_semi").join(sets, "cls")

    found = _blocks(with_sets(left, True), with_sets(right, False), ["set"]).applyInArrow(link, "x long, y long")
    return _ordered(found, "x", "y")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate components of all ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * shared shingles >= percent * all their
    shingles (words split at ASCII white space, A-Z lower-cased, whole texts).
    ``component_id`` is the least doc_id reachable over links.  One text of
    each component is ``kept``: of the rows that bear that id the one of the
    least class and text hash, and with it its copies (rows of equal doc_id
    and text).  Null texts and texts without words have no shingles, are
    linked with nothing and are kept.  Repeated rows are returned each; a
    null doc_id, or a repeated one with another text, is its own component
    unless linked to another.  Other columns are ignored; an empty table
    gives no rows.
    """
    return _marked(docs, percent).drop("txt")


def _marked(docs: DataFrame, percent: int) -> DataFrame:
    """``near_duplicates`` with the text hash of every row."""
    all_rows = keep(sketched(docs, percent), "sketches")
    known = all_rows.filter("cls is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "txt")).alias("first")
    classes = known.groupBy("cls").agg(first).select("cls", F.col("first.doc_id").alias("first_doc"), F.col("first.txt").alias("first_txt"))
    classes = keep(classes, "classes")
    # One row per class: the document of least id (equal sets have equal sketches).
    is_first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("txt") == F.col("first_txt"))
    one = known.join(classes, (known.cls == classes.cls) & is_first).select(known["*"]).dropDuplicates(["cls"])
    sketches = keep(one.select("cls", "doc_id", "txt", F.col("n_shingles").alias("n"), "registers", "bands"), "class-sketches")
    banded = sketches.select("cls", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = keep(banded.join(sizes, "bucket"), "bucket-members")
    central = members.groupBy("cls").agg(F.sum("size").alias("central"))
    centres = (members.join(central, "cls").groupBy("bucket")
               .agg(F.max(F.struct("central", F.col("cls").alias("centre"))).getField("centre").alias("centre")))
    members = keep(members.drop("size").join(centres, "bucket"), "bucket-stars")

    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _txt().alias("txt"))
    place = sketches.select("cls", "doc_id", "txt")
    texts = whole.join(place, whole.doc_id.eqNullSafe(place.doc_id) & (whole.txt == place.txt)).select("cls", "text")
    star = keep(_likely(_ordered(members, "cls", "centre"), sketches, percent), "likely-pairs")
    links = keep(_verified(star, texts, percent), "links")
    roots = keep(components(links), "roots")
    more = keep(_left_over(members, roots, sketches, texts, percent), "more-links")
    if not more.isEmpty():
        roots = keep(components(links.unionByName(more)), "all-roots")

    least = F.min(F.struct(F.col("first_doc").isNull().alias("no_id"), "first_doc", "cls")).alias("least")
    linked = classes.join(roots, classes.cls == roots.node).groupBy("root").agg(least)
    component = roots.join(linked, "root").select(F.col("node").alias("cls"), F.col("least.first_doc").alias("component_id"),
                                                  F.col("least.cls").alias("best_cls"))
    final = (classes.join(component, "cls", "left")
             .withColumn("component_id", F.coalesce("component_id", "first_doc"))
             .withColumn("has_kept", F.coalesce(F.col("best_cls") == F.col("cls"), F.lit(True))).drop("best_cls"))
    out = all_rows.select("doc_id", "txt", "n_shingles", "cls").join(final, "cls", "left")
    return out.select("doc_id", "txt", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      (F.col("cls").isNull() | F.col("has_kept") & is_first).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, all columns; its copies become one, but rows without id and words all stay.

    Null and empty texts are linked with nothing and stay, once per doc_id;
    columns of any name stay; an empty table stays empty.
    """
    txt = "txt"
    while any(c.lower() in (txt, f"kept_{txt}", f"kept_doc_{txt}") for c in docs.columns):
        txt += "_"
    kept = (_marked(docs.select("doc_id", "text"), percent).filter("kept and (doc_id is not null or n_shingles > 0)")
            .select(F.col("doc_id").alias(f"kept_doc_{txt}"), F.col("txt").alias(f"kept_{txt}")).distinct())
    marked = docs.withColumn(txt, _txt())
    found = marked.join(kept, F.col("doc_id").eqNullSafe(F.col(f"kept_doc_{txt}")) & (F.col(txt) == F.col(f"kept_{txt}")), "left_semi")
    bare = docs.filter(F.col("doc_id").isNull() & (F.translate(F.coalesce("text", F.lit("")), " \t\n\r\v\f", "") == ""))
    return found.dropDuplicates(["doc_id", txt]).drop(txt).unionByName(bare)
