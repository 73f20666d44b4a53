"""Near-duplicate groups by Jaccard similarity of five-word shingles, ``LEAST`` or more.

The wide companion of ``simhash_dedup``: texts as similar as that differ in 3 to 14 bits of a
64-bit SimHash, more than covering tables can span, so candidates come from minimum hashes.
Words are split at ASCII white space and compared in lower case (A to Z); a text's set holds
the 64-bit hashes of its shingles, and a text of fewer words is one shingle. Texts of equal
sets are one node throughout, so groups of copies cost one row.

Each of ``BANDS`` keys joins the minima of ``ROWS`` random orders of a set. Two sets of
similarity s share a key but for a chance of (1 - s**ROWS)**BANDS, which is 9e-7 at 0.8, over
the choice of the orders and so for any texts. Candidates are linked only if their whole
sets are similar enough, counted exactly.

Within the texts of one key not all pairs need comparing: those already linked, directly or
in steps, are left out. In the first round a text is compared only with the best its keys
offer, that which shares keys with the most others and so is the middle of its group. Then all
pairs still apart are compared where they are few for the rows there are; otherwise a key's
texts are compared with any one of them, round by round, until few pairs are left or a round
links nothing, and then all that are left. What no comparison linked is so compared in the
end, since no link may be lost, and a very large group whose texts are just short of ``LEAST``
alike costs its square there.

Most of those comparisons read no set. A sketch holds for each of ``CELLS`` cells whether the
number of a set's hashes in it is odd. Two sketches differ in no more cells than their sets
differ in members, so the join itself leaves out pairs whose sketches differ in too many; that
never loses a similar pair, and only sets of pairs that pass are read and counted.

With ``simhash`` the links of ``simhash_dedup``, two or fewer of 64 bits, come first: its
fingerprints, covering tables and components are made of the same rows, and comparisons only
add what these left apart. Groups are then those of both kinds of links, in any steps.

Cases: null, empty and wordless texts are one group; a long text is a block of its own;
similarity of just ``LEAST`` links; repeated rows and repeated doc_ids are rows of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators.graph import components
from . import simhash_dedup
from .tokens import Sums, blocks, mix

SHINGLE = 5
#: The least similarity as a fraction, so that no rounding decides.
LEAST = (4, 5)
BANDS, ROWS = 35, 5
#: All pairs of a key are compared if no more than so many for each row, or after so many rounds.
PAIRS, ROUNDS = 64, 12
CELLS = 512
CELL_BITS = 24
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_random = np.random.default_rng(11)
_ADD = _random.integers(0, 1 << 64, BANDS * ROWS, _U, endpoint=False)
_TIMES = _random.integers(0, 1 << 64, BANDS * ROWS, _U, endpoint=False) | _U(1)


def sets(column: pa.Array):
    """(row, sorted distinct shingle hashes) of each text."""
    for b in blocks(column):
        b.data = _LOWER[b.data]
        b.words()
        hashes = Sums(b.hashes(), "words")
        for i, row in enumerate(b.rows):
            a, z = int(b.limit[i]), int(b.limit[i + 1])
            at = np.arange(a, max(a + 1, z - SHINGLE + 1)) if z > a else np.zeros(0, np.int64)
            yield row, np.unique(hashes.of(at, np.minimum(at + SHINGLE, z)))


def mark(found: np.ndarray) -> int:
    """One number for a set; the empty set has zero."""
    return int(Sums(found, "check").of(np.array([0]), np.array([len(found)])).view(np.int64)[0]) if len(found) else 0


def keys(found: np.ndarray) -> np.ndarray:
    """A key for each band; none for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~_U(0))
    for at in range(0, len(found), 4096):  # memory stays flat for long texts
        part = (found[at : at + 4096] ^ _ADD[:, None]) * _TIMES[:, None]
        least = np.minimum(least, part.min(axis=1))
    out = np.arange(BANDS, dtype=_U)
    for column in least.reshape(BANDS, ROWS).T:
        out = mix(out ^ column)
    return out.view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """A bit for each cell, set if the cell has an odd number of the hashes."""
    odd = np.bincount((found >> _U(64 - (CELLS - 1).bit_length())).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(batches, simhash: bool = False):
    for batch in batches:
        marks, sizes, bands, odd = [], [], [], []
        for _, found in sets(batch.column("text")):
            marks.append(mark(found))
            sizes.append(len(found))
            bands.append(keys(found))
            odd.append(sketch(found))
        names = [n for n in batch.schema.names if n != "text"]
        made = [pa.array(marks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]
        more = [pa.array(np.array([simhash_dedup.fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64))] if simhash else []
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made, *more], names=[*names, "fp", "n", "bands", "odd", *["simhash"][: len(more)]])


def _members(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """fp and the whole set of ``nodes`` (fp), read from the texts again; a bitmap goes before the join."""
    cell = F.shiftright("fp", 64 - CELL_BITS) + (1 << CELL_BITS - 1)
    words = nodes.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast((shiftright(fp, {64 - CELL_BITS}) + {1 << CELL_BITS - 1}) % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << CELL_BITS - 6, np.int64)
    bits[np.asarray(words.column("word"), np.int64)] = np.asarray(words.column("bits"), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # 2**CELL_BITS bits, whatever the data

    def rows(batches):
        bits = shared.value
        for batch in batches:
            for _, found in sets(batch.column("text")):
                at = ((fp := mark(found)) >> 64 - CELL_BITS) + (1 << CELL_BITS - 1)
                if int(bits[at >> 6]) >> (at & 63) & 1:
                    yield pa.RecordBatch.from_arrays([pa.array([fp], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names=["fp", "members"])

    return docs.select("text").mapInArrow(rows, "fp long, members array<long>").join(nodes, "fp", "left_semi").dropDuplicates(["fp"])


def _fits(n, m, most):
    """Whether sets of n and m that share at most ``most`` can be similar enough."""
    return F.expr(f"{sum(LEAST)} * ({most}) >= {LEAST[0]} * ({n} + {m})")


def _near(n, m, odd, other):
    """Whether sets of n and m with these sketches can be similar enough."""
    cells = " + ".join(f"bit_count({odd}[{i}] ^ {other}[{i}])" for i in range(CELLS // 64))
    return F.expr(f"{sum(LEAST)} * ({cells}) <= {LEAST[1] - LEAST[0]} * ({n} + {m})")


def _links(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    one, two = (whole.select(F.col("fp").alias(c), F.col("members").alias(f"_{c}")) for c in ("u", "v"))
    both = pairs.join(one, "u").join(two, "v").withColumn("same", F.size(F.array_intersect("_u", "_v")))
    return both.filter(_fits("size(_u)", "size(_v)", "same")).select("u", "v")


def _printed(found: DataFrame) -> DataFrame:
    """Edges (u, v) of sets whose texts ``simhash_dedup`` links, directly or in steps; ``found`` has fp and simhash."""
    both = scratch.keep(found.select("fp", "simhash").distinct(), "prints")
    near = components(simhash_dedup.links(both.select(F.col("simhash").alias("fp")).distinct()))
    near = both.join(near.withColumnRenamed("node", "simhash"), "simhash", "left").withColumn("component", F.coalesce("component", "simhash"))
    near = scratch.keep(near.select("component", "fp").distinct(), "printed")
    least = scratch.keep(near.groupBy("component").agg(F.min("fp").alias("u"), F.max("fp").alias("v")).filter("u <> v").select("component", "u"), "least")
    return scratch.keep(near.join(least, "component").select("u", F.col("fp").alias("v")).filter("u <> v"), "links")


def links(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """(node, component) of the sets linked to others; ``found`` has fp, n, bands and odd of each row, and simhash if its links count."""
    keyed = found.select("fp", "n", F.explode("bands").alias("k"))
    shared = scratch.keep(keyed.groupBy("k").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("k"), "shared")
    rows = scratch.keep(keyed.join(shared, "k").distinct(), "candidates")
    whole = edges = groups = sketches = None
    if "simhash" in found.columns and not (new := _printed(found)).isEmpty():
        edges, groups = new, scratch.keep(components(new), "components")
    stalled, total = False, rows.count()
    for turn in range(ROUNDS + 1):
        now = rows.withColumn("label", F.col("fp"))
        if groups is not None:
            now = rows.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp")).drop("component")
        sizes = now.groupBy("k", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("k").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.count(F.lit(1)).alias("labels"))
        sizes = scratch.keep(sizes.filter("labels > 1").select("k", "c", F.expr("(c * c - cc) div 2").alias("pairs")), "sizes")
        left = sizes.agg(F.sum("pairs")).first()[0]
        if not left:
            break
        last = turn > 0 and (stalled or turn == ROUNDS or left <= PAIRS * total)
        sizes = sizes.select("k", "c", F.expr("true" if last else "false" if not turn else f"pairs <= {PAIRS} * c").alias("all"))
        now = scratch.keep(now.join(sizes, "k"), "open")
        if turn and sketches is None:
            sketches = scratch.keep(found.select("fp", "odd").join(now.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]), "sketches")
        weights = scratch.keep(now.filter("not all").groupBy("fp").agg(F.sum("c").alias("w")), "weights")
        rank = F.xxhash64("fp", "k", F.lit(turn)) if turn else F.struct("w", F.xxhash64("fp"))
        one = scratch.keep(now.filter("not all").join(weights, "fp").groupBy("k").agg(F.max_by(F.struct("fp", "n", "label", "all", "w"), rank).alias("x")).select("k", "x.*"), "pivots")
        other = now.filter("all").withColumn("w", F.lit(0).cast("long")).unionByName(one, allowMissingColumns=True)
        other = other.select("k", F.col("fp").alias("fq"), F.col("n").alias("m"), F.col("label").alias("lq"), "w")
        if turn:
            now = now.join(sketches, "fp")
            other = other.join(sketches.withColumnsRenamed({"fp": "fq", "odd": "oq"}), "fq")
        near = now.join(other, "k").filter(F.col("label") != F.col("lq")).filter(~F.col("all") | (F.col("label") < F.col("lq"))).filter(_fits("n", "m", "least(n, m)"))
        if turn:
            near = near.filter(_near("n", "m", "odd", "oq"))
        else:
            near = near.groupBy("fp").agg(F.max_by("fq", F.struct("w", F.xxhash64("fq", F.lit(turn)))).alias("fq"))
        pairs = scratch.keep(near.select(F.least("fp", "fq").alias("u"), F.greatest("fp", "fq").alias("v")).distinct(), "pairs")
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
        nodes = scratch.keep(nodes if whole is None else nodes.join(whole, "fp", "left_anti"), "nodes")
        if not nodes.isEmpty():
            more = scratch.keep(_members(docs, nodes), "sets")
            whole = more if whole is None else whole.union(more)
        if whole is None:
            stalled = turn > 0
        else:
            new = scratch.keep(_links(pairs, whole), "links")
            stalled = new.isEmpty() and turn > 0
            if not new.isEmpty():
                edges = new if edges is None else edges.union(new)
                groups = scratch.keep(components(edges), "components")
        rows = now.filter("not all").select(*rows.columns)
        if last or one.isEmpty():
            break
    return groups


def near_groups(docs: DataFrame, *carry: str, simhash: bool = False) -> DataFrame:
    """doc_id, fp (long), group and component_id, the smallest doc_id linked directly or in steps.

    ``group`` tells groups apart where rows share a doc_id. ``carry`` names columns that go along.
    With ``simhash`` the links of ``simhash_dedup`` count as well.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    schema = docs.drop("text").withColumns({"fp": F.lit(0).cast("long"), "n": F.lit(0), "bands": F.array(F.lit(0).cast("long")), "odd": F.array(F.lit(0).cast("long")), **({"simhash": F.lit(0).cast("long")} if simhash else {})}).schema
    found = scratch.keep(docs.mapInArrow(partial(_signatures, simhash=simhash), schema), "signatures")
    classes = scratch.keep(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    groups = links(docs, found)
    named = classes.withColumn("component", F.col("fp"))
    if groups is not None:
        named = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = scratch.keep(named.join(names, "component").select("fp", F.col("component").alias("group"), "component_id"), "groups")
    return found.join(of, "fp").select("doc_id", *carry, "fp", "group", "component_id")
