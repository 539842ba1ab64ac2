"""Merkle fixity audit of WARC replicas.

Every record's bytes are hashed. Records lie in files at offsets; ranges of offsets are the leaves of
a tree per file, files are the leaves of a tree above them. An audit compares the roots of two
replicas and goes down only where branches differ, to the records that are damaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import ship, stored

ship(__name__)

RANGE_BYTES = 1 << 16
FANOUT = 16
# Files are numbered by this many hexadecimal digits of md5; a digit is a level of the tree.
FILE_DIGITS = 3


def record_bytes(url: Column, key: Column, html: Column) -> Column:
    """A WARC response record: header block, empty line, payload, two empty lines."""
    payload = F.coalesce(html.cast("string"), F.lit("")).cast("binary")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    ).cast("binary")
    return F.concat(header, payload, F.lit("\r\n\r\n").cast("binary"))


def _hash(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def layout(pages: DataFrame, replica: str | None = None) -> DataFrame:
    """(file, offset, length, page_id, digest) of every page (page_id, url, html) written as a WARC record.

    Files are slices of md5 of page id and url, so no site fills one. Inside a file records lie
    by that md5 and their digest. Only lengths and digests move, never the bytes. ``replica`` names
    a column with the payload that a second store holds at the same place: its record is hashed
    as ``replica_digest``, NULL where the payload is.

    * NULL columns count as empty. Repeated rows are records one behind the other. Other columns
      are ignored.
    """
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    record = record_bytes(F.col("url"), F.col("page_id"), F.col("html"))
    extra = []
    if replica:
        held = _hash(record_bytes(F.col("url"), F.col("page_id"), F.col(replica)))
        extra = [F.when(F.col(replica).isNotNull(), held).alias("replica_digest")]
    rows = pages.select("page_id", name.alias("_name"), record.alias("_record"), *extra).select(
        "page_id", "_name", F.octet_length("_record").cast("long").alias("length"),
        _hash(F.col("_record")).alias("digest"), *(["replica_digest"] if replica else []),
    )
    rows = rows.withColumn("file", F.conv(F.substring("_name", 1, FILE_DIGITS), 16, 10).cast("long"))
    before = Window.partitionBy("file").orderBy("_name", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(
        "file", "offset", "length", "page_id", "digest", *(["replica_digest"] if replica else [])
    )


def _joined(order: str, part: str) -> Column:
    """Hash of the children's numbers and hashes, in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(part).alias("hash"))))
    text = F.transform(listed, lambda x: F.concat_ws(":", x["at"].cast("string"), x["hash"]))
    return F.sha2(F.array_join(text, ",").cast("binary"), 256)


def leaves(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, node, hash): one leaf per range of offsets in a file.

    ``records`` has file, offset, digest. A leaf is hashed by one task and has as many children as
    records begin in ``range_bytes``, never a whole file.
    """
    node = F.floor(F.col("offset") / range_bytes).cast("long")
    return records.groupBy("file", node.alias("node")).agg(_joined("offset", "digest").alias("hash"))


def _above(level: DataFrame, inside: bool) -> DataFrame:
    """The level above: ``FANOUT`` ranges of a file, or else ``FANOUT`` files, are one node."""
    up = F.floor(F.col("node" if inside else "file") / FANOUT).cast("long")
    keys = [F.col("file"), up.alias("_up")] if inside else [up.alias("_up")]
    grouped = level.groupBy(*keys).agg(_joined("node" if inside else "file", "hash").alias("hash"))
    if inside:
        return grouped.select("file", F.col("_up").alias("node"), "hash")
    return grouped.select(F.col("_up").alias("file"), F.lit(0).cast("long").alias("node"), "hash")


def tree(leaf_level: DataFrame, height: int) -> list[DataFrame]:
    """Levels (file, node, hash) from the leaves to the root: ``height`` levels inside files, then
    one for each power of ``FANOUT`` files. A node has at most ``FANOUT`` children."""
    levels = [leaf_level]
    for inside in [True] * height + [False] * FILE_DIGITS:
        levels.append(_above(levels[-1], inside))
    return levels


def _height(*leaf_levels: DataFrame) -> int:
    last = max([0, *[level.agg(F.max("node").alias("m")).first()["m"] or 0 for level in leaf_levels]])
    height = 0
    while last:
        last, height = last // FANOUT, height + 1
    return height


def root(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row with the root ``hash`` of a replica; no row for an empty one."""
    leaf_level = stored(leaves(records, range_bytes), "merkle-leaves")
    return tree(leaf_level, _height(leaf_level))[-1].select("hash")


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, offset, page_id, status, left_digest, right_digest) of every damaged record.

    ``left`` and ``right`` have file, offset, page_id, digest: the manifest, and what a replica holds at
    the same places. ``status`` is ``changed``, ``missing`` (on the right) or ``extra``. The roots are
    compared first; each level then reads only the children of nodes that differ above it, and
    records only in the ranges that differ.

    * Equal replicas: no row. An empty one: all records of the other are missing or extra.
    * Records repeated at one place are compared as often as they are there.
    """
    sides = {"left": stored(left, "replica"), "right": stored(right, "replica")}
    leaf = {name: stored(leaves(records, range_bytes), "merkle-leaves") for name, records in sides.items()}
    height = _height(*leaf.values())
    trees = {name: tree(level, height) for name, level in leaf.items()}
    suspects = None
    for number in range(height + FILE_DIGITS, -1, -1):
        here = {name: levels[number] for name, levels in trees.items()}
        if suspects is not None:
            inside = number < height
            up = F.floor(F.col("node" if inside else "file") / FANOUT).cast("long")
            above = suspects.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
            match = (F.col("file") == F.col("_file")) & (up == F.col("_node")) if inside else up == F.col("_file")
            here = {name: level.join(above, match, "left_semi") for name, level in here.items()}
        a = here["left"].select("file", "node", F.col("hash").alias("_left"))
        b = here["right"].select("file", "node", F.col("hash").alias("_right"))
        different = ~F.col("_left").eqNullSafe(F.col("_right"))
        suspects = stored(a.join(b, ["file", "node"], "full_outer").filter(different).select("file", "node"), "merkle-suspects")
        if suspects.isEmpty():
            break
    ranges = suspects.select("file", F.col("node").alias("_range"))

    def damaged(name: str) -> DataFrame:
        place = F.floor(F.col("offset") / range_bytes).cast("long")
        records = sides[name].withColumn("_range", place).join(ranges, ["file", "_range"], "left_semi")
        nth = F.row_number().over(Window.partitionBy("file", "offset").orderBy("digest"))
        return records.select(
            "file", "offset", nth.alias("_nth"), F.col("page_id").alias(f"_{name}_id"), F.col("digest").alias(f"{name}_digest")
        )

    both = damaged("left").join(damaged("right"), ["file", "offset", "_nth"], "full_outer")
    status = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    return both.filter(~F.col("left_digest").eqNullSafe(F.col("right_digest"))).select(
        "file", "offset", F.coalesce("_left_id", "_right_id").alias("page_id"), status.alias("status"), "left_digest", "right_digest"
    )
