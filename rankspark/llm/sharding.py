"""Candidate records in shards, placed by a hierarchical weighted hash tree.

A record descends from the root to a region, from there to a rack and then to a shard. At
every level each child draws a number from the hash of the record's key and the child's
name, scaled by the child's weight, and the smallest draw wins; a child's chance is its
share of the weight. A draw depends on the key and that child alone, so when the weights of a
subtree change, records move only into it or out of it. Everything is Spark expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankspark.llm.common import pick
from rankspark.session import cut

# hexadecimal digits of a hash that make a draw: 52 bits, exact in a double
_DIGITS = 13
# shards of a layout as it begins
PLANNED = 40


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. A shard has a number and a weight, the others have children."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=0)


def layout(shards: int, planned: int = PLANNED, racks: int = 2, per_rack: int = 4) -> Node:
    """The tree for a number of shards, which alone decides it.

    The first ``planned`` shards fill regions of ``racks`` racks with ``per_rack`` shards
    each. Every later shard is a rack and a region of its own, so that the only subtree
    whose weight changes with it holds nothing else: rows move into the new shard only.
    """
    if shards <= 0:
        raise ValueError("at least one shard is needed")
    regions = []
    first = min(shards, planned)
    for at in range(0, first, racks * per_rack):
        numbers = range(at, min(at + racks * per_rack, first))
        region = f"region {len(regions)}"
        parts = [numbers[k : k + per_rack] for k in range(0, len(numbers), per_rack)]
        regions.append(
            Node(
                region,
                tuple(
                    Node(f"{region} rack {k}", tuple(Node(f"shard {s}", shard=s) for s in part))
                    for k, part in enumerate(parts)
                ),
            )
        )
    for s in range(first, shards):
        region = f"region of shard {s}"
        regions.append(Node(region, (Node(f"{region} rack 0", (Node(f"shard {s}", shard=s),)),)))
    return Node("root", tuple(regions))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential draw: the smallest of several belongs to a child with its share of the weight."""
    digest = F.md5(F.concat(key, F.lit("/"), name).cast("binary"))
    number = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")
    return -F.ln((number + 0.5) / float(16**_DIGITS)) / weight


def place(key: Column, root: Node) -> Column:
    """The shard of a key: per level the child with the smallest draw, the first of equal ones.

    ``key`` must not be null. Only the draws of the children along the way are made; the
    tree itself is a constant, as long as it has nodes.
    """
    at, level = F.lit(0), [root]
    while any(n.children for n in level):
        below: list[Node] = []
        families = []
        for node in level:
            members = []
            for child in node.children or (node,):
                members.append(F.struct(F.lit(child.name).alias("name"), F.lit(child.weight).alias("weight"), F.lit(len(below)).alias("at")))
                below.append(child)
            families.append(F.array(*members))
        family = F.get(F.array(*families), at)
        drawn = F.transform(family, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), c["at"].alias("at")))
        at, level = F.array_min(drawn)["at"], below
    return F.get(F.array(*[F.lit(n.shard) for n in level]), at)


def shard_candidates(
    candidates: DataFrame,
    shards: int = 40,
    candidate_id: str = "candidate_id",
    text: str = "text",
    rows_per_sort: int = 200_000,
    planned: int | None = None,
) -> DataFrame:
    """``candidate_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the UTF-8 length of the text plus 16 and ``text_crc32`` the unsigned checksum
    of its bytes. The law is ``key``: the id and the number of shards decide the shard, and
    ``grown_shard``, for one more shard, differs only where it is the new one. For that the
    first ``planned`` shards must be those that the layout began with: 40, or ``shards`` if
    that is fewer. Who began with fewer and adds shards later goes on to name that number. ``slot``
    numbers the rows of a shard without gaps from 0, by a hash and then the id, so a shard is
    never sorted by one task.

    A null text counts as empty. A null id is a key like any other, so rows without an id
    share a shard; repeated ids share one, too. Rows that are equal in everything get
    different slots. An empty table gives an empty result; other columns are not read.
    """
    planned = min(shards, PLANNED) if planned is None else planned
    if not 0 < planned <= shards:
        raise ValueError("planned must be from 1 to the number of shards")
    rows = pick(candidates, candidate_id=candidate_id, text=text)
    key = F.coalesce(F.col("candidate_id").cast("string"), F.lit(""))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = cut(
        rows.select(
            "candidate_id",
            (F.octet_length(body) + 16).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.lit("key").alias("law"),
            place(key, layout(shards, planned)).cast("int").alias("shard"),
            place(key, layout(shards + 1, planned)).cast("int").alias("grown_shard"),
        )
    )
    parts = 1 + placed.count() // (shards * rows_per_sort)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("candidate_id", "text_crc32", "size"), F.lit(parts)))
    # rows before each part of a shard: shards x parts numbers, summed shard by shard
    per_part = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_part.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("candidate_id", "text_crc32", "size")
    return (
        placed.withColumn("nth", F.row_number().over(inside))
        .join(first, ["shard", "part"])
        .select(
            "candidate_id",
            "size",
            "text_crc32",
            "law",
            "shard",
            (F.col("first") + F.col("nth") - 1).alias("slot"),
            "grown_shard",
        )
    )
