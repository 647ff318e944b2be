"""Exact and near duplicates, and their leakage across splits.

Near duplicates come from covering masks: two hashes that differ in at most 7 bits agree under one of 255 masks, so an
equi-join by mask and masked hash finds every pair, at any size and with the same copies of a row. Content is made distinct first, and so are hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import Duplicates
from plumbline.functions.columns import split_rank
from plumbline.plans import covering
from plumbline.plans.components import connected_components
from plumbline.plans.store import table

PARTS = 8
#: Members of a group whose ids are gathered to name it.
NAMED = 100_000


def firsts(images: DataFrame, key: str = "sha256", order: str = "path") -> DataFrame:
    """One row for each content: the first by ``order``. Only a row's order is ranked, in parts of each task first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return images.withColumn("_n", rank).where(F.col("_n") == 1).drop("_n")


def _part(hash: Column, n: int) -> Column:
    return F.shiftrightunsigned(hash, 8 * n).bitwiseAND(F.lit(255))


def similar_pairs(rows: DataFrame, hash: str, distance: int, key: str = "id", second: str | None = None, second_distance: int = 0) -> DataFrame:
    """(a, b, distance): pairs of rows, a before b by key, whose hashes differ in at most ``distance`` bits (7 or fewer).

    With ``second`` the other hash has to be near too. Null hashes take no part.
    """
    if not 0 <= distance < PARTS:
        raise ValueError("pairs are found up to distance 7 only")
    cols = [F.col(key).alias("k"), F.col(hash).alias("h")] + ([F.col(second).alias("s")] if second else [])
    cut = covering.masked(rows.where(F.col(hash).isNotNull()).select(*cols), "h", distance)
    a, b = cut.alias("a"), cut.alias("b")
    x = F.col("a.h").bitwiseXOR(F.col("b.h"))
    near = (F.col("a.k") < F.col("b.k")) & (F.bit_count(x) <= distance)
    if second:
        near &= F.bit_count(F.col("a.s").bitwiseXOR(F.col("b.s"))) <= second_distance
    # The masks' copies aren't counted where Spark guesses sizes, so it would take a side for small and gather it in the driver.
    # A pair meets under several masks; tasks bring it down to one row before it is shuffled.
    pairs = a.join(b.hint("merge"), (F.col("a.v") == F.col("b.v")) & (F.col("a.value") == F.col("b.value")) & near)
    return pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.bit_count(x).alias("distance")).distinct()


def skipped_buckets(rows: DataFrame, hash: str, max_bucket: int) -> DataFrame:
    """(part, value, count): the values that over ``max_bucket`` rows have in a part of 8 bits of their hash."""
    parts = F.array(*[F.struct(F.lit(n).cast("tinyint").alias("part"), _part(F.col(hash), n).cast("smallint").alias("value")) for n in range(PARTS)])
    return rows.where(F.col(hash).isNotNull()).select(F.explode(parts).alias("p")).groupBy("p.part", "p.value").count().where(F.col("count") > max_bucket)


def members(images: DataFrame, cfg: Duplicates | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, edges) of the duplicate groups of images (id, path, split, status, sha256, and for near ones phash_l, dhash_l, contrast).

    members are (root, id, path, split, sha256); edges are the near pairs (a, b, distance) between the first images of
    each content and hash, and of those of one hash with the first. Images that aren't ok or have no hash of their content take no part.
    """
    cfg = cfg or Duplicates()
    own = images.where("status = 'ok' and sha256 is not null")
    first = firsts(own)
    copies = own.select("id", "path", "split", "sha256").join(first.select(F.col("id").alias("first"), "sha256"), "sha256")
    star = copies.where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    edges = own.sparkSession.createDataFrame([], "a string, b string, distance int")
    if cfg.enabled and {"phash_l", "dhash_l", "contrast"} <= set(images.columns):
        able = first.where((F.col("contrast") >= cfg.min_hash_std) & F.col("phash_l").isNotNull() & F.col("dhash_l").isNotNull())
        # Images of the same hashes are linked to the first of them, which alone is compared with others.
        one = able.groupBy("phash_l", "dhash_l").agg(F.min("id").alias("one"))
        same = able.select("id", "phash_l", "dhash_l").join(one, ["phash_l", "dhash_l"]).where("id != one").select(F.col("one").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
        edges = table(similar_pairs(one, "phash_l", cfg.phash_max_distance, "one", "dhash_l", cfg.dhash_max_distance).unionByName(same), "edges")
    roots = connected_components(star.unionByName(edges.select("a", "b")))
    found = own.select("id", "path", "split", "sha256").join(roots.withColumnRenamed("node", "id").withColumnRenamed("component", "root"), "id")
    return found.select("root", "id", "path", "split", "sha256"), edges


def with_groups(members: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members with group_id, groups) from rows (root, id, path, split, sha256).

    groups: (group_id, kind, scope, splits, size, unique_files, max_distance, first_path). A group's id is the hash of its
    members' ids, or in a group of over ``NAMED`` of its root and how many they are, as so long a list is gathered nowhere.
    It is exact if all have the same content, and crosses splits if its members are in several.
    """
    large = members.groupBy("root").count().where(F.col("count") > NAMED).select("root", F.col("count").alias("large"))
    listed = members.join(large, "root", "left")
    near = members.select("root", "id").join(edges.select(F.col("a").alias("id"), "distance"), "id").groupBy("root").agg(F.max("distance").alias("max_distance")) if edges is not None else None
    splits = F.transform(F.array_sort(F.collect_set(F.struct(split_rank(F.col("split")).alias("r"), F.col("split").alias("s")))), lambda x: x["s"])
    ids = F.array_join(F.array_sort(F.collect_set(F.when(F.col("large").isNull(), F.col("id")))), "|")
    g = listed.groupBy("root").agg(
        F.concat(F.lit("g_"), F.substring(F.sha1(F.coalesce(F.concat(F.first("root").cast("string"), F.lit("|"), F.max("large").cast("string")), ids)), 1, 10)).alias("group_id"),
        F.countDistinct("sha256").alias("unique_files"), F.count("*").alias("size"), splits.alias("splits"), F.min("path").alias("first_path"),
    )
    g = g.join(near, "root", "left") if near is not None else g.withColumn("max_distance", F.lit(0))
    g = g.select("root", "group_id", F.when(F.col("unique_files") == 1, "exact").otherwise("perceptual").alias("kind"), F.when(F.size("splits") > 1, "cross_split").otherwise("within_split").alias("scope"), "splits", "size", "unique_files", F.coalesce("max_distance", F.lit(0)).alias("max_distance"), "first_path")
    return members.join(g.select("root", "group_id", "kind", "scope"), "root").drop("root"), g.drop("root")


def summary(members: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: groups, exact, perceptual, within_split, cross_split, images_in_groups, redundant_within_split."""
    over = redundant(members).agg(F.coalesce(F.sum("redundant"), F.lit(0)).cast("long").alias("redundant_within_split"))
    is_ = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    counts = groups.agg(F.count("*").alias("groups"), is_("kind", "exact"), is_("kind", "perceptual"), is_("scope", "within_split"), is_("scope", "cross_split"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("images_in_groups"))
    return counts.crossJoin(F.broadcast(over))  # one row each


def redundant(members: DataFrame) -> DataFrame:
    """(split, redundant): copies beyond the first of each group within a split."""
    each = members.groupBy("group_id", "split").agg((F.count("*") - 1).alias("n"))
    return each.groupBy("split").agg(F.sum("n").alias("redundant"))


def leaked(members: DataFrame) -> DataFrame:
    """Members outside the first split, in the order of splits, that their group has."""
    first = members.groupBy("group_id").agg(F.min(F.struct(split_rank(F.col("split")).alias("r"), F.col("split").alias("s")))["s"].alias("__first"))
    return members.join(first, "group_id").where("split != __first").select(*members.columns)


def leakage_totals(images: DataFrame, members: DataFrame) -> DataFrame:
    """One row: leaked_images, eval_images, leakage_rate (null without the latter), applicable (several splits)."""
    valid = images.where("status = 'ok'").agg(F.count_if(F.col("split") != "train").alias("eval_images"), (F.countDistinct("split") > 1).alias("applicable"))
    out = leaked(members).agg(F.countDistinct("id").alias("leaked_images")).crossJoin(F.broadcast(valid))  # one row each
    return out.select("leaked_images", "eval_images", F.try_divide("leaked_images", "eval_images").alias("leakage_rate"), "applicable")


def leakage_pairs(members: DataFrame, examples: int = 12) -> DataFrame:
    """(a, b, exact_groups, perceptual_groups, total_groups, images_a, images_b, examples) for pairs of splits with shared groups.

    A group is exact for a pair if its two sides share any content.
    """
    # An image has one content, so a split's images are those of its contents, and each list has a row for each split at most.
    own = members.groupBy("group_id", "sha256", "split").agg(F.countDistinct("id").alias("n"), F.first(split_rank(F.col("split"))).alias("r"))
    content = own.groupBy("group_id", "sha256").agg(F.array_sort(F.collect_list(F.struct("r", "split", "n"))).alias("splits"))
    named = lambda **c: F.named_struct(*[x for k, v in c.items() for x in (F.lit(k), v)])
    pair = lambda s, k: F.transform(F.slice(s, k + 2, 1 << 30), lambda y: named(a=F.get(s, k)["split"], b=y["split"], na=F.get(s, k)["n"], nb=y["n"]))
    pairs_of = lambda s: F.flatten(F.transform(s, lambda _, k: pair(s, k)))
    bare = lambda p: F.transform(p, lambda x: named(a=x["a"], b=x["b"]))
    several = content.select("group_id", F.explode_outer("splits").alias("s"), bare(pairs_of(F.col("splits"))).alias("same"))
    sides = several.groupBy("group_id", "s.split", "s.r").agg(F.sum("s.n").alias("n"), F.array_distinct(F.flatten(F.collect_set("same"))).alias("same"))
    groups = sides.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("r", "split", "n"))).alias("splits"), F.array_distinct(F.flatten(F.collect_set("same"))).alias("same"))
    pairs = groups.select("group_id", "same", F.explode(pairs_of(F.col("splits"))).alias("p")).select("group_id", "p.*", F.array_contains("same", F.struct("p.a", "p.b")).alias("exact"))
    pairs = table(pairs, "leaks")
    counts = pairs.groupBy("a", "b").agg(F.count_if("exact").alias("exact_groups"), F.count_if(~F.col("exact")).alias("perceptual_groups"), F.count("*").alias("total_groups"), F.sum("na").cast("long").alias("images_a"), F.sum("nb").cast("long").alias("images_b"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("group_id"))
    some = pairs.select("a", "b", "group_id").withColumn("n", rank).where(F.col("n") <= examples).groupBy("a", "b").agg(F.array_sort(F.collect_list("group_id")).alias("examples"))
    return counts.join(some, ["a", "b"])


def tags(images: DataFrame, members: DataFrame, boxes: DataFrame, cfg) -> DataFrame:
    """images with ``tags``: the status if it isn't ok, else quality flags and grayscale; labels; boxes; duplicates.

    images needs status, flags, is_grayscale, label_status and invalid_lines.
    """
    content = members.groupBy("group_id", "sha256").agg((F.count("*") > 1).alias("exact"))
    several = content.groupBy("group_id").agg((F.count("*") > 1).alias("near"))
    of = members.join(content, ["group_id", "sha256"]).join(several, "group_id").select("id", "exact", "near", (F.col("scope") == "cross_split").alias("cross"))
    odd = boxes.groupBy(F.col("image_id").alias("id")).agg(F.max(F.arrays_overlap("flags", F.array(*map(F.lit, ["tiny", "large", "out_of_bounds", "duplicate"])))).alias("odd"))
    out = images.join(of, "id", "left").join(odd, "id", "left")
    tag = lambda c, name: F.when(c, F.lit(name))
    own = F.when(F.col("status") != "ok", F.array("status")).otherwise(F.concat("flags", F.array_compact(F.array(tag(F.col("is_grayscale"), "grayscale")))))
    more = F.array_compact(F.array(tag(F.col("label_status") == "missing", "missing_label"), tag(F.col("label_status") == "empty", "empty_label"), tag(F.col("invalid_lines") > 0, "invalid_annotations"), tag(F.col("odd"), "suspicious_boxes"), tag(F.col("exact"), "exact_duplicate"), tag(F.col("near"), "near_duplicate"), tag(F.col("cross"), "cross_split_leak")))
    return out.withColumn("tags", F.concat(own, more)).drop("exact", "near", "cross", "odd")
