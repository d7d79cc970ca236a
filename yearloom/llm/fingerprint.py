"""Document fingerprints: a Merkle tree over sections and paragraphs, with Spark expressions only.

Sections are parted by empty lines, paragraphs by line ends.  A paragraph is
cut into leaves of 1, 1, 2, 4, 8, 16, 32 and then 64 characters each, so short
texts have fine leaves and long ones few.  A paragraph's node is the hash of
its leaves' hashes, a section's that of its paragraphs', the root that of all
sections'.  A fingerprint is the tree as text::

    root|section(paragraph.leaf.leaf;paragraph.leaf)section(paragraph)

with nodes of 8 hexadecimal digits (32 for the root) and leaves of 8 digits
and their length.  Equal roots mean equal texts; where the roots differ, the
branches that differ locate the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yearloom.scale.written import materialise

# First character and length of a paragraph's first leaves, then the length of all others.
FIRST_LEAVES = ((1, 1), (2, 1), (3, 2), (5, 4), (9, 8), (17, 16), (33, 32))
LEAF = 64


def _leaves(paragraph: Column) -> Column:
    first = F.array(*[F.substring(paragraph, at, n) for at, n in FIRST_LEAVES])
    rest = F.regexp_extract_all(F.substr(paragraph, F.lit(LEAF + 1)), F.lit("(?s).{1,%d}" % LEAF), F.lit(0))
    # Most paragraphs end within a few leaves; the empty ones after the end are left out.
    return F.filter(F.concat(first, rest), lambda leaf: leaf != "")


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaves: array of array of array of (hash, length)."""

    def paragraph(p: Column) -> Column:
        return F.transform(_leaves(p), lambda leaf: F.struct(F.md5(leaf.cast("binary")).alias("hash"), F.length(leaf).alias("n")))

    sections = F.split(F.coalesce(text, F.lit("")), "\n\n", -1)
    return F.transform(sections, lambda s: F.transform(F.split(s, "\n", -1), paragraph))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""

    def paragraph(leaves: Column) -> Column:
        node = F.md5(F.array_join(F.transform(leaves, lambda x: x["hash"]), "").cast("binary"))
        shown = F.transform(leaves, lambda x: F.concat(F.lit("."), F.substring(x["hash"], 1, 8), F.lpad(x["n"].cast("string"), 2, "0")))
        return F.struct(node.alias("node"), F.array_join(shown, "").alias("leaves"))

    def section(paragraphs: Column) -> Column:
        node = F.md5(F.array_join(F.transform(paragraphs, lambda p: p["node"]), ",").cast("binary"))
        shown = F.transform(paragraphs, lambda p: F.concat(F.substring(p["node"], 1, 8), p["leaves"]))
        return F.struct(node.alias("node"), F.concat(F.substring(node, 1, 8), F.lit("("), F.array_join(shown, ";"), F.lit(")")).alias("shown"))

    sections = F.transform(F.transform(tree(text), lambda s: F.transform(s, paragraph)), section)
    whole = F.transform(
        F.array(sections),
        lambda all_: F.concat(
            F.md5(F.array_join(F.transform(all_, lambda s: s["node"]), ";").cast("binary")),
            F.lit("|"),
            F.array_join(F.transform(all_, lambda s: s["shown"]), ""),
        ),
    )
    return F.element_at(whole, 1)


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 32)


def _leaf_set(print_: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(print_, F.lit(r"\.([0-9a-f]{8}[0-9]{2})"), F.lit(1)))


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, leaf: n + F.substring(leaf, 9, 2).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """The share of characters in leaves that two fingerprints have in common, 0 to 1; 1 if the roots are equal."""

    def share(x: Column, y: Column) -> Column:
        both = F.lit(2.0) * _weight(F.array_intersect(x, y))
        return F.coalesce(both / F.nullif(_weight(x) + _weight(y), F.lit(0)), F.lit(0.0))

    pair = F.array(F.struct(_leaf_set(a).alias("x"), _leaf_set(b).alias("y")))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(F.element_at(F.transform(pair, lambda p: share(p["x"], p["y"])), 1))


def locate_edits(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: array of (section, paragraph), from 0; whole sections that one lacks have paragraph -1."""

    def sections(print_: Column) -> Column:
        found = F.split(F.substr(print_, F.lit(34)), "\\)", -1)
        return F.slice(found, 1, F.size(found) - 1)

    def paragraphs(section: Column) -> Column:
        return F.transform(F.split(F.substr(section, F.lit(10)), ";", -1), lambda p: F.substring(p, 1, 8))

    def differing(pair: Column, i: Column) -> Column:
        x, y = pair["x"], pair["y"]
        inner = F.zip_with(paragraphs(x), paragraphs(y), lambda p, q: ~p.eqNullSafe(q))
        at = F.transform(inner, lambda d, j: F.struct(i.cast("int").alias("section"), F.when(d, j).alias("paragraph")))
        whole = F.array(F.struct(i.cast("int").alias("section"), F.lit(-1).alias("paragraph")))
        none = F.array().cast("array<struct<section: int, paragraph: int>>")
        same = F.substring(x, 1, 8) == F.substring(y, 1, 8)
        return (
            F.when(x.isNull() | y.isNull(), whole).when(same, none)
            .otherwise(F.filter(at, lambda d: d["paragraph"].isNotNull()))
        )

    pairs = F.zip_with(sections(a), sections(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.flatten(F.transform(pairs, differing))


def _order() -> list[Column]:
    return [F.col("doc_id").desc_nulls_last(), F.col("h").desc()]


def predecessors(docs: DataFrame) -> DataFrame:
    """For each document (doc_id, h): the one before it in descending doc_id, round the end, and half its length.

    Only ids and lengths move here: they are dealt by range, each range finds
    its neighbours, and one row per range carries the link over its edge.
    """
    ids = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).distinct()
    dealt = ids.repartitionByRange(*_order()).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "doc-order")
    row = F.struct(F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"), F.col("n").alias("p_n"))
    before = F.lag(row).over(Window.partitionBy("part").orderBy(*_order()))
    # The last of a range is its least (a null doc_id is the least of all).
    ends = dealt.groupBy("part").agg(F.min(row).alias("end"))
    over = Window.orderBy("part")
    edges = ends.select(
        F.col("part").alias("e_part"),
        F.coalesce(F.lag("end").over(over), F.last("end").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"),
    )
    linked = dealt.withColumn("before", before).join(edges, F.col("part") == F.col("e_part"))
    link = F.coalesce("before", "edge")
    return linked.select("doc_id", "h", link["p_id"].alias("p_id"), link["p_h"].alias("p_h"), link["p_n"].alias("p_n"))


def _key(doc_id: str) -> list[Column]:
    return [F.coalesce(doc_id, F.lit(0)).alias("k"), F.col(doc_id).isNull().alias("no_id")]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of an edited copy, and how like it the edited copy and the next document are.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many of the next document in descending doc_id (after the last, the
    first; equal doc_ids by their texts' hashes, nulls last).  Null texts are
    empty; rows alike in doc_id and text are one document and each returned;
    other columns are ignored; an empty table gives no rows.  A document sends
    the one before it only the half it needs and its fingerprint.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    links = materialise(predecessors(rows), "doc-links")
    # Plain key columns, so that both joins and the window share one exchange of the texts.
    key = ["k", "no_id", "h"]
    keyed = rows.select(*_key("doc_id"), "text", F.xxhash64("text").alias("h"))
    here = keyed.join(links.select(*_key("doc_id"), "h", "p_id", "p_h", "p_n"), key)
    number = F.row_number().over(Window.partitionBy(*key).orderBy("h"))  # rows alike are one document
    gives = here.withColumn("number", number).filter("number = 1").select(
        *_key("p_id"), F.col("p_h").alias("h"),
        F.substring("text", F.lit(1), F.floor(F.col("p_n") / 2).cast("int")).alias("tail"),
        fingerprint(F.col("text")).alias("next_fingerprint"),
    )
    both = keyed.join(gives, key)
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("tail"))
    prints = both.withColumn("edited", edited).select(
        F.when(~F.col("no_id"), F.col("k")).alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fingerprint",
    )
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
