"""Queries of the operators for training data, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.canonical import canonical_fields
from quirefold.llm.encodings import restore_fields
from quirefold.llm.mixing import mix_sources
from quirefold.llm.names import link_names, linked_pairs, nearest_names
from quirefold.llm.pieces import split_pages
from quirefold.llm.sentences import split_sentences
from quirefold.llm.tokenize import token_ids
from quirefold.llm.tomes import pack_chapters, unused_space
from quirefold.operators.packed_values import explode_packed
from quirefold.session import table


def _credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    credits = explode_packed(table(spark, sf_dir, "comicinfo"), ["info_id"], ("writers", "pencillers")).select("val")
    authors = table(spark, sf_dir, "book_meta").select(F.explode("authors").alias("val")).where("val <> 'cb'")
    return credits.unionByName(authors)


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the person or studio it denotes, and how many others it is linked to."""
    return link_names(_credited(spark, sf_dir), "val")


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar names of every spelling."""
    return nearest_names(_credited(spark, sf_dir), "val")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings that denote the same person or studio."""
    return linked_pairs(p1_entities(spark, sf_dir))


TEXT_FIELDS = ("series", "title", "summary")


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled values with what could be restored of them."""
    return restore_fields(table(spark, sf_dir, "comicinfo"), "info_id", TEXT_FIELDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled values."""
    return p2_restored(spark, sf_dir).select("info_id", "field_name")


def p3_tomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chapter, or piece of one, with its tome."""
    return pack_chapters(table(spark, sf_dir, "encoded_pages"), table(spark, sf_dir, "profiles"))


def p3_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the tomes of each book are, beside the fewest that could do."""
    return unused_space(p3_tomes(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that the packing had to route to the oversized tier."""
    return p3_tomes(spark, sf_dir).where("tier = 0").select("book_id", "chapter").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page in pieces no taller than its profile allows."""
    return split_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "profiles"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that came out in pieces, and whether a panel had to be cut."""
    return p4_pieces(spark, sf_dir).where("n_pieces > 1").groupBy("page_id").agg(F.max(F.col("forced").cast("int")).alias("forced"))


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series, title and entry name in its consistent form."""
    comics = canonical_fields(table(spark, sf_dir, "comicinfo"), "info_id", ("series", "title")).withColumnRenamed("info_id", "row_id")
    names = canonical_fields(table(spark, sf_dir, "entries"), "entry_id", ("name",)).withColumnRenamed("entry_id", "row_id")
    return comics.unionByName(names)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that the consistent form changes, without the garbled ones."""
    garbled = p2_found(spark, sf_dir).select("field_name", F.col("info_id").alias("row_id"))
    changed = p5_canonical(spark, sf_dir).where("changed").select("field_name", "row_id").distinct()
    return changed.join(garbled, ["field_name", "row_id"], "left_anti")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", token_ids(F.col("text")).alias("ids"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in its global order."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares by source."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document."""
    return split_sentences(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sentences end."""
    return p9_sentences(spark, sf_dir).select("doc_id", "end_pos").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p1_nearest": p1_nearest,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_tomes": p3_tomes,
    "p3_unused": p3_unused,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_canonical": p5_canonical,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_sentences": p9_sentences,
}

_P3_FOUND = """
WITH once AS (SELECT enc_id, any_value(book_id) AS book_id, any_value(chapter) AS chapter, any_value(profile) AS profile, any_value(n_bytes) AS n_bytes FROM encoded_pages GROUP BY enc_id),
sums AS (SELECT book_id, chapter, min(profile) AS code, sum(greatest(coalesce(n_bytes, 0), 0)) AS weight FROM once GROUP BY book_id, chapter)
SELECT book_id, chapter FROM sums JOIN profiles USING (code) WHERE weight > tome_bytes
"""

_P4_FOUND = """
WITH once AS (SELECT page_id, any_value(profile) AS profile, any_value(height) AS height, any_value(panels) AS panels FROM pages GROUP BY page_id),
tall AS (SELECT page_id, max_height, panels FROM once JOIN profiles ON profile = code WHERE once.height > max_height),
spans AS (SELECT page_id, max_height, p.top AS a, p.bottom AS b FROM (SELECT page_id, max_height, unnest(panels) AS p FROM tall) WHERE p.top < p.bottom),
marked AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY page_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM spans),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY page_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM marked),
long AS (SELECT DISTINCT page_id FROM (SELECT page_id, run FROM runs GROUP BY page_id, run HAVING max(b) - min(a) > min(max_height)))
SELECT page_id, CASE WHEN page_id IN (SELECT page_id FROM long) THEN 1 ELSE 0 END AS forced FROM tall
"""

ORACLE = {"p3_found": _P3_FOUND, "p4_found": _P4_FOUND}
